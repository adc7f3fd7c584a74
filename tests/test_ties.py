"""Values at a limit: the queries beside their SQL on small tables that have such values."""

import random
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import seasight.plans.frames  # noqa: F401  (registers its queries)
from seasight.operators import screening
from seasight.operators.quantiles import between
from seasight.plans.queries import QUERIES, SQL


def both(spark, path, name, events):
    """Rows of a query and of its SQL over a table of (event_id, user_id, event_type, value)."""
    pd.DataFrame(events, columns=["event_id", "user_id", "event_type", "value"]).to_parquet(path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    out = [p[sorted(p.columns)].sort_values(sorted(p.columns)).values.tolist() for p in (QUERIES[name](spark, str(path)).toPandas(), con.execute(SQL[name]).df())]
    return out


#: Its debris index is the fixed threshold itself, by the index's own rounding.
AT_THRESHOLD = (570732, 8084, "signup", 0.0)


def test_fixed_threshold_at_its_own_value(spark, tmp_path):
    got, want = both(spark, tmp_path, "fixed_vs_adaptive", [AT_THRESHOLD, (570733, 8084, "view", 50.0)])
    assert got == want


def test_mask_at_the_fixed_threshold(spark, tmp_path):
    got, want = both(spark, tmp_path, "masks", [AT_THRESHOLD, (570733, 8084, "view", 50.0)])
    assert got == want and [r[0] for r in got] == [False, True]


def tile(seed=1782):
    """A tile of 24 pixels with values equal but for the rounding of their index beside its threshold."""
    r = random.Random(seed)
    return [(e, r.randrange(21), "view", float(r.choice([30, 40, 50, 60, 70, 80, 85, 90, 95, 100, 100, 110]))) for e in range(1, 25)]


@pytest.mark.parametrize("name", ["scene_screened", "screen_summary", "screen_tiles", "screen_verdicts"])
def test_screening_of_values_beside_the_tiles_threshold(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, tile())
    assert got == want


@pytest.mark.parametrize("n, yes", [(160, 87), (160, 93), (1600, 34), (9600, 204), (9600, 972)])
def test_rates_halfway_between_two_roundings(spark, n, yes):
    """Shares of tiles that end in a five at the fifth digit, as the SQL's round_even has them."""
    tiles = spark.range(n).select((F.col("id") < yes).alias("accepted"), F.lit(0).cast("long").alias("candidate_pixels"))
    want = duckdb.connect().execute(f"SELECT round_even({yes} / {n}, 4), round_even(1 - {yes} / {n}, 4)").fetchone()
    assert screening.summary(tiles).select("accept_rate", "work_avoided").first()[:] == want


def test_between_rounds_as_the_sql_engine_does(spark):
    """lo * (1 - d) + hi * d, its first product exact; 2,000 draws, of which about one in seven is another number if both are rounded."""
    r = random.Random(3)
    rows = [(lo, lo + r.random() * r.choice([1, 1e-3, 1e-16]), r.random()) for lo in (r.uniform(-0.1, 0.1) for _ in range(2000))]
    got = [x[0] for x in spark.createDataFrame(rows, "lo double, hi double, d double").select(between(F.col("lo"), F.col("hi"), F.col("d"))).collect()]
    assert got == [lo if lo == hi else float(Fraction(lo) * Fraction(1 - d) + Fraction(hi * d)) for lo, hi, d in rows]
    odd = spark.createDataFrame([(0.0, float("inf"), 0.5), (1e308, 1.5e308, 0.5), (None, 1.0, 0.5)], "lo double, hi double, d double")
    assert [x[0] for x in odd.select(between(F.col("lo"), F.col("hi"), F.col("d"))).collect()] == [float("inf"), 1.25e308, None]


@pytest.mark.parametrize("seed", [7, 35])
def test_detector_at_its_limit(spark, tmp_path, seed):
    """63 pixels with data whose mean is the limit but for rounding; adding them up in another order gives the other side."""
    r = random.Random(seed)
    cents = [r.randrange(0, 11001) for _ in range(63)]
    cents[-1] += 5500 * 63 - sum(cents)
    at = [(y * 100 + x) for y in range(8) for x in range(8)]
    got, want = both(spark, tmp_path, "scene_detect", [(e, 1, "view", v / 100) for e, v in zip(at, [0, *cents])])
    assert got == want
