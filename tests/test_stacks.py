"""Bands on one grid by stretches, against loops over pixels; running counts beside rows without a score."""

import numpy as np
import pytest

from seasight.operators import curves, stacks

KIND = "path string, band string, r long, c0 long, values array<double>"


def rows_of(band, a, most=7, path="f"):
    return [(path, band, r, c0, [None if np.isnan(v) else float(v) for v in a[r, c0 : c0 + most]]) for r in range(len(a)) for c0 in range(0, a.shape[1], most)]


def grid(rows, path="f"):
    h, w = max(r["r"] for r in rows) + 1, max(r["c0"] + len(r["values"]) for r in rows)
    out = np.full((h, w), np.inf)
    for r in rows:
        if r["path"] == path:
            assert np.isinf(out[r["r"], r["c0"] : r["c0"] + len(r["values"])]).all()  # each pixel once
            out[r["r"], r["c0"] : r["c0"] + len(r["values"])] = [np.nan if v is None else v for v in r["values"]]
    return out


def brute(a, k, method):
    h, w = a.shape
    if method in ("average", "mode"):
        by = round(1 / k)
        out = np.full((-(-h // by), -(-w // by)), np.nan)
        for i in range(out.shape[0]):
            for j in range(out.shape[1]):
                v = [x for x in a[i * by : (i + 1) * by, j * by : (j + 1) * by].ravel().tolist() if x == x]
                if v:
                    out[i, j] = sum(v) / len(v) if method == "average" else min(set(v), key=lambda x: (-v.count(x), x))
        return out
    out = np.full((int(np.ceil(h * k)), int(np.ceil(w * k))), np.nan)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            y, x = (i + 0.5) / k, (j + 0.5) / k
            if method == "nearest":
                out[i, j] = a[min(int(y), h - 1), min(int(x), w - 1)]
                continue
            y, x = min(max(y - 0.5, 0), h - 1), min(max(x - 0.5, 0), w - 1)
            s = n = 0.0
            for r in {int(y), min(int(y) + 1, h - 1)}:
                for c in {int(x), min(int(x) + 1, w - 1)}:
                    wt = (1 - abs(y - r)) * (1 - abs(x - c))
                    if a[r, c] == a[r, c] and wt > 0:
                        s, n = s + wt * a[r, c], n + wt
            out[i, j] = s / n if n else np.nan
    return out


@pytest.mark.parametrize(("own", "gsd", "method"), [(20, 10, "nearest"), (20, 10, "bilinear"), (60, 10, "bilinear"), (10, 20, "average"), (10, 30, "mode"), (25, 10, "bilinear"), (20, 10, "average")])
@pytest.mark.parametrize("block", [3, 64])
def test_resampled_rows_are_those_of_loops(spark, own, gsd, method, block):
    """Also with holes, short stretches, odd sizes, and blocks of few rows."""
    r = np.random.default_rng(3)
    a = r.integers(0, 4, (13, 17)).astype(float) if method == "mode" else r.normal(size=(13, 17))
    a[r.random(a.shape) < 0.2] = np.nan
    df = spark.createDataFrame(rows_of("b", a) + rows_of("b", a[:, ::-1].copy(), 5, "g"), KIND).repartition(4)
    got = stacks.resample(df, own, gsd, method, block, most=6).collect()
    how = "nearest" if method == "average" and own > gsd else method
    np.testing.assert_allclose(grid(got), brute(a, own / gsd, how), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(grid(got, "g"), brute(a[:, ::-1], own / gsd, how), rtol=1e-12, atol=1e-12)


def test_missing_rows_have_no_data(spark):
    a = np.arange(40.0).reshape(8, 5)
    df = spark.createDataFrame([x for x in rows_of("b", a) if x[2] not in (3, 4)], KIND)
    a[3:5] = np.nan
    for method in ("nearest", "bilinear"):
        got = grid(stacks.resample(df, 20, 10, method, 2).collect())
        np.testing.assert_allclose(np.where(np.isinf(got), np.nan, got), brute(a, 2.0, method))
    with pytest.raises(ValueError):
        stacks.resample(df, 20, 10, "cubic")


def test_a_stack_of_bands(spark):
    """Bands of three pixel sizes and a layer of classes as one pixel table; none of it is joined by pixels."""
    r = np.random.default_rng(5)
    fine, mid, scl, tiny = r.normal(size=(12, 16)), r.normal(size=(6, 8)), r.integers(0, 9, (6, 8)).astype(float), r.normal(size=(24, 32))
    df = spark.createDataFrame(rows_of("B03", fine) + rows_of("B11", mid) + rows_of("SCL", scl) + rows_of("pan", tiny), KIND)
    rows = stacks.stack(df, {"B03": 10, "B11": 20, "SCL": 20, "pan": 5}, 10)
    whole = stacks.resample(rows, 10, 10, "nearest")  # in stretches that are cut alike
    got = stacks.pixels(whole, ["B03", "B11", "SCL", "pan"]).collect()
    assert len(got) == 12 * 16
    want = {"B03": fine, "B11": brute(mid, 2.0, "bilinear"), "SCL": brute(scl, 2.0, "nearest"), "pan": brute(tiny, 0.5, "average")}
    for x in got:
        for b, a in want.items():
            assert x[b] == pytest.approx(a[x["r"], x["c"]])
    with pytest.raises(ValueError):
        stacks.stack(df, {}, 10)


def test_rows_without_a_score_are_above_no_threshold(spark):
    x = spark.createDataFrame([(1, 1, 0.9), (2, 1, None), (3, 0, 0.1)], "id long, pos int, score double")
    assert sorted(map(tuple, curves.running(x).collect())) == [(0.1, 1, 2, 2), (0.9, 1, 1, 2)]
    assert curves.best_threshold(x).first()["recall"] == 0.5
