"""Regions of whole scenes against flood fill, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasight.operators import regions, screening

KIND = "image long, r long, c long, candidate boolean, v double"


def flood(mask, connectivity):
    """(first_r, first_c, xmin, ymin, xmax, ymax, n) of every region."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    seen, out = set(), set()
    for p in zip(*map(list, (x.tolist() for x in np.nonzero(mask)))):
        if p in seen:
            continue
        seen.add(p)
        todo, all_ = [p], [p]
        while todo:
            r, c = todo.pop()
            for y, x in steps:
                q = (r + y, c + x)
                if q not in seen and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]:
                    seen.add(q)
                    todo.append(q)
                    all_.append(q)
        rs, cs = [q[0] for q in all_], [q[1] for q in all_]
        out.add((*p, min(cs), min(rs), max(cs) + 1, max(rs) + 1, len(all_)))
    return out


def spiral(n):
    m, r, c, step, d = np.zeros((n, n), bool), 0, 0, n, 0
    m[0, :] = True
    r, c = 0, n - 1
    moves = [(1, 0), (0, -1), (-1, 0), (0, 1)]
    step = n - 1
    while step > 0:
        for _ in range(2):
            for _ in range(step):
                r, c = r + moves[d][0], c + moves[d][1]
                m[r, c] = True
            d = (d + 1) % 4
        step -= 2
    return m


def masks():
    g = np.random.default_rng(5)
    yield from (g.random((13, 17)) < share for share in (0.4, 0.55))
    yield spiral(12)
    yield np.ones((9, 9), bool)


@pytest.mark.parametrize(("connectivity", "block"), [(4, 5), (8, 4)])
def test_scene_regions_are_those_of_flood_fill(spark, connectivity, block):
    every = list(masks())
    cells = [(i, r, c, bool(m[r, c]), 0.0) for i, m in enumerate(every) for r in range(m.shape[0]) for c in range(m.shape[1])]
    out = regions.scene_regions(spark.createDataFrame(cells, KIND), connectivity=connectivity, least=1, block=block).collect()
    for i, m in enumerate(every):
        got = [tuple(x[1:]) for x in out if x["image"] == i]
        assert set(got) == flood(m, connectivity) and len(got) == len(set(got))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_of_a_block(connectivity):
    for m in masks():
        r, c = np.nonzero(m)
        k = regions.labels(r, c - 7, connectivity)  # also left of zero
        got = {(int(r[i]), int(c[i]), int(c[k == i].min()), int(r[k == i].min()), int(c[k == i].max()) + 1, int(r[k == i].max()) + 1, int((k == i).sum())) for i in set(k.tolist())}
        assert got == flood(m, connectivity)
    assert len(regions.labels(np.zeros(0, int), np.zeros(0, int))) == 0


def test_edges_of_regions(spark):
    """Empty tables, NULLs, repeats, places below zero, images of NULL and clashing columns."""
    assert regions.scene_regions(spark.createDataFrame([], KIND)).count() == 0
    cells = [(1, -1, -1, True, 0.2), (1, 0, 0, True, 0.9), (1, 0, 0, True, None), (1, 0, 1, None, 5.0), (1, None, 2, True, 7.0), (None, 0, 0, True, None), (None, 0, 1, True, None), (2, 0, 0, False, 1.0)]
    px = spark.createDataFrame(cells, KIND).withColumns({"node": F.lit(1), "k": F.lit("x"), "root": F.lit(0), "region": F.lit(2)})
    out = {tuple(x) for x in regions.scene_regions(px, least=1, score="v", block=4).collect()}
    assert out == {(1, -1, -1, -1, -1, 1, 1, 2, 0.9), (None, 0, 0, 0, 0, 2, 1, 2, None)}
    assert {x["n_pixels"] for x in regions.scene_regions(px, connectivity=4, least=1, block=4).collect()} == {1, 2}
    with pytest.raises(ValueError):
        regions.scene_regions(px, connectivity=6)


def test_components_of_a_chain(spark):
    """A long chain in random order, a star and loops."""
    g = np.random.default_rng(1)
    names = g.permutation(200).tolist()
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(500, 500 + i) for i in range(40)] + [(900, 900)]
    out = {r["node"]: r["root"] for r in regions.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(200)}, **{500 + i: 500 for i in range(40)}}


def test_boxes_of_scores(spark):
    """A patch over a block's border is one box at its largest score; land, cloud and NULL scores are out."""
    rows = []
    for r in range(12):
        for c in range(12):
            hot = 3 <= r < 5 and 2 <= c < 7
            rows.append((1, r, c, 0.05, 0.2 if r == 9 else 0.01, 9 if r == 11 else 6, 0.9 if r in (9, 11) else 0.75 + c / 100 if hot else None if c == 0 else 0.1))
    px = spark.createDataFrame(rows, "image long, r long, c long, green double, nir double, scl int, p double")
    out = regions.scored_boxes(px, "p", 0.736, "sargassum", block=4).collect()
    assert [tuple(x)[1:] for x in out] == [(1, "sargassum", 0.81, 2.0, 3.0, 7.0, 5.0)]
    p = spark.sql("SELECT array(0.2D, 0.3D, 0.5D) AS proba")
    of = lambda *w: p.select(regions.class_score("proba", ["a", "b", "c"], w)).first()[0]
    assert (of("a", "c", "z"), of("z")) == (0.7, 0.0)


def test_tiles_cut_regions(spark):
    cells = [(0, c // 3, 0, c, True) for c in range(6)]
    px = spark.createDataFrame(cells + cells[:2], "tr long, tc long, r long, c long, candidate boolean")
    assert {tuple(x) for x in screening.regions(px, least=3).collect()} == {(0, 0, 0, 0, 3, 1, 3), (0, 1, 3, 0, 6, 1, 3)}
