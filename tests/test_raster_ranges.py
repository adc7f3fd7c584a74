"""Raster files by byte ranges: windows against whole arrays, and what is read for them."""

import struct
import zlib

import numpy as np
import pytest

from seasight.sources import rasters


def tiff(bands, side=16, deflate=True, apart=True, spoil=()):
    """A tiled file of 16-bit bands; the tiles of the places in ``spoil`` hold no pixels that can be read."""
    n, h, w = bands.shape
    body, starts, sizes, i = b"", [], [], 0
    for group in [bands[k : k + 1] for k in range(n)] if apart else [bands]:
        for y in range(0, h, side):
            for x in range(0, w, side):
                part = np.zeros((side, side, len(group)), "<u2")
                cut = group[:, y : y + side, x : x + side]
                part[: cut.shape[1], : cut.shape[2]] = cut.transpose(1, 2, 0)
                raw = zlib.compress(part.tobytes()) if deflate else part.tobytes()
                raw = b"\xff" * len(raw) if i in spoil else raw
                starts, sizes, body, i = [*starts, 8 + len(body)], [*sizes, len(raw)], body + raw + b"\0" * (len(raw) % 2), i + 1
    at = 8 + len(body)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16] * n), (259, 3, [8 if deflate else 1]), (277, 3, [n]), (284, 3, [2 if apart else 1]), (322, 4, [side]), (323, 4, [side]), (324, 4, starts), (325, 4, sizes), (339, 3, [1] * n)]
    head, extra, where = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        packed = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(v), *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", where + len(extra)))
        extra += packed if len(packed) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + head + struct.pack("<I", 0) + extra


BANDS = np.random.default_rng(2).integers(0, 60000, (2, 50, 70)).astype("<u2")


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize(("most", "piece"), [(1024, 1 << 22), (24, 200)])
def test_pieces_are_the_array(monkeypatch, deflate, apart, most, piece):
    """Any window, also with stretches that cut tiles, pieces of few rows, and ends outside the file."""
    monkeypatch.setattr(rasters, "MOST", most)
    monkeypatch.setattr(rasters, "PIECE", piece)
    t = rasters.Tiff(tiff(BANDS, deflate=deflate, apart=apart))
    assert (t.array() == BANDS).all()
    for window in [(0, 0, 70, 50), (17, 5, 30, 21), (69, 49, 9, 9), (-4, -4, 10, 10)]:
        seen = np.zeros(BANDS.shape, int)
        for p in t.pieces(*window):
            at = (slice(None) if p[0] < 0 else slice(p[0], p[0] + 1), slice(p[1], p[2]), slice(p[3], p[4]))
            assert p[4] - p[3] <= most and (t.read(p) == BANDS[at]).all()
            seen[at] += 1
        x, y, w, h = window
        want = np.zeros(BANDS.shape, int)
        want[:, max(y, 0) : y + h, max(x, 0) : x + w] = 1
        assert (seen == want).all()
    assert not list(t.pieces(70, 0, 5, 5)) and not list(t.pieces(0, 0, 0, 5))


def test_a_window_reads_its_tiles_only(spark, tmp_path):
    """All other tiles are spoilt; a file is several tasks' work; bands that aren't asked for aren't read."""
    across = 5
    mine = {y * across + x for y in (1, 2) for x in (2, 3)}
    (tmp_path / "a.tif").write_bytes(tiff(BANDS, spoil=set(range(2 * 20)) - mine))
    path, window = f"file://{tmp_path}/a.tif", (40, 20, 20, 25)
    todo = rasters.pieces(spark, path, window, ["band1"]).collect()
    sizes = rasters.Tiff((tmp_path / "a.tif").read_bytes()).tags[rasters.TILE_BYTES]
    assert sum(len(p["tiles"]) for p in todo) == 4 and sum(p["bytes"] for p in todo) == sum(sizes[i] for i in mine)
    out = np.full((25, 20), -1.0)
    for r in rasters.read_rows(spark, path, window, ["band1"]).collect():
        assert r["band"] == "band1"
        out[r["r"], r["c0"] : r["c0"] + len(r["values"])] = r["values"]
    assert (out == BANDS[0, 20:45, 40:60]).all()
    with pytest.raises(Exception, match="zlib|decompress"):
        rasters.read_rows(spark, path).count()
    assert rasters.read_rows(spark, path, (500, 500, 5, 5)).count() == 0
    assert rasters.profiles(spark, path).first()["names"] == ["band1", "band2"]


def test_a_file_is_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(rasters.encode({"B03": BANDS[0], "B08": BANDS[1]}))
    rows = rasters.read_rows(spark, f"file://{tmp_path}/a.tif")
    back = {(r["band"], r["r"]): r["values"] for r in rows.collect()}
    assert len(back) == 100 and all(back[b, r] == BANDS[i, r].tolist() for i, b in enumerate(("B03", "B08")) for r in range(50))
    assert rows.rdd.getNumPartitions() >= 4
