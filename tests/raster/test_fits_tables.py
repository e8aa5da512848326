"""FITS tables of every column kind and images by byte ranges."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest

from skyframe.operators import kernels, mosaics
from skyframe.sources import fits, fits_tables


def unit(cards: list[str], body: bytes) -> bytes:
    head = "".join(f"{c:<80}" for c in [*cards, "END"])
    pad = lambda b, fill: b.ljust(-(-len(b) // 2880) * 2880, fill)
    return pad(head.encode(), b" ") + pad(body, b"\0")


def table_file(n: int) -> tuple[bytes, list[dict]]:
    """A file with one column of each kind, and its rows."""
    forms = [("flag", "L"), ("bits", "11X"), ("small", "B"), ("short", "I"), ("unsigned", "I"), ("whole", "J"), ("scaled", "J"), ("big", "K"), ("huge", "K"), ("name", "6A"), ("f", "E"), ("d", "D"), ("pair", "3I"), ("c", "C"), ("m", "2M"), ("list", "PJ(9)"), ("text", "QA(9)"), ("floats", "QE(4)"), ("none", "0J")]
    extra = {"TNULL4": -1, "TZERO5": 32768, "TSCAL7": 0.5, "TZERO7": 10, "TNULL7": 7, "TZERO9": 2**63, "TNULL13": -2}
    body, heap, rows = b"", b"", []
    for i in range(n):
        bits = [(i >> k) & 1 == 1 for k in range(11)]
        items, floats = [i * k for k in range(i % 4)], [0.5 * i] * (i % 3)
        places = []
        for part in (np.array(items, ">i4").tobytes(), f"t{i}".encode(), np.array(floats, ">f4").tobytes()):
            places.append(len(heap))
            heap += part
        body += [b"T", b"F", b"\0"][i % 3] + np.packbits(bits).tobytes() + bytes([i % 256]) + np.array([-1 if i % 5 == 0 else i, i - 32768], ">i2").tobytes() + np.array([-i, i], ">i4").tobytes() + np.array([i << 40, i - 2**63], ">i8").tobytes()
        body += f"n{i}".encode().ljust(6) + np.array([i / 4], ">f4").tobytes() + np.array([math.nan if i == 1 else i / 3], ">f8").tobytes() + np.array([i, -2, i + 1], ">i2").tobytes()
        body += np.array([i, -i], ">f4").tobytes() + np.array([i, 1, 2, i], ">f8").tobytes()
        body += np.array([len(items), places[0]], ">i4").tobytes() + np.array([len(f"t{i}"), places[1]], ">i8").tobytes() + np.array([len(floats), places[2]], ">i8").tobytes()
        rows.append({
            "flag": [True, False, None][i % 3], "bits": bits, "small": i % 256, "short": None if i % 5 == 0 else i, "unsigned": i, "whole": -i, "scaled": None if i == 7 else 0.5 * i + 10, "big": i << 40, "huge": Decimal(i), "name": f"n{i}",
            "f": i / 4, "d": math.nan if i == 1 else i / 3, "pair": [i, None, i + 1], "c": [float(i), float(-i)], "m": [[float(i), 1.0], [2.0, float(i)]], "list": items, "text": f"t{i}", "floats": floats, "none": [],
        })
    stride = len(body) // n if n else 0
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {stride}", f"NAXIS2  = {n}", f"PCOUNT  = {len(heap)}", "GCOUNT  = 1", f"TFIELDS = {len(forms)}"]
    cards += [f"{k:<8}= {v}" for i, (name, form) in enumerate(forms, 1) for k, v in ((f"TTYPE{i}", f"'{name}'"), (f"TFORM{i}", f"'{form}'"))] + [f"{k:<8}= {v}" for k, v in extra.items()]
    return fits.to_bytes(np.zeros((1, 1))) + unit(cards, body + heap), rows


def same(got, want) -> bool:
    if isinstance(want, float) and math.isnan(want):
        return isinstance(got, float) and math.isnan(got)
    return got == want and type(got) is type(want) if not isinstance(want, list) else len(got) == len(want) and all(map(same, got, want))


@pytest.mark.parametrize("span", [fits_tables.HEAP_SPAN, 0])
def test_every_kind_of_column(spark, tmp_path, monkeypatch, span):
    content, rows = table_file(60)
    (tmp_path / "t.fits").write_bytes(content)
    monkeypatch.setattr(fits_tables, "HEAP_SPAN", span)
    df = fits_tables.read(spark, str(tmp_path / "t.fits"), range_bytes=1500)
    assert df.rdd.getNumPartitions() > 3
    got = {r.whole: r.asDict() for r in df.collect()}
    assert len(got) == 60
    for want in rows:
        for name, value in want.items():
            assert same(got[want["whole"]][name], value), (name, value, got[want["whole"]][name])
    whole = fits.read_table(spark, str(tmp_path / "t.fits"), df.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))


def test_some_columns_of_several_files(spark, tmp_path):
    for k, n in enumerate((3, 5)):
        (tmp_path / f"{k}.fits").write_bytes(table_file(n)[0])
    (tmp_path / "image.fits").write_bytes(fits.to_bytes(np.zeros((2, 2))))
    df = fits_tables.read(spark, str(tmp_path), "whole int, list array<int>")
    assert sorted((r.whole, r.list) for r in df.collect()) == sorted((-i, [i * k for k in range(i % 4)]) for n in (3, 5) for i in range(n))
    with pytest.raises(Exception, match="no columns"):
        fits_tables.read(spark, str(tmp_path), "nothing int").collect()


def test_blank_pixels_are_nan(spark, tmp_path):
    cards = ["SIMPLE  = T", "BITPIX  = 16", "NAXIS   = 2", "NAXIS1  = 3", "NAXIS2  = 1", "BLANK   = -9", "BSCALE  = 2", "BZERO   = 1"]
    (tmp_path / "b.fits").write_bytes(unit(cards, np.array([4, -9, 5], ">i2").tobytes()))
    for data in (fits.read_hdus(spark, str(tmp_path / "b.fits")).first().data, fits_tables.read_tiles(spark, str(tmp_path / "b.fits")).first().data):
        assert data[0] == 9.0 and data[2] == 11.0 and (data[1] is None or math.isnan(data[1]))


def test_an_image_is_read_and_labelled_by_tiles(spark, tmp_path):
    a = np.random.default_rng(3).random((45, 38))
    (tmp_path / "i.fits").write_bytes(fits.to_bytes(a))
    tiles = fits_tables.read_tiles(spark, str(tmp_path / "i.fits"), 16)
    assert tiles.rdd.getNumPartitions() == 3
    back = np.zeros_like(a)
    for t in tiles.collect():
        back[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.array(t.data).reshape(t.h, t.w)
    assert (back == a).all()
    got = {(r.x, r.y): r.island_id for r in mosaics.label_tiles(tiles, 0.5, 16, "path").collect()}
    i, island = kernels.label_runs(a >= 0.5)
    assert got == {(int(k % 38), int(k // 38)): int(v) for k, v in zip(i, island, strict=True)}
