"""FITS files as DataFrames, read through Spark's own file listing so that any store works.

Files are parsed whole here, one a row; a file must fit a task (binary rows are limited to 2 GB). `fits_tables` reads larger ones by byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2880
_KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HDUS = "path string, idx int, header map<string,string>, bitpix int, naxis array<int>, data array<double>"


def _card(card: str) -> tuple[str, str] | None:
    key, rest = card[:8].strip(), card[10:]
    if not key or card[8:10] != "= ":
        return None
    if rest.lstrip().startswith("'"):
        text, i = rest.lstrip()[1:], 0
        while True:
            i = text.find("'", i)
            if i < 0 or text[i + 1 : i + 2] != "'":
                break
            i += 2
        return key, text[: i if i >= 0 else None].replace("''", "'").rstrip()
    return key, rest.partition("/")[0].strip()


def parse(content: bytes) -> Iterator[tuple[dict[str, str], int, list[int], bytes]]:
    """(header, bitpix, axes, raw data) of each unit."""
    at = 0
    while at + BLOCK <= len(content):
        header: dict[str, str] = {}
        ended = False
        while not ended and at + BLOCK <= len(content):
            for i in range(at, at + BLOCK, 80):
                card = content[i : i + 80].decode("ascii", "replace")
                if card[:8].strip() == "END":
                    ended = True
                    break
                if found := _card(card):
                    header[found[0]] = found[1]
            at += BLOCK
        if not ended:
            return
        bitpix, n = int(header.get("BITPIX", 8)), int(header.get("NAXIS", 0))
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(n)]
        size = abs(bitpix) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + int(np.prod(axes))) if n else 0
        yield header, bitpix, axes, content[at : at + size]
        at += -(-size // BLOCK) * BLOCK


def image(header: dict[str, str], bitpix: int, axes: list[int], raw: bytes) -> np.ndarray | None:
    """Scaled values in file order, or None for units that hold no image."""
    if not axes or header.get("XTENSION", "IMAGE") not in ("IMAGE", "IUEIMAGE"):
        return None
    return pixel_values(header, np.frombuffer(raw[: abs(bitpix) // 8 * int(np.prod(axes))], _KINDS[bitpix]))


def pixel_values(header: dict[str, str], stored: np.ndarray) -> np.ndarray:
    """Stored values as doubles: scaled, and NaN where whole numbers have the value of the BLANK card."""
    a = stored.astype(float) * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
    if "BLANK" in header and stored.dtype.kind in "iu":
        a[stored == int(header["BLANK"])] = np.nan
    return a


def read_hdus(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, header, bitpix, naxis, data) of every unit; data is null where a unit has no image."""

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = [(name, i, h, b, a, image(h, b, a, raw)) for i, (h, b, a, raw) in enumerate(parse(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "idx", "header", "bitpix", "naxis", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(units, HDUS)


def hdu_list(hdus: DataFrame) -> DataFrame:
    """(path, hdus) with the units in file order."""
    one = F.struct("idx", "header", "bitpix", "naxis", "data")
    in_order = lambda c: F.array_sort(c, lambda a, b: a["idx"] - b["idx"])  # noqa: E731  headers have no order of their own
    return hdus.groupBy("path").agg(in_order(F.collect_list(one)).alias("hdus"))


def header_of(idx: int, hdus: Column) -> Column:
    """Header of unit idx from 0, or from the end if idx is negative."""
    return F.element_at(hdus, idx + 1 if idx >= 0 else idx)["header"]


def data_of(idx: int, hdus: Column) -> Column:
    return F.element_at(hdus, idx + 1 if idx >= 0 else idx)["data"]


def rasters(hdus: DataFrame, idx: int = 0) -> DataFrame:
    """Packed rasters (path, header, h, w, data) of one unit of each file."""
    return hdus.where(F.col("idx") == idx).where("data IS NOT NULL").select("path", "header", F.element_at("naxis", 2).alias("h"), F.element_at("naxis", 1).alias("w"), "data")


def read_table(spark: SparkSession, path: str, schema: str, idx: int = 1) -> DataFrame:
    """Rows of a binary table by Spark's binary reader, so that any store works; only the columns of `schema` are decoded.

    Values are as `fits_tables.decoded` states them. A file is held whole; `fits_tables.read` reads byte ranges.
    """
    from .fits_tables import decoded, fields

    wanted = spark.createDataFrame([], schema).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for i, (header, _, axes, raw) in enumerate(parse(content.as_py())):
                    if i != idx or header.get("XTENSION") != "BINTABLE":
                        continue
                    stride, n = axes[0], axes[1]
                    heap = int(header.get("THEAP", stride * n))
                    for a in range(0, n, 10_000):
                        b = min(n, a + 10_000)
                        yield decoded(np.frombuffer(raw[a * stride : b * stride], np.uint8).reshape(b - a, stride), fields(header), wanted, lambda at, size, raw=raw, heap=heap: raw[heap + at : heap + at + size])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def to_bytes(data: np.ndarray, header: dict[str, str | float | int] | None = None) -> bytes:
    """A file with one primary image of doubles."""
    cards = ["SIMPLE  =                    T", f"BITPIX  = {-64:20d}", f"NAXIS   = {data.ndim:20d}"]
    cards += [f"NAXIS{i + 1:<3d}= {n:20d}" for i, n in enumerate(reversed(data.shape))]
    for k, v in (header or {}).items():
        if k not in ("SIMPLE", "BITPIX", "NAXIS", "END", "BSCALE", "BZERO") and not k.startswith("NAXIS"):
            try:
                cards.append(f"{k[:8]:<8}= {float(v):20.13G}")
            except ValueError:
                quoted = str(v).replace("'", "''")
                cards.append(f"{k[:8]:<8}= '{quoted}'")
    text = "".join(f"{c:<80}" for c in [*cards, "END"])
    body = data.astype(">f8").tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
