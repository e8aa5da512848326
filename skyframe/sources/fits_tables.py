"""FITS tables and images of any size as Spark data sources: headers are read first, then byte ranges, a range a task.

`read` gives a binary table's rows, `read_tiles` an image's tiles. Files lie where pyarrow's file systems reach them (local and shared folders, HDFS, object
stores); `fits.read_table` and `fits.read_hdus` read whole files through Spark from anywhere else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import store_of
from .fits import _KINDS, BLOCK, _card, pixel_values

#: Bytes of table rows, or of an image's rows, that a task reads.
RANGE = 32 << 20
#: Longest stretch of the heap that is read at once although its rows use little of it.
HEAP_SPAN = 8 << 20
# The type codes of binary-table columns, their stored form, bytes and type.
_STORED = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "u1", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8", "P": ">i4", "Q": ">i8"}
_BYTES = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
_TYPES = {"L": "boolean", "X": "boolean", "B": "smallint", "I": "smallint", "J": "int", "K": "bigint", "E": "float", "D": "double", "C": "array<float>", "M": "array<double>"}
_FORM = re.compile(r"(\d*)([LXBIJKAEDCMPQ])(?:([LXBIJKAEDCM])(?:\(\d*\))?)?")


@dataclass(frozen=True)
class Field:
    """A column: its place and bytes in a row, how many elements of which code, and its scale, zero and null value."""

    name: str
    at: int
    size: int
    n: int
    code: str
    held: str  # code of the elements: of the heap's for P and Q
    scale: float
    zero: float
    null: int | None

    @property
    def kind(self) -> str:
        """The column's Spark type."""
        if self.held == "A":
            return "string"
        one = _TYPES[self.held]
        if self.held in "BIJK" and (self.scale, self.zero) != (1, 0):
            whole = self.scale == 1 and self.zero == int(self.zero)
            one = ("decimal(20,0)" if self.held == "K" else "bigint") if whole else "double"
        elif self.held in "ED" and (self.scale, self.zero) != (1, 0):
            one = "double"
        return f"array<{one}>" if self.code in "PQX" or self.n != 1 else one


def fields(header: dict[str, str]) -> list[Field]:
    out, at = [], 0
    for c in range(1, int(header["TFIELDS"]) + 1):
        form = _FORM.match(header[f"TFORM{c}"].strip())
        if not form:
            raise ValueError(f"TFORM{c} = {header[f'TFORM{c}']!r}")
        n, code = int(form[1] or 1), form[2]
        size = -(-n // 8) if code == "X" else n * _BYTES[code]
        null = header.get(f"TNULL{c}")
        out.append(Field(header.get(f"TTYPE{c}", f"col{c}"), at, size, n, code, form[3] if code in "PQ" else code, float(header.get(f"TSCAL{c}", 1)), float(header.get(f"TZERO{c}", 0)), int(null) if null else None))
        at += size
    return out


def _elements(f: Field, raw: np.ndarray) -> list:
    """Values of bytes that hold elements of the field's code, one after another; None for nulls."""
    if f.held == "L":
        return [{84: True, 70: False}.get(b) for b in raw.tolist()]
    v = np.ascontiguousarray(raw).view(_STORED[f.held])
    if f.held in "CM":
        return v.astype(float).reshape(-1, 2).tolist()
    if f.held in "ED":
        return (v.astype(float) * f.scale + f.zero if (f.scale, f.zero) != (1, 0) else v.astype(float)).tolist()
    plain = v.tolist()
    if (f.scale, f.zero) == (1, 0):
        values = plain
    elif f.scale == 1 and f.zero == int(f.zero):
        values = [Decimal(x + int(f.zero)) if f.held == "K" else x + int(f.zero) for x in plain]
    else:
        values = (v.astype(float) * f.scale + f.zero).tolist()
    return values if f.null is None else [None if x == f.null else y for x, y in zip(plain, values, strict=True)]


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace").rstrip()


def _column(f: Field, cells: np.ndarray, heap: Callable[[int, int], bytes]) -> list:
    if f.code in "PQ":
        places = np.ascontiguousarray(cells).view(_STORED[f.code]).reshape(-1, 2).astype(np.int64)
        sizes = [-(-n // 8) if f.held == "X" else n * _BYTES[f.held] for n in places[:, 0].tolist()]
        starts = places[:, 1].tolist()
        ends = [a + s for a, s in zip(starts, sizes, strict=True) if s]
        low, high = min((a for a, s in zip(starts, sizes, strict=True) if s), default=0), max(ends, default=0)
        whole = heap(low, high - low) if high - low <= max(HEAP_SPAN, 2 * sum(sizes)) else None
        read = (lambda a, s: whole[a - low : a - low + s]) if whole is not None else heap
        parts = [read(a, s) if s else b"" for a, s in zip(starts, sizes, strict=True)]
        if f.held == "A":
            return [_text(p) for p in parts]
        if f.held == "X":
            return [np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool).tolist() for p, n in zip(parts, places[:, 0].tolist(), strict=True)]
        return [_elements(f, np.frombuffer(p, np.uint8)) for p in parts]
    if f.code == "A":
        return [_text(c.tobytes()) for c in cells]
    if f.code == "X":
        return np.unpackbits(cells, axis=1, count=f.n).astype(bool).tolist()
    if f.n == 0:
        return [[] for _ in cells]
    flat = _elements(f, cells.reshape(-1))
    return flat if f.n == 1 else [flat[k : k + f.n] for k in range(0, len(flat), f.n)]


def decoded(rows: np.ndarray, known: list[Field], schema: StructType, heap: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """The schema's columns of some rows (bytes, rows x stride); `heap(at, size)` gives bytes of the heap. Other columns aren't looked at.

    Logical values are booleans, null if neither true nor false; bits are arrays of booleans; complex numbers are pairs; whole numbers equal to
    TNULL are null and are scaled by TSCAL and TZERO (whole zeros, as of unsigned numbers, keep them whole); P and Q columns are arrays from
    the heap. Text ends at a zero byte and loses trailing spaces. NaN stays NaN.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    by_name = {f.name: f for f in known}
    if lost := [n for n in schema.names if n not in by_name]:
        raise ValueError(f"no columns {lost}")
    shape = to_arrow_schema(schema)
    cells = lambda f: rows[:, f.at : f.at + f.size]
    return pa.RecordBatch.from_arrays([pa.array(_column(f, cells(f), heap), shape.field(f.name).type, from_pandas=False) for f in (by_name[n] for n in schema.names)], schema=shape)


def units(file) -> Iterator[tuple[dict[str, str], int, int]]:
    """(header, first data byte, data bytes) of each unit of an open file; reads headers only."""
    size, at = file.size(), 0
    while at + BLOCK <= size:
        header: dict[str, str] = {}
        ended = False
        while not ended and at + BLOCK <= size:
            block = file.read_at(BLOCK, at)
            at += BLOCK
            for i in range(0, BLOCK, 80):
                card = block[i : i + 80].decode("ascii", "replace")
                if card[:8].strip() == "END":
                    ended = True
                    break
                if found := _card(card):
                    header[found[0]] = found[1]
        if not ended:
            return
        n = int(header.get("NAXIS", 0))
        count = int(np.prod([int(header[f"NAXIS{i + 1}"]) for i in range(n)], dtype=object)) if n else 0
        bytes_ = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + count) if n else 0
        yield header, at, bytes_
        at += -(-bytes_ // BLOCK) * BLOCK


def _files(path: str) -> list[str]:
    """The file, or the .fits files below the folder, by name."""
    from pyarrow import fs

    store, base = store_of(path)
    if store.get_file_info(base).type == fs.FileType.File:
        return [base]
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and i.base_name.lower().endswith((".fits", ".fit")))


@dataclass
class Range(InputPartition):
    """Rows [first, last) of a unit: what a task reads."""

    path: str
    header: dict[str, str]
    at: int
    first: int
    last: int


def chosen(options: dict[str, str], default: int) -> Iterator[tuple[str, dict[str, str], int]]:
    """(path, header, first data byte) of the wanted unit of each file; the driver reads headers up to it."""
    store, _ = store_of(options["path"])
    for path in _files(options["path"]):
        with store.open_input_file(path) as file:
            for i, (header, at, _) in enumerate(units(file)):
                if i == int(options.get("hdu", default)):
                    yield path, header, at
                    break


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.root, self.schema = dict(options), options["path"], schema
        self.range, self.tile = int(options.get("range", RANGE)), int(options.get("tile", 512))


class _TableReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for path, header, at in chosen(self.options, 1):
            if header.get("XTENSION") == "BINTABLE":
                stride, n = int(header["NAXIS1"]), int(header["NAXIS2"])
                step = max(1, self.range // max(1, stride))
                out += [Range(path, header, at, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [Range("", {}, 0, 0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        stride, heap = int(p.header["NAXIS1"]), p.at + int(p.header.get("THEAP", int(p.header["NAXIS1"]) * int(p.header["NAXIS2"])))
        known = fields(p.header)
        with store_of(self.root)[0].open_input_file(p.path) as file:
            for a in range(p.first, p.last, 10_000):
                n = min(p.last, a + 10_000) - a
                rows = np.frombuffer(file.read_at(n * stride, p.at + a * stride), np.uint8).reshape(n, stride)
                yield decoded(rows, known, self.schema, lambda at, size: file.read_at(size, heap + at))


class FitsTable(DataSource):
    """Rows of a binary table. Options: path, hdu (1), range (bytes of rows a task reads). A schema that names some columns reads these only."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        for _, header, _ in chosen(self.options, 1):
            if header.get("XTENSION") == "BINTABLE":
                return ", ".join(f"`{f.name}` {f.kind}" for f in fields(header))
        raise ValueError("no binary table there")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options, schema)


class _TileReader(_Reader):
    def partitions(self) -> list[Range]:
        """A range for each row of tiles, so a task holds `tile` rows of the image."""
        out = []
        for path, header, at in chosen(self.options, 0):
            if int(header.get("NAXIS", 0)) >= 2 and header.get("XTENSION", "IMAGE") == "IMAGE":
                h = int(header["NAXIS2"])
                out += [Range(path, header, at, a, min(h, a + self.tile)) for a in range(0, h, self.tile)]
        return out or [Range("", {}, 0, 0, 0)]

    def read(self, p: Range) -> Iterator[tuple]:
        if not p.path:
            return
        kind, w = np.dtype(_KINDS[int(p.header["BITPIX"])]), int(p.header["NAXIS1"])
        with store_of(self.root)[0].open_input_file(p.path) as file:
            raw = file.read_at((p.last - p.first) * w * kind.itemsize, p.at + p.first * w * kind.itemsize)
        a = pixel_values(p.header, np.frombuffer(raw, kind)).reshape(-1, w)
        for x in range(0, w, self.tile):
            part = a[:, x : x + self.tile]
            yield p.path, x, p.first, part.shape[0], part.shape[1], part.ravel().tolist()


class FitsTiles(DataSource):
    """Tiles (path, x0, y0, h, w, data) of an image's first plane. Options: path, hdu (0), tile (512)."""

    @classmethod
    def name(cls) -> str:
        return "fits_tiles"

    def schema(self) -> str:
        return "path string, x0 int, y0 int, h int, w int, data array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TileReader(self.options, schema)


def read(spark: SparkSession, path: str, schema: str | None = None, hdu: int = 1, range_bytes: int = RANGE) -> DataFrame:
    """A binary table's rows; `schema` names the columns to decode, all without it."""
    spark.dataSource.register(FitsTable)
    r = spark.read.format("fits_table").option("hdu", hdu).option("range", range_bytes)
    return (r.schema(schema) if schema else r).load(path)


def read_tiles(spark: SparkSession, path: str, tile: int = 512, hdu: int = 0) -> DataFrame:
    """An image's tiles, as `mosaics` takes them (its raster key is `path`)."""
    spark.dataSource.register(FitsTiles)
    return spark.read.format("fits_tiles").option("hdu", hdu).option("tile", tile).load(path)
