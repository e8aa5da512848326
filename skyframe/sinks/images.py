"""Image and array files as binary columns, and their writer."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fits import to_bytes


def png(a: np.ndarray) -> bytes:
    """An H x W x 3 or H x W array of uint8 or uint16 as a PNG."""
    h, w = a.shape[:2]
    rows = a.astype(">u2" if a.dtype.itemsize == 2 else "u1").reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8 * a.dtype.itemsize, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def quantised(planes: np.ndarray, per_image: bool = True) -> np.ndarray:
    """C x H x W values to H x W x C of uint16, each plane over its own range or clipped to [0, 1]; truncated."""
    if per_image:
        low, high = planes.min((1, 2), keepdims=True), planes.max((1, 2), keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            planes = np.where(high - low <= 1e-8, 0.0, (planes - low) / (high - low))
    return (np.clip(planes, 0, 1) * 65535).astype(np.uint16).transpose(1, 2, 0)


def _column(rasters: DataFrame, key: str, name: str, make) -> DataFrame:
    """(key, name): `make` of each raster's array; rasters hold h, w and data, planes one after another."""

    def files(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], name: [make(np.asarray(d, float).reshape(-1, h, w)) for d, h, w in zip(f["data"], f["h"], f["w"], strict=True)]})

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "h", "w", "data").mapInPandas(files, f"{key} {kind}, {name} binary")


def png16(rasters: DataFrame, key: str, per_image: bool = True) -> DataFrame:
    return _column(rasters, key, "content", lambda a: png(quantised(a, per_image)))


def png8(rasters: DataFrame, key: str) -> DataFrame:
    """The first three planes cast to bytes without scaling."""
    return _column(rasters, key, "content", lambda a: png(a[:3].astype(np.uint8).transpose(1, 2, 0)))


def npy(rasters: DataFrame, key: str) -> DataFrame:
    def saved(a: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, a[0] if len(a) == 1 else a)
        return out.getvalue()

    return _column(rasters, key, "content", saved)


def fits(rasters: DataFrame, key: str) -> DataFrame:
    return _column(rasters, key, "content", lambda a: to_bytes(a[0] if len(a) == 1 else a))


def npz_proposals(proposals: DataFrame, key: str) -> DataFrame:
    """(key, content): boxes and scores of a key's proposals as a compressed archive; keys without proposals have none."""
    held = proposals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("size", "members", "xmin", "ymin", "xmax", "ymax", "score"))).alias("p"))

    def archive(frames):
        for f in frames:
            out = []
            for rows in f["p"]:
                data = io.BytesIO()
                np.savez_compressed(data, boxes=np.array([[r["xmin"], r["ymin"], r["xmax"], r["ymax"]] for r in rows], np.float32), scores=np.array([r["score"] for r in rows], np.float32))
                out.append(data.getvalue())
            yield pd.DataFrame({key: f[key], "content": out})

    kind = proposals.schema[key].dataType.simpleString()
    return held.mapInPandas(archive, f"{key} {kind}, content binary")


def write_files(files: DataFrame, root: str) -> None:
    """Writes (file_name, content) rows below `root`, from the tasks; `root` is a store that every executor reaches."""

    def write(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r['file_name']}") as out:
                out.write(bytes(r["content"]))

    files.select("file_name", "content").foreachPartition(write)


def write_statistics(df: DataFrame, path: str) -> None:
    """A small table (a row per split or stratum) as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
