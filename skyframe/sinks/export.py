"""Splits as files: one COCO document each, image and proposal files copied beside it, all from the tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import proposal_name
from ..session import checkpointed, store_of

#: Bytes that are held of a file while it is copied or joined.
STEP = 4 << 20


def document_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame, by: str = "split") -> DataFrame:
    """(by, part, id, value): the lines of each split's document in order of part and id. Categories are those of every split.

    Rows follow one another by id; of rows that share an id each is a line. A split without annotations has an empty list.
    """
    def rows(df: DataFrame, part: int) -> DataFrame:
        body = F.to_json(F.struct(*(c for c in df.columns if c != by)))
        firsts = df.groupBy(by).agg(F.min("id").alias("_first"))  # one row a split
        return df.join(F.broadcast(firsts), by).select(by, F.lit(part).alias("part"), F.col("id").cast("long").alias("id"), F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), body).alias("value"))

    splits = images.select(by).unionByName(annotations.select(by)).distinct()
    frame = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(v).alias("value")) for p, v in ((0, '{"images": ['), (2, '], "annotations": ['), (4, '], "categories": ['), (6, "]}"))))
    marks = splits.select(by, F.inline(frame)).select(by, "part", F.lit(0).cast("long").alias("id"), "value")
    kinds = categories.crossJoin(F.broadcast(splits))  # a row a split and category
    return marks.unionByName(rows(images, 1)).unionByName(rows(annotations, 3)).unionByName(rows(kinds, 5))


def write_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, root: str, by: str = "split", name: str = "annotations.json") -> DataFrame:
    """Writes `root`/<split>/`name` for every split and returns (split, path, bytes).

    Lines are sorted in ranges and written as parts; each split's parts are then joined as streams by one task that holds `STEP` bytes at a
    time, so neither a task nor the driver holds a split. Ids that repeat within a table are an error.
    """
    clash = images.groupBy(by, "id").count().where("count > 1").select("id").unionByName(annotations.groupBy(by, "id").count().where("count > 1").select("id"))
    if not clash.isEmpty():
        raise ValueError("ids of a document are unique")
    if not name.endswith(".json"):
        raise ValueError("a COCO document's name ends in .json")
    parts = f"{root.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    lines = document_lines(images, annotations, categories, by)
    lines.repartitionByRange(by, "part", "id").sortWithinPartitions(by, "part", "id").select(by, "value").write.partitionBy(by).text(parts)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = store_of(root)
        held = store_of(parts)[1]
        for f in frames:
            out = []
            for split in f[by]:
                files = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{held}/{by}={split}")) if i.base_name.startswith("part-"))
                store.create_dir(f"{base}/{split}", recursive=True)
                size = 0
                with store.open_output_stream(f"{base}/{split}/{name}") as to:
                    for path in files:
                        with store.open_input_stream(path) as read:
                            while block := read.read(STEP):
                                to.write(block)
                                size += len(block)
                out.append((split, f"{root.rstrip('/')}/{split}/{name}", size))
            yield pd.DataFrame(out, columns=[by, "path", "bytes"])

    splits = images.select(F.col(by).cast("string").alias(by)).unionByName(annotations.select(F.col(by).cast("string").alias(by))).distinct()
    written = checkpointed(splits.repartition(by).mapInPandas(join, f"{by} string, path string, bytes long"))
    store, base = store_of(parts)
    store.delete_dir(base)
    return written


def copy_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Copies (file_name, folder) from `source` to `target`/folder, each in a task and in steps; returns them with `copied`, false where there is no such file."""

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        (store, base), (goal, to) = store_of(source), store_of(target)
        for f in frames:
            done = []
            for name, folder in zip(f["file_name"], f["folder"], strict=True):
                there = store.get_file_info(f"{base}/{name}").type == fs.FileType.File
                if there:
                    goal.create_dir(f"{to}/{folder}", recursive=True)
                    with store.open_input_stream(f"{base}/{name}") as read, goal.open_output_stream(f"{to}/{folder}/{name}") as out:
                        while block := read.read(STEP):
                            out.write(block)
                done.append(there)
            yield pd.DataFrame({"file_name": f["file_name"], "folder": f["folder"], "copied": done})

    return checkpointed(files.select("file_name", "folder").mapInPandas(copy, "file_name string, folder string, copied boolean"))


def export_splits(images: DataFrame, annotations: DataFrame, categories: DataFrame, root: str, image_root: str, proposal_root: str) -> dict[str, DataFrame]:
    """A folder for each split with its document, images and proposals: images(split, id, file_name, ...), annotations(split, ...).

    Returns the documents and the files with `copied`; a missing file is a row of false, as not every image has proposals.
    """
    named = images.select("file_name", "split")
    return {
        "documents": write_documents(images, annotations, categories, root),
        "images": copy_files(named.select("file_name", F.concat("split", F.lit("/images")).alias("folder")), image_root, root),
        "proposals": copy_files(named.select(proposal_name(F.col("file_name")).alias("file_name"), F.concat("split", F.lit("/proposals")).alias("folder")), proposal_root, root),
    }
