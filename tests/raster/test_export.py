"""Documents and files of splits, proposal archives read back, statistics, the command line."""

from __future__ import annotations

import csv
import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.__main__ import arguments, main
from skyframe.operators import coco
from skyframe.sinks import export, images
from skyframe.sources import coco_json, proposal_files


def tables(spark, n: int = 40):
    rows = spark.range(n).select("id", (F.col("id") % 3).alias("k")).withColumn("split", F.when(F.col("k") == 0, "train").when(F.col("k") == 1, "val").otherwise("test"))
    meta = F.expr("named_struct('RA', 1.5D, 'DEC', 2.0D, 'grg_positions', array(array(1, 2)), 'all_component_positions', array(array(1, 2)), 'rotated', false, 'origin_id', id, 'rotation_angle', 0.0D, 'stretch', 'sqrt', 'reprojected', false, 'old_redshift', CAST(NULL AS DOUBLE), 'new_redshift', CAST(NULL AS DOUBLE))")
    pictures = rows.select("id", F.concat(F.lit("g_"), "id", F.lit('.png')).alias("file_name"), F.lit(3).alias("width"), F.lit(4).alias("height"), meta.alias("metadata"), "split")
    boxes = rows.where("id % 2 = 0 AND split <> 'val'").select("id", F.col("id").alias("image_id"), F.lit(0).alias("xmin"), F.lit(1).alias("ymin"), F.lit(2).alias("xmax"), F.lit(3).alias("ymax"), F.lit(4.0).alias("area"))
    return pictures, coco.annotation_rows(boxes).join(rows.select("id", "split"), "id")


def test_each_split_has_its_document(spark, tmp_path, monkeypatch):
    """Joined from several parts in steps of few bytes; read back equal; a split without annotations has an empty list."""
    monkeypatch.setattr(export, "STEP", 100)
    pictures, annotations = tables(spark)
    done = {r.split: r for r in export.write_documents(pictures, annotations, coco.categories(spark), str(tmp_path)).collect()}
    assert set(done) == {"train", "val", "test"} and not glob.glob(str(tmp_path / ".parts*"))
    for split, r in done.items():
        text = open(r.path).read()
        doc = json.loads(text)
        assert len(text.encode()) == r.bytes
        want = sorted(x.id for x in pictures.where(F.col("split") == split).collect())
        assert [i["id"] for i in doc["images"]] == want and "split" not in doc["images"][0]
        assert [a["id"] for a in doc["annotations"]] == ([] if split == "val" else [i for i in want if i % 2 == 0])
        assert [c["name"] for c in doc["categories"]] == ["GRG"]
        back, boxes, _ = coco_json.read(spark, r.path)
        assert sorted(map(str, back.collect())) == sorted(map(str, pictures.where(F.col("split") == split).drop("split").collect()))
        assert boxes.count() == len(doc["annotations"])


def test_ids_of_a_document_are_unique(spark, tmp_path):
    pictures, annotations = tables(spark, 6)
    with pytest.raises(ValueError):
        export.write_documents(pictures.unionByName(pictures), annotations, coco.categories(spark), str(tmp_path))
    with pytest.raises(ValueError):
        export.write_documents(pictures, annotations, coco.categories(spark), str(tmp_path), name="a.txt")


def test_files_follow_their_split(spark, tmp_path):
    pictures, annotations = tables(spark, 7)
    for folder, kind in (("png", "png"), ("npz", "npz")):
        (tmp_path / folder).mkdir()
        for i in range(7 if kind == "png" else 4):
            (tmp_path / folder / f"g_{i}.{kind}").write_bytes(bytes([i]) * 10)
    out = export.export_splits(pictures, annotations, coco.categories(spark), str(tmp_path / "out"), str(tmp_path / "png"), str(tmp_path / "npz"))
    assert {(r.file_name, r.folder) for r in out["images"].where("copied").collect()} == {(f"g_{i}.png", f"{['train', 'val', 'test'][i % 3]}/images") for i in range(7)}
    assert {r.file_name for r in out["proposals"].where("NOT copied").collect()} == {"g_4.npz", "g_5.npz", "g_6.npz"}
    assert (tmp_path / "out/val/images/g_1.png").read_bytes() == b"\1" * 10 and (tmp_path / "out/train/proposals/g_3.npz").exists() and not (tmp_path / "out/val/proposals/g_4.npz").exists()


def test_proposals_come_back_from_their_files(spark, tmp_path):
    rows = [(k, s, [s], s, s + 1, s + 5, s + 7 + k, 0.25 * s) for k in range(3) for s in range(1, 3 + k)]
    regions = spark.createDataFrame(rows, "id long, size int, members array<int>, xmin int, ymin int, xmax int, ymax int, score double")
    pictures = spark.createDataFrame([(k, f"g_{k}.png") for k in range(5)], "id long, file_name string")
    files = images.npz_proposals(regions, "id").join(pictures, "id").select(F.replace("file_name", F.lit(".png"), F.lit(".npz")).alias("file_name"), "content")
    images.write_files(files, str(tmp_path))
    with np.load(tmp_path / "g_1.npz") as a:
        assert a["boxes"].dtype == np.float32 and a["boxes"].shape == (3, 4) and a["scores"].tolist() == [0.25, 0.5, 0.75]
    (tmp_path / "g_3.npz").write_bytes(b"no archive")
    back = proposal_files.read(spark, str(tmp_path))
    joined = proposal_files.of_images(pictures, back).where("error IS NULL")
    assert {(r.image_id, r.xmin, r.ymin, r.xmax, r.ymax, r.score) for r in joined.collect()} == {(k, x, y, a, b, s) for k, _, _, x, y, a, b, s in rows}
    assert [r.n for r in joined.where("image_id = 2").orderBy("n").collect()] == [0, 1, 2, 3]
    assert [r.file_name for r in back.where("error IS NOT NULL").collect()] == ["g_3.npz"]
    assert [r.id for r in proposal_files.missing(pictures, back).collect()] == [4]


def test_statistics_and_tables(spark, tmp_path):
    pictures, annotations = tables(spark, 9)
    images.write_statistics(pictures.groupBy("split").count().orderBy("split"), str(tmp_path / "s"))
    (path,) = glob.glob(str(tmp_path / "s" / "part-*.csv"))
    assert list(csv.reader(open(path))) == [["split", "count"], ["test", "3"], ["train", "3"], ["val", "3"]]
    coco_json.write_tables(pictures, annotations, str(tmp_path / "t"), by="split")
    assert spark.read.parquet(str(tmp_path / "t/images/split=val")).count() == 3
    assert spark.read.parquet(str(tmp_path / "t/annotations")).count() == annotations.count()


def test_command_line():
    a = arguments(["split", "--document", "d.json", "--images", "i", "--proposals", "p", "--out", "o"])
    assert a.command == "split" and a.seed == 42
    assert arguments(["train", "--cutouts", "c", "--catalogue", "k", "--out", "o"]).settings is None
    with pytest.raises(SystemExit):
        arguments(["search", "--out", "o"])


def test_splits_from_the_command_line(spark, tmp_path):
    pictures, annotations = (df.drop("split").withColumn("split", F.lit("all")) for df in tables(spark, 60))
    export.write_documents(pictures, annotations, coco.categories(spark), str(tmp_path))
    for folder in ("png", "npz"):
        (tmp_path / folder).mkdir()
    for i in range(60):
        (tmp_path / "png" / f"g_{i}.png").write_bytes(b"x")
    main(["split", "--document", str(tmp_path / "all/annotations.json"), "--images", str(tmp_path / "png"), "--proposals", str(tmp_path / "npz"), "--out", str(tmp_path / "out")])
    docs = {k: json.load(open(tmp_path / "out" / k / "annotations.json")) for k in ("train", "val", "test")}
    assert {k: len(d["images"]) for k, d in docs.items()} == {"train": 14, "val": 3, "test": 3}
    for k, d in docs.items():
        assert {i["file_name"] for i in d["images"]} == {p.name for p in (tmp_path / "out" / k / "images").iterdir()}
        assert {a["image_id"] for a in d["annotations"]} == {i["id"] for i in d["images"]}
