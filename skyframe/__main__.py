"""python -m skyframe train|search|split: the three plans over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import coco
from .plans import datasets
from .session import session
from .sinks import export, images
from .sources import coco_json
from .sources.catalogue import Settings


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m skyframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "search"):
        p = commands.add_parser(name)
        p.add_argument("--cutouts", required=True, help="Parquet: image_id, ra, dec, h, w, data, header")
        p.add_argument("--catalogue", required=True, help="Parquet: ra, dec, source, component")
        p.add_argument("--settings", help="YAML file; defaults without it")
        p.add_argument("--out", required=True)
    p = commands.add_parser("split")
    p.add_argument("--document", required=True, help="COCO JSON")
    p.add_argument("--images", required=True, help="folder of image files")
    p.add_argument("--proposals", required=True, help="folder of proposal files")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out", required=True)
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = session(f"skyframe {a.command}")
    if a.command == "split":
        pictures, annotations, categories = coco_json.read(spark, a.document)
        out = datasets.split_dataset(pictures, annotations, seed=a.seed)
        held = pictures.join(out["members"], "id")
        done = export.export_splits(held, out["annotations"], categories, a.out, a.images, a.proposals)
        images.write_statistics(out["summary"], f"{a.out}/summary")
        images.write_statistics(out["components"], f"{a.out}/components")
        for r in done["documents"].orderBy("split").collect():  # a row a split
            print(r["path"], r["bytes"])
        return
    s = Settings.from_yaml(a.settings) if a.settings else Settings()
    cutouts, catalogue = spark.read.parquet(a.cutouts), spark.read.parquet(a.catalogue)
    plan = datasets.training_from_catalogue if a.command == "train" else datasets.search_from_catalogue
    out = plan(cutouts, catalogue, s)
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    pictures, regions = spark.read.parquet(f"{a.out}/images"), spark.read.parquet(f"{a.out}/proposals")
    named = pictures.select("id", export.proposal_name(F.col("file_name")).alias("file_name"))
    images.write_files(images.npz_proposals(regions, "id").join(named, "id"), f"{a.out}/proposal_files")
    annotations = spark.read.parquet(f"{a.out}/annotations") if "annotations" in out else spark.createDataFrame([], "id long, image_id long")
    export.write_documents(pictures.withColumn("split", F.lit("all")), annotations.withColumn("split", F.lit("all")), coco.categories(spark), a.out)


if __name__ == "__main__":
    main()
