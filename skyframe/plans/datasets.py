"""The training, search and split plans, each one chain of operators.

Inputs: cutouts(image_id, ra, dec, h, w, data) and components(image_id, skey, seg_ord, ord, x, y); or, from the sky, cutouts with their
header and a catalogue(ra, dec, source, component), which are joined to components first; these are read many times and so written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stretch
from ..operators import coco, geometry, grg, kernels, pixels, proposals, quality, segment, sky, split
from ..session import checkpointed
from ..sources.catalogue import Settings

KEY, VIEW = "image_id", "view_id"


def _views(df: DataFrame) -> DataFrame:
    return df.withColumn(VIEW, F.concat_ws("/", F.col(KEY).cast("string"), F.col("angle_index").cast("string")))


def augmented(cutouts: DataFrame, components: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(rasters, points) of every image and angle, keyed by view_id."""
    size, crop = s.cutout_size, s.crop_size
    turned = _views(kernels.rotated_rasters(cutouts, s.angles, (crop, crop), key=KEY))
    points = _views(geometry.rotate_points(components, s.angles, size, size, crop, crop))
    return turned, points


def training(cutouts: DataFrame, components: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """images, annotations, proposals, encoded pixels, cleaned points and scores of a training set.

    Images and annotations are those that cleaning leaves, with cleaned positions; scores are of the set before it.
    """
    level, crop = s.nr_sigmas * s.rms, s.crop_size
    whole = kernels.label_components(cutouts, level, KEY)
    central = grg.find_central(components, whole, KEY, s.cutout_size, s.cutout_size).select(KEY, F.col("skey").alias("central"))
    turned, points = augmented(cutouts, components.join(central, KEY).withColumn("grg", F.col("skey") == F.col("central")), s)
    turned = turned.join(central.select(KEY), KEY, "left_semi")
    labels = kernels.label_components(turned, level, VIEW)
    own = segment.segment_islands(points.where("grg"), labels, VIEW).select(VIEW, "island_id").distinct()
    mask = labels.join(own, [VIEW, "island_id"], "left_semi")
    boxes = mask.groupBy(VIEW).agg(*pixels.box_columns(), F.count("*").cast("double").alias("area"))
    samples = turned.select(VIEW, KEY, "angle_index", "angle").join(boxes, VIEW)
    samples = coco.origin_ids(coco.sample_ids(samples, [KEY, "angle_index"], KEY), KEY)
    named = samples.join(cutouts.select(KEY, "ra", "dec"), KEY)
    all_islands = segment.segment_islands(points, labels, VIEW).select(VIEW, "island_id").distinct()
    regions = proposals.subsets(proposals.island_properties(labels.join(all_islands, [VIEW, "island_id"], "left_semi"), VIEW), VIEW, s.max_islands)
    cleaned = quality.clean(points, mask, VIEW)
    positions = quality.cleaned_positions(cleaned, VIEW)
    outlined = samples.join(positions.select(VIEW), VIEW, "left_semi").join(coco.segmentations(mask, VIEW, crop, crop, s.segmentation), VIEW)
    metadata = F.struct(
        F.col("ra").alias("RA"), F.col("dec").alias("DEC"), "grg_positions", "all_component_positions", (F.col("angle") != 0).alias("rotated"), "origin_id", F.col("angle").alias("rotation_angle"),
        F.lit("asinh" if s.asinh else "sqrt").alias("stretch"), F.lit(False).alias("reprojected"), F.lit(None).cast("double").alias("old_redshift"), F.lit(None).cast("double").alias("new_redshift"),
    )
    described = named.join(positions, VIEW).withColumn("metadata", metadata).withColumnRenamed("angle", "rotation_angle")
    encode = stretch.rgb_encode(F.col("v"), s.rms, s.asinh)
    return {
        "images": coco.image_rows(described, crop, crop, "GRG"),
        "annotations": coco.annotation_rows(outlined.select("id", F.col("id").alias("image_id"), "xmin", "ymin", "xmax", "ymax", "area", "segmentation")),
        "proposals": regions.join(samples.select(VIEW, "id"), VIEW),
        "pixels": pixels.explode_pixels(turned, VIEW).select(VIEW, "x", "y", *(c.alias(n) for c, n in zip(encode, "rgb", strict=True))),
        "cleaned": cleaned,
        "metrics": quality.metrics(quality.judge(points, mask, VIEW)),
    }


def training_from_catalogue(cutouts: DataFrame, catalogue: DataFrame, s: Settings, source: str = "source", component: str = "component") -> dict[str, DataFrame]:
    """`training` with the catalogue's rows that each cutout shows, grouped to objects by their parent source."""
    return training(cutouts, checkpointed(sky.cutout_components(catalogue, cutouts, source, component, KEY)), s)


def search_from_catalogue(cutouts: DataFrame, catalogue: DataFrame, s: Settings, component: str = "component") -> dict[str, DataFrame]:
    """`search` with the catalogue's rows that each cutout shows, every one an object of its own."""
    return search(cutouts, checkpointed(sky.cutout_components(catalogue, cutouts, None, component, KEY)), s)


def search(cutouts: DataFrame, components: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """images and proposals of a search set: every component is an object of its own, images without proposals go."""
    labels = kernels.label_components(cutouts, s.nr_sigmas * s.rms, KEY)
    held = components.join(labels, [KEY, "x", "y"]).select(KEY, "island_id").distinct()
    regions = proposals.subsets(proposals.island_properties(labels.join(held, [KEY, "island_id"], "left_semi"), KEY), KEY, s.max_islands)
    kept = cutouts.join(regions.select(KEY), KEY, "left_semi").select(KEY, "ra", "dec")
    positions = components.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "skey", F.col("x").cast("string"), F.col("y").cast("string")).alias("k"), F.struct("x", "y").alias("v")))).alias("positions"))
    rows = coco.sample_ids(kept.join(positions, KEY), [KEY], KEY)
    rows = rows.withColumn("metadata", F.struct(F.col("ra").alias("RA"), F.col("dec").alias("DEC"), "positions", F.lit("asinh" if s.asinh else "sqrt").alias("stretch")))
    return {"images": coco.image_rows(rows, s.crop_size, s.crop_size, "Search"), "proposals": regions.join(rows.select(KEY, "id"), KEY)}


def split_dataset(images: DataFrame, annotations: DataFrame, splits: dict[str, float] = split.SPLITS, seed: int = 42) -> dict[str, DataFrame]:
    """members (split, id), annotations with their split, the summary and the component distribution, from COCO tables."""
    flat = images.select("id", F.col("metadata.origin_id").alias("origin_id"), F.col("metadata.rotated").alias("rotated"), F.size("metadata.grg_positions").alias("component_count"))
    counts = flat.select(F.col("id").alias("image_id"), "component_count")
    good = annotations.where("bbox IS NOT NULL")
    chosen = split.stratified(split.eligible(flat, good, counts), splits, seed)
    members = split.with_rotations(chosen, flat)
    return {
        "members": members, "annotations": annotations.join(members.select(F.col("id").alias("image_id"), "split"), "image_id"),
        "summary": split.summary(members, annotations), "components": split.component_pivot(chosen, list(splits)),
    }
