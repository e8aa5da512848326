"""Sky joins, mosaics in tiles, polygon masks, exact apertures and redshift sweeps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import aperture, coco, kernels, mosaics, pixels, polygons, reproject, sky
from skyframe.plans import datasets
from skyframe.sources.catalogue import Settings


def angle(a1, d1, a2, d2):
    u, v = (np.array([np.cos(np.radians(d)) * np.cos(np.radians(a)), np.cos(np.radians(d)) * np.sin(np.radians(a)), np.sin(np.radians(d))]) for a, d in ((a1, d1), (a2, d2)))
    return math.degrees(2 * math.asin(min(1.0, np.linalg.norm(u - v) / 2)))


@pytest.mark.parametrize("height", [0.7, 3.0, 40.0, 180.0])
def test_pairs_within_an_angle_equal_brute_force(spark, height):
    """Poles, right ascension 0 and 360, positions outside [0, 360), circles over a pole, a radius of each row's own."""
    rng = np.random.default_rng(11)
    left = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(-20, 380, 150), np.degrees(np.arcsin(rng.uniform(-1, 1, 150))), strict=True))]
    left += [(200, 0.0, 0.0), (201, 360.0, 0.0), (202, 359.99, 0.01), (203, 12.0, 90.0), (204, 200.0, -90.0), (205, 180.0, 89.2), (206, 90.0, -89.4), (207, None, 5.0), (208, 5.0, None), (209, 5.0, 91.0)]
    right = [(0, 0.005, 0.0, 0.02), (1, 359.9, 0.1, 3.0), (2, 77.0, 89.0, 2.5), (3, 300.0, -89.0, 1.7), (4, 10.0, 45.0, 20.0), (5, 123.0, -33.0, 95.0), (6, 0.0, 90.0, 0.9)]
    a = spark.createDataFrame(left, "i int, ra double, dec double")
    b = spark.createDataFrame(right, "j int, ra0 double, dec0 double, radius double")
    got = {(r.i, r.j) for r in sky.within(a, b, "radius", height).select("i", "j").collect()}
    good = [(i, ra, dec) for i, ra, dec in left if ra is not None and dec is not None and abs(dec) <= 90]
    want = {(i, j) for i, ra, dec in good for j, ra0, dec0, r in right if angle(ra, dec, ra0, dec0) <= r}
    assert got == want and {j for _, j in want} >= {0, 1, 2, 3, 4, 5, 6}


def headers():
    base = {"CRVAL1": "359.8", "CRVAL2": "61.5", "CRPIX1": "40.0", "CRPIX2": "-12.0"}
    return [
        base | {"CTYPE1": "RA---TAN", "CDELT1": "-0.01", "CDELT2": "0.01"},
        base | {"CTYPE1": "RA---SIN", "CDELT1": "-0.01", "CDELT2": "0.012", "CROTA2": "33"},
        base | {"CD1_1": "-0.008", "CD1_2": "0.002", "CD2_1": "0.003", "CD2_2": "0.009"},
        base | {"CTYPE1": "RA---TAN", "CDELT1": "-0.02", "CDELT2": "0.02", "PC1_1": "0.8", "PC1_2": "-0.6", "PC2_1": "0.6", "PC2_2": "0.8"},
        base | {"CTYPE1": "RA---SIN", "CRVAL2": "89.99", "CDELT1": "-0.01", "CDELT2": "0.01"},
    ]


def test_projections_go_there_and_back(spark):
    rows = [(k, h, float(x), float(y)) for k, h in enumerate(headers()) for x in (-5, 0, 39, 80.25) for y in (-13, 0, 17.5, 100)]
    df = spark.createDataFrame(rows, "k int, header map<string,string>, px double, py double").withColumn("w", sky.wcs(F.col("header")))
    ra, dec = sky.to_sky(F.col("px"), F.col("py"), F.col("w"))
    df = df.withColumns({"ra": ra, "dec": dec})
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), F.col("w"))
    for r in df.withColumns({"x": x, "y": y}).collect():
        assert abs(r.x - r.px) < 1e-6 and abs(r.y - r.py) < 1e-6 and 0 <= r.ra < 360
    middle = df.where("px = 39 AND py = -13").collect()
    assert all(abs(r.ra - 359.8) < 1e-9 and abs(r.dec - float(r.header["CRVAL2"])) < 1e-9 for r in middle)
    back = spark.createDataFrame([(179.8, -61.5)], "ra double, dec double").withColumn("w", sky.wcs(F.create_map(*(F.lit(c) for p in headers()[0].items() for c in p))))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), F.col("w"))
    assert back.select(x, y).first() == (None, None)


def test_tangent_plane_by_hand(spark):
    """At the reference declination 0, x grows as -tan(ra - ra0) and y as tan(dec)."""
    header = {"CTYPE1": "RA---TAN", "CRVAL1": "0", "CRVAL2": "0", "CRPIX1": "1", "CRPIX2": "1", "CDELT1": "-0.5", "CDELT2": "0.5"}
    df = spark.createDataFrame([(358.0, 0.0), (0.0, 3.0)], "ra double, dec double").withColumn("w", sky.wcs(F.create_map(*(F.lit(c) for p in header.items() for c in p))))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), F.col("w"))
    a, b = (tuple(r) for r in df.select(x, y).collect())
    assert np.allclose(a, (math.degrees(math.tan(math.radians(2))) / 0.5, 0)) and np.allclose(b, (0, math.degrees(math.tan(math.radians(3))) / 0.5))


def sky_tables(spark):
    header = {"CTYPE1": "RA---TAN", "CRPIX1": "21", "CRPIX2": "21", "CDELT1": "-0.01", "CDELT2": "0.01"}
    cutouts = spark.createDataFrame([(k, ra, dec, 41, 41, [0.0] * 1681, header | {"CRVAL1": str(ra), "CRVAL2": str(dec)}) for k, (ra, dec) in enumerate([(0.0, 0.0), (100.0, 89.0), (250.0, -89.0)])], "image_id int, ra double, dec double, h int, w int, data array<double>, header map<string,string>")
    rows = [(1, "A", 359.9, 0.05), (2, "A", 0.1, -0.05), (3, "B", 0.0, 0.1), (4, None, 0.15, 0.15), (5, "C", 100.0, 89.1), (6, "C", 95.0, 88.95), (7, "D", 250.0, -89.15), (8, "A", 180.0, 0.0), (9, "E", None, 0.0)]
    return cutouts, spark.createDataFrame(rows, "component int, source string, ra double, dec double")


def test_catalogue_rows_become_components(spark):
    cutouts, catalogue = sky_tables(spark)
    got = {(r.image_id, r.skey, r.seg_ord, r.ord): (r.x, r.y) for r in sky.cutout_components(catalogue, cutouts, "source", "component").collect()}
    assert set(got) == {(0, "4", 0, 4), (0, "A", 1, 1), (0, "A", 1, 2), (0, "B", 2, 3), (1, "C", 0, 5), (1, "C", 0, 6), (2, "D", 0, 7)}
    assert got[0, "A", 1, 1] == (30, 25) and got[0, "A", 1, 2] == (10, 15) and got[1, "C", 0, 5] == (20, 30) and got[2, "D", 0, 7] == (20, 5)
    alone = sky.cutout_components(catalogue, cutouts, None, "component")
    assert {(r.image_id, r.skey) for r in alone.collect()} == {(0, "1"), (0, "2"), (0, "3"), (0, "4"), (1, "5"), (1, "6"), (2, "7")}
    assert sky.cutout_components(catalogue.limit(0), cutouts, "source", "component").count() == 0
    assert sky.cutout_components(catalogue, cutouts.limit(0), "source", "component").count() == 0


def test_objects_are_summed_components(spark):
    cutouts, catalogue = sky_tables(spark)
    for source in ("source", None):
        one = sky.cutout_components(catalogue, cutouts, source, "component").groupBy("image_id", "skey", "seg_ord").agg(F.count("*").alias("n"), *pixels.box_columns())
        got = sky.cutout_objects(catalogue, cutouts, source, "component").select(*one.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect())) and got.count() >= 5
    assert sky.cutout_objects(catalogue, cutouts.limit(0), "source", "component").count() == 0


def test_pairs_of_a_catalogue_are_cheap(spark):
    """Headers are read once a cutout, not once for each use in a filter below (3.6 million characters before), and pairs need no trigonometry."""
    from skyframe import queries
    from tests.conftest import DATA

    plan = queries.sky_cutout_join(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
    join = plan[: plan.index("isnotnull(cell")].split("\n")
    assert not any(f in line for line in join if " Join " in line or line.startswith(("Project", "+- Filter")) for f in ("SIN(", "COS(", "ASIN(", "POWER("))


def test_cutouts_copied_to_cells_are_never_broadcast(spark):
    """Spark sizes the cutouts without their copies (77 a cutout here), so a table below the broadcast threshold filled the driver's memory."""
    from skyframe import queries
    from tests.conftest import DATA

    plan = queries.sky_cutout_join(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_objects_are_summed_where_pairs_arise(spark):
    """No pair and no object is sent: the one exchange after the copies to patches is the last one, and only counts of patches go to every task."""
    from skyframe import queries
    from tests.conftest import DATA

    plan = queries.sky_objects(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("BroadcastExchange") <= 2


def test_objects_of_many_sizes_blocks_and_parts(spark, monkeypatch):
    """Crowded and lonely cutouts of unlike sizes, a pole, a null key; blocks of few rows, parts of few cutouts, objects longer than a block."""
    rng = np.random.default_rng(8)
    header = lambda ra, dec, step, kind: {"CTYPE1": kind, "CRVAL1": str(ra), "CRVAL2": str(dec), "CRPIX1": "11", "CRPIX2": "11", "CDELT1": str(-step), "CDELT2": str(step)}
    places = [(0.1 * k, 0.05 * k, 0.01, "RA---TAN") for k in range(12)] + [(40.0 * k, 89.9 - 0.02 * k, 0.02, "RA---SIN") for k in range(5)] + [(10.0, 5.0, 1.5, "RA---TAN"), (200.0, -3.0, 9.0, "RA---SIN"), (300.0, 10.0, 0.0, "RA---TAN")]
    cutouts = spark.createDataFrame([(k or None, 21, 21, header(*p)) for k, p in enumerate(places)], "image_id int, w int, h int, header map<string,string>")
    at = list(zip(rng.uniform(-0.2, 1.3, 900), rng.uniform(-0.2, 0.8, 900), strict=True)) + list(zip(rng.uniform(0, 360, 300), rng.uniform(89.5, 90, 300), strict=True)) + list(zip(rng.uniform(0, 360, 400), rng.uniform(-90, 90, 400), strict=True))
    names = ["one"] * 300 + [None if k % 7 == 0 else f"{k % 40}" for k in range(len(at) - 300)]
    rows = [(None if k == 350 else k, n, float(a), float(d)) for k, (n, (a, d)) in enumerate(zip(names, at, strict=True))]
    catalogue = spark.createDataFrame(rows, "component int, source string, ra double, dec double")
    one = sky.cutout_components(catalogue, cutouts, "source", "component").groupBy("image_id", "skey", "seg_ord").agg(F.count("*").alias("n"), *pixels.box_columns())
    want = sorted(map(str, one.collect()))
    assert len(want) > 300
    for together, block, out, sent in ((512, 1 << 14, 1 << 16, 1 << 20), (3, 50, 20, 0)):
        for name, value in zip(("TOGETHER", "BLOCK", "OUT", "SENT_CUTOUTS"), (together, block, out, sent), strict=True):
            monkeypatch.setattr(sky, name, value)
        got = sky.cutout_objects(catalogue, cutouts, "source", "component").select(*one.columns)
        assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("size", [40, 41])
def test_pixels_on_the_edge_are_kept(spark, size):
    """Places within half a pixel of the first and the last one, for even and odd sizes; an image without pixels."""
    header = {"CTYPE1": "RA---SIN", "CRVAL1": "0", "CRVAL2": "0", "CRPIX1": "1", "CRPIX2": "1", "CDELT1": str(math.degrees(0.01)), "CDELT2": str(math.degrees(0.01))}
    cutouts = spark.createDataFrame([(0, size, size, header), (1, 0, size, header)], "image_id int, w int, h int, header map<string,string>")
    at = [(i, math.degrees(math.asin(0.01 * x))) for i, x in enumerate((-0.51, -0.49, size - 1.0, size - 0.51, size - 0.49))]
    got = sky.catalogue_pixels(spark.createDataFrame([(i, ra, 0.0) for i, ra in at], "i int, ra double, dec double"), cutouts)
    assert sorted(map(tuple, got.select("image_id", "i", "x", "y").collect())) == [(0, 1, 0, 0), (0, 2, size - 1, 0), (0, 3, size - 1, 0)]


def test_pixels_of_pairs_equal_the_projection(spark):
    rng = np.random.default_rng(5)
    cutouts = spark.createDataFrame([(k, 90, 70, h) for k, h in enumerate(headers())] + [(9, 90, 70, headers()[0] | {"CDELT1": "0"})], "image_id int, w int, h int, header map<string,string>")
    rows = [(i, float(a % 360), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(355, 365, 400), rng.uniform(60, 64, 400), strict=True))] + [(1000 + i, 3.6 * i, 89.5 + 0.004 * i) for i in range(100)]
    catalogue = spark.createDataFrame(rows, "i int, ra double, dec double")
    all_pairs = catalogue.crossJoin(cutouts.where("image_id < 9").withColumn("wcs", sky.wcs(F.col("header"))))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), F.col("wcs"))
    inside = F.col("x").between(0, F.col("w") - 1) & F.col("y").between(0, F.col("h") - 1)
    want = all_pairs.withColumns({"x": F.rint(x), "y": F.rint(y)}).where(inside).select("i", "image_id", F.col("x").cast("int"), F.col("y").cast("int"))
    got = sky.catalogue_pixels(catalogue, cutouts).select("i", "image_id", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r.image_id for r in got.collect()} == {0, 1, 2, 3, 4}


def test_plans_take_a_catalogue(spark):
    cutouts, catalogue = sky_tables(spark)
    y, x = np.mgrid[:41, :41]
    bright = np.where((x > 8) & (x < 34) & (abs(y - 20) < 7), 1.0, 0.0).ravel().tolist()
    cutouts = cutouts.withColumn("data", F.lit(bright))
    s = Settings(cutout_size=41, crop_size=29, nr_sigmas=3, rms=0.1, angles=[0.0, 90.0], max_islands=4)
    components = spark.createDataFrame(sky.cutout_components(catalogue, cutouts, "source", "component").collect(), "image_id int, skey string, ord int, x int, y int, seg_ord int")
    by_hand, by_sky = (p["images"].collect() for p in (datasets.training(cutouts, components, s), datasets.training_from_catalogue(cutouts, catalogue, s)))
    assert sorted(map(str, by_hand)) == sorted(map(str, by_sky)) and by_sky
    found = datasets.search_from_catalogue(cutouts, catalogue, s)["images"].select("metadata.positions").collect()
    assert {k.split("/")[0] for r in found for k in r.positions} == {"1", "2", "3", "4", "5", "6"}  # an image without proposals goes


# --- mosaics


@pytest.mark.parametrize("size", [4, 7, 50])
def test_tiles_are_labelled_as_the_whole(spark, size):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(3):
        a = rng.random((23, 31))
        a[rng.random(a.shape) < 0.05] = np.nan
        if k == 2:  # a snake through all tiles
            a[:] = 0
            a[::2] = 1
            a[1::4, -1] = 1
            a[3::4, 0] = 1
        rows.append((k, 23, 31, a.ravel().tolist()))
    rasters = spark.createDataFrame(rows, "raster_id int, h int, w int, data array<double>")
    whole = sorted(map(tuple, kernels.label_components(rasters, 0.45).select("raster_id", "x", "y", "island_id").collect()))
    tiles = mosaics.cut_tiles(rasters, size)
    assert tiles.select(F.max(F.size("data"))).first()[0] <= size * size
    got = sorted(map(tuple, mosaics.label_tiles(tiles, 0.45, size).select("raster_id", "x", "y", "island_id").collect()))
    assert got == whole and len({r[3] for r in whole if r[0] == 2}) == 1
    assert mosaics.label_tiles(tiles.limit(0), 0.45, size).count() == 0


def test_small_tiles_are_labelled_together():
    rng = np.random.default_rng(3)
    rows = [(f"r{k}", x0, y0, h, w, 6, rng.random(h * w)) for k in range(400) for x0, y0, h, w in ((0, 0, 4, 4), (4, 0, 4, 2), (0, 4, 1, 4), (4, 4, 0, 2))]
    tiles = pd.DataFrame(rows, columns=["k", "x0", "y0", "h", "w", "width", "data"])
    found = list(mosaics.tile_labels(iter([tiles]), 0.4, "k"))
    assert len(found) == 3  # a frame a shape; a frame a tile took two milliseconds each
    want = []
    for k, x0, y0, h, w, width, data in rows:
        i, island = kernels.label_runs(data.reshape(h, w) >= 0.4)
        want += [(k, a % w + x0, a // w + y0, (b // w + y0) * width + b % w + x0) for a, b in zip(i.tolist(), island.tolist(), strict=True)]
    got = [tuple(r) for f in found for r in f.itertuples(index=False)]
    assert sorted(got) == sorted(want) and len(want) > 4000


def test_long_chains_of_ids_are_joined(spark):
    chain = [(k % 2, i, i + 1) for k in range(2) for i in range(60)] + [(0, 100, 200), (0, 150, 200), (1, 300, 300)]
    got = {(r.k, r.id): r.least for r in mosaics.joined_ids(spark.createDataFrame(chain, "k int, a long, b long"), "k").collect()}
    assert got == {(k, i): 0 for k in range(2) for i in range(1, 61)} | {(0, 200): 100, (0, 150): 100}


def test_stamps_equal_those_of_the_joined_mosaic(spark):
    rng = np.random.default_rng(4)
    mosaic = rng.random((26, 37))
    rasters = spark.createDataFrame([(9, 26, 37, mosaic.ravel().tolist())], "raster_id int, h int, w int, data array<double>")
    places = [(1, 0, 0), (2, 18, 13), (3, 36, 25), (4, 8, 8), (5, 500, 500), (6, -3, 12)]
    at = spark.createDataFrame([(9, i, x, y) for i, x, y in places], "raster_id int, id int, x int, y int")
    got = {r.id: np.array(r.data).reshape(r.h, r.w) for r in mosaics.stamps(at, mosaics.cut_tiles(rasters, 8), 11, 8).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    padded = np.full((26 + 40, 37 + 40), np.nan)
    padded[20:46, 20:57] = mosaic
    for i, x, y in places:
        if i in got:
            np.testing.assert_array_equal(got[i], padded[y + 15 : y + 26, x + 15 : x + 26])


# --- polygons


def test_outlines_fill_to_their_masks(spark):
    rng = np.random.default_rng(7)
    masks = []
    for _ in range(12):
        m = np.zeros((24, 30), bool)
        for _ in range(4):
            x, y, a, b = rng.integers(2, 26), rng.integers(2, 20), rng.integers(1, 5), rng.integers(1, 4)
            m[max(y - b, 0) : y + b + 1, max(x - a, 0) : x + a + 1] = True
        masks.append(m)
    rows = [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    mask = spark.createDataFrame(rows, "id int, x int, y int")
    outside = lambda m: {(x, y) for x, y in reach(~np.pad(m, 1))}

    def reach(free):
        seen, stack = set(), [(0, 0)]
        while stack:
            x, y = stack.pop()
            if (x, y) in seen or not (0 <= x < free.shape[1] and 0 <= y < free.shape[0]) or not free[y, x]:
                continue
            seen.add((x, y))
            stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        return {(x - 1, y - 1) for x, y in seen}

    for mode in ("polygon", "rle"):
        back = polygons.annotation_masks(coco.segmentations(mask, "id", 24, 30, mode), 24, 30)
        got = {(r.id, r.x, r.y) for r in back.collect()}
        filled = {(k, x, y) for k, m in enumerate(masks) for x in range(30) for y in range(24) if (x, y) not in outside(m)}
        assert got == (filled if mode == "polygon" else set(rows))


def test_odd_polygons(spark):
    """Too few points, off the raster, of no height, crossing itself, with a fraction, two that overlap."""
    shapes = [
        (1, 0, [1.0, 1.0, 5.0, 5.0]), (2, 0, [-9.0, -9.0, -5.0, -9.0, -5.0, -5.0]), (3, 0, [1.0, 2.0, 6.0, 2.0, 3.0, 2.0]), (4, 0, [0.0, 0.0, 4.0, 4.0, 4.0, 0.0, 0.0, 4.0]),
        (5, 0, [0.6, 0.6, 3.4, 0.6, 3.4, 2.5, 0.6, 2.5]), (6, 0, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]), (6, 1, [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0]), (7, 0, None), (8, 0, [-3.0, 1.0, 20.0, 1.0, 20.0, 2.0, -3.0, 2.0]),
    ]
    got = {}
    for r in polygons.fill(spark.createDataFrame(shapes, "id int, polygon int, points array<double>"), "id", 8, 8).collect():
        got.setdefault(r.id, []).append((r.x, r.y))
    assert set(got) == {3, 4, 5, 6, 8}
    assert sorted(got[3]) == [(x, 2) for x in range(1, 7)]
    assert set(got[4]) == {(x, y) for y in range(5) for x in range(5) if x <= min(y, 4 - y) or x >= max(y, 4 - y)}
    assert set(got[5]) == {(x, y) for x in (1, 2, 3) for y in (1, 2)}
    assert len(got[6]) == 14 == len(set(got[6]))
    assert set(got[8]) == {(x, y) for x in range(8) for y in (1, 2)}


# --- apertures and sweeps


@pytest.mark.parametrize(("x0", "y0", "r"), [(7.0, 7.0, 3.0), (6.3, 7.9, 4.5), (7.5, 7.5, 0.4), (7.0, 7.2, 0.2), (6.5, 7.0, 5.0), (7.01, 6.99, 6.2)])
def test_shares_add_up_to_the_circle(spark, x0, y0, r):
    y, x = np.mgrid[:15, :15]
    one = spark.createDataFrame([(1, int(a), int(b), 1.0) for a, b in zip(x.ravel(), y.ravel(), strict=True)], "id int, x int, y int, v double")
    got = aperture.aperture_sum(one, "id", x0, y0, r).first()
    assert abs(got.flux - math.pi * r * r) < 1e-9 and abs(got.area - math.pi * r * r) < 1e-9
    share = one.withColumn("s", aperture.overlap(F.col("x") - x0, F.col("y") - y0, r)).select("x", "y", "s").collect()
    sub = (np.arange(200) + 0.5) / 200 - 0.5
    for p in share[::5]:
        exact = ((p.x + sub[None, :] - x0) ** 2 + (p.y + sub[:, None] - y0) ** 2 <= r * r).mean()
        assert abs(p.s - exact) < 2e-3


def test_sweep_equals_the_single_steps(spark):
    rng = np.random.default_rng(9)
    objects = spark.createDataFrame([(k, 12, 10, rng.random(120).tolist(), z) for k, z in enumerate([0.1, 0.25, 0.0, None])], "raster_id int, h int, w int, data array<double>, z double")
    got = {(r.raster_id, r.step): r for r in reproject.sweep(objects, 0.15, 0.6, 4, (9, 11), 3.3).collect()}
    assert len(got) == 16 and all(got[k, s].flux is None and got[k, s].error for k in (2, 3) for s in range(4))
    swept = reproject.redshift_sweep(objects.where("z > 0"), 0.15, 0.6, 4)
    placed = swept.select("sweep_id", "raster_id", "step")
    for r in reproject.reproject(swept, "sweep_id").join(placed, "sweep_id").collect():
        frame = reproject.pasted(np.array(r.data).reshape(r.h, r.w), 9, 11)
        at = spark.createDataFrame([(1, int(x), int(y), float(frame[y, x])) for y in range(9) for x in range(11)], "id int, x int, y int, v double")
        want = aperture.aperture_sum(at, "id", 5.0, 4.0, 3.3).first().flux
        own = got[r.raster_id, r.step]
        assert (own.h, own.w) == (r.h, r.w) and abs(own.flux - want) < 1e-6 * abs(want)
    assert got[0, 3].flux < got[0, 0].flux


def test_pasting_crops_and_centres(spark):
    a = np.arange(1.0, 13.0).reshape(3, 4)
    assert reproject.pasted(a, 5, 8)[1:4, 2:6].tolist() == a.tolist() and reproject.pasted(a, 5, 8).sum() == a.sum()
    small = spark.createDataFrame([(1, x, y, float(a[y, x])) for y in range(3) for x in range(4)], "id int, x int, y int, v double")
    by_columns = {(r.x, r.y): r.v for r in pixels.paste_centre(small, "id", 4, 3, 2, 2).collect()}
    assert by_columns == {(x, y): v for (y, x), v in np.ndenumerate(reproject.pasted(a, 2, 2))}
