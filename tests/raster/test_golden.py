"""Values computed by hand, and properties."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.functions import cosmology, names, numeric, stretch, units
from skyframe.operators import coco, geometry, grg, kernels, pixels, proposals, quality, reproject, segment, split
from skyframe.plans import datasets
from skyframe.sinks import images
from skyframe.sources import catalogue, coco_json, fits
from skyframe.streaming import ingest

ANGLES = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]


def test_inscribed_rectangles(spark):
    assert [geometry.inscribed_rectangle(300, 300, a)[0] for a in ANGLES] == [300, 212, 300, 212, 299, 212, 299, 212]
    assert [geometry.inscribed_rectangle(425, 425, a)[0] for a in ANGLES] == [425, 300, 425, 300, 424, 300, 424, 300]
    wide = [(400, 300), (212, 212), (300, 400), (212, 212), (399, 299), (212, 212), (299, 399), (212, 212)]
    assert [geometry.inscribed_rectangle(400, 300, a) for a in ANGLES] == wide
    assert [geometry.inscribed_rectangle(*s, 30) for s in ((300, 300), (425, 425), (400, 300))] == [(219, 219), (311, 311), (300, 173)]
    df = spark.createDataFrame([(400, 300, a) for a in ANGLES], "w int, h int, a double")
    w, h = geometry.inscribed_rectangle_columns(F.col("w"), F.col("h"), F.col("a"))
    assert [tuple(r) for r in df.select(w, h).collect()] == wide


def test_rotated_points(spark):
    pts = [(212, 212), (213, 212), (250, 180), (63, 63), (62, 62), (420, 10)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, x int, y int")
    rows = geometry.rotate_points(df, [0.0, 45.0, 90.0, 135.0], 425, 425, 300, 300).orderBy("angle_index", "i").collect()
    got = {a: [(r.x, r.y) for r in rows if r.angle == a] for a in (0, 45, 90, 135)}
    assert got == {0: [(150, 150), (150, 150), (188, 118), (0, 0), (0, 0)], 45: [(150, 150), (150, 149), (154, 100)], 90: [(150, 150), (150, 148), (118, 112), (0, 298)], 135: [(150, 150), (149, 149), (100, 145)]}


def test_split_boundaries_and_families(spark):
    for n, (a, b) in {1: (0, 0), 2: (1, 1), 3: (2, 2), 7: (4, 5), 10: (7, 8), 20: (14, 17), 100: (70, 85)}.items():
        df = spark.range(n).select(F.col("id").alias("image_id"), F.lit(1).alias("stratum"))
        got = {r[0]: r[1] for r in split.stratified(df).groupBy("split").count().collect()}
        assert (got.get("train", 0), got.get("train", 0) + got.get("val", 0), sum(got.values())) == (a, b, n)
    with pytest.raises(ValueError):
        split.stratified(spark.range(1).selectExpr("id AS image_id", "1 AS stratum"), {"train": 0.5, "test": 0.4})


def test_nan_and_zero_arithmetic(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (-1.0,), (0.0,), (5.0,)], "v double")
    v = F.col("v")
    got = df.select(numeric.clip(v, 0.0, 1.0), numeric.at_least(v, 0.0), numeric.log10(v), numeric.divide(v, F.lit(0.0))).collect()
    assert math.isnan(got[0][0]) and [r[0] for r in got[1:]] == [0.0, 0.0, 1.0]
    assert [r[1] for r in got] == [False, False, True, True]
    assert math.isnan(got[1][2]) and got[2][2] == -math.inf
    assert math.isnan(got[0][3]) and got[1][3] == -math.inf and math.isnan(got[2][3]) and got[3][3] == math.inf
    assert [r[0] for r in spark.createDataFrame([("7",), ("12345678901",)], "s string").select(numeric.zero_filled(F.col("s"), 10)).collect()] == ["0000000007", "12345678901"]


def test_stretch_guards(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, float("nan")), (2, 1.0), (None, 1.0), (None, 3.0)], "g int, v double")
    assert {r.z for r in stretch.robust_z_score(df, "v", ["g"]).where("g = 1").collect()} == {0.0}
    assert {r.q for r in stretch.quantile_stretch(df, "v", ["g"]).where("g = 1").collect()} == {0.0}
    assert all(math.isnan(r.z) for r in stretch.robust_z_score(df, "v", ["g"]).where("g = 2").collect())
    assert all(math.isnan(r.z) for r in stretch.z_score(df, "v", ["g"]).where("g = 1").collect())
    assert sorted(r.z for r in stretch.z_score(df, "v", ["g"]).where("g IS NULL").collect()) == [-1.0, 1.0]


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(1)
    for h, w, p in ((1, 1, 1.0), (7, 5, 0.5), (30, 40, 0.6), (20, 20, 0.0), (9, 9, 1.0)):
        m = rng.random((h, w)) < p
        got = dict(zip(*kernels.label_runs(m), strict=True))
        want, seen = {}, set()
        for start in map(int, np.flatnonzero(m)):
            if start in seen:
                continue
            stack = [start]
            seen.add(start)
            while stack:
                i = stack.pop()
                want[i] = start
                y, x = divmod(i, w)
                for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= a < h and 0 <= b < w and m[a, b] and a * w + b not in seen:
                        seen.add(a * w + b)
                        stack.append(a * w + b)
        assert got == want


def test_rotation_kernel():
    rng = np.random.default_rng(2)
    a = rng.random((12, 12))
    assert np.array_equal(kernels.rotate(a, 90), np.rot90(a)) and np.array_equal(kernels.rotate(a, 360), a)
    y, x = np.mgrid[:41, :41] - 20.0
    blob = np.exp(-((x - 4) ** 2 + y**2) / 18)
    turned = np.exp(-((x - 4 * math.cos(math.radians(30))) ** 2 + (y + 4 * math.sin(math.radians(30))) ** 2) / 18)
    assert np.abs(kernels.rotate(blob, 30) - turned).max() < 2e-3
    k = kernels.spline_coefficients(a)
    inner = (k[:-2] + 4 * k[1:-1] + k[2:]) / 6
    inner = (inner[:, :-2] + 4 * inner[:, 1:-1] + inner[:, 2:]) / 6
    assert np.allclose(inner, a[1:-1, 1:-1])


def test_resize_kernel_and_contours():
    assert np.allclose(kernels.resize(np.full((9, 7), 2.5), 4, 5), 2.5)
    assert kernels.resize(np.arange(16.0).reshape(4, 4), 8, 8).shape == (8, 8)
    m = np.zeros((8, 8), bool)
    m[2:5, 3:7] = True
    m[7, 0] = True
    assert [sorted(map(tuple, c)) for c in kernels.contours(m)] == [[(3, 2), (3, 4), (6, 2), (6, 4)]]


def test_rasters_through_spark(spark):
    rows = [(1, 3, 4, [0.0] * 12), (2, 2, 2, [1.0, float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "raster_id long, h int, w int, data array<double>")
    got = {(r.raster_id, r.x, r.y): r.island_id for r in kernels.label_components(df, 0.5).collect()}
    assert got == {(2, 0, 0): 0, (2, 0, 1): 0, (2, 1, 1): 0}
    back = pixels.pack_pixels(pixels.explode_pixels(df.where("raster_id = 1")), "raster_id", 3, 4).first()
    assert back["data"] == [0.0] * 12
    turned = kernels.rotated_rasters(df.where("raster_id = 1"), [0.0, 90.0], dynamic=True).collect()
    assert len(turned) == 2
    with pytest.raises(ValueError):
        kernels.rotated_rasters(df, [0.0], (2, 2), True)
    assert kernels.polygons(df).count() == 2


def test_four_quarter_turns_are_identity(spark):
    df = spark.createDataFrame([(0, x, y, float(10 * x + y)) for x in range(3) for y in range(3)], "k int, x int, y int, v double")
    out = df
    for _ in range(4):
        out = pixels.rotate_quarter(out, 3, 3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_proposals_properties(spark):
    rows = [(1, i, 10 - i, i, i, i + 1, i + 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, island_id long, area long, xmin int, ymin int, xmax int, ymax int")
    got = proposals.subsets(df, "k").toPandas()
    assert len(got) == 31 and got.score.max() == 1.0 and got.loc[got.members == 31, "xmax"].item() == 5
    assert sorted(got.groupby("size").size().tolist()) == [1, 5, 5, 10, 10]
    with pytest.raises(ValueError):
        proposals.subsets(df, "k", 25)


def test_units_and_cosmology(spark):
    one = spark.range(1)
    header = F.create_map(F.lit("BMAJ"), F.lit("1"), F.lit("BMIN"), F.lit("1"), F.lit("CDELT1"), F.lit("-1"), F.lit("CDELT2"), F.lit("1"), F.lit("BUNIT"), F.lit("x"))
    assert one.select(units.header_factor(header)).first()[0] == pytest.approx(4 * math.log(2) / math.pi)
    assert one.select(units.with_unit(header, "JY/PIXEL")["BUNIT"]).first()[0] == "JY/PIXEL"
    with pytest.raises(Exception, match="header lacks"):
        one.select(units.header_factor(F.create_map(F.lit("BMAJ"), F.lit("1")))).collect()
    z = F.lit(0.5)
    d, t, lum, ang = one.select(cosmology.comoving_distance(z), cosmology.transverse_comoving_distance(z), cosmology.luminosity_distance(z), cosmology.angular_diameter_distance(z)).first()
    assert d == t and lum == pytest.approx(ang * 2.25) and lum / 1.5 == pytest.approx(d, rel=2e-3) and 1900 < d < 2000
    for k in (0.1, -0.1):
        assert one.select(cosmology.transverse_comoving_distance(z, k)).first()[0] == pytest.approx(d, rel=0.01)


def test_reprojection_keeps_scaled_flux(spark):
    data = [float(i % 7) for i in range(400)]
    df = spark.createDataFrame([(1, 20, 20, data, 0.1, 0.2), (2, 20, 20, data, None, 0.2)], "raster_id long, h int, w int, data array<double>, z double, z_new double")
    got = {r.raster_id: r for r in reproject.reproject(df).collect()}
    factor = spark.range(1).select(cosmology.flux_scaling(F.lit(0.1), F.lit(0.2))).first()[0]
    assert sum(got[1]["data"]) == pytest.approx(sum(data) * factor) and got[1].h < 20
    assert got[2]["data"] is None and got[2].error
    assert reproject.redshift_sweep(df, 0.1, 0.5, 5).count() == 10


def test_fits_round_trip(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    (tmp_path / "a.fits").write_bytes(fits.to_bytes(a, {"BMAJ": 0.5, "BUNIT": "JY/BEAM"}))
    hdus = fits.read_hdus(spark, str(tmp_path / "a.fits"))
    r = fits.rasters(hdus).first()
    assert (r.h, r.w, r["data"]) == (2, 3, a.ravel().tolist()) and r.header["BUNIT"] == "JY/BEAM" and float(r.header["BMAJ"]) == 0.5
    held = fits.hdu_list(hdus)
    assert held.select(fits.data_of(0, F.col("hdus")), fits.header_of(-1, F.col("hdus"))["NAXIS"]).first()[1] == "2"
    t = np.array([(b"abc  ", 1.5), (b"d", -2.0)], [("Parent_Source", "S5"), ("RA", ">f8")])
    cards = ["XTENSION= 'BINTABLE'", f"BITPIX  = {8:20d}", f"NAXIS   = {2:20d}", f"NAXIS1  = {13:20d}", f"NAXIS2  = {2:20d}", f"PCOUNT  = {0:20d}", f"GCOUNT  = {1:20d}", f"TFIELDS = {2:20d}", "TTYPE1  = 'Parent_Source'", "TFORM1  = '5A'", "TTYPE2  = 'RA'", "TFORM2  = 'D'", "END"]
    head = "".join(f"{c:<80}" for c in cards).ljust(2880).encode()
    (tmp_path / "t.fits").write_bytes(fits.to_bytes(np.zeros((1, 1))) + head + t.tobytes().ljust(2880, b"\0"))
    assert [tuple(r) for r in fits.read_table(spark, str(tmp_path / "t.fits"), "Parent_Source string, RA double").collect()] == [("abc", 1.5), ("d", -2.0)]


def test_coco_documents_round_trip(spark, tmp_path):
    meta = "named_struct('RA', 1.0D, 'DEC', 2.0D, 'grg_positions', array(array(1, 2)), 'all_component_positions', array(array(1, 2)), 'rotated', {r}, 'origin_id', 0L, 'rotation_angle', 0.0D, 'stretch', 'sqrt', 'reprojected', false, 'old_redshift', CAST(NULL AS DOUBLE), 'new_redshift', CAST(NULL AS DOUBLE))"
    i = spark.sql(f"SELECT 0L AS id, 'a.png' AS file_name, 3 AS width, 3 AS height, {meta.format(r='false')} AS metadata UNION ALL SELECT 1L, 'b.png', 3, 3, {meta.format(r='true')}")
    boxes = spark.sql("SELECT 0L AS id, 0L AS image_id, 0 AS xmin, 0 AS ymin, 2 AS xmax, 1 AS ymax, 4.0D AS area UNION ALL SELECT 1L, 1L, NULL, NULL, NULL, NULL, 0.0D")
    a = coco.annotation_rows(boxes)
    assert a.count() == 1 and coco.annotation_rows(boxes, "xywh").first().bbox == [0.0, 0.0, 2.0, 1.0]
    path = str(tmp_path / "d.json")
    coco_json.write_document(i, a, coco.categories(spark), path, 4)
    assert json.load(open(path))["categories"] == [{"id": 1, "name": "GRG"}]
    ri, ra, rc = coco_json.read(spark, path)
    assert ri.count() == 2 and ra.first().bbox == [0.0, 0.0, 2.0, 1.0] and rc.first().name == "GRG"
    out = datasets.split_dataset(ri, ra)
    assert sorted((r.split, r.id) for r in out["members"].collect()) == [("test", 0), ("test", 1)] and out["summary"].first().annotations == 1
    with pytest.raises(ValueError):
        coco_json.checked_path("d.txt")


def test_image_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 2, [float(i) for i in range(12)])], "k long, h int, w int, data array<double>")
    assert images.png16(df, "k").first().content[:8] == b"\x89PNG\r\n\x1a\n" and images.png8(df, "k").first().content[24] == 8
    import io

    assert np.load(io.BytesIO(images.npy(df, "k").first().content)).shape == (3, 2, 2)
    q = images.quantised(np.array([[[0.0, 1.0]], [[2.0, 2.0]]]))
    assert q[..., 0].tolist() == [[0, 65535]] and q[..., 1].tolist() == [[0, 0]]
    images.write_files(images.npy(df, "k").select(F.lit("x.npy").alias("file_name"), "content"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.npy").exists()


def test_catalogue_settings_and_streams(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Ref,RAJ2000,DEJ2000,extra\nA,1.5,2.5,x\nB,3.0,4.0,y\n")
    assert [tuple(r) for r in catalogue.read_giants(spark, str(tmp_path / "c.csv"), "A").collect()] == [(1.5, 2.5)]
    (tmp_path / "s.yaml").write_text("DATA:\n  CUTOUT_SIZE: 20\n  other: 1\nRMS: 0.5\n")
    assert catalogue.Settings.from_yaml(str(tmp_path / "s.yaml")) == catalogue.Settings(cutout_size=20, rms=0.5)
    df = spark.createDataFrame([(1, 1, 3, [0.1, 0.5, 0.9])], "raster_id long, h int, w int, data array<double>")
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.detections(ingest.read_cutouts(spark, str(tmp_path / "in"), "raster_id long, h int, w int, data array<double>"), 0.5)
    ingest.write(s, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination(60)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.area, round(r.flux, 6)) == (2, 1.4)


def test_cleaning_and_finder(spark):
    pts = spark.createDataFrame([(1, 0, 0, 0, True), (1, 1, 5, 5, True), (1, 2, 1, 0, False), (1, 3, 6, 6, False), (2, 0, 9, 9, True)], "k int, ord int, x int, y int, grg boolean")
    mask = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "k int, x int, y int")
    got = {r.k: r for r in quality.clean(pts, mask, "k").collect()}
    assert [(p.x, p.y) for p in got[1].grg] == [(0, 0), (1, 0)] and [(p.x, p.y) for p in got[1].other] == [(6, 6), (5, 5)] and got[1].updated and got[2].removed
    m = quality.metrics(quality.judge(pts, mask, "k")).first()
    assert (m.tp, m.fp, m.fn, m.accuracy) == (0, 2, 2, 0.0)
    labels = spark.createDataFrame([(1, x, y, i) for i, (x0, x1, y0, y1) in {0: (0, 9, 0, 9), 90: (3, 6, 20, 24)}.items() for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)], "k int, x int, y int, island_id long")
    comps = spark.createDataFrame([(1, "a", 0, 0, 1, 1), (1, "b", 1, 0, 2, 2), (1, "c", 2, 0, 4, 21), (1, "d", 3, 0, 11, 11)], "k int, skey string, seg_ord int, ord int, x int, y int")
    assert segment.segment_sizes(comps, labels, "k").where("skey = 'd'").first().size == 0
    owned = {r.island_id: r.skey for r in segment.owned_islands(comps, labels, "k").collect()}
    assert owned == {0: "a", 90: "c"}
    f = grg.find_central(comps, labels, "k", 10, 10).first()
    assert f.skey == "a" and f.contains_centre
    assert grg.find_central(comps, labels, "k", 10, 10, tie="largest").count() == 1
    with pytest.raises(ValueError):
        grg.find_central(comps, labels, "k", 10, 12)
    assert grg.central_positions(comps, grg.find_central(comps, labels, "k", 10, 10), "k").first().all_positions[0].x == 1


def test_training_and_search_plans(spark):
    y, x = np.mgrid[:40, :40]
    a = np.exp(-((x - 20.0) ** 2 + (y - 20.0) ** 2) / 20) + 0.8 * np.exp(-((x - 8.0) ** 2 + (y - 30.0) ** 2) / 6)
    cut = spark.createDataFrame([(1, 10.0, 20.0, 40, 40, a.ravel().tolist())], "image_id long, ra double, dec double, h int, w int, data array<double>")
    comps = spark.createDataFrame([(1, "GRG", 0, 0, 20, 20), (1, "o1", 1, 0, 8, 30)], "image_id long, skey string, seg_ord int, ord int, x int, y int")
    s = catalogue.Settings(cutout_size=40, crop_size=28, rms=0.1, angles=[0.0, 90.0])
    out = datasets.training(cut, comps, s)
    assert out["images"].count() == 2 and out["annotations"].count() == 2 and out["metrics"].first().recall == 1.0
    assert out["images"].orderBy("id").first().file_name == "GRG_0000000000_RA10.0_DEC20.0.png"
    held = out["annotations"].orderBy("id").first()
    runs = coco.unpacked_counts(out["annotations"].select("id", "segmentation.rle.counts"), "id").where(f"id = {held.id}").orderBy("run").collect()
    assert list(held.segmentation.rle.size) == [28, 28] and sum(r.length for r in runs) == 28 * 28 and sum(r.length for r in runs[1::2]) == held.area
    assert out["images"].orderBy("id").first().metadata.grg_positions == [[14, 14]]
    square = spark.createDataFrame([(7, x, y) for x in (2, 3, 4) for y in (1, 2)], "image_id long, x int, y int")
    outline = coco.segmentations(square, "image_id", 6, 8, "polygon").first().segmentation
    assert outline.rle is None and sorted(zip(outline.polygons[0][::2], outline.polygons[0][1::2], strict=True)) == [(2, 1), (2, 2), (4, 1), (4, 2)]
    with pytest.raises(ValueError):
        coco.segmentations(comps, "image_id", 4, 4, "outline")
    assert out["proposals"].count() >= 2 and out["pixels"].count() == 2 * 28 * 28
    found = datasets.search(cut, comps, s)
    assert found["images"].count() == 1 and found["proposals"].count() == 3
    assert spark.range(1).select(names.proposal_name(F.lit("a.png"))).first()[0] == "a.npz"


@pytest.mark.parametrize("cell", [None, 3.0, 40.0])
def test_members_of_near_points_are_lists_without_pairs(spark, cell):
    rng = np.random.default_rng(4)
    left = [(i, float(x), float(y), None if i % 5 == 0 else i % 3) for i, (x, y) in enumerate(rng.integers(-30, 30, (200, 2)))] + [(900, None, 1.0, 1)]
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-30, 30, (40, 2)))] + [(99, 5.0, None)]
    a, b = spark.createDataFrame(left, "id int, x double, y double, g int"), spark.createDataFrame(right, "id int, x double, y double")
    want = {}
    for j, rx, ry in right[:-1]:
        for i, x, y, g in left[:-1]:
            if abs(x - rx) <= 5 and abs(y - ry) <= 5:
                want.setdefault((j, g), []).append(i)
    found = geometry.near_members(a, b, 5.0, "g", cell)
    assert {(r.right_id, r.g): (r.n, r.members) for r in found.collect()} == {k: (len(v), sorted(v)) for k, v in want.items()}
    pairs = sorted((r.left_id, r.right_id) for r in geometry.near_pairs(a, b, 5.0, cell).collect())
    assert pairs == sorted((i, j) for (j, _), v in want.items() for i in v)


def test_copied_points_are_never_broadcast(spark):
    """Spark sizes the right side without its 72 copies a point, so a table below the broadcast threshold filled the driver's memory."""
    from skyframe import queries
    from tests.conftest import DATA

    plan = queries.spatial_range_join(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
