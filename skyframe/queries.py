"""Registered queries over the test tables, each with its DuckDB twin.

Adapters turn the tables into this library's inputs: embeddings are 8 x 8 rasters, lineitem gives catalogue
components and points, orders and lineitem stand for images and annotations, events for pixel values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cosmology, numeric, stretch, units
from .functions.names import proposal_name, sample_name
from .operators import aperture, coco, geometry, grg, kernels, mosaics, pixels, polygons, proposals, quality, reproject, segment, sky, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEVEL, SIDE, KEY = 0.1, 8, "vec_id"
#: Most ids of rasters that go to every task, which then sends only their lines; with more ids, all lines are sent to meet them.
SENT_IDS = 1 << 21
ANGLES = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL, under the function's name or `name`."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- values: events -------------------------------------------------------------------------------------------


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("v"))


@query("SELECT event_id, round(sqrt(greatest(value, 0.0)), 6) AS s FROM events")
def sqrt_stretch(spark, sf_dir):
    return values(spark, sf_dir).select("event_id", r6(stretch.sqrt_stretch(F.col("v")), "s"))


@query("SELECT event_id, round(asinh(value / 5.0::DOUBLE), 6) AS s FROM events")
def asinh_stretch(spark, sf_dir):
    return values(spark, sf_dir).select("event_id", r6(stretch.asinh_stretch(F.col("v"), 5.0), "s"))


@query("SELECT event_id, least(greatest(value, 10.0::DOUBLE), 400.0::DOUBLE) AS s FROM events")
def linear_stretch(spark, sf_dir):
    return values(spark, sf_dir).select("event_id", stretch.linear_stretch(F.col("v"), 10.0, 400.0).alias("s"))


@query("SELECT event_id, round(log10(value + 0.001::DOUBLE), 6) AS s FROM events")
def log_stretch(spark, sf_dir):
    return values(spark, sf_dir).select("event_id", r6(stretch.log_stretch(F.col("v"), 0.001), "s"))


@query("SELECT event_id, round(pow(value, 1.5::DOUBLE), 6) AS s FROM events")
def power_stretch(spark, sf_dir):
    return values(spark, sf_dir).select("event_id", r6(stretch.power_stretch(F.col("v"), 1.5), "s"))


@query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY ALL) SELECT event_id, round((value - m) / d, 6) AS z FROM events JOIN s USING (event_type)")
def z_score(spark, sf_dir):
    return stretch.z_score(values(spark, sf_dir), "v", ["event_type"]).select("event_id", r6("z", "z"))


@query(
    "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL), d AS (SELECT e.*, m, abs(value - m) AS d FROM events e JOIN m USING (event_type)), "
    "s AS (SELECT event_type, quantile_cont(d, 0.5) AS s FROM d GROUP BY ALL) SELECT event_id, round(CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END, 6) AS z FROM d JOIN s USING (event_type)"
)
def robust_z(spark, sf_dir):
    return stretch.robust_z_score(values(spark, sf_dir), "v", ["event_type"]).select("event_id", r6("z", "z"))


@query("WITH s AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY ALL) SELECT event_id, round((value - a) / (b - a), 6) AS q FROM events JOIN s USING (event_type)")
def quantile_stretch(spark, sf_dir):
    return stretch.quantile_stretch(values(spark, sf_dir), "v", ["event_type"]).select("event_id", r6("q", "q"))


@query("WITH s AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY ALL) SELECT event_id, trunc((value - a) / (b - a) * 65535)::INT AS level FROM events JOIN s USING (event_type)")
def png16_quantize(spark, sf_dir):
    return stretch.quantise_per_group(values(spark, sf_dir), "v", ["event_type"]).select("event_id", "level")


_FACTOR = "(abs(radians(-1.5 / 3600::DOUBLE) * radians(1.5 / 3600::DOUBLE)) / (pi() * radians(6 / 3600::DOUBLE) * radians(6 / 3600::DOUBLE) / (4 * ln(2::DOUBLE))))"


def _headed(spark, sf_dir):
    header = F.create_map(*(x for k, v in (("BMAJ", 6 / 3600), ("BMIN", 6 / 3600), ("CDELT1", -1.5 / 3600), ("CDELT2", 1.5 / 3600)) for x in (F.lit(k), F.lit(v).cast("string"))), F.lit("BUNIT"), F.lit("JY/BEAM"))
    return values(spark, sf_dir).withColumn("header", header)


@query(f"SELECT event_id, round(value * {_FACTOR}, 6) AS v, 'JY/PIXEL' AS unit FROM events")
def jy_beam_to_pixel(spark, sf_dir):
    unit = units.with_unit(F.col("header"), "JY/PIXEL")["BUNIT"]
    return _headed(spark, sf_dir).select("event_id", r6(units.beam_to_pixel(F.col("v"), units.header_factor(F.col("header"))), "v"), unit.alias("unit"))


@query(f"SELECT event_id, round(value / {_FACTOR}, 6) AS v, 'JY/BEAM' AS unit FROM events")
def jy_pixel_to_beam(spark, sf_dir):
    unit = units.with_unit(F.col("header"), "JY/BEAM")["BUNIT"]
    return _headed(spark, sf_dir).select("event_id", r6(units.pixel_to_beam(F.col("v"), units.header_factor(F.col("header"))), "v"), unit.alias("unit"))


# --- redshift: lineitem discounts --------------------------------------------------------------------------------


def redshifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.lit(0.01) + F.col("l_discount")).alias("z")).distinct()


def _e(z: str) -> str:
    a = f"(1 + {z})"
    return f"sqrt({cosmology.OMEGA_M!r}::DOUBLE * {a} * {a} * {a} + {cosmology.OMEGA_R!r}::DOUBLE * {a} * {a} * {a} * {a} + {cosmology.OMEGA_L!r}::DOUBLE)"


def _e_massive(z: str) -> str:
    """E(z) with the density of one massive neutrino, for luminosity distances."""
    a, photon, mass, power = f"(1 + {z})", cosmology.OMEGA_PHOTON, cosmology._MASS, cosmology._POWER
    heavy = f"pow(1 + pow({mass!r}::DOUBLE / {a}, {power!r}::DOUBLE), {1 / power!r}::DOUBLE)"
    return f"sqrt({cosmology.OMEGA_M!r}::DOUBLE * {a} * {a} * {a} + {photon!r}::DOUBLE * (1 + {cosmology._EACH!r}::DOUBLE * (2 + {heavy})) * {a} * {a} * {a} * {a} + {cosmology.OMEGA_L!r}::DOUBLE)"


_Z = "z AS (SELECT DISTINCT 0.01::DOUBLE + l_discount AS z FROM lineitem)"
_DC = f"(SELECT sum((CASE WHEN i = 0 OR i = {cosmology.STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / {_e(f'(z * i / {cosmology.STEPS}.0::DOUBLE)')}) FROM range({cosmology.STEPS} + 1) r(i)) * z / {3 * cosmology.STEPS}.0::DOUBLE * {cosmology.hubble_distance()!r}::DOUBLE"


@query(f"WITH {_Z} SELECT round(z, 6) AS z, round({cosmology.H0}::DOUBLE * {_e('z')}, 6) AS h FROM z")
def hubble_parameter(spark, sf_dir):
    return redshifts(spark, sf_dir).select(r6("z", "z"), r6(cosmology.hubble_parameter(F.col("z")), "h"))


@query(f"WITH {_Z} SELECT round(z, 6) AS z, round({_DC}, 6) AS d FROM z")
def comoving_distance(spark, sf_dir):
    return redshifts(spark, sf_dir).select(r6("z", "z"), r6(cosmology.transverse_comoving_distance(F.col("z")), "d"))


@query("SELECT l_orderkey, l_linenumber, round(log10(l_quantity * 1e-26 * 4 * pi() * pow((100 + l_extendedprice) * 3.086e22, 2)), 6) AS log_l FROM lineitem")
def luminosity(spark, sf_dir):
    lum = units.luminosity(F.col("l_quantity"), F.lit(100.0) + F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(numeric.log10(lum), "log_l"))


@query("SELECT l_orderkey, l_linenumber, round(0.0001::DOUBLE * sqrt(l_extendedprice / l_quantity), 6) AS sigma FROM lineitem")
def flux_sigma(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(units.flux_sigma(F.lit(1e-4), F.col("l_extendedprice"), F.col("l_quantity")), "sigma"))


# --- pixels: embeddings -----------------------------------------------------------------------------------------


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(KEY, F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.col("embedding").cast("array<double>").alias("data"))


def all_pixels(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    return pixels.explode_pixels(rasters(spark, sf_dir), KEY, keep)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.threshold(all_pixels(spark, sf_dir), LEVEL)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.label_components(rasters(spark, sf_dir), LEVEL, KEY)


_PIXELS = "pixels AS (SELECT vec_id, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"
_MASK = f"{_PIXELS}, mask AS (SELECT * FROM pixels WHERE v >= 0.1::DOUBLE)"
_LABELS = (
    f"{_MASK}, reach AS (SELECT vec_id, x, y, y * 8 + x AS l FROM mask UNION SELECT m.vec_id, m.x, m.y, r.l FROM reach r JOIN mask m ON m.vec_id = r.vec_id AND abs(m.x - r.x) + abs(m.y - r.y) = 1), "
    "labels AS (SELECT vec_id, x, y, min(l)::BIGINT AS island_id FROM reach GROUP BY ALL)"
)
_BOX = "min(x)::INT AS xmin, min(y)::INT AS ymin, max(x)::INT AS xmax, max(y)::INT AS ymax"


@query(f"WITH {_MASK} SELECT vec_id, x, y FROM mask")
def threshold_mask(spark, sf_dir):
    return mask(spark, sf_dir).select(KEY, "x", "y")


@query(f"WITH {_PIXELS} SELECT vec_id, x, y, round(sqrt(greatest(v, 0)), 6) AS r, (v >= 3 * 0.02::DOUBLE)::INT AS g, (v >= 5 * 0.02::DOUBLE)::INT AS b FROM pixels")
def rgb_encode(spark, sf_dir):
    r, g, b = stretch.rgb_encode(F.col("v"), 0.02)
    return all_pixels(spark, sf_dir).select(KEY, "x", "y", r6(r, "r"), g.alias("g"), b.alias("b"))


@query(f"WITH {_MASK} SELECT vec_id, count(*)::DOUBLE AS area FROM mask GROUP BY ALL")
def mask_area(spark, sf_dir):
    return pixels.mask_area(mask(spark, sf_dir), KEY)


@query(f"WITH {_MASK} SELECT vec_id, {_BOX} FROM mask GROUP BY vec_id")
def mask_bbox(spark, sf_dir):
    return pixels.mask_box(mask(spark, sf_dir), KEY)


@query(f'WITH {_MASK} SELECT vec_id, min(x)::INT AS "left", min(y)::INT AS top, (max(x) - min(x))::INT AS width, (max(y) - min(y))::INT AS height FROM mask GROUP BY vec_id')
def bbox_xywh(spark, sf_dir):
    return pixels.box_to_xywh(mask_bbox(spark, sf_dir)).select(KEY, "left", "top", "width", "height")


@query(f"WITH {_PIXELS} SELECT vec_id, round(sum(v), 6) AS flux FROM pixels GROUP BY ALL")
def total_flux(spark, sf_dir):
    return pixels.total_flux(all_pixels(spark, sf_dir), KEY).select(KEY, r6("flux", "flux"))


@query(f"WITH RECURSIVE {_LABELS} SELECT * FROM labels")
def connected_components(spark, sf_dir):
    return labels(spark, sf_dir)


@query(f"WITH RECURSIVE {_LABELS} SELECT * FROM labels")
def tiled_components(spark, sf_dir):
    """The same, from tiles of three pixels that are labelled alone and linked across their seams."""
    return mosaics.label_tiles(mosaics.cut_tiles(rasters(spark, sf_dir), 3, KEY), LEVEL, 3, KEY)


_ISLANDS = f"{_LABELS}, islands AS (SELECT vec_id, island_id, count(*)::BIGINT AS area, {_BOX} FROM labels GROUP BY vec_id, island_id)"
_TOP = f"{_ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, island_id)::INT AS rank FROM islands)"


@query(f"WITH RECURSIVE {_ISLANDS} SELECT * FROM islands")
def island_properties(spark, sf_dir):
    return proposals.island_properties(labels(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_TOP} SELECT * FROM ranked WHERE rank <= 3")
def topk_islands(spark, sf_dir):
    return proposals.largest_islands(island_properties(spark, sf_dir), KEY, 3)


_SUBSETS = (
    "{top}, top AS (SELECT * FROM ranked WHERE rank <= {k}), n AS (SELECT vec_id, count(*) AS n, sum(area) AS total FROM top GROUP BY vec_id), "
    "sets AS (SELECT vec_id, total, unnest(generate_series(1, (1 << n) - 1)) AS members FROM n), "
    "subsets AS (SELECT s.vec_id, s.members::BIGINT AS members, count(*)::INT AS size, min(xmin)::FLOAT AS xmin, min(ymin)::FLOAT AS ymin, max(xmax)::FLOAT AS xmax, max(ymax)::FLOAT AS ymax, (sum(area)::DOUBLE / any_value(s.total))::FLOAT AS score "
    "FROM sets s JOIN top t ON t.vec_id = s.vec_id AND (s.members >> (t.rank - 1)) & 1 = 1 GROUP BY s.vec_id, s.members)"
)


@query("WITH RECURSIVE " + _SUBSETS.format(top=_TOP, k=10) + " SELECT vec_id, count(*) AS n, round(sum(score::DOUBLE), 4) AS scores, max(score) AS best FROM subsets GROUP BY vec_id")
def proposal_powerset(spark, sf_dir):
    held = proposals.subsets(island_properties(spark, sf_dir), KEY, 10)
    return held.groupBy(KEY).agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("double")), 4).alias("scores"), F.max("score").alias("best"))


@query("WITH RECURSIVE " + _SUBSETS.format(top=_TOP, k=4) + " SELECT * FROM subsets", "proposals")
def proposals_top4(spark, sf_dir):
    return proposals.subsets(island_properties(spark, sf_dir), KEY, 4)


_RUNS = (
    f"{_PIXELS}, p AS (SELECT vec_id, x * 8 + y AS p, (v >= 0.1::DOUBLE)::INT AS m FROM pixels UNION ALL SELECT DISTINCT vec_id, -1, 0 FROM pixels), "
    "g AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY p) AS run FROM (SELECT *, (m <> lag(m, 1, 0) OVER (PARTITION BY vec_id ORDER BY p))::INT AS c FROM p)), "
    "runs AS (SELECT vec_id, run::INT AS run, count(*) FILTER (p >= 0)::INT AS length FROM g GROUP BY vec_id, run)"
)


@query(f"WITH {_RUNS} SELECT * FROM runs")
def rle_runs(spark, sf_dir):
    runs = pixels.run_lengths(mask(spark, sf_dir), KEY, SIDE, SIDE)
    return runs.select(KEY, F.col("run").cast("int").alias("run"), F.col("length").cast("int").alias("length"))


_MORE = "rest <> CASE WHEN low >= 16 THEN -1 ELSE 0 END"


@query(
    f"WITH RECURSIVE {_RUNS}, d AS (SELECT vec_id, run, CASE WHEN run > 2 THEN length - lag(length, 2) OVER (PARTITION BY vec_id ORDER BY run) ELSE length END AS x FROM runs), "
    "c AS (SELECT vec_id, run, 0 AS k, x - 32 * floor(x / 32.0::DOUBLE) AS low, floor(x / 32.0::DOUBLE) AS rest FROM d "
    f"UNION ALL SELECT vec_id, run, k + 1, rest - 32 * floor(rest / 32.0::DOUBLE), floor(rest / 32.0::DOUBLE) FROM c WHERE {_MORE}) "
    f"SELECT vec_id, string_agg(chr((48 + low + CASE WHEN {_MORE} THEN 32 ELSE 0 END)::INT), '' ORDER BY run, k) AS counts FROM c GROUP BY vec_id"
)
def rle_strings(spark, sf_dir):
    return coco.packed_counts(rle_runs(spark, sf_dir), KEY)


@query(f"WITH {_MASK} SELECT vec_id, x, y FROM mask")
def rle_decode(spark, sf_dir):
    """The mask again, by way of the packed strings."""
    return pixels.runs_to_mask(coco.unpacked_counts(rle_strings(spark, sf_dir), KEY), KEY, SIDE)


def _plane(spark: SparkSession, sf_dir: str, name: str, key: str, across: str, *more: Column) -> DataFrame:
    """Rows of a table as points (id, x, y) of a plane."""
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), (F.col(across) / 10).alias("x"), ((F.col(key) % 100).cast("double") * 10).alias("y"), *more)


@query(
    "WITH l AS (SELECT c_custkey AS id, c_acctbal / 10 AS x, (c_custkey % 100)::DOUBLE * 10 AS y, c_nationkey AS g FROM customer), r AS (SELECT s_suppkey AS id, s_acctbal / 10 AS x, (s_suppkey % 100)::DOUBLE * 10 AS y FROM supplier), "
    "j AS (SELECT r.id, l.g, l.id AS p FROM l JOIN r ON abs(l.x - r.x) <= 25 AND abs(l.y - r.y) <= 25) SELECT id AS cutout, g AS parent, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS members FROM j GROUP BY id, g"
)
def cutout_components(spark, sf_dir):
    """Catalogue components near each cutout, grouped by their parent source."""
    parents = _plane(spark, sf_dir, "customer", "c_custkey", "c_acctbal", F.col("c_nationkey").alias("parent"))
    held = geometry.near_members(parents, _plane(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"), 25.0, "parent")
    return held.select(F.col("right_id").alias("cutout"), "parent", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"WITH {_PIXELS} SELECT vec_id, y AS x, 7 - x AS y, round(v, 6) AS v FROM pixels")
def rotate90(spark, sf_dir):
    return pixels.rotate_quarter(all_pixels(spark, sf_dir), SIDE, SIDE).select(KEY, "x", "y", r6("v", "v"))


@query(f"WITH {_PIXELS} SELECT vec_id, x - 2 AS x, y - 2 AS y, round(v, 6) AS v FROM pixels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def crop_center(spark, sf_dir):
    return pixels.crop_centre(all_pixels(spark, sf_dir), SIDE, SIDE, 4, 4).select(KEY, "x", "y", r6("v", "v"))


@query(
    f"WITH {_PIXELS}, g AS (SELECT x.i AS ox, y.i AS oy, least(greatest((x.i + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5, 0), 7)::DOUBLE AS sx, least(greatest((y.i + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5, 0), 7)::DOUBLE AS sy FROM range(12) x(i), range(12) y(i)), "
    "t AS (SELECT ox, oy, sx - floor(sx) AS fx, sy - floor(sy) AS fy, floor(sx)::INT AS x0, least(floor(sx) + 1, 7)::INT AS x1, floor(sy)::INT AS y0, least(floor(sy) + 1, 7)::INT AS y1 FROM g), "
    "u AS (SELECT ox, oy, x0 AS x, y0 AS y, (1 - fx) * (1 - fy) AS k FROM t UNION ALL SELECT ox, oy, x1, y0, fx * (1 - fy) FROM t UNION ALL SELECT ox, oy, x0, y1, (1 - fx) * fy FROM t UNION ALL SELECT ox, oy, x1, y1, fx * fy FROM t) "
    "SELECT vec_id, ox::INT AS x, oy::INT AS y, round(sum(v * k), 6) AS v FROM pixels JOIN u USING (x, y) GROUP BY vec_id, ox, oy"
)
def bilinear_resize(spark, sf_dir):
    return pixels.bilinear(all_pixels(spark, sf_dir), KEY, SIDE, SIDE, 12, 12).select(KEY, "x", "y", r6("v", "v"))


@query(f"WITH {_PIXELS}, t AS (SELECT x.i AS tx, y.i AS ty FROM generate_series(0, 4, 2) x(i), generate_series(0, 4, 2) y(i)) SELECT vec_id, tx::INT AS tx, ty::INT AS ty, round(sum(v), 6) AS flux FROM pixels JOIN t ON x BETWEEN tx AND tx + 3 AND y BETWEEN ty AND ty + 3 GROUP BY ALL")
def tile_grid(spark, sf_dir):
    tiled = pixels.tiles(rasters(spark, sf_dir), 4, 0.5)
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda dy: F.aggregate(F.slice("data", (F.col("ty") + dy) * SIDE + F.col("tx") + 1, 4), F.lit(0.0), lambda a, v: a + v))
    return tiled.select(KEY, "tx", "ty", r6(F.aggregate(rows, F.lit(0.0), lambda a, v: a + v), "flux"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(sum(v), 6) AS flux FROM pixels WHERE pow(x - 3.5, 2) + pow(y - 3.5, 2) <= 9 GROUP BY vec_id")
def aperture_flux(spark, sf_dir):
    return pixels.aperture_flux(all_pixels(spark, sf_dir), KEY, 3.5, 3.5, 3.0).select(KEY, r6("flux", "flux"))


@query(f"WITH {_PIXELS}, p AS (SELECT DISTINCT vec_id, 2 + 3 * (vec_id % 2) AS px, 4 AS py FROM pixels) SELECT vec_id AS id, (x - px + 2)::INT AS x, (y - py + 2)::INT AS y, round(v, 6) AS v FROM pixels JOIN p USING (vec_id) WHERE x BETWEEN px - 2 AND px + 1 AND y BETWEEN py - 2 AND py + 1")
def cutout_stamps(spark, sf_dir):
    at = rasters(spark, sf_dir).select(KEY, F.col(KEY).alias("id"), (2 + 3 * (F.col(KEY) % 2)).alias("x"), F.lit(4).alias("y"))
    return pixels.cutouts(at, all_pixels(spark, sf_dir), 4, KEY).select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), r6("v", "v"))


#: The share of a pixel in a circle as the sum over the pixel's edges of the sectors and triangles that an edge spans with the circle's middle.
_SHARES = (
    "places AS (SELECT x.i::INT AS x, y.i::INT AS y, x.i - 3.2::DOUBLE AS cx, y.i - 3.6::DOUBLE AS cy FROM range(8) x(i), range(8) y(i)), "
    "corners AS (SELECT x, y, cx + s.px AS px, cy + s.py AS py, cx + s.qx AS qx, cy + s.qy AS qy FROM places, (VALUES (-0.5::DOUBLE, -0.5::DOUBLE, 0.5::DOUBLE, -0.5::DOUBLE), (0.5, -0.5, 0.5, 0.5), (0.5, 0.5, -0.5, 0.5), (-0.5, 0.5, -0.5, -0.5)) s(px, py, qx, qy)), "
    "reach AS (SELECT *, -(px * (qx - px) + py * (qy - py)) AS mid, pow(px * (qx - px) + py * (qy - py), 2) - (px * px + py * py - 6.25::DOUBLE) AS disc FROM corners), "
    "cut AS (SELECT *, CASE WHEN disc <= 0 THEN 1 ELSE least(greatest(mid - sqrt(greatest(disc, 0)), 0), 1) END AS t1, CASE WHEN disc <= 0 THEN 1 ELSE least(greatest(mid + sqrt(greatest(disc, 0)), 0), 1) END AS t2 FROM reach), "
    "met AS (SELECT *, px + t1 * (qx - px) AS ax, py + t1 * (qy - py) AS ay, px + t2 * (qx - px) AS ux, py + t2 * (qy - py) AS uy FROM cut), "
    "shares AS (SELECT x, y, sum((6.25::DOUBLE * atan2(px * ay - py * ax, px * ax + py * ay) + (ax * uy - ay * ux) + 6.25::DOUBLE * atan2(ux * qy - uy * qx, ux * qx + uy * qy)) / 2) AS share FROM met GROUP BY x, y)"
)


@query(f"WITH {_PIXELS}, {_SHARES} SELECT vec_id, round(sum(v * share), 6) AS flux, round(sum(share), 6) AS area FROM pixels JOIN shares USING (x, y) WHERE share > 1e-12 GROUP BY vec_id")
def aperture_exact(spark, sf_dir):
    """Photometry with exact pixel shares, about a place off the grid."""
    return aperture.aperture_sum(all_pixels(spark, sf_dir), KEY, 3.2, 3.6, 2.5).select(KEY, r6("flux", "flux"), r6("area", "area"))


#: A mosaic of 8 x 8 rasters: vec_id by vec_id, 16 a row.
_MOSAIC = f"{_PIXELS}, mosaic AS (SELECT (vec_id % 16) * 8 + x AS mx, (vec_id // 16) * 8 + y AS my, v FROM pixels)"


@query(f"WITH {_MOSAIC}, p AS (SELECT vec_id, (vec_id % 16) * 8 + vec_id % 5 AS px, (vec_id // 16) * 8 + vec_id % 7 AS py FROM embeddings) SELECT vec_id AS id, (mx - px + 5)::INT AS x, (my - py + 5)::INT AS y, round(v, 6) AS v FROM mosaic JOIN p ON mx BETWEEN px - 5 AND px + 4 AND my BETWEEN py - 5 AND py + 4")
def mosaic_stamps(spark, sf_dir):
    """Stamps of ten pixels across the tiles of a mosaic, blank where there is none."""
    held = rasters(spark, sf_dir).select(F.lit(0).alias("mosaic"), ((F.col(KEY) % 16) * SIDE).cast("int").alias("x0"), (F.floor(F.col(KEY) / 16) * SIDE).cast("int").alias("y0"), "h", "w", "data", KEY)
    at = held.select("mosaic", F.col(KEY).alias("id"), (F.col("x0") + F.col(KEY) % 5).cast("int").alias("x"), (F.col("y0") + F.col(KEY) % 7).cast("int").alias("y"))
    cut = mosaics.stamps(at, held.drop(KEY), 10, SIDE, "mosaic")
    return pixels.explode_pixels(cut, "id", ~F.isnan("v")).select("id", "x", "y", r6("v", "v"))


@query(
    "WITH c AS (SELECT l_orderkey AS vec_id, (l_linenumber % 3)::INT AS polygon, (l_partkey % 8)::INT AS x, (l_suppkey % 8)::INT AS y, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 3) AS n FROM lineitem WHERE l_orderkey IN (SELECT vec_id FROM embeddings)), "
    "e AS (SELECT a.vec_id, a.polygon, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.polygon = b.polygon AND b.k = a.k % a.n + 1 WHERE a.n >= 3), "
    "p AS (SELECT DISTINCT vec_id, polygon, px.i::INT AS x, py.i::INT AS y FROM e, range(8) px(i), range(8) py(i)), "
    "j AS (SELECT vec_id, polygon, p.x, p.y, count(*) FILTER ((y1 > p.y) <> (y2 > p.y) AND (p.x - x1) * abs(y2 - y1) < (p.y - y1) * (x2 - x1) * sign(y2 - y1)) AS crossings, "
    "bool_or((x2 - x1) * (p.y - y1) = (y2 - y1) * (p.x - x1) AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge FROM p JOIN e USING (vec_id, polygon) GROUP BY ALL) "
    "SELECT DISTINCT vec_id, x, y FROM j WHERE on_edge OR crossings % 2 = 1"
)
def polygon_fill(spark, sf_dir):
    """Pixels of each raster that its segments' positions, taken as outlines, enclose."""
    listed = components(spark, sf_dir).groupBy(KEY, F.col("seg_ord").alias("polygon")).agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    flat = listed.select(KEY, "polygon", F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"]))).alias("points"))
    return polygons.fill(flat, KEY, SIDE, SIDE)


_DL = f"(SELECT sum((CASE WHEN i = 0 OR i = {cosmology.STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / {_e_massive('(Z * i / ' + str(cosmology.STEPS) + '.0::DOUBLE)')}) FROM range({cosmology.STEPS} + 1) r(i)) * Z * (1 + Z)"


@query(
    f"WITH {_MASK}, o AS (SELECT vec_id, 0.05::DOUBLE + 0.01 * (vec_id % 10) AS z, sum(v) AS total FROM mask GROUP BY vec_id), zs AS (SELECT i::INT AS step, 0.2::DOUBLE + i * ((0.5::DOUBLE - 0.2::DOUBLE) / 3) AS z_new FROM range(4) r(i)), "
    f"near AS (SELECT DISTINCT z, {_DL.replace('Z', 'z')} AS dl FROM o), far AS (SELECT step, z_new, {_DL.replace('Z', 'z_new')} AS dl FROM zs) "
    "SELECT vec_id, step, round(z_new, 6) AS z_new, round(total * pow(near.dl / far.dl, 2), 6) AS flux FROM o JOIN near USING (z), far"
)
def redshift_sweep(spark, sf_dir):
    """Flux against redshift in a circle that holds the whole frame."""
    objects = rasters(spark, sf_dir).select(KEY, "h", "w", F.transform("data", lambda v: F.when(v >= LEVEL, v).otherwise(0.0)).alias("data"), (F.lit(0.05) + F.lit(0.01) * (F.col(KEY) % 10)).alias("z"))
    lit = objects.where(F.exists("data", lambda v: v > 0))
    return reproject.sweep(lit, 0.2, 0.5, 4, (16, 16), 12.0, KEY).select(KEY, "step", r6("z_new", "z_new"), r6("flux", "flux"))


# --- pixels + components -------------------------------------------------------------------------------------------


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the orders that number a raster (a vec_id of embeddings): three keys an image, and `ord` as a total order of a key's positions."""
    c = F.col("l_linenumber") % 3
    ids = table(spark, sf_dir, "embeddings").select(F.col(KEY).alias("l_orderkey"))
    li = table(spark, sf_dir, "lineitem").join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "l_orderkey", "left_semi")
    return li.select(
        F.col("l_orderkey").alias(KEY), F.concat(F.lit("S"), c.cast("string")).alias("skey"), c.cast("int").alias("seg_ord"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), (F.col("l_suppkey") % SIDE).cast("int").alias("y"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("ord"),
    )


_COMPONENTS = (
    "components AS (SELECT l_orderkey AS vec_id, 'S' || (l_linenumber % 3) AS skey, (l_linenumber % 3)::INT AS seg_ord, (l_partkey % 8)::INT AS x, (l_suppkey % 8)::INT AS y, "
    "row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM lineitem WHERE l_orderkey IN (SELECT vec_id FROM embeddings))"
)
_SEGMENTS = (
    f"{_ISLANDS}, {_COMPONENTS}, keys AS (SELECT DISTINCT vec_id, skey, seg_ord FROM components), "
    "hits AS (SELECT DISTINCT vec_id, skey, seg_ord, island_id FROM components JOIN labels USING (vec_id, x, y)), "
    "sizes AS (SELECT k.vec_id, k.skey, k.seg_ord, coalesce(sum(area), 0)::BIGINT AS size FROM keys k LEFT JOIN hits h USING (vec_id, skey) LEFT JOIN islands i ON i.vec_id = h.vec_id AND i.island_id = h.island_id GROUP BY ALL), "
    "ranks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, seg_ord)::INT AS rank FROM sizes), "
    "owned AS (SELECT vec_id, island_id, skey, seg_ord, rank FROM (SELECT h.vec_id, h.island_id, h.skey, h.seg_ord, r.rank, row_number() OVER (PARTITION BY h.vec_id, h.island_id ORDER BY r.rank) AS n FROM hits h JOIN ranks r USING (vec_id, skey)) WHERE n = 1), "
    "boxes AS (SELECT k.vec_id, k.skey, k.seg_ord, min(xmin)::INT AS xmin, min(ymin)::INT AS ymin, max(xmax)::INT AS xmax, max(ymax)::INT AS ymax FROM keys k LEFT JOIN owned o USING (vec_id, skey) LEFT JOIN islands i ON i.vec_id = o.vec_id AND i.island_id = o.island_id GROUP BY ALL)"
)
_FOUND = (
    f"{_SEGMENTS}, cand AS (SELECT b.*, r.rank, (SELECT count(*) FROM components c WHERE c.vec_id = b.vec_id AND c.skey = b.skey) AS n_pos, (4 BETWEEN xmin AND xmax AND 4 BETWEEN ymin AND ymax) AS contains_centre FROM boxes b JOIN ranks r USING (vec_id, skey) WHERE xmin IS NOT NULL), "
    "found AS (SELECT vec_id, skey, seg_ord, contains_centre, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY contains_centre DESC, CASE WHEN contains_centre THEN rank ELSE n_pos END DESC, seg_ord) AS n FROM cand) WHERE n = 1)"
)


def _sky(spark, sf_dir):
    """Components and labels; the labels are read by several joins and come from a Python kernel, so they are kept."""
    return components(spark, sf_dir), labels(spark, sf_dir).persist()


@query(f"WITH {_COMPONENTS} SELECT vec_id, skey, x, y FROM components WHERE x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5")
def marker_bounds(spark, sf_dir):
    return segment.in_bounds(components(spark, sf_dir), 6, 6).select(KEY, "skey", "x", "y")


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM hits")
def segment_islands(spark, sf_dir):
    return segment.segment_islands(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM sizes")
def segment_size(spark, sf_dir):
    return segment.segment_sizes(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM ranks")
def segment_rank(spark, sf_dir):
    return segment.rank_segments(segment_size(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT vec_id, x, y, count(*) AS n FROM hits JOIN labels USING (vec_id, island_id) GROUP BY ALL")
def overlap_count(spark, sf_dir):
    return segment.overlap_counts(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM owned")
def overlap_resolve(spark, sf_dir):
    return segment.owned_islands(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS}, nums AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seg_ord)::INT AS label FROM keys) SELECT l.vec_id, l.x, l.y, n.label FROM labels l JOIN owned o USING (vec_id, island_id) JOIN nums n ON n.vec_id = o.vec_id AND n.skey = o.skey")
def segmentation_map(spark, sf_dir):
    return segment.segmentation_map(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM boxes")
def segment_bbox(spark, sf_dir):
    return segment.segment_boxes(*_sky(spark, sf_dir), KEY)


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT p.vec_id, p.x, p.y, round(CASE WHEN l.island_id IN (SELECT h.island_id FROM hits h WHERE h.vec_id = p.vec_id AND h.skey = 'S0') THEN v ELSE 0 END, 6) AS v FROM pixels p LEFT JOIN labels l USING (vec_id, x, y)")
def object_mask(spark, sf_dir):
    c, l = _sky(spark, sf_dir)
    return segment.object_mask(all_pixels(spark, sf_dir), c.where("skey = 'S0'"), l, KEY).select(KEY, "x", "y", r6("v", "v"))


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT vec_id, skey, (4 BETWEEN xmin AND xmax AND 4 BETWEEN ymin AND ymax) AS inside FROM boxes WHERE xmin IS NOT NULL")
def bbox_contains_center(spark, sf_dir):
    b = segment_bbox(spark, sf_dir).where("xmin IS NOT NULL")
    return b.select(KEY, "skey", (F.lit(4).between(F.col("xmin"), F.col("xmax")) & F.lit(4).between(F.col("ymin"), F.col("ymax"))).alias("inside"))


@query(f"WITH RECURSIVE {_FOUND} SELECT * FROM found")
def find_grg(spark, sf_dir):
    return grg.find_central(*_sky(spark, sf_dir), KEY, SIDE, SIDE)


@query(f"WITH RECURSIVE {_FOUND} SELECT f.vec_id, f.skey, {_BOX}, count(*)::DOUBLE AS area FROM found f JOIN owned o USING (vec_id, skey) JOIN labels l ON l.vec_id = o.vec_id AND l.island_id = o.island_id GROUP BY f.vec_id, f.skey")
def grg_full_annotation(spark, sf_dir):
    return grg.full_annotation(*_sky(spark, sf_dir), KEY, SIDE, SIDE)


@query(f"WITH {_MASK}, {_COMPONENTS} SELECT c.vec_id, skey, c.x, c.y, m.v IS NOT NULL AS inside FROM components c LEFT JOIN mask m USING (vec_id, x, y)")
def point_in_mask(spark, sf_dir):
    return segment.points_in_mask(components(spark, sf_dir), mask(spark, sf_dir), KEY).select(KEY, "skey", "x", "y", "inside")


@query(f"WITH RECURSIVE {_FOUND}, own AS (SELECT c.* FROM components c JOIN found f USING (vec_id, skey)) SELECT c.vec_id, c.skey, c.x, c.y FROM components c WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.vec_id = c.vec_id AND o.x = c.x AND o.y = c.y)")
def non_grg_anti_join(spark, sf_dir):
    c, l = _sky(spark, sf_dir)
    own = grg.with_central(c, l, KEY, SIDE, SIDE).where("skey = _central.skey")
    return quality.others(c, own, KEY).select(KEY, "skey", "x", "y")


@query(f"WITH {_COMPONENTS} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY seg_ord, ord)::INT AS n, x, y FROM components")
def union_positions(spark, sf_dir):
    return segment.union_positions(components(spark, sf_dir), KEY)


_JUDGED = f"{_FOUND}, points AS (SELECT c.vec_id, c.skey, c.x, c.y, c.ord, c.skey = f.skey AS grg FROM components c JOIN found f USING (vec_id)), omask AS (SELECT l.vec_id, l.x, l.y FROM found f JOIN owned o USING (vec_id, skey) JOIN labels l ON l.vec_id = o.vec_id AND l.island_id = o.island_id), placed AS (SELECT p.*, m.x IS NOT NULL AS inside FROM points p LEFT JOIN omask m USING (vec_id, x, y))"


def _placed(spark, sf_dir):
    """All positions of the images with a central object, with `grg` (its own ones) and `inside` (those in its mask); labels are read once, so they aren't kept."""
    c = components(spark, sf_dir)
    placed = grg.with_central(c, labels(spark, sf_dir), KEY, SIDE, SIDE).where("_central IS NOT NULL")
    return grg.in_central(placed).withColumn("grg", F.col("skey") == F.col("_central.skey")).select(*c.columns, "grg", "inside")


@query(
    f"WITH RECURSIVE {_JUDGED} SELECT vec_id, coalesce(string_agg(x || ':' || y, ',' ORDER BY NOT grg, ord) FILTER (inside), '') AS grg, coalesce(string_agg(x || ':' || y, ',' ORDER BY grg, ord) FILTER (NOT inside), '') AS other, coalesce(bool_or(grg AND NOT inside), false) AS updated FROM placed GROUP BY vec_id"
)
def clean_components(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["x"], p["y"])), ",")
    held = quality.clean_placed(_placed(spark, sf_dir), KEY)
    return held.select(KEY, text("grg").alias("grg"), text("other").alias("other"), "updated")


@query(
    f"WITH RECURSIVE {_JUDGED}, held AS (SELECT vec_id, string_agg(x || ':' || y, ',' ORDER BY NOT grg, ord) FILTER (inside) AS own, string_agg(x || ':' || y, ',' ORDER BY grg, ord) FILTER (NOT inside) AS rest, "
    "coalesce(bool_or(grg AND NOT inside), false) AS updated FROM placed GROUP BY vec_id HAVING bool_or(inside)) SELECT vec_id, own AS grg_positions, concat_ws(',', own, rest) AS all_positions, updated FROM held"
)
def cleaned_images(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda p: F.array_join(p.cast("array<string>"), ":")), ",")
    left = quality.cleaned_positions(quality.clean_placed(_placed(spark, sf_dir), KEY), KEY)
    return left.select(KEY, text("grg_positions").alias("grg_positions"), text("all_component_positions").alias("all_positions"), "updated")


@query(f"WITH RECURSIVE {_JUDGED.replace('LEFT JOIN omask m USING (vec_id, x, y)', 'LEFT JOIN omask m ON m.vec_id = p.vec_id AND m.x = (p.x + 4) % 8 AND m.y = p.y')} SELECT vec_id FROM placed GROUP BY vec_id HAVING NOT bool_or(inside)")
def clean_removed(spark, sf_dir):
    """Images that lose their object: the positions are moved by half a raster, as an object's own positions are always in its mask."""
    c, l = _sky(spark, sf_dir)
    placed = grg.with_central(c, l, KEY, SIDE, SIDE).where("_central IS NOT NULL")
    moved = grg.others_in_central(placed, l, KEY, ((F.col("x") + 4) % SIDE).cast("int"), F.col("y"))
    return quality.clean_placed(moved.withColumn("grg", F.col("skey") == F.col("_central.skey")), KEY).where("removed").select(KEY)


@query(
    f"WITH RECURSIVE {_JUDGED}, j AS (SELECT vec_id, coalesce(bool_and(inside) FILTER (grg), true) AS a, coalesce(bool_or(inside) FILTER (NOT grg), false) AS o FROM placed GROUP BY vec_id), "
    "n AS (SELECT count(*) FILTER (a AND NOT o) AS tp, count(*) FILTER (NOT (a AND NOT o)) AS fp, count(*) FILTER (NOT a) AS fn FROM j) "
    "SELECT tp, fp, fn, round(tp / greatest(tp + fp + fn, 1)::DOUBLE, 6) AS accuracy, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall FROM n"
)
def eval_metrics(spark, sf_dir):
    m = quality.metrics(quality.judge_placed(_placed(spark, sf_dir), KEY))
    return m.select("tp", "fp", "fn", *(r6(c, c) for c in ("accuracy", "precision", "recall")))


@query(f"WITH RECURSIVE {_FOUND}, a AS (SELECT f.vec_id, {_BOX}, count(*)::DOUBLE AS area FROM found f JOIN owned o USING (vec_id, skey) JOIN labels l ON l.vec_id = o.vec_id AND l.island_id = o.island_id GROUP BY f.vec_id) SELECT vec_id AS id, vec_id AS image_id, 1::BIGINT AS category_id, xmin || ',' || ymin || ',' || xmax || ',' || ymax AS bbox, area, 0 AS iscrowd FROM a")
def coco_annotations(spark, sf_dir):
    rows = coco.annotation_rows(grg_full_annotation(spark, sf_dir).select(F.col(KEY).alias("id"), F.col(KEY).alias("image_id"), "xmin", "ymin", "xmax", "ymax", "area"))
    return rows.withColumn("bbox", F.array_join(F.col("bbox").cast("array<int>"), ","))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central object of each raster with the proposals of its ten largest islands."""
    found = find_grg(spark, sf_dir).select(KEY, "skey", "contains_centre")
    return found.join(proposals.subsets(island_properties(spark, sf_dir), KEY, 10), KEY)


# --- points -----------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 425).cast("int").alias("x"), ((F.col("l_suppkey") * 7) % 425).cast("int").alias("y"))


@query(
    "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 425 AS x, (l_suppkey * 7) % 425 AS y FROM lineitem), a AS (SELECT i::INT AS angle_index, i * 45.0::DOUBLE AS angle FROM range(8) r(i)), "
    "t AS (SELECT l_orderkey, l_linenumber, angle_index, angle, round_even(sin(radians(angle)) * (y - 212.0::DOUBLE) + cos(radians(angle)) * (x - 212.0::DOUBLE) + 212 - 62.5::DOUBLE, 0)::INT AS x, "
    "round_even(cos(radians(angle)) * (y - 212.0::DOUBLE) - sin(radians(angle)) * (x - 212.0::DOUBLE) + 212 - 62.5::DOUBLE, 0)::INT AS y FROM p, a) SELECT * FROM t WHERE x BETWEEN 0 AND 299 AND y BETWEEN 0 AND 299"
)
def rotate_points(spark, sf_dir):
    return geometry.rotate_points(points(spark, sf_dir), ANGLES, 425, 425, 300, 300)


@query(
    "WITH c AS (SELECT DISTINCT p_size * 10 AS w, p_size * 7 + 20 AS h, (p_size % 24) * 15.0::DOUBLE AS angle FROM part), "
    "t AS (SELECT *, abs(sin(radians(angle))) AS s, abs(cos(radians(angle))) AS c, abs(sin(2 * radians(angle))) AS d FROM c) "
    "SELECT w, h, angle, trunc(CASE WHEN w <= h * d THEN w / (2 * c) WHEN h <= w * d THEN h / (2 * s) ELSE (w * c - h * s) / (c * c - s * s) END)::INT AS rw, "
    "trunc(CASE WHEN w <= h * d THEN w / (2 * s) WHEN h <= w * d THEN h / (2 * c) ELSE (h * c - w * s) / (c * c - s * s) END)::INT AS rh FROM t"
)
def rotated_rect(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") * 10).alias("w"), (F.col("p_size") * 7 + 20).alias("h"), ((F.col("p_size") % 24) * F.lit(15.0)).alias("angle")).distinct()
    rw, rh = geometry.inscribed_rectangle_columns(F.col("w"), F.col("h"), F.col("angle"))
    return sizes.select("w", "h", "angle", rw.alias("rw"), rh.alias("rh"))


@query(
    "WITH l AS (SELECT c_custkey AS id, c_acctbal / 10 AS x, (c_custkey % 100)::DOUBLE * 10 AS y FROM customer), r AS (SELECT s_suppkey AS id, s_acctbal / 10 AS x, (s_suppkey % 100)::DOUBLE * 10 AS y FROM supplier) "
    "SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r ON abs(l.x - r.x) <= 25 AND abs(l.y - r.y) <= 25"
)
def spatial_range_join(spark, sf_dir):
    return geometry.near_pairs(_plane(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), _plane(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"), 25.0)


_SCALE, _FIELD = 2 / 60, 300
_PLACED = (
    "cat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_partkey * 911 + l_linenumber * 13) % 36000) / 100.0::DOUBLE AS ra, ((l_suppkey * 179 + l_orderkey * 7) % 17801) / 100.0::DOUBLE - 89.0::DOUBLE AS dec FROM lineitem), "
    "cut AS (SELECT s_suppkey AS cutout, (s_suppkey * 360 % 36000) / 100.0::DOUBLE AS ra0, CASE s_suppkey % 10 WHEN 0 THEN 89.0::DOUBLE WHEN 5 THEN -89.0::DOUBLE ELSE ((s_suppkey * 5393) % 17801) / 100.0::DOUBLE - 89.0::DOUBLE END AS dec0, s_suppkey % 2 AS odd FROM supplier), "
    "turned AS (SELECT *, radians(ra - ra0) AS a, radians(dec) AS d, radians(dec0) AS d0 FROM cat, cut), "
    "facing AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a) AS f, cos(d) * sin(a) AS east, cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a) AS north FROM turned), "
    f"plane AS (SELECT *, degrees(east / CASE odd WHEN 1 THEN 1 ELSE f END) / -{_SCALE!r}::DOUBLE AS px, degrees(north / CASE odd WHEN 1 THEN 1 ELSE f END) / {_SCALE!r}::DOUBLE AS py FROM facing WHERE f > 0), "
    f"placed AS (SELECT *, round_even(150 + px, 0)::INT AS x, round_even(150 + py, 0)::INT AS y FROM plane WHERE abs(px) < 200 AND abs(py) < 200)"
)


def sky_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as components all over the sky, poles and RA 0 included; the supplier is the parent source."""
    ra = ((F.col("l_partkey") * 911 + F.col("l_linenumber") * 13) % 36000) / F.lit(100.0)
    dec = ((F.col("l_suppkey") * 179 + F.col("l_orderkey") * 7) % 17801) / F.lit(100.0) - 89.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ra.alias("ra"), dec.alias("dec"))


def sky_cutouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cutouts of ten degrees, some at RA 0 and at declinations of 89 degrees; every other one is orthographic."""
    k = F.col("s_suppkey")
    ra = (k * 360 % 36000) / F.lit(100.0)
    dec = F.when(k % 10 == 0, 89.0).when(k % 10 == 5, -89.0).otherwise(((k * 5393) % 17801) / F.lit(100.0) - 89.0)
    cards = {"CRVAL1": ra, "CRVAL2": dec, "CRPIX1": F.lit(151.0), "CRPIX2": F.lit(151.0), "CDELT1": F.lit(-_SCALE), "CDELT2": F.lit(_SCALE)}
    kind = F.when(k % 2 == 1, "RA---SIN").otherwise("RA---TAN")
    header = F.create_map(F.lit("CTYPE1"), kind, *(c for n, v in cards.items() for c in (F.lit(n), v.cast("string"))))
    return table(spark, sf_dir, "supplier").select(k.alias("cutout"), F.lit(_FIELD).alias("w"), F.lit(_FIELD).alias("h"), header.alias("header"))


@query(f"WITH {_PLACED} SELECT cutout, l_orderkey, l_linenumber, l_partkey, x, y FROM placed WHERE x BETWEEN 0 AND 299 AND y BETWEEN 0 AND 299")
def sky_cutout_join(spark, sf_dir):
    """Catalogue rows in each cutout at their pixels."""
    return sky.catalogue_pixels(sky_catalogue(spark, sf_dir), sky_cutouts(spark, sf_dir), "cutout").select("cutout", "l_orderkey", "l_linenumber", "l_partkey", "x", "y")


@query(f"WITH {_PLACED}, own AS (SELECT *, dense_rank() OVER (PARTITION BY cutout ORDER BY l_suppkey::VARCHAR) - 1 AS seg_ord FROM placed WHERE x BETWEEN 0 AND 299 AND y BETWEEN 0 AND 299) SELECT cutout, l_suppkey::VARCHAR AS skey, seg_ord::INT AS seg_ord, count(*) AS n, min(x) AS xmin, max(y) AS ymax FROM own GROUP BY ALL")
def sky_objects(spark, sf_dir):
    """Objects of each cutout, by the parent source of its catalogue rows."""
    return sky.cutout_objects(sky_catalogue(spark, sf_dir), sky_cutouts(spark, sf_dir), "l_suppkey", "l_orderkey", "cutout").select("cutout", "skey", "seg_ord", "n", "xmin", "ymax")


# --- coco: orders and lineitem ----------------------------------------------------------------------------------------


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("id"), (i - i % 8).alias("origin_id"), (i % 8 != 0).alias("rotated"), ((i % 8) * 45).cast("double").alias("rotation_angle"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("id"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir)
    return split.eligible(images(spark, sf_dir), a, a.groupBy("image_id").agg(F.count("*").alias("component_count")))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(families(spark, sf_dir), order=split.congruential_order)


_IMAGES = "images AS (SELECT o_orderkey AS id, o_orderkey - o_orderkey % 8 AS origin_id, o_orderkey % 8 <> 0 AS rotated FROM orders), annotations AS (SELECT l_orderkey AS image_id FROM lineitem), counts AS (SELECT image_id, count(*) AS stratum FROM annotations GROUP BY ALL)"
_CHOSEN = (
    f"{_IMAGES}, fam AS (SELECT id AS image_id, stratum FROM images JOIN counts ON image_id = id WHERE NOT rotated), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY (image_id * 1103515245 + 42) % 2147483648, image_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM fam), "
    "chosen AS (SELECT image_id, stratum, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o)"
)
_MEMBERS = f"{_CHOSEN}, members AS (SELECT split, id FROM chosen JOIN images ON origin_id = image_id UNION SELECT split, image_id FROM chosen)"


@query(f"WITH {_IMAGES} SELECT id FROM images WHERE EXISTS (SELECT 1 FROM annotations WHERE image_id = id)")
def images_with_annotations(spark, sf_dir):
    return images(spark, sf_dir).join(annotations(spark, sf_dir).select(F.col("image_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {_MEMBERS} SELECT l_orderkey AS image_id, l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM members WHERE split = 'val')")
def annotations_semi_join(spark, sf_dir):
    val = split.with_rotations(chosen(spark, sf_dir), images(spark, sf_dir)).where("split = 'val'").select(F.col("id").alias("image_id"))
    return annotations(spark, sf_dir).join(val, "image_id", "left_semi")


@query("SELECT a.image_id, any_value(a.id) AS first_id, any_value(o_orderstatus) AS status FROM (SELECT l_orderkey AS image_id, min(l_linenumber) AS id FROM lineitem GROUP BY ALL) a JOIN orders ON o_orderkey = image_id GROUP BY a.image_id")
def first_annotation(spark, sf_dir):
    first = annotations(spark, sf_dir).groupBy("image_id").agg(F.min("id").alias("first_id"))
    return first.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("status")), "image_id")


@query(f"WITH {_MEMBERS} SELECT * FROM members")
def origin_expand(spark, sf_dir):
    return split.with_rotations(chosen(spark, sf_dir), images(spark, sf_dir))


@query("SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem")
def id_union(spark, sf_dir):
    return images(spark, sf_dir).select("id").union(annotations(spark, sf_dir).select("image_id")).distinct()


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_orderkey // 8) AS origin_id FROM orders WHERE o_orderstatus <> 'F'")
def origin_id(spark, sf_dir):
    valid = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 8).alias("cutout"))
    return coco.origin_ids(valid, "cutout").select("id", "origin_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders WHERE o_orderstatus <> 'F'")
def sample_ids(spark, sf_dir):
    valid = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.floor(F.col("o_orderkey") / 4096).alias("bucket"))
    return coco.sample_ids(valid, ["o_orderkey"], "bucket").select("o_orderkey", "id")


@query(f"WITH {_CHOSEN} SELECT stratum AS component_count, count(*) AS n FROM fam GROUP BY ALL")
def component_histogram(spark, sf_dir):
    return families(spark, sf_dir).groupBy(F.col("stratum").alias("component_count")).agg(F.count("*").alias("n"))


@query(f"WITH {_CHOSEN} SELECT * FROM chosen")
def stratified_split(spark, sf_dir):
    return chosen(spark, sf_dir)


@query(f"WITH {_MEMBERS} SELECT split, count(DISTINCT id) AS images, coalesce(sum(c.stratum), 0)::BIGINT AS annotations FROM members LEFT JOIN counts c ON c.image_id = id GROUP BY split")
def split_summary(spark, sf_dir):
    return split.summary(origin_expand(spark, sf_dir), annotations(spark, sf_dir))


@query(
    f"WITH {_CHOSEN}, t AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') AS c FROM chosen) SELECT stratum AS component_count, "
    + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_count, CASE WHEN any_value({v}) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (split = '{s}') / any_value({v}), 1) ELSE 0 END AS {s}_percentage" for s, v in (("train", "a"), ("val", "b"), ("test", "c")))
    + " FROM chosen, t GROUP BY stratum"
)
def split_pivot(spark, sf_dir):
    return split.component_pivot(chosen(spark, sf_dir))


@query("SELECT o_orderkey AS id, 'GRG_' || lpad(o_orderkey::VARCHAR, 10, '0') || CASE WHEN o_orderkey % 8 <> 0 THEN '_rotated_angle' || (o_orderkey % 8) * 45 ELSE '' END || '_RA' || o_custkey || '_DEC' || (o_orderkey % 90) || '.png' AS file_name FROM orders")
def file_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    return o.select(i.alias("id"), sample_name("GRG", i, F.col("o_custkey"), i % 90, F.when(i % 8 != 0, (i % 8) * 45)).alias("file_name"))


@query("SELECT o_orderkey AS id, 'GRG_' || lpad(o_orderkey::VARCHAR, 10, '0') || '_RA' || o_custkey || '_DEC' || (o_orderkey % 90) || '.npz' AS file_name FROM orders", "proposal_name")
def proposal_names(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("id"), proposal_name(sample_name("GRG", i, F.col("o_custkey"), i % 90)).alias("file_name"))


# --- catalogues: customer and nation ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal AS ra, c_nationkey AS dec FROM customer WHERE c_mktsegment = 'BUILDING'")
def catalog_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_acctbal").alias("ra"), F.col("c_nationkey").alias("dec"))


@query("SELECT n_name AS field_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def mosaic_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("field_name"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").groupBy("field_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100")
def limit_ordered(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_custkey").limit(100)
