from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyframe import queries as q
from skyframe.operators import grg, segment
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, duck, same, name):
    same(q.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(q.ORACLES[name]).df())


def test_components_cover_every_raster(spark, tmp_path):
    sf, ids = f"{DATA}/sf0.001", [3, 499, 500, 731, 1400]
    rasters = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 5")
    rasters.selectExpr(f"element_at(array({','.join(f'{i}L' for i in ids)}), cast(vec_id as int) + 1) AS vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(r.l_orderkey, r.n) for r in lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).collect() if r.l_orderkey in ids}
    got = q.union_positions(spark, str(tmp_path)).groupBy("vec_id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == want
    assert max(i for i, _ in want) >= 500
    assert {r.vec_id for r in q.segment_size(spark, str(tmp_path)).collect()} == {i for i, _ in want}


def test_flagship_has_rows_and_schema(spark):
    df = q.flagship(spark, f"{DATA}/sf0.001")
    assert df.columns == ["vec_id", "skey", "contains_centre", "members", "size", "xmin", "ymin", "xmax", "ymax", "score"]
    assert df.limit(5).count() > 0


def test_rle_strings_decode_to_the_runs(spark):
    def decode(s):
        out, i = [], 0
        while i < len(s):
            x = k = 0
            more = True
            while more:
                c = ord(s[i]) - 48
                x |= (c & 31) << 5 * k
                more, i, k = bool(c & 32), i + 1, k + 1
                if not more and c & 16:
                    x |= -1 << 5 * k
            out.append(x + (out[-2] if len(out) > 2 else 0))
        return out

    sf = f"{DATA}/sf0.001"
    runs = q.rle_runs(spark, sf).toPandas().sort_values(["vec_id", "run"]).groupby("vec_id").length.apply(list)
    strings = q.rle_strings(spark, sf).toPandas().set_index("vec_id").counts
    assert all(decode(strings[k]) == runs[k] for k in runs.index)


@pytest.mark.parametrize("name", ["clean_components", "cleaned_images", "clean_removed"])
def test_lines_of_other_orders_are_not_shuffled(spark, duck, same, monkeypatch, name):
    """Before, a table of ids over the broadcast threshold had all of lineitem shuffled, once for each of its twelve uses."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sf = f"{DATA}/sf0.001"
        plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 2 and plan.count("LeftSemi, BuildRight") == plan.count("lineitem.parquet") > 0
        assert "BroadcastHashJoin [l_orderkey" in plan and plan.count("Exchange hashpartitioning") <= 16
        monkeypatch.setattr(q, "SENT_IDS", 0)  # ids too many to send: the same rows by a shuffle
        held = q.QUERIES[name](spark, sf)
        assert "BroadcastHashJoin" not in held._jdf.queryExecution().executedPlan().toString()
        same(held.toPandas(), duck.execute(q.ORACLES[name]).df())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "exchanges"), [("cleaned_images", 1), ("clean_components", 1), ("eval_metrics", 1), ("clean_removed", 2)])
def test_cleaning_sends_lines_and_pixels_once(spark, name, exchanges):
    """Before, masks were joined to the points again, so lines were read and segments settled twice, with up to 16 exchanges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= exchanges


def test_positions_in_the_central_mask_equal_a_join_of_its_pixels(spark):
    spots = [(k, f"s{s}", s, i, (k * 5 + s * 3 + i * 7) % 8, (k + s + i * 3) % 8) for k in range(12) for s in range(3) for i in range(4)]
    comps = spark.createDataFrame(spots, "k int, skey string, seg_ord int, ord int, x int, y int")
    pixels = [(k, x, y, 10 * (x // 3) + y // 2) for k in range(11) for x in range(8) for y in range(8) if (x + k) % 3 != 2]  # image 11 has none
    labels = spark.createDataFrame(pixels, "k int, x int, y int, island_id long")
    placed = grg.with_central(comps, labels, "k", 8, 8)
    mask = labels.join(grg.central_islands(placed, "k"), ["k", "island_id"])
    want = segment.points_in_mask(comps, mask, "k").select(*comps.columns, "inside").collect()
    assert sorted(grg.in_central(placed).select(*comps.columns, "inside").collect()) == sorted(want)
    assert {r.inside for r in want} == {True, False} and len(want) == len(spots)
    others = comps.withColumn("x", (F.col("x") + 3) % 9).withColumn("y", F.when(F.col("y") > 0, F.col("y")))  # some outside, some null
    want = segment.points_in_mask(others, mask, "k").select("k", "skey", "ord", "inside").collect()
    got = grg.others_in_central(placed, labels.unionByName(labels.limit(0)), "k", (F.col("x") + 3) % 9, F.when(F.col("y") > 0, F.col("y")))
    assert got.columns == [*placed.columns, "inside"] and sorted(got.select("k", "skey", "ord", "inside").collect()) == sorted(want)
    assert {r.inside for r in want} == {True, False}


def test_settled_odd_rows(spark):
    """Null keys and positions meet no island (also not labels without a key), repeated rows stay, types and columns are the components' own."""
    rows = [(1, 1, 1, "a", 0), (1, 1, 1, "a", 0), (1, None, 1, "a", 0), (1, 5, 5, "b", 1), (None, 1, 1, "a", 0), (2, 1, 1, "a", 0)]
    comps = spark.createDataFrame([(*r, {"p": 1}) for r in rows], "k int, x int, y int, skey string, seg_ord int, extra map<string,int>").select("skey", "k", "y", "extra", "x", "seg_ord")
    labels = spark.createDataFrame([(1, 1, 1, 7), (1, 2, 1, 7), (1, None, 1, 9), (None, 1, 1, 8), (2, 1, 1, None)], "k int, x int, y int, island_id long")
    got = segment.settled(comps, labels, "k")
    assert got.columns[:6] == comps.columns and [f.dataType for f in got.schema.fields[:6]] == [f.dataType for f in comps.schema.fields]
    seen = sorted((str(r.k), str(r.x), r.skey, r._island, r._size, r._positions, tuple(r._box) if r._box else None) for r in got.collect())
    box = (1, 1, 2, 1)
    assert seen == sorted([("1", "1", "a", 7, 2, 3, box), ("1", "1", "a", 7, 2, 3, box), ("1", "None", "a", None, 2, 3, box), ("1", "5", "b", None, 0, 1, None), ("None", "1", "a", None, 0, 1, None), ("2", "1", "a", None, 0, 1, None)])


def test_settled_segments_equal_plain_python(spark):
    spots = [(k, f"s{s}", s, i, (k * 5 + s * 3 + i * 7) % 8, (k + s + i * 3) % 4) for k in range(6) for s in range(3) for i in range(4)]
    comps = spark.createDataFrame(spots, "k int, skey string, seg_ord int, ord int, x int, y int")
    pixels = {(k, x, y): 10 * (x // 3) + y // 2 for k in range(5) for x in range(8) for y in range(4) if x % 3 != 2}  # image 5 has none
    labels = spark.createDataFrame([(*p, i) for p, i in pixels.items()], "k int, x int, y int, island_id long")
    got = {(r.k, r.skey, r.ord): r for r in segment.settled(comps, labels.unionByName(labels.limit(0)), "k").collect()}
    assert len(got) == len(spots) and segment.settled(comps, labels.unionByName(labels), "k").count() == len(spots)
    for k in range(6):
        area = {i: sum(j == i and p[0] == k for p, j in pixels.items()) for i in pixels.values()}
        hit = {s: {pixels[k, x, y] for kk, name, _, _, x, y in spots if kk == k and name == s and (k, x, y) in pixels} for s in ("s0", "s1", "s2")}
        ranks = sorted(hit, key=lambda s: (-sum(area[i] for i in hit[s]), s))
        owner = {i: next(s for s in ranks if i in hit[s]) for s in hit for i in hit[s]}
        for _, s, _, o, x, y in (p for p in spots if p[0] == k):
            r, own = got[k, s, o], [p for p, i in pixels.items() if p[0] == k and owner.get(i) == s]
            assert (r._island, r._size, r._rank, r._positions) == (pixels.get((k, x, y)), sum(area[i] for i in hit[s]), ranks.index(s) + 1, 4)
            assert (r._owner.skey if r._owner else None) == owner.get(pixels.get((k, x, y)))
            assert (tuple(r._box) if r._box else None) == ((*(min(p[a] for p in own) for a in (1, 2)), *(max(p[a] for p in own) for a in (1, 2))) if own else None)
