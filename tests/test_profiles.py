"""Queries of pairs of parts: against all pairs scored one by one, and on blocks too large for that."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from linkspark.operators import profiles, rank
from linkspark.plans import catalogue, link_queries
from tests.oracle import connected, rows_by_sql, rows_of

SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def folder_of(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """60 000 parts of one brand and type, three profiles: 3.6 thousand million pairs."""
    df = spark.range(60_000).select(
        F.col("id").alias("p_partkey"), F.when(F.col("id") % 3 == 0, "big bolt").otherwise("old ring").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"),
        F.when(F.col("id") % 3 == 2, 50).otherwise(1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    return folder_of(spark, tmp_path_factory.mktemp("many"), df)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Parts with repeated and missing keys, brands, names and sizes."""
    r = random.Random(7)

    def pick(*values):
        return r.choice(values)

    names = ["big bolt", "big bold", "old ring", "old rings", "The, a", "", None, "x" * 30]
    rows = [(None if r.random() < 0.03 else r.randrange(400), pick(*names), pick("b1", "b2", None), pick("t", "t", "u", None), pick(1, 2, 12, 13, 25, 50, None), 1.0) for _ in range(500)]
    return folder_of(spark, tmp_path_factory.mktemp("odd"), spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def varied(spark, tmp_path_factory):
    """Parts without nulls, which SQL and Spark order alike, of nearly as many profiles as rows."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["big", "old", "hot", "cold"]) for _ in range(r.randint(1, 3))), r.choice(["b", "c"]), r.choice("tu"), r.randint(1, 50), 1.0) for i in range(700)]
    return folder_of(spark, tmp_path_factory.mktemp("varied"), spark.createDataFrame(rows, SCHEMA))


def within(spark, seconds, run):
    """The result of ``run``, whose jobs are cancelled if they take longer, which is an error."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def agrees(spark, folder, name):
    columns, got = rows_of(catalogue.QUERIES[name](spark, folder))
    assert got and got == rows_by_sql(connected(folder), catalogue.SQL[name], columns)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_top_k_is_that_of_all_pairs(spark, odd, k):
    all_pairs = rank.top_k(link_queries.parts_scored(spark, odd), "left_key", "distance", "right_key", k)
    assert rows_of(profiles.top_k(link_queries._parts(spark, odd), link_queries.PARTS, k)) == rows_of(all_pairs)


def test_top_k_under_a_distance(spark, odd):
    all_pairs = rank.top_k(link_queries.parts_scored(spark, odd).where("distance < 0.2"), "left_key", "distance", "right_key", 2)
    assert rows_of(profiles.top_k(link_queries._parts(spark, odd), link_queries.PARTS, 2, 0.2)) == rows_of(all_pairs)


def test_topk_parts_of_varied_profiles(spark, varied):
    agrees(spark, varied, "q_topk_parts")


def test_topk_parts_of_a_large_block(spark, many):
    df = within(spark, 100, lambda: catalogue.QUERIES["q_topk_parts"](spark, many).cache())
    try:
        rows = within(spark, 100, lambda: df.where("left_key in (0, 7, 59999)").orderBy("left_key", "rank").collect())
        assert [(r.left_key, r.right_key, r.distance) for r in rows if r.left_key == 0] == [(0, k, 0.0) for k in (3, 6, 9, 12, 15)]
        assert [r.right_key for r in rows if r.left_key == 7] == [1, 4, 10, 13, 16]
        assert [r.right_key for r in rows if r.left_key == 59999] == [2, 5, 8, 11, 14]
        assert df.count() == 300_000
    finally:
        df.unpersist()


def test_similarity_pct_of_varied_profiles(spark, varied):
    agrees(spark, varied, "q_similarity_pct")


def test_similarity_pct_of_a_large_block(spark, many):
    one = within(spark, 100, lambda: catalogue.QUERIES["q_similarity_pct"](spark, many).agg(F.count("*"), F.min("percent"), F.max("colour"), F.max("right_key")).first())
    assert tuple(one) == (300_000, 100.0, "green", 17)


def test_problems_of_varied_profiles(spark, varied):
    agrees(spark, varied, "q_problems")


def test_problems_of_a_large_block(spark, many):
    one = within(spark, 100, lambda: catalogue.QUERIES["q_problems"](spark, many).agg(F.count("*"), F.max("right_key"), F.max(F.size("problems"))).first())
    assert tuple(one) == (60_000, 5, 3)


def test_pairs_are_all_pairs(spark, odd, monkeypatch):
    monkeypatch.setattr(profiles, "CHUNK", 3)
    rows, all_pairs = link_queries._parts(spark, odd), link_queries.parts_scored(spark, odd)
    assert rows_of(profiles.pairs(rows, link_queries.PARTS)) == rows_of(all_pairs)
    assert rows_of(profiles.pairs(rows, link_queries.PARTS, 0.1)) == rows_of(all_pairs.where("distance < 0.1"))


def test_auto_selected_of_odd_rows(spark, odd):
    all_pairs = rank.auto_selected(link_queries.parts_scored(spark, odd).where("distance < 0.1"), "left_key", "distance")
    assert rows_of(profiles.auto_selected(link_queries._parts(spark, odd), link_queries.PARTS, 0.1)) == rows_of(all_pairs)


def test_auto_select_of_varied_profiles(spark, varied):
    agrees(spark, varied, "q_auto_select")
    assert {r.decision for r in catalogue.QUERIES["q_auto_select"](spark, varied).collect()} == {"auto_select", "needs_review"}


def test_auto_select_of_a_large_block(spark, tmp_path):
    """60 000 parts of 200 names by 50 sizes; parts of one name up to 21 sizes apart are near."""
    name, size = F.substring(F.sha2((F.col("id") % 200).cast("string"), 256), 1, 12), (F.floor(F.col("id") / 200) % 50 + 1).cast("int")
    df = spark.range(60_000).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), size.alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    folder = folder_of(spark, tmp_path, df)
    one = within(spark, 100, lambda: catalogue.QUERIES["q_auto_select"](spark, folder).agg(F.count("*"), F.max("distance"), F.max("decision"), F.countDistinct("left_key")).first())
    assert tuple(one) == (200 * 36 * 1688 - 60_000, 0.091667, "needs_review", 60_000)


def test_extended_of_odd_rows(spark, odd):
    s = link_queries.parts_scored(spark, odd)
    all_pairs = rank.extended(rank.top_k(s, "left_key", "distance", "right_key", 3), s.withColumn("distance", F.col("distance") + 0.1), "left_key", "right_key", "distance")
    assert rows_of(profiles.extended(link_queries._parts(spark, odd), link_queries.PARTS, 3, 0.1)) == rows_of(all_pairs)


def test_dedupe_union_of_varied_profiles(spark, varied):
    agrees(spark, varied, "q_dedupe_union")


def test_dedupe_union_shuffles_no_pairs(spark, varied):
    plan = catalogue.QUERIES["q_dedupe_union"](spark, varied)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode(_keys")]
    assert "Exchange" not in above and "Aggregate" not in above


@pytest.mark.parametrize("name", ["q_topk_parts", "q_auto_select", "q_dedupe_union"])
def test_no_join_of_parts_is_broadcast(spark, varied, monkeypatch, name):
    """Files of repeated texts seem small enough for it, but their rows don't fit the driver."""
    plans, written = [], profiles.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(profiles, "written", seen)
    plans.append(catalogue.QUERIES[name](spark, varied)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_dedupe_union_takes_little_disk(spark, tmp_path):
    """4000 parts of 50 profiles in one block: pairs of two profiles stand together, so that files repeat themselves."""
    size = (F.col("id") % 50 + 1).cast("int")
    df = spark.range(4000).select(F.col("id").alias("p_partkey"), F.sha2(size.cast("string"), 256).alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), size.alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    catalogue.QUERIES["q_dedupe_union"](spark, folder_of(spark, tmp_path, df)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4000 * 3999
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 4000 * 3999
