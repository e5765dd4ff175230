"""Edits over large tables: what is joined, shuffled and made, and the short ways of texts."""

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cadenza import schema
from cadenza.functions import hashing, text
from cadenza.operators import edit
from cadenza.sources import store


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return schema.conform(spark.createDataFrame([Row(**r) for r in rows]))


def test_restore_meets_the_table_once(spark):
    df = table(spark, [{"path": f"/m/{k}.mp3", "year": 1990 + k, "title": f"t{k}"} for k in range(4)])
    entries = spark.createDataFrame([("/m/1.mp3", {"year": "1950", "comment": " old "}, None, None), ("/m/2.mp3", {"title": None, "year": "1992"}, None, None)], "path string, fields map<string,string>, source string, art string")
    back = edit.restore(df, entries)
    assert [(r.year, r.title, r.comment) for r in back.orderBy("path").collect()] == [(1990, "t0", ""), (1950, "t1", "old"), (1992, "", ""), (1993, "t3", "")]
    assert len(re.findall(r"\bJoin ", back._jdf.queryExecution().optimizedPlan().toString())) == 2  # fields, and names


def test_dirty_shuffles_paths_and_hashes(spark):
    rows = [{"path": f"/m/{k}.mp3", "title": f"t{k}", "comment": "x"} for k in range(5)]
    saved = table(spark, rows).withColumn("comment", F.when(F.col("path") == "/m/3.mp3", F.lit(None)).otherwise(F.col("comment")))
    now = saved.withColumn("title", F.when(F.col("path") == "/m/1.mp3", "").otherwise(F.col("title"))).withColumn("comment", F.when(F.col("path") == "/m/2.mp3", F.lit(None)).otherwise(F.col("comment")))
    now = now.withColumn("path", F.when(F.col("path") == "/m/4.mp3", "/m/5.mp3").otherwise(F.col("path")))
    found = edit.dirty(now, saved)
    assert sorted(r.path for r in found.collect()) == ["/m/1.mp3", "/m/2.mp3", "/m/5.mp3"] and found.columns == now.columns
    swapped = saved.withColumns({"artist": F.lit(None).cast("string"), "album": F.lit("a")}), saved.withColumns({"artist": F.lit("a"), "album": F.lit(None).cast("string")})
    assert edit.dirty(*swapped).count() == 5 and edit.dirty(swapped[0], swapped[0]).count() == 0
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = edit.dirty(now, saved)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    keys = re.findall(r"hashpartitioning\(([^()]*)\)", shown)
    assert len(keys) == 2 and all(k.count(",") == 1 for k in keys), shown  # one key and the number of partitions


def test_rename_makes_no_ids_before_they_are_asked(spark):
    df = table(spark, [{"path": "/m/1.mp3", "title": "One", "artist": "A"}, {"path": "/m/2.mp3", "title": " -Two. ", "artist": "B "}, {"path": "/m/3.mp3", "title": "AC/DC", "artist": " "}])
    there = set(store.names_in(spark, store.shared_dir(spark)))
    plan = edit.plan_rename(df, "$artist/$title", ("/m",))
    made = [n for n in store.names_in(spark, store.shared_dir(spark)) if n not in there]
    assert [spark.read.parquet(f"{store.shared_dir(spark)}/{n}").columns for n in made] == [["path", "dest", "complete"]]
    assert [(r.status, r.dest) for r in plan.orderBy("path").collect()] == [("changed", "/m/A/One.mp3"), ("changed", "/m/B/Two.mp3"), ("incomplete", "/m/AC-DC.mp3")]
    assert [r.id for r in plan.orderBy("path").collect()] == [r.i for r in df.select(hashing.track_id(F.col("path")).alias("i"), "path").orderBy("path").collect()]


def test_texts_that_need_no_trimming_are_as_if_trimmed(spark):
    odd = ["", "a", " a", "a\n", "a ", " a", "é", "é ", "\x1fa", "~", "a\x7f", "a b", "\t", "-a/b", "a/b_", "a/ b", "a/.b", "a./b", "a//b", "/a", "a/", "a - /b", "a. /b", "..", "a/b"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    slow = F.array_join(F.filter(F.transform(F.split("x", "/"), lambda s: F.regexp_replace(text.trim(F.regexp_replace(text.trim(s), r"^[ \-_]+|[ \-_]+\z", "")), r"[.]+\z", "")), lambda s: s != ""), "/")
    wrong = df.where((text.trim_column(F.col("x")) != text.trim(F.col("x"))) | (text.tidy_path(F.col("x")) != slow)).collect()
    assert not wrong
