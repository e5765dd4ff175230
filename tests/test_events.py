from pyspark.sql import functions as F

from cadenza.streaming import events as ev


def made(spark, n, epoch="e"):
    return ev.numbered(spark.range(n).select(F.lit(epoch).alias("epoch"), F.col("id").alias("at"), "id", F.lit("t").alias("type")))


def test_replay(spark):
    few = made(spark, 3).cache()
    assert [r.seq for r in ev.replay(few, "e", 1).orderBy("seq").collect()] == [2, 3]
    assert [(r.type, r.missed) for r in ev.replay(few, "other", 1).collect()] == [("gap", -1)]
    assert ev.replay(few, "e", 3).count() == 0
    many = ev.history(made(spark, 266)).cache()
    assert many.count() == 256
    assert [(r.type, r.missed) for r in ev.replay(many, "e", 1).collect()] == [("gap", 9)]


def test_limits(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 1, 60, 60.5, 61)], "k string, at double")
    assert [r.used for r in ev.in_window(df, "k").orderBy("at").collect()] == [1, 2, 2, 3, 3]
    slots = [round(r.slot, 3) for r in ev.spaced(df, "k").orderBy("at").collect()]
    assert slots == [0.0, 1.1, 60.0, 61.1, 62.2]
    r = spark.range(1).select(ev.remaining(F.lit(50), 60).alias("a"), ev.remaining(F.lit(5), 60, F.lit(20), F.lit(18)).alias("b"), ev.remaining(F.lit(99), 60).alias("c")).first()
    assert tuple(r) == (10, 2, 0)


def test_one_hot_key_is_dealt_out(spark):
    """A key with a million requests, bursts among them: as many window groups as it has minutes, and what a plain window gives."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), "id", (F.floor(F.col("id") / 7) * 0.137 + F.when(F.col("id") % 50_000 < 3_000, 0).otherwise(F.col("id") % 3 * 0.01)).alias("at"))
    used = ev.in_window(df, "k")
    from pyspark.sql import Window

    micros = F.round(F.col("at") * 1_000_000).cast("long")
    plain = df.withColumn("used", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy(micros).rangeBetween(1 - 60_000_000, 0)))
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum("used"), F.bit_xor(F.xxhash64("id", "used"))).first())
    assert mark(used) == mark(plain)
    few = df.where("id < 50000")
    order = Window.partitionBy("k").orderBy("at")
    rows = few.withColumn("n", F.row_number().over(order).cast("double"))
    slots = rows.withColumn("slot", F.max(F.col("at") - F.col("n") * 0.1).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n") * 0.1)
    total = lambda x: x.agg(F.count(F.lit(1)), F.round(F.sum("slot"), 3), F.round(F.max("slot"), 3)).first()
    assert total(ev.spaced(few, "k", gap=0.1, block=60.0)) == total(slots)


def test_limits_without_key_or_time(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", -30.0), ("a", 29.999999), ("a", 30.0)], "k string, at double")
    assert sorted(((r.k, r.at, r.used) for r in ev.in_window(df, "k").collect()), key=str) == sorted([(None, 1.0, 1), (None, 2.0, 2), ("a", None, None), ("a", -30.0, 1), ("a", 29.999999, 2), ("a", 30.0, 2)], key=str)
    assert {(r.k, r.at): r.slot for r in ev.spaced(df, "k", gap=1.5).collect()} == {(None, 1.0): 1.0, (None, 2.0): 2.5, ("a", None): None, ("a", -30.0): -30.0, ("a", 29.999999): 29.999999, ("a", 30.0): 31.499999}


def test_jobs(spark):
    jobs = spark.createDataFrame([("1", "scan", "done", 1, 5), ("2", "scan", "done", 2, 4), ("3", "set", "running", 3, None)], "id string, kind string, state string, created long, finished long")
    assert [(r.kind, r.id) for r in ev.latest_of_kind(jobs).collect()] == [("scan", "1")]
    assert [r.id for r in ev.job_page(jobs, state="done", limit=1).collect()] == ["2"]
    assert [r.id for r in ev.job_page(jobs, limit=-1).collect()] == ["3", "2", "1"]


def test_published_stream_answers_from_its_ring(spark, tmp_path):
    import json

    src, kind = f"{tmp_path}/in", "epoch string, id long, type string, after long, known string"

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)

    arrive([("e", k, f"t{k}", None, None) for k in range(6)] + [("e", 90, "sub", 3, "e")])
    arrive([("e", k, f"t{k}", None, None) for k in range(6, 9)] + [("e", 91, "sub", 2, "e"), ("e", 92, "sub", 9, "e"), ("e", 93, "sub", 1, "old"), ("e", 94, "sub", 0, None), ("e", 95, "sub", 5, "e"), ("f", 7, "t", None, None)])
    stream = ev.published(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src), keep=4)
    q = ev.delivered(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    rows = [json.loads(x) for f in (tmp_path / "out").glob("batch=*/*.json") for x in f.read_text().splitlines()]
    to_all = sorted((r["event_id"], r["type"]) for r in rows if "subscriber" not in r)
    assert to_all == sorted([(f"e:{k + 1}", f"t{k}") for k in range(9)] + [("f:1", "t")])
    told = sorted((r["subscriber"], r["type"], r["seq"], r.get("missed")) for r in rows if "subscriber" in r)
    assert told == [(90, "t3", 4, None), (90, "t4", 5, None), (90, "t5", 6, None), (91, "gap", 9, 3), (93, "gap", 9, -1), (95, "t5", 6, None), (95, "t6", 7, None), (95, "t7", 8, None), (95, "t8", 9, None)]


def test_stream_numbers_on(spark, tmp_path):
    src, kind = f"{tmp_path}/in", "epoch string, id long, type string"
    spark.createDataFrame([("e", k, "t") for k in range(4)] + [("f", 9, "t")], kind).coalesce(1).write.parquet(src)
    spark.createDataFrame([("e", k, "t") for k in range(4, 7)], kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = ev.sequenced(stream).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.epoch, r.seq) for r in spark.table("numbered").collect())
    assert got == [("e", k) for k in range(1, 8)] + [("f", 1)]
