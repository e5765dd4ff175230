import random

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import events as ev
from cadenza.streaming import state

#: Time starts after 1970, as what is not after a watermark of zero is late.
START = 1000
ASKED = "key string, at double, id long, kind string, amount double, cap long"


class Feed:
    """Batches of rows that a stream takes one after another; what comes out is kept in order."""

    def __init__(self, spark, folder, kind, make):
        self.spark, self.folder, self.kind, self.make, self.n = spark, folder, kind, make, 0

    def run(self, *batches):
        for rows in batches:
            df = self.spark.createDataFrame(rows, self.kind).withColumn("ts", F.timestamp_micros(F.round((F.col("at") + START) * 1_000_000).cast("long"))).drop("at")
            df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
            stream = self.spark.readStream.schema(df.schema).parquet(f"{self.folder}/in")
            q = self.make(stream).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/cp").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
        return self.spark.read.parquet(f"{self.folder}/out")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_window_limiter_equals_its_batch_twin(spark, tmp_path):
    """State carries over from run to run of the query; without refusals what is left is the limit less the batch count."""
    rnd = random.Random(1)
    times = sorted({round(rnd.uniform(0, 300), 3) for _ in range(60)})
    rows = [(rnd.choice("ab"), t, n, "take", None, None) for n, t in enumerate(times)]
    got = Feed(spark, str(tmp_path), ASKED, lambda s: state.limited(s, 1000)).run(rows[:20], rows[20:45], rows[45:])
    twin = ev.in_window(spark.createDataFrame(rows, ASKED), "key")
    assert {r.id: r.remaining for r in got.where("answer = 'granted'").collect()} == {r.id: 1000 - r.used for r in twin.collect()}


def test_window_limiter_waits_refuses_and_listens(spark, tmp_path):
    take = lambda n, t: ("k", float(t), n, "take", None, None)
    feed = Feed(spark, str(tmp_path), ASKED, lambda s: state.limited(s, 3))
    one = [take(1, 0), take(2, 1), take(3, 2), take(4, 10), take(5, 58)]  # 4 would wait 50 s, 5 waits 2 s
    two = [take(6, 70), ("k", 71.0, 7, "observed", 1.0, 5), take(8, 72), take(9, 73), take(10, 131.5)]  # the server says that one is left of five
    three = [("other", 500.0, 11, "take", None, None)]  # a watermark that passes: k has been idle for a window
    got = {(r.id if r.id is not None else r.key): (r.answer, round(r.slot - START, 1), r.remaining) for r in feed.run(one, two, three, [("other", 501.0, 12, "take", None, None)]).collect()}
    assert got.pop("k")[0::2] == ("refilled", 5)
    assert got == {
        1: ("granted", 0.0, 2), 2: ("granted", 1.0, 1), 3: ("granted", 2.0, 0), 4: ("refused", 60.0, 0), 5: ("granted", 60.0, 0), 6: ("granted", 70.0, 1), 8: ("granted", 72.0, 0), 9: ("refused", 120.0, 0),
        10: ("granted", 131.5, 3), 11: ("granted", 500.0, 2), 12: ("granted", 501.0, 1),
    }


def test_spaced_limiter(spark, tmp_path):
    rows = [("k", t, n, "take", None, None) for n, t in enumerate((0.0, 0.1, 0.2, 0.25, 0.5, 9.0))] + [("k", 9.5, 6, "back_off", 2.5, None), ("k", 9.6, 7, "take", None, None), ("k", 9.7, 8, "take", None, None)]
    got = {r.id: (r.answer, round(r.slot - START, 3)) for r in Feed(spark, str(tmp_path), ASKED, state.paced).run(rows[:4], rows[4:]).collect()}
    assert got == {0: ("granted", 0.0), 1: ("granted", 1.1), 2: ("granted", 2.2), 3: ("refused", 3.3), 4: ("granted", 3.3), 5: ("granted", 9.0), 7: ("granted", 12.0), 8: ("refused", 13.1)}


def test_cache_expires_without_a_new_row_and_evicts_the_first(spark, tmp_path):
    kind = "key string, at double, id long, kind string, entry string, value string"
    put, get = lambda n, t, e, v=None: ("c", float(t), n, "put", e, v), lambda n, t, e: ("c", float(t), n, "get", e, None)
    feed = Feed(spark, str(tmp_path), kind, lambda s: state.cached(s, ttl=100.0, size=3))
    one = [put(1, 0, "a", "A"), put(2, 1, "b", "B"), get(3, 2, "a"), put(4, 3, "a", "A2"), put(5, 4, "c", "C"), put(6, 5, "d", "D"), get(7, 6, "a"), get(8, 6, "b")]  # a came first, so it goes for d
    two = [("other", 150.0, 9, "get", "x", None)]
    got = feed.run(one, two, [("other", 151.0, 10, "get", "x", None)])
    assert {r.id: (r.answer, r.value) for r in got.where("id is not null").collect()} == {3: ("hit", "A"), 7: ("miss", None), 8: ("hit", "B"), 9: ("miss", None), 10: ("miss", None)}
    assert sorted((r.entry, r.answer) for r in got.where("id is null").collect()) == [("a", "evicted"), ("b", "expired"), ("c", "expired"), ("d", "expired")]


def test_hub(spark, tmp_path):
    """Resuming, a restart, beyond the history, no resume, a job's stream, a slow subscriber and keep-alives."""
    kind = "epoch string, at double, id long, kind string, subscriber long, type string, job string, known string, after long"
    clock = iter(range(1, 10_000))

    def row(what, who=None, type=None, job=None, known=None, after=None):
        n = next(clock)
        return ("e", n / 100, n, what, who, type, job, known, after)

    one = [row("event", type=f"t{k}", job="j1" if k % 2 else "j2") for k in range(1, 13)]
    one += [row("subscribe", 1, known="e", after=10), row("subscribe", 2, known="old", after=3), row("subscribe", 3, known="e", after=1), row("subscribe", 4), row("subscribe", 5, job="j1", known="e", after=9), row("subscribe", 6, known="e", after=12), row("subscribe", 7, job="j1", known="e", after=1)]
    two = [row("event", type=f"t{k}", job="j1" if k % 2 else "j2") for k in range(13, 17)] + [row("read", 1)] + [row("event", type="t17", job="j1"), row("leave", 2), row("event", type="t18", job="j2")]
    late = [("f", 60.0, 1, "event", None, "x", None, None, None)]
    feed = Feed(spark, str(tmp_path), kind, lambda s: state.handed(s, keep=8, behind=3))
    got = feed.run(one, two, late, [("f", 61.0, 2, "event", None, "x", None, None, None)])
    told = {}
    for r in got.where("epoch = 'e'").orderBy(F.col("seq").asc_nulls_last()).collect():
        told.setdefault(r.subscriber, []).append((r.type, r.missed if r.type == "gap" else r.seq))
    alive = {who: sum(t == "keep-alive" for t, _ in rows) for who, rows in told.items()}
    told = {who: [x for x in rows if x[0] != "keep-alive"] for who, rows in told.items()}
    assert told == {
        1: [("t11", 11), ("t12", 12), ("t13", 13), ("t14", 14), ("t15", 15), ("t17", 17), ("t18", 18)],  # it had three to read when t16 came
        2: [("gap", -1), ("t13", 13), ("t14", 14), ("t15", 15)], 3: [("gap", 3), ("t13", 13), ("t14", 14), ("t15", 15)], 4: [("t13", 13), ("t14", 14), ("t15", 15)],
        5: [("t11", 11), ("t13", 13), ("t15", 15)], 6: [("t13", 13), ("t14", 14), ("t15", 15)], 7: [("gap", 3), ("t13", 13), ("t15", 15)],
    }
    assert alive.get(2, 0) == 0 and {alive[k] for k in (1, 3, 4, 5, 6, 7)} <= {1, 2} and alive[1] >= 1
