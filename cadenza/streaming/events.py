"""The change stream: numbered events, replay with gaps, and rate limits; as tables and as streams.

As a table, events are numbered within an epoch in order of time. As a stream, sequenced() keeps the
last number of each epoch in state, and published() its last HISTORY events too, from which it answers
subscribers that resume: with what they missed, or one gap event where history no longer reaches back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_dir

HISTORY = 256


def numbered(events: DataFrame, epoch: str = "epoch", at: str = "at", id: str = "id") -> DataFrame:
    """events with seq, from 1 within an epoch.

    Counted within blocks of time order and then over blocks: an epoch of any size is dealt out over range partitions,
    which are written once, and only the blocks' sizes come together.
    """
    spark, path = events.sparkSession, f"{shared_dir(events.sparkSession)}/numbered-{uuid.uuid4().hex}"
    dealt = events.repartitionByRange(epoch, at, id).withColumn("__b", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("__n", F.row_number().over(Window.partitionBy("__b", epoch).orderBy(at, id)))
    sizes = spark.read.schema(dealt.schema).parquet(path).groupBy("__b", epoch).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(epoch).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__b", F.col(epoch).alias("__e"), before.alias("__before"))
    met = rows.join(sizes.withColumnRenamed("__b", "__c"), (F.col("__b") == F.col("__c")) & F.col(epoch).eqNullSafe(F.col("__e")))
    return met.withColumn("seq", F.col("__n") + F.col("__before")).select(*events.columns, "seq")


def history(seq: DataFrame, keep: int = HISTORY, epoch: str = "epoch") -> DataFrame:
    """The last events of each epoch, by their numbers."""
    last = seq.groupBy(epoch).agg(F.max("seq").alias("__last"))
    return seq.join(last, epoch).where(F.col("seq") > F.col("__last") - keep).drop("__last")


def replay(kept: DataFrame, epoch: str, after: int, of: str = "epoch", current: str | None = None) -> DataFrame:
    """What a subscriber that saw `after` of `epoch` gets: (type, seq, missed).

    current is the epoch that runs now: without it, any epoch that has a history will do. Of another epoch,
    one gap of -1; nothing if it is up to date; one gap of what is lost where history starts later; else the
    events it has not seen.
    """
    if current is not None:
        kept = kept.where(F.col(of) == current)
    elif not kept.where(F.col(of) == epoch).isEmpty():
        kept = kept.where(F.col(of) == epoch)
    ends = kept.agg(F.max(of).alias("now"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    missed = F.when(F.col("now") != epoch, F.lit(-1)).when(F.col("low") > after + 1, F.col("low") - after - 1)
    gap = ends.withColumn("missed", missed.cast("long")).where("missed is not null").select(F.lit("gap").alias("type"), F.col("high").alias("seq"), "missed")
    rest = kept.join(ends, F.lit(True)).where((F.col("now") == epoch) & (F.col("low") <= after + 1) & (F.col("seq") > after)).select("type", "seq", F.lit(None).cast("long").alias("missed"))
    return gap.unionByName(rest)


def in_window(events: DataFrame, by: str, at: str = "at", seconds: int = 60) -> DataFrame:
    """events with used: how many of the same key fall in the window that ends with each, itself included.

    at is a number of seconds; what is exactly `seconds` old is out, and without a time used is null. A key's time is cut into blocks as long
    as the window, each summed by itself: what comes in it, less what came in the block before as that runs out, over that block's
    total. So one key, however busy, is dealt out over as many tasks as it has blocks, and equal times are one row.
    """
    width = seconds * 1_000_000
    t, start = F.round(F.col(at) * 1_000_000).cast("long"), F.col("__t") - F.pmod("__t", F.lit(width))
    counts = events.select(F.col(by).alias("__k"), t.alias("__t")).where("__t is not null").groupBy("__k", "__t").agg(F.count(F.lit(1)).alias("__d")).withColumn("__s", start)
    leave = counts.select("__k", F.col("__t") + width, -F.col("__d"), F.col("__s") + width)
    carried = counts.groupBy("__k", "__s").agg(F.sum("__d").alias("__d")).select("__k", F.col("__s") + width - 1, "__d", F.col("__s") + width)
    deltas = counts.union(leave).union(carried).groupBy("__k", "__s", "__t").agg(F.sum("__d").alias("__d"), F.max("__d").alias("__most"))
    running = F.sum("__d").over(Window.partitionBy("__k", "__s").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0))
    used = deltas.withColumn("used", running).where("__most > 0").select("__k", "__t", "used", "__s").where(F.col("__t") >= F.col("__s")).drop("__s")
    return events.withColumn("__at", t).join(used, F.col(by).eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__t")), "left").select(*events.columns, "used")


def remaining(used: Column, limit: int, server: Column | None = None, spent: Column | None = None) -> Column:
    """What a limiter still allows: the less of its own count and the server's last word less what was spent since."""
    own = F.greatest(F.lit(limit) - used, F.lit(0))
    return own if server is None else F.least(own, F.greatest(server - F.coalesce(spent, F.lit(0)), F.lit(0)))


def spaced(events: DataFrame, by: str, at: str = "at", gap: float = 1.1, block: float = 3600.0) -> DataFrame:
    """events with slot: the time at which each may go, `gap` seconds after the one before at least.

    slot_n = max(t_n, slot_(n-1) + gap) is n * gap + the running maximum of t_k - k * gap. Counts and maxima are taken within blocks of
    time and then over blocks, so one key is dealt out over many tasks. Without a time there is no slot.
    """
    k, t = F.col(by).alias("__k"), F.col(at).cast("double").alias("__t")
    counts = events.select(k, t).where("__t is not null").groupBy("__k", "__t").agg(F.count(F.lit(1)).alias("__m")).withColumn("__s", F.floor(F.col("__t") / block))
    whole, within = Window.partitionBy("__k").orderBy("__s"), Window.partitionBy("__k", "__s").orderBy("__t")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("__k", "__s").agg(F.sum("__m").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(earlier(whole)), F.lit(0)))
    same = lambda a, b: a["__k"].eqNullSafe(b["__k2"]) & (a["__s"] == b["__s2"])
    named = lambda df, *cols: df.select(F.col("__k").alias("__k2"), F.col("__s").alias("__s2"), *cols)
    sized = named(sizes, "__before")
    rows = counts.join(sized, same(counts, sized)).withColumn("__c", F.col("__before") + F.coalesce(F.sum("__m").over(earlier(within)), F.lit(0)))
    rows = rows.withColumn("__v", F.col("__t") - (F.col("__c") + 1) * gap).select("__k", "__s", "__t", "__c", "__v")
    tops = rows.groupBy("__k", "__s").agg(F.max("__v").alias("__top")).withColumn("__over", F.max("__top").over(earlier(whole)))
    topped = named(tops, "__over")
    slots = rows.join(topped, same(rows, topped)).withColumn("__max", F.greatest("__over", F.max("__v").over(within.rowsBetween(Window.unboundedPreceding, 0)))).select("__k", "__t", "__c", "__max")
    numbered_ = events.withColumns({"__at": F.col(at).cast("double"), "__j": F.row_number().over(Window.partitionBy(by, at).orderBy(F.lit(1)))})
    met = numbered_.join(slots, F.col(by).eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__t")), "left")
    return met.withColumn("slot", F.col("__max") + (F.col("__c") + F.col("__j")) * gap).select(*events.columns, "slot")


def alive(rows: DataFrame, now: Column, ttl: int, at: str = "at") -> DataFrame:
    """Entries of a cache that are younger than ttl seconds."""
    return rows.where(now - F.col(at) < ttl)


def latest_of_kind(jobs: DataFrame) -> DataFrame:
    """The job of each kind that finished last."""
    return jobs.where("finished is not null").groupBy("kind").agg(F.max_by("id", F.struct("finished", "id")).alias("id"), F.max("finished").alias("finished"))


def job_page(jobs: DataFrame, kind: str | None = None, state: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Jobs, filtered and then paged, newest first; limit -1 is all."""
    rows = jobs.where(F.lit(kind is None) | (F.col("kind") == F.lit(kind))).where(F.lit(state is None) | (F.col("state") == F.lit(state))).orderBy(F.desc("created"), "id").offset(offset)
    return rows if limit < 0 else rows.limit(limit)


def sequenced(stream: DataFrame, epoch: str = "epoch") -> DataFrame:
    """A stream of events (epoch, id, type) with seq: state per epoch is the last number."""

    def number(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in pdfs:
            pdf = pdf.sort_values("id")
            seq = range(n + 1, n + 1 + len(pdf))
            n += len(pdf)
            yield pd.DataFrame({"epoch": key[0], "id": pdf["id"], "type": pdf["type"], "seq": seq})
        state.update((n,))

    return stream.groupBy(epoch).applyInPandasWithState(number, "epoch string, id long, type string, seq long", "n long", "append", "NoTimeout")


def published(stream: DataFrame, keep: int = HISTORY) -> DataFrame:
    """A stream of events and subscriptions, numbered and answered.

    In: epoch, id, type; a subscription has its subscriber's id and `after`, the last number it knows, of the
    epoch `known` (without one it has nothing to make up for). Out: epoch, subscriber (null: for all), seq, id, type, missed. A batch's events come first,
    then its subscriptions are answered up to there; who subscribes follows the events of later batches.
    State per epoch is its last number and its last `keep` events.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, ids, types = state.get if state.exists else (0, (), ())
        rows = pd.concat(list(pdfs))
        asked = rows["after"].notna()
        events = rows[~asked].sort_values(["id", "type"])
        out = [(key[0], None, n + k, i, t, None) for k, (i, t) in enumerate(zip(events["id"], events["type"], strict=True), 1)]
        n += len(events)
        ids, types = [*ids, *events["id"].tolist()][-keep:], [*types, *events["type"].tolist()][-keep:]
        first = n - len(ids) + 1
        for who, after, known in rows[asked & rows["known"].fillna("").ne("")].sort_values(["id", "after"])[["id", "after", "known"]].itertuples(index=False):
            missed = -1 if known != key[0] else first - int(after) - 1
            if known != key[0] or after < first - 1:
                out.append((key[0], who, n, None, "gap", missed))
            else:
                out += [(key[0], who, s, ids[s - first], types[s - first], None) for s in range(max(first, int(after) + 1), n + 1)]
        state.update((n, ids, types))
        yield pd.DataFrame(out, columns=["epoch", "subscriber", "seq", "id", "type", "missed"]).astype({"subscriber": "Int64", "id": "Int64", "missed": "Int64"})

    kind = "epoch string, subscriber long, seq long, id long, type string, missed long"
    return stream.groupBy("epoch").applyInPandasWithState(run, kind, "n long, ids array<long>, types array<string>", "append", "NoTimeout")


def delivered(stream: DataFrame, folder: str, checkpoint: str, every: str = "1 second"):
    """Write published events as JSON lines, event_id being epoch:seq; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("event_id", F.concat_ws(":", "epoch", "seq")).write.mode("overwrite").json(f"{folder}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def rescans(stream: DataFrame, work, every: str = "1 minute", checkpoint: str | None = None):
    """Run work(batch, id) on what arrived, at most once per interval and never twice at a time."""
    writer = stream.writeStream.foreachBatch(work).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
