"""What queries over the tracks view shuffle where no table is small enough to be sent to all tasks."""

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cadenza import catalog, schema
from cadenza.functions import hashing
from cadenza.operators import browse, edit
from cadenza.plans.tracks import tracks

WHERE = "/root/testdata/sf0.001"


@contextmanager
def nothing_broadcast(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df: DataFrame) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def shuffles(plan: str) -> int:
    """Exchanges that are made, not used again."""
    return len(re.findall(r"(?m)^[ :+*\-]*Exchange hashpartitioning", plan))


def below(plan: str, line: str) -> str:
    """The lines of a plan that are deeper than the first one that holds a text."""
    lines = plan.splitlines()
    depth = lambda x: len(re.match(r"[ :+*\-]*", x)[0])
    at = next(k for k, x in enumerate(lines) if line in x)
    end = next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(lines[at])), len(lines))
    return "\n".join(lines[at + 1 : end])


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return schema.conform(spark.createDataFrame([Row(**r) for r in rows]))


def test_customers_meet_orders_before_lines(spark):
    with nothing_broadcast(spark):
        shown = plan_of(tracks(spark, WHERE).select("path", "composer", "year"))
    assert "l_orderkey" not in below(shown, "hashpartitioning(o_custkey")


def test_who_asks_the_view_often_joins_its_tables_once(spark):
    for name in ("dirty_tracks", "live_version", "journal_restore", "duplicates_default", "duplicates_duration"):
        assert "lineitem.parquet" not in plan_of(catalog.QUERIES[name](spark, WHERE)), name
    view, once, dealt = (tracks(spark, WHERE, **kw) for kw in ({}, {"once": True}, {"once": True, "dealt": True}))
    assert view.schema == once.schema == dealt.schema
    for other in (once, dealt):
        assert view.exceptAll(other).isEmpty() and other.exceptAll(view).isEmpty()


def test_whole_tracks_are_dealt_out_once_to_be_edited_and_compared(spark):
    with nothing_broadcast(spark):
        found = catalog.QUERIES["dirty_tracks"](spark, WHERE)
        shown = final_plan(found)
    assert "ReusedExchange" in shown
    assert shuffles(shown) == 2, shown  # whole tracks, and those that change


def test_what_is_said_of_paths_is_shuffled_without_them(spark):
    df = table(spark, [{"path": f"/m/{k}.mp3", "title": f"t{k}", "year": 1990 + k, "size": k, "mod_time": k} for k in range(4)])
    plan = edit.plan_set(df.where("year > 1991"), {"title": "new"})
    revs = spark.createDataFrame([("/m/1.mp3", 1), ("/m/1.mp3", 2), ("/m/2.mp3", 1), (None, 5), ("/m/9.mp3", 1)], "path string, n long")
    with nothing_broadcast(spark):
        done = edit.apply(df, plan)
        for made in (done, edit.restore(done, edit.journal(plan)), edit.with_version(df, revs)):
            assert re.findall(r"hashpartitioning\(__p1#", plan_of(made)) and not re.findall(r"hashpartitioning\((path|__p|__jp|__rp)#", plan_of(made))
        assert [(r.title, r.year) for r in done.orderBy("path").collect()] == [("t0", 1990), ("t1", 1991), ("new", 1992), ("new", 1993)]
        assert edit.restore(done, edit.journal(plan)).exceptAll(df).isEmpty()
        base = {r.path: r.v for r in df.select("path", hashing.track_version(F.col("path"), F.col("size"), F.col("mod_time")).alias("v")).collect()}
        want = {p: hashing.fnv_text(v.encode() + {"/m/1.mp3": 3, "/m/2.mp3": 1}[p].to_bytes(8, "little")) if p in ("/m/1.mp3", "/m/2.mp3") else v for p, v in base.items()}
        assert {r.path: r.version for r in edit.with_version(df, revs).collect()} == want


def test_names_are_dealt_out_once_for_claims_and_plan(spark):
    rows = [{"path": f"/m/{n}.mp3", "title": t, "artist": "A"} for n, t in (("1", "One"), ("2", "One"), ("3", "Two"), ("4", ""), ("5", "Five"), ("A/Six", "Six"))]
    df, there = table(spark, rows), spark.createDataFrame([("/m/A/Two.mp3",), ("/m/A/Two.mp3",), (None,), ("/m/A/Six.mp3",), ("/m/none.mp3",)], "path string")
    with nothing_broadcast(spark):
        plan = edit.plan_rename(df, "$artist/$title", ("/m",))
        shown = final_plan(plan)
        alone = {r.path: r.status for r in plan.collect()}
        met = {r.path: r.status for r in edit.plan_rename(df, "$artist/$title", ("/m",), there).collect()}
    want = {"/m/1.mp3": "changed", "/m/2.mp3": "collision", "/m/3.mp3": "changed", "/m/4.mp3": "incomplete", "/m/5.mp3": "changed", "/m/A/Six.mp3": "same"}
    assert alone == want and met == want | {"/m/3.mp3": "collision"}
    assert "ReusedExchange" in shown and shuffles(shown) == 1, shown


def test_duplicates_are_ranked_in_tasks_before_the_shuffle(spark):
    rows = [{"path": f"/m/{k:02}.mp3", "title": "same" if k < 30 else f"t{k // 2}", "artist": "Ä" if k % 3 else "a", "size": k + 1} for k in range(37)]
    df = table(spark, rows)
    with nothing_broadcast(spark):
        found = browse.duplicates(df)
        shown = plan_of(found)
        assert "LeftSemi" not in shown
        limit = re.search(r"Exchange hashpartitioning\([^\n]*\n[^\n]*WindowGroupLimit [^\n]*Partial", shown)
        assert limit, shown
        got = {r.key: (r.tracks, r.bytes, r.wasted, list(r["items"])) for r in found.collect()}
        groups = {}
        for r in rows:
            groups.setdefault(f"a — {r['title']}", []).append(r)
        want = {k: (len(g), sum(r["size"] for r in g), sum(r["size"] for r in g) - max(r["size"] for r in g), [r["path"] for r in g][:20]) for k, g in groups.items() if len(g) > 1}
        assert got == want and "a — t18" not in got
        plain = browse.duplicate_groups(df)
        assert sorted(map(tuple, plain.collect())) == sorted(x[:3] for x in want.values()) and "path" not in re.sub(r"Location: [^\n]*", "", plan_of(browse.duplicate_groups(tracks(spark, WHERE))))
    assert browse.duplicate_totals(plain).collect() == browse.duplicate_totals(found).collect()
