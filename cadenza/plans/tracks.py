"""The tracks view that the queries run on, derived from the order tables, and how to read a stored catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import half
from ..sources import store

FORMATS = ("mp3", "flac", "mp4", "ogg", "opus")


#: Bytecode of a method that the JVM still compiles; what is longer it interprets, row by row.
METHOD = 8000
#: Bytes of files that a task reads where rows are short on disk and wide as tracks.
SPLIT = 32 << 20


def bound_methods(spark: SparkSession) -> None:
    """Let Spark split generated code that the JVM would not compile: conditions on derived columns hold these in full, often several times."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer, part, supplier and place, in the few short columns that tracks are made of.

    Dimensions are joined as Spark sees fit. Numbers are made whole and dates days before they are shuffled, as doubles and times hardly
    compress; customers are joined to orders, of which there are fewer, and names and places, which make rows wide, come last.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier", "nation", "region", "customer")}
    lines = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), (F.col("l_returnflag") == "R").alias("returned"),
    )
    orders = t["orders"].select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("ordered")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(*lines.columns, "ordered", "c_mktsegment", "p_name", "p_brand", "p_type", "s_name", "r_name")


def tracks(spark: SparkSession, sf_dir: str, once: bool = False, dealt: bool = False) -> DataFrame:
    """The order tables as tracks.

    once: for who asks the view several times. The joined rows are written now, so that the tables are joined and shuffled once; paths and what else is made of
    the rows are not written. dealt: for who joins whole tracks by path (see edit). Rows are dealt out by that before paths
    and the rest make them wide, and as what is asked of them then comes later, two who ask all of them share the shuffle.
    """
    bound_methods(spark)
    if once:
        spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
    rows = store.written(_joined(spark, sf_dir), "tracks") if once else _joined(spark, sf_dir)
    fmt = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    text = lambda *cols: F.concat(*[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    dash = F.lit("-")
    path = text(
        F.lit("/music/"), "r_name", F.lit("/"), "s_name", F.lit("/"), "p_brand", F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(" "), "p_name", F.lit(" "),
        "l_orderkey", dash, "l_partkey", dash, "l_suppkey", dash, "cents", dash, "day", F.lit("."), fmt,
    )
    if dealt:
        path = F.coalesce(path, F.lit(""))  # as conform() makes it
        rows = rows.repartition(half(path, 0))
    return schema.conform(
        rows.select(
            path.alias("path"), F.col("p_name").alias("title"), F.col("s_name").alias("artist"), F.col("p_type").alias("genre"),
            F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("album_artist"),
            F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.col("p_brand")).alias("album"),
            F.when(F.col("l_suppkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("composer"),
            F.when(F.col("l_partkey") % 20 == 0, 0).otherwise(F.col("ordered")).alias("year"),
            F.col("l_linenumber").alias("track_no"), (F.lit(1) + F.col("l_orderkey") % 2).alias("disc"),
            (F.col("quantity") * 6000 + F.col("l_orderkey") % 1000).alias("duration_ms"),
            F.col("cents").alias("size"), (F.col("day").cast("long") * 86400).alias("mod_time"), (F.lit(128) + F.col("l_suppkey") % 4 * 64).alias("bitrate"),
            fmt.alias("format"), F.col("returned").alias("has_art"), (F.col("l_partkey") % 10 == 0).alias("compilation"),
        )
    )


#: The same in DuckDB, as a common table expression named tracks.
SQL = """tracks AS (
SELECT '/music/' || r_name || '/' || s_name || '/' || p_brand || '/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ' ' || p_name || ' '
    || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) || '-' || CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR)
    || '.' || ['mp3', 'flac', 'mp4', 'ogg', 'opus'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS path,
  p_name AS title, s_name AS artist, p_type AS genre,
  CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE s_name END AS album_artist, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE p_brand END AS album,
  CASE WHEN l_suppkey % 2 = 0 THEN c_mktsegment ELSE '' END AS composer, '' AS comment,
  CAST(CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE year(o_orderdate) END AS INTEGER) AS year,
  CAST(l_linenumber AS INTEGER) AS track_no, CAST(1 + l_orderkey % 2 AS INTEGER) AS disc,
  CAST(CAST(floor(l_quantity) AS INTEGER) * 6000 + l_orderkey % 1000 AS INTEGER) AS duration_ms,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS size, CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400 AS mod_time,
  CAST(128 + l_suppkey % 4 * 64 AS INTEGER) AS bitrate, ['mp3', 'flac', 'mp4', 'ogg', 'opus'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS format,
  l_returnflag = 'R' AS has_art, l_partkey % 10 = 0 AS compilation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN customer ON o_custkey = c_custkey)"""
