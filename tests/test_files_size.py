"""Files are dealt over all cores, whatever their names weigh."""

import os

from pyspark.sql import functions as F

from cadenza.sources import contents, samples, scan


def test_files_are_dealt_out_and_removed(spark, tmp_path):
    k = F.col("id")
    none = F.lit(None).cast("binary")
    rows = spark.range(0, 40, 1, 1).select(F.concat(F.lit(f"{tmp_path}/music/"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("path"), F.lit("mp3").alias("format"), *[F.lit("x").alias(c) for c in ("title", "artist", "genre", "mood", "gapless")], F.lit(1999).alias("year"), F.lit(1).alias("track"), none.alias("art"))
    assert samples.write_files(rows) == 40
    names = spark.createDataFrame([(f"{tmp_path}/music/{n % 3}/{n}.mp3", 1, 1) for n in range(40)], "path string, size long, mod_time long").coalesce(1)
    read, raw = scan.read_tags(names), contents.raw(names)
    assert min(x.rdd.getNumPartitions() for x in (read, raw, contents.pictures(names))) >= spark.sparkContext.defaultParallelism
    assert read.where("title = 'x' and error is null").count() == 40 and raw.select("path").distinct().count() == 40
    assert samples.remove_files(rows) == 3 and os.listdir(f"{tmp_path}/music") == []
    assert samples.remove_files(rows) == 0
