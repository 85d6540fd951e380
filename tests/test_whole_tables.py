"""Queries over more rows than the smallest tables have."""

from pyspark.sql import functions as F

from docflow.plans import catalogue


def test_prune_counts_all_files(spark, tmp_path):
    users = spark.range(100_150).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.timestamp_seconds("id").alias("ts"))
    users.unionByName(users).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in catalogue.queries()["rec_03_prune_recent"](spark, str(tmp_path)).collect()] == [(100_130,)]
