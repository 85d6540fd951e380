"""What the operators share: written intermediate tables, folds by crc32, keys and ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster for intermediate tables.

    It is spark.checkpoint.dir. Where that is unset, a local session (as in tests)
    gets a temporary folder of its own and any other session is refused.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="docflow-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and return the written table: lineage ends here, lost executors lose nothing.

    Spark removes shuffle files once the driver's JVM has dropped the plan that made them. It is asked
    to do so now, as by itself it may take half an hour.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in an Arrow batch of whole texts.
BATCH = 1_000


def small_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Set the session's Arrow batches to so many rows if they are larger: a batch is held several times over in an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """df with rank, each row's place from 0 in its group by order (nulls first), whatever the group's size.

    Rows are dealt by ranges of (group, order), so a large group lies in many partitions and no
    task holds it. Only a partition's first group can have begun before it; where it did is
    worked out from one row a partition. The ranked rows are written, so that places stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, place, head, last = TaskContext.get().partitionId(), 0, -1, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(names.index(g)) for g in group]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in own:
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                differ = pc.or_(pc.xor(a.is_null(), b.is_null()), pc.fill_null(pc.not_equal(a, b), False))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in own]
            new[0] = last is not None and first != last
            last = [c[-1].as_py() for c in own]
            i = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(new, i, -1))
            places = np.where(begun >= 0, i - begun, place + 1 + i)
            heads = head & (begun < 0)
            head, place = bool(heads[-1]), int(places[-1])
            more = {"_part": pa.array(np.full(batch.num_rows, part), pa.int32()), "_at": pa.array(i + at), rank: pa.array(places), "_head": pa.array(heads)}
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*names, *more])

    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField(rank, T.LongType()), T.StructField("_head", T.BooleanType())])
    placed = stash(df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).mapInArrow(work, schema), "ranked")
    ends = placed.groupBy("_part").agg(
        F.min_by(F.struct(F.lit(0).alias("_"), *group), "_at").alias("first"), F.max_by(F.struct(F.lit(0).alias("_"), *group), "_at").alias("last"),
        F.max_by(rank, "_at").alias("place"), F.bool_and("_head").alias("one"),
    )
    before, carry, carried = [], 0, None
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a partition
        start = carry if carried == row["first"] else 0
        if start:
            before.append((row["_part"], start))
        carry, carried = row["place"] + 1 + (start if row["one"] else 0), row["last"]
    if before:
        starts = F.broadcast(spark.createDataFrame(before, "_part int, _start long"))
        placed = placed.join(starts, "_part", "left").withColumn(rank, F.col(rank) + F.when(F.col("_head"), F.coalesce("_start", F.lit(0))).otherwise(0))
    return placed.select(*names, rank)


#: A key with more than one in HOT_SHARE of all rows is joined by broadcast: there can't be HOT_SHARE such keys, whatever the corpus.
HOT_SHARE = 1024


def met(rows: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows whose key is in found, with found's columns; found: one row a key that isn't null, with n, how many rows have it.

    The keys that many rows have are few and go to the rows by broadcast, so no task gets all rows of one.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT_SHARE
    marked = rows.join(F.broadcast(found.where(hot).select(key, *columns, F.lit(True).alias("_hot"))), key, "left")
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(found.where(~hot).select(key, *columns), key)
    names = [*rows.columns, *columns]
    return marked.where("_hot").select(*names).unionByName(rest.select(*names))
