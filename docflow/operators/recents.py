"""The list of recently used files: newest first, one row a file."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators.tree import first_per

KEPT, SHOWN = 20, 5


def with_defaults(recents: DataFrame) -> DataFrame:
    """recents(uri, file_name, mime_type, file_size, last_accessed) with "" and 0 for an unknown type and size."""
    return recents.withColumns({"mime_type": F.coalesce("mime_type", F.lit("")), "file_size": F.coalesce("file_size", F.lit(0).cast("long"))})


def upsert(recents: DataFrame, accesses: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """recents after accesses of the same columns: of each uri the latest, the kept newest; ties by uri. Where kept is None, all in no order."""
    both = with_defaults(recents.unionByName(accesses))
    latest = first_per(both, ["uri"], F.desc("last_accessed"))
    return latest if kept is None else latest.orderBy(F.desc("last_accessed"), "uri").limit(kept)


def visible(recents: DataFrame, shown: int = SHOWN) -> DataFrame:
    return recents.orderBy(F.desc("last_accessed"), "uri").limit(shown)


def prune(recents: DataFrame, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """The kept newest rows, and a row with the number removed."""
    n = F.count("*")
    return visible(recents, kept), recents.agg((n - F.least(n, F.lit(kept))).alias("removed"))


def to_json(recents: DataFrame) -> DataFrame:
    """One row, json: the bounded list as an array, newest first."""
    millis = F.unix_millis(F.col("last_accessed").cast("timestamp"))
    item = F.struct(F.col("uri"), F.col("file_name").alias("fileName"), F.col("mime_type").alias("mimeType"), F.col("file_size").alias("fileSize"), millis.alias("lastAccessed"))
    items = F.array_sort(F.collect_list(F.struct((-millis).alias("late"), "uri", item.alias("item"))))
    return visible(recents, KEPT).agg(F.to_json(F.transform(items, lambda s: s["item"])).alias("json"))


def from_json(json: Column) -> Column:
    """The list of a JSON text as array<struct>; what is absent is "" or 0, null is an empty list."""
    items = F.coalesce(F.from_json(json, S.RECENT), F.array().cast(S.RECENT))
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(
        items,
        lambda i: F.struct(
            text(i["uri"]).alias("uri"), text(i["fileName"]).alias("file_name"), text(i["mimeType"]).alias("mime_type"),
            F.coalesce(i["fileSize"], F.lit(0)).alias("file_size"), F.timestamp_millis(F.coalesce(i["lastAccessed"], F.lit(0))).alias("last_accessed"),
        ),
    )


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


class RecentStore:
    """The bounded list as a stored table that several writers may change: snapshots, and a log with an entry for each version.

    A version is made by creating its log entry, which fails if there is one; a writer that has lost starts again from
    the version that won, so no upsert is lost. The list never holds more than `kept` rows; since accesses only make files newer, the
    newest of all files so far are among the last list and what is new.
    """

    def __init__(self, spark: SparkSession, path: str, kept: int = KEPT):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), kept

    def _hadoop(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        system, log = self._hadoop(f"{self.path}/_log")
        names = [f.getPath().getName() for f in system.listStatus(log)] if system.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_log/{version:020d}").first().value) if version else {"folder": None, "batches": {}}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The list of a version, the last by default; None before the first."""
        folder = self._entry(self.version() if version is None else version)["folder"]
        return folder and self.spark.read.parquet(f"{self.path}/{folder}")

    def commit(self, rows: DataFrame, after: int, batches: dict[str, int]) -> int:
        """Make rows the version that follows `after`; Conflict if there is one already, and then nothing is left behind.

        The entry is written under another name and renamed, which fails where the name is taken; so an entry is whole.
        """
        folder, jvm = f"snapshot-{uuid.uuid4().hex}", self.spark._jvm
        rows.coalesce(1).write.parquet(f"{self.path}/{folder}")
        system, entry = self._hadoop(f"{self.path}/_log/{after + 1:020d}")
        made = self._hadoop(f"{self.path}/_log/new-{uuid.uuid4().hex}")[1]
        out = system.create(made, False)
        out.write(json.dumps({"folder": folder, "batches": batches}).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(system.makeQualified(made), system.makeQualified(entry), plainly)
        except Py4JJavaError as fault:
            system.delete(made, False)
            system.delete(self._hadoop(f"{self.path}/{folder}")[1], True)
            if after + 1 <= self.version():
                raise Conflict(str(after + 1)) from fault
            raise
        return after + 1

    def upsert(self, accesses: DataFrame, stream: str | None = None, batch: int = 0, tries: int = 20) -> int:
        """The version after accesses. A stream's batch that has been committed isn't again."""
        for _ in range(tries):
            after = self.version()
            entry = self._entry(after)
            if stream is not None and entry["batches"].get(stream, -1) >= batch:
                return after
            last = accesses.limit(0) if after == 0 else self.spark.read.parquet(f"{self.path}/{entry['folder']}")
            try:
                return self.commit(upsert(last, accesses, self.kept), after, entry["batches"] | ({} if stream is None else {stream: batch}))
            except Conflict:
                continue
        raise Conflict(f"lost to other writers {tries} times")
