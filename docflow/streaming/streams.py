"""Corpora and recents that grow while they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docflow.functions import strings as S
from docflow.operators import elements as E
from docflow.operators import odt as O
from docflow.operators import recents as R
from docflow.sources import packages as P

BINARY = "path string, modificationTime timestamp, length long, content binary"


def dealt(batch: DataFrame) -> DataFrame:
    """A batch's files dealt out to four tasks a core: what arrives may be one file of many packages, and one task would unpack and parse them all."""
    return batch.repartition(max(4 * batch.sparkSession.sparkContext.defaultParallelism, 16), "path")


def parsed(files: DataFrame, nodes_of: Callable[[DataFrame], DataFrame], blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Elements of the files that can be read, whatever their format, and doc_id, ok, error of each file. nodes_of(parts) keeps the nodes, which are read several times. blank: see elements.document_elements."""
    known = P.described(files).withColumn("format", P.route(F.col("mime"), F.col("filename")))
    nodes = nodes_of(P.explode_parts(known.where("format <> 'text'")))
    name = S.after_last(F.col("doc_id"), "/")  # a file's format is known from its path, so nodes needn't meet the files
    of = lambda kind: nodes.where(P.route(P.infer_mime(name), name) == kind)
    status = P.parse_status(known, nodes)
    # a DOCX has elements of its main part only, so it can be read; an ODT file that can't may have metadata
    odt = O.odt_elements(of("odt"), P.explode_parts(known.where("format = 'odt'"), content=False)).join(status.where("ok").select("doc_id"), "doc_id", "left_semi")
    rows = E.document_elements(of("docx"), blank=blank).unionByName(odt)
    plain = P.plain_text_elements(known.where("format = 'text'"))
    rows = rows.unionByName(E.as_elements(plain, 2, 4, "paragraph", pre=F.lit(0)).withColumn("seq", F.lit(0)))
    return rows, status


def stream_documents(files: DataFrame, checkpoint: str, path: str, blank: bool = False) -> StreamingQuery:
    """Parse each file of a stream of files(path, length, modificationTime, content) once, whatever its format, into three tables below path.

    elements; quarantine, doc_id and error of files that can't be read; and manifest, doc_id and ok of all. Each has a folder a batch
    that is written whole, the manifest last; so a batch that is given again after a failure replaces what it has left, and a file is in the tables
    once. The nodes of a batch are removed when it is done. blank: paragraphs without text are elements too.
    """
    spark = files.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        kept = P.new_folder(spark, "nodes")

        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={number}")
        try:
            rows, status = parsed(dealt(batch), lambda parts: P.written(P.shred(parts), kept), blank)
            put(rows, "elements")
            put(status.where("not ok").select("doc_id", "error"), "quarantine")
            put(status.select("doc_id", "ok"), "manifest")
        finally:
            P.removed(spark, kept)
            spark._jvm.System.gc()  # for the batch's shuffle files, see packages.written

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def streamed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of stream_documents: the batches that the manifest has, which are whole."""
    return spark.read.parquet(f"{path}/{name}").join(spark.read.parquet(f"{path}/manifest").select("batch").distinct(), "batch", "left_semi")


def stream_files(files: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], blank: bool = False) -> StreamingQuery:
    """Parse each DOCX of a stream of files(path, length, modificationTime, content) once; take(elements, batch) gets each batch's elements. A batch may be given again after a failure, under its number. blank: see elements.document_elements."""
    spark = files.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        nodes = P.stored(P.shred(P.explode_parts(P.described(dealt(batch)))))
        take(E.document_elements(nodes, blank=blank), number)
        P.removed(spark, *{f.rsplit("/", 1)[0] for f in nodes.inputFiles()})

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def stream_corpus(spark: SparkSession, path: str, pattern: str, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """stream_files of the files below path as they arrive. What has been read is known from the checkpoint, after a restart too."""
    return stream_files(spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(path), checkpoint, take)


def stream_recents(accesses: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], store: R.RecentStore | None = None) -> StreamingQuery:
    """take(visible, batch) gets the newest files after each batch of accesses(uri, last_accessed, and the other columns of recents where there are any).

    The state is the bounded list in store (by default beside the checkpoint), however many files are accessed: a file
    that has left the list comes back only by an access of its own. A batch that is given again changes nothing.
    """
    spark = accesses.sparkSession
    kept = store or R.RecentStore(spark, f"{checkpoint.rstrip('/')}-recents")

    def each(batch: DataFrame, number: int) -> None:
        known = {"file_name": "string", "mime_type": "string", "file_size": "long"}
        rows = batch.select("uri", *(F.col(c) if c in batch.columns else F.lit(None).cast(k).alias(c) for c, k in known.items()), "last_accessed")
        kept.upsert(rows, checkpoint, number)
        take(R.visible(kept.read()), number)

    return accesses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
