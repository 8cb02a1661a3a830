"""Incremental ingest: a file stream of articles, chunked, deduplicated by keyed state and written in each micro-batch.

What has been seen is in the stream's state store, by hash: of an article (id and content) before it is chunked, and of a paragraph after. A batch costs what it brings, and never a
read of the index. State and source offsets are in one checkpoint, and a batch writes one folder under its number, so a batch that fails or is stopped is done again as a whole and gives the
same folder. Of equal paragraphs the one in the earliest batch stays, within a batch any one of them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lexmill.operators import increments
from lexmill.operators.chunking import chunk_documents
from lexmill.sources import lifecycle
from lexmill.sources.articles import accepted, point_id

STOPPED = "ingest stopped at the end of a batch"


class StopIngest(Exception):
    """Ends a stream before the batch that it is raised in has written anything."""


def new_paragraphs(articles: DataFrame) -> DataFrame:
    """Chunks of a stream of articles (doc_id, text) that no earlier batch had, with phash and point_id."""
    docs = accepted(articles, "text").withColumn("sha1", F.sha1(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "sha1"])
    chunks = chunk_documents(docs.select("doc_id", "text")).withColumn("phash", F.md5(F.substring("text", 1, 1024).cast("binary")))
    return chunks.dropDuplicates(["phash"]).withColumn("point_id", point_id("chunk_id"))


def ingest_stream(
    spark: SparkSession, source: str, index: str, checkpoint: str, files_per_batch: int = 100, segments: str | None = None, stop: Callable[[], bool] | None = None
) -> StreamingQuery:
    """Read (doc_id, text) Parquet files as they come and append their new chunks to ``index``, one folder a batch.

    With ``segments`` a batch's chunks are also a write to the index in segments there (see increments). ``stop`` is asked before each batch; once it says so, the stream ends with what has been
    written (see stopped()), and goes on from there when it is started again.
    """

    def write(batch: DataFrame, number: int) -> None:
        if stop is not None and stop():
            raise StopIngest(STOPPED)
        batch.write.mode("overwrite").parquet(f"{index}/batch={number}")  # the same folder if the batch is done again
        if segments is not None:
            rows = spark.read.schema(batch.schema).parquet(f"{index}/batch={number}").drop("embed_text", "phash", "point_id")
            increments.upsert(spark, segments, rows, number=number)

    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", files_per_batch).parquet(source)
    chunks = new_paragraphs(stream.observe("articles", F.count(F.lit(1)).alias("n"))).observe("chunks", F.count(F.lit(1)).alias("n"))
    return chunks.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query: StreamingQuery) -> bool:
    """Wait for the end of an ingest; False if it was stopped, True if it read all there was. Other errors are raised."""
    try:
        query.awaitTermination()
        return True
    except Exception as e:
        if STOPPED not in str(e):
            raise
        return False


class ProgressTable(StreamingQueryListener):
    """Writes a row a batch to a folder of JSON files: documents and chunks so far, chunks a second, and the time left where the total of documents is known.

    Register it with spark.streams.addListener(); it follows the query with the given run id, or all queries.
    """

    def __init__(self, spark: SparkSession, path: str, total: int | None = None, run_id: str | None = None) -> None:
        self.spark, self.path, self.total, self.run_id = spark, path, total, run_id
        self.documents = self.chunks = 0
        self.began = time.time()

    def onQueryStarted(self, event) -> None:
        self.began = time.time()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.run_id is not None and str(p.runId) != self.run_id:
            return
        n = {name: p.observedMetrics[name]["n"] if name in p.observedMetrics else 0 for name in ("articles", "chunks")}
        self.documents += n["articles"]
        self.chunks += n["chunks"]
        elapsed = time.time() - self.began
        rate, left = lifecycle.progress(self.documents, max(self.total or 0, self.documents), self.chunks, elapsed)
        row = {"batch": p.batchId, "documents": self.documents, "chunks": self.chunks, "rate": round(rate, 3), "left": left if self.total else "...", "elapsed": round(elapsed, 3)}
        self._write(f"{self.path}/batch={p.batchId}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _write(self, path: str, line: str) -> None:
        # one small file through the file system that Spark uses: a listener is no place for a job
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray((line + "\n").encode()))
        out.close()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("batch long, documents long, chunks long, rate double, left string, elapsed double").json(path)
