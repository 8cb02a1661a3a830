"""A run of the ingest over article files: what is unchanged, accepted, new; the writes; the state that the next run finds.

State is one table (path, doc_id, sha1, status, run): the row of a file's last run, with status ``processed`` or ``failed``. It is written after the index, so a file is
only taken for unchanged if its chunks are there: a run that fails between is done again as a whole.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chunking
from lexmill.sources.articles import accepted, path_metadata, point_id, rejected, unseen_paragraphs, upsert

STATE = "path string, doc_id string, sha1 string, status string, run long"
FATAL = (PermissionError, ValueError)

logger = logging.getLogger(__name__)


@dataclass
class Manifest:
    """What a run did."""

    run: int
    docs_processed: int
    failed_docs: int
    total_chunks: int
    skipped_file_dup: int
    skipped_para_dup: int
    skipped_ref_chars: int
    elapsed_seconds: float
    dry_run: bool


def latest(state: DataFrame) -> DataFrame:
    """The row of each file's last run: a file that succeeds later isn't failed any more."""
    return state.groupBy("path").agg(F.max_by(F.struct("doc_id", "sha1", "status", "run"), "run").alias("s")).select("path", "s.*")


def failed(state: DataFrame) -> DataFrame:
    """Documents whose last run failed, each once."""
    return latest(state).filter("status = 'failed'").select("doc_id").distinct()


def remaining(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, doc_id, sha1, text) that are new, changed or failed."""
    done = latest(state).filter("status = 'processed'").select("path", "sha1")
    return files.join(done, ["path", "sha1"], "left_anti")


def skipped_characters(docs: DataFrame) -> DataFrame:
    """doc_id and the characters of its reference tail that no chunk has."""
    from lexmill.operators.lines import classify

    rows = classify(docs).filter("in_references AND class NOT IN ('blank', 'page_number', 'reference_header')")
    return rows.groupBy("doc_id").agg(F.sum(F.length("line")).alias("skipped"))


def plan(files: DataFrame, state: DataFrame, seen: DataFrame | None) -> dict[str, DataFrame]:
    """The parts of a run: todo, short (rejected), chunks (all), fresh (paragraphs that neither the index nor an earlier chunk has)."""
    todo = remaining(files, state)
    good = accepted(todo, "text")
    chunks = chunking.chunk_documents(good.select("doc_id", "text"))
    fresh = unseen_paragraphs(chunks, seen)
    return {"todo": todo, "short": rejected(todo, "text"), "good": good, "chunks": chunks, "fresh": fresh}


def dry_run(files: DataFrame, state: DataFrame, seen: DataFrame | None) -> DataFrame:
    """What a run would do: total, unchanged, fresh_files, paragraphs, duplicates, unique."""
    p = plan(files, state, seen)
    n = [files.agg(F.count("*").alias("total")), p["todo"].agg(F.count("*").alias("todo")), p["good"].agg(F.count("*").alias("fresh_files")), p["chunks"].agg(F.count("*").alias("paragraphs")), p["fresh"].agg(F.count("*").alias("unique"))]
    one = n[0]
    for x in n[1:]:
        one = one.join(x)  # single rows
    return one.select("total", (F.col("total") - F.col("todo")).alias("unchanged"), "fresh_files", "paragraphs", (F.col("paragraphs") - F.col("unique")).alias("duplicates"), "unique")


def run(spark: SparkSession, files: DataFrame, index: str, state_path: str, number: int, previous: str | None = None, force: bool = False, attempts: int = 3, delay: float = 2.0) -> Manifest:
    """Chunk what is left of ``files``, write the index as a new version over ``previous``, then the state and the manifest.

    ``force`` starts anew without state. Documents without a chunk are failed, as are all of a run whose write fails; their files are tried again by the next one.
    """
    began = time.time()
    state = spark.createDataFrame([], STATE) if force else read_state(spark, state_path)
    old = None if force or previous is None else spark.read.parquet(previous)
    p = plan(files, state, old)
    kept = p["fresh"].withColumn("point_id", point_id("chunk_id")).withColumn("m", path_metadata("doc_id")).select("*", "m.*").drop("m")
    chunked = p["chunks"].select("doc_id").distinct()
    ok = True
    try:
        write_with_retries(lambda: upsert(old, kept).write.mode("overwrite").parquet(index), attempts, delay)
    except FATAL:
        raise
    except Exception:
        logger.exception("run %d: the index could not be written; its documents are failed", number)
        ok = False
    status = F.when(F.col("chunked") & F.lit(ok), "processed").otherwise("failed")
    rows = p["todo"].select("path", "doc_id", "sha1").join(chunked.withColumn("chunked", F.lit(True)), "doc_id", "left").withColumn("chunked", F.coalesce("chunked", F.lit(False)))
    rows.select("path", "doc_id", "sha1", status.alias("status"), F.lit(number).cast("long").alias("run")).write.mode("overwrite").parquet(f"{state_path}/run={number}")
    now = spark.read.parquet(f"{state_path}/run={number}")
    n = {r["status"]: r["n"] for r in now.groupBy("status").agg(F.count("*").alias("n")).collect()}
    # the run's own rows, whether they are new or replace others
    written = spark.read.parquet(index).join(p["good"].select("doc_id"), "doc_id", "left_semi").join(kept.select("point_id"), "point_id", "left_semi").count() if ok else 0
    total, chunks = files.count(), p["chunks"].count()
    tail = skipped_characters(p["good"]).agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]
    made = Manifest(number, n.get("processed", 0), n.get("failed", 0), written, total - sum(n.values()), chunks - written if ok else 0, tail, round(time.time() - began, 1), False)
    spark.createDataFrame([asdict(made)]).coalesce(1).write.mode("overwrite").json(f"{state_path}-manifest/run={number}")
    return made


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all runs; empty before the first."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], STATE)
        raise


def write_with_retries(write, attempts: int = 3, delay: float = 2.0, sleep=time.sleep) -> None:
    """Call ``write``; again after delay, 2 delay, 4 delay … seconds if it fails, but not for errors that no repeat mends."""
    for k in range(attempts):
        try:
            write()
            return
        except FATAL:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(delay * 2**k)


def progress(done: int, total: int, chunks: int, elapsed: float) -> tuple[float, str]:
    """Chunks a second and the time left as text."""
    rate = chunks / elapsed if elapsed > 0 else 0.0
    if not done or elapsed <= 0:
        return rate, "..."
    left = (total - done) / (done / elapsed)
    return rate, f"{left:.0f}s" if left < 60 else f"{left / 60:.1f}m" if left < 3600 else f"{left / 3600:.1f}h"


def document_batches(chunks: DataFrame, size: int, part: str | None = None) -> DataFrame:
    """Adds batch (part, k): documents of a part of the input in the order of their ids, gathered until they have ``size`` chunks or more; then the next batch starts.

    A part is what has one value of ``part`` (constant within a document), or one range of ids where there is none. Where a batch ends depends on where the last one did, so it is a fold over the counts of a part's
    documents, which stream by in order; no part is held in memory.
    """
    sizes = chunks.groupBy(*([F.col(part).alias("part")] if part else []), "doc_id").agg(F.count("*").alias("n"))
    if part:
        rows = sizes.repartition("part").sortWithinPartitions("part", "doc_id")
    else:
        rows = sizes.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.spark_partition_id().alias("part"), "doc_id", "n")
    kinds = dict(rows.dtypes)

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, held, first = None, 0, 0, True
        for batch in batches:
            numbers = []
            for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
                if first or p != now:
                    now, k, held, first = p, 0, 0, False
                numbers.append(k)
                held += n
                if held >= size:
                    k, held = k + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(numbers, pa.int64())], names=["part", "doc_id", "k"])

    # written down by the shuffle that the join needs, so that parts by range are made once
    numbered = rows.mapInArrow(flush, f"part {kinds['part']}, doc_id {kinds['doc_id']}, k long").select("doc_id", F.struct("part", "k").alias("batch"))
    return chunks.join(numbered, "doc_id")
