"""An index that grows: upserts by chunk id into immutable segments, merged on read and compacted now and then.

The folder of an index has

* ``chunks``, partitioned by a bucket of the chunk id. An upsert replaces the folders of the buckets that it touches (dynamic partition overwrite) and leaves the files of
  the others as they are.
* ``postings``, ``vectors`` and ``df``, partitioned by segment, one a write. Postings are sorted by hash bucket, so that a query's buckets prune row groups.
* ``ids``, by segment and bucket of the id: a chunk's id and hash buckets, which say what an upsert takes out of older segments without reading their postings.
* ``deletes``, by segment and bucket of the id: what a write replaced or removed in older segments. A posting holds unless a later segment deletes its chunk.
* ``sketches``, by segment: a mergeable sketch of the documents of each journal.
* ``manifest``: a line a write. It is written last, so a write that fails leaves nothing that a reader sees but chunk rows, which the same write, done again, makes whole. Doing a write of
  the same number again gives the same folders.

How often a bucket occurs is a sum over segments, deleted chunks with a minus, so weights are those of an index built at once. Compaction writes one segment of what holds.

Rows that repeat a chunk id in one write are one row, the one with the greatest text; null chunk ids are left out; empty texts have a row and no postings.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import retrieval
from lexmill.operators.search import CHUNK_COLUMNS, with_defaults
from lexmill.session import missing, remove_path

BUCKETS = 64
TABLES = ("postings", "vectors", "df", "ids", "deletes", "sketches")
# Kinds of columns that are fixed; ids are texts.
SCHEMAS = {
    "postings": "chunk_id string, bucket long, tf double, seg long", "vectors": "chunk_id string, vector array<double>, seg long", "df": "bucket long, n long, seg long",
    "ids": "chunk_id string, terms array<long>, seg long, b int", "deletes": "chunk_id string, seg long, b int", "sketches": "journal_id string, sketch binary, seg long",
}
#: Deletes up to which they are broadcast to the postings that a search reads.
DELETES_MOST = 1_000_000


@dataclass
class Version:
    """What a write did, and from which segment on readers look."""

    number: int
    base: int
    rows: int
    deleted: int
    chunks: int
    buckets: int
    dimensions: int


def _bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int").alias("b")


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The writes that readers see, in order: one row a write since the last compaction."""
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
    except Exception as e:
        if missing(e):
            return []
        raise
    made = sorted((Version(**json.loads(r["value"])) for r in rows), key=lambda v: v.number)
    return [v for v in made if v.number >= made[-1].base]


def _segments(spark: SparkSession, path: str, name: str, since: int, until: int) -> DataFrame:
    """A table's rows of some segments; none before the first write."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").filter(F.col("seg").between(since, until))
    except Exception as e:
        if missing(e):
            return spark.createDataFrame([], SCHEMAS[name])
        raise


def _segment(df: DataFrame, path: str, name: str, number: int, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}/seg={number}")


def _live(ids: DataFrame, deletes: DataFrame) -> DataFrame:
    """The latest row of each id that no later segment deletes."""
    gone = deletes.groupBy("chunk_id").agg(F.max("seg").alias("gone"))
    last = ids.groupBy("chunk_id").agg(F.max_by("terms", "seg").alias("terms"), F.max("seg").alias("seg"), F.first("b").alias("b"))
    return last.join(gone, "chunk_id", "left").filter("gone IS NULL OR seg >= gone").drop("gone")


def upsert(spark: SparkSession, path: str, rows: DataFrame, number: int | None = None, removed: DataFrame | None = None, buckets: int = BUCKETS, dimensions: int = retrieval.DIMENSIONS) -> Version:
    """Write chunk rows (see CHUNK_COLUMNS) over those with the same ids, and take out the chunks of ``removed`` (chunk_id).

    ``number`` names the write, so that one that failed can be done again; it has to be above those of earlier writes (the default is the next one). Buckets and dimensions are those of
    the first write.
    """
    known = [v for v in versions(spark, path) if number is None or v.number < number]
    last = known[-1] if known else None
    number = number if number is not None else (last.number + 1 if last else 0)
    base = last.base if last else number
    buckets, dimensions = (last.buckets, last.dimensions) if last else (buckets, dimensions)
    staged = f"{path}/staged/{number}"
    rows = with_defaults(rows.withColumn("chunk_id", F.col("chunk_id").cast("string")).filter("chunk_id IS NOT NULL")).drop("score")
    order = ["text", *[c for c in rows.columns if c not in ("text", "chunk_id")]]
    rows = rows.groupBy("chunk_id").agg(F.max(F.struct(*order)).alias("r")).select("chunk_id", "r.*")
    rows.withColumn("seg", F.lit(number).cast("long")).withColumn("b", _bucket_of(buckets)).write.mode("overwrite").parquet(f"{staged}/rows")
    rows = spark.read.parquet(f"{staged}/rows")
    out = rows.select("chunk_id", "b")
    if removed is not None:
        out = out.unionByName(removed.select(F.col("chunk_id").cast("string").alias("chunk_id")).withColumn("b", _bucket_of(buckets)))
    out.distinct().write.mode("overwrite").parquet(f"{staged}/out")
    out = spark.read.parquet(f"{staged}/out")
    touched = [r["b"] for r in out.select("b").distinct().collect()]  # at most ``buckets``
    # what the write replaces or removes, from older segments alone, so that doing it again finds the same
    in_touched = F.col("b").isin(touched)
    older = [_segments(spark, path, n, base, number - 1).filter(in_touched) for n in ("ids", "deletes")]
    gone = _live(*older).join(out.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "terms", "b")
    gone.write.mode("overwrite").parquet(f"{staged}/gone")
    gone = spark.read.parquet(f"{staged}/gone")
    _segment(gone.select("chunk_id", "b").repartitionByRange("b", "chunk_id"), path, "deletes", number, "b")
    posts = retrieval.postings(rows).select("chunk_id", "bucket", "tf")
    _segment(posts.repartitionByRange("bucket", "chunk_id").sortWithinPartitions("bucket"), path, "postings", number)
    posts = spark.read.schema("chunk_id string, bucket long, tf double").parquet(f"{path}/postings/seg={number}")
    _segment(retrieval.vectors_of(posts, dimensions), path, "vectors", number)
    minus = gone.select(F.explode("terms").alias("bucket")).groupBy("bucket").agg((-F.count("*")).alias("n"))
    df = posts.groupBy("bucket").agg(F.count("*").alias("n")).unionByName(minus).groupBy("bucket").agg(F.sum("n").alias("n"))
    _segment(df.coalesce(1), path, "df", number)  # one row a hash bucket
    terms = posts.groupBy("chunk_id").agg(F.collect_list("bucket").alias("terms"))
    ids = rows.select("chunk_id", "b").join(terms, "chunk_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<bigint>")))
    _segment(ids.repartitionByRange("b", "chunk_id"), path, "ids", number, "b")
    _segment(_sketches(rows), path, "sketches", number)
    # the buckets' rows, from what is there and what comes, then in place of their folders
    have = None
    try:
        have = spark.read.parquet(f"{path}/chunks").filter(in_touched)
    except Exception as e:
        if not missing(e):
            raise
    whole = rows if have is None else have.join(out.select("chunk_id"), "chunk_id", "left_anti").select(*rows.columns).unionByName(rows)
    whole.repartitionByRange("b", "chunk_id").write.mode("overwrite").parquet(f"{staged}/chunks")
    merged = spark.read.parquet(f"{staged}/chunks")
    merged.repartitionByRange("b", "chunk_id").sortWithinPartitions("b", "chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b").parquet(f"{path}/chunks")
    for b in set(touched) - {r["b"] for r in merged.select("b").distinct().collect()}:
        remove_path(spark, f"{path}/chunks/b={b}")  # nothing is left of the bucket
    n, minus_n = rows.count(), gone.count()
    made = Version(number, base, n, minus_n, (last.chunks if last else 0) + n - minus_n, buckets, dimensions)
    _commit(spark, path, made)
    remove_path(spark, staged)
    return made


def _sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("journal_id").agg(F.hll_sketch_agg(F.col("doc_id").cast("string"), F.lit(14)).alias("sketch"))


def _commit(spark: SparkSession, path: str, made: Version) -> None:
    spark.createDataFrame([(json.dumps(asdict(made)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest/v={made.number}")


def _held(rows: DataFrame, deletes: DataFrame, n_deleted: int) -> DataFrame:
    """Rows of segments that no later segment deletes."""
    if not n_deleted:
        return rows.drop("seg")
    gone = deletes.groupBy("chunk_id").agg(F.max("seg").alias("gone"))
    gone = F.broadcast(gone) if n_deleted <= DELETES_MOST else gone
    return rows.join(gone, "chunk_id", "left").filter("gone IS NULL OR seg >= gone").drop("seg", "gone")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """chunks, postings, idf and vectors as search() takes them, of all writes so far."""
    made = versions(spark, path)
    if not made:
        raise ValueError(f"no index at {path}")
    base, last = made[-1].base, made[-1].number
    deletes, n_deleted = _segments(spark, path, "deletes", base, last), sum(v.deleted for v in made)
    counts = _segments(spark, path, "df", base, last).groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 0")
    chunks = spark.read.parquet(f"{path}/chunks")
    return {
        "chunks": chunks.select(*CHUNK_COLUMNS, *[c for c in chunks.columns if c not in CHUNK_COLUMNS and c not in ("seg", "b")]),
        "postings": _held(_segments(spark, path, "postings", base, last), deletes, n_deleted),
        "idf": retrieval.idf_of(counts, made[-1].chunks),
        "vectors": _held(_segments(spark, path, "vectors", base, last), deletes, n_deleted),
    }


def document_estimates(spark: SparkSession, path: str) -> DataFrame:
    """journal_id and about how many documents it has, from the writes' sketches, which no row is read for; documents removed since the last compaction still count."""
    made = versions(spark, path)
    rows = _segments(spark, path, "sketches", made[-1].base, made[-1].number)
    return rows.groupBy("journal_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("documents"))


def compact(spark: SparkSession, path: str) -> Version:
    """One segment in place of all: what holds of each, without deletes. Readers see it once it is whole; the old segments go then."""
    made = versions(spark, path)
    last, base = made[-1], made[-1].base
    number, index = last.number + 1, read_index(spark, path)
    _segment(index["postings"].repartitionByRange("bucket", "chunk_id").sortWithinPartitions("bucket"), path, "postings", number)
    _segment(index["vectors"], path, "vectors", number)
    _segment(index["idf"].select("bucket", "n").coalesce(1), path, "df", number)
    live = _live(_segments(spark, path, "ids", base, last.number), _segments(spark, path, "deletes", base, last.number))
    _segment(live.select("chunk_id", "terms", "b").repartitionByRange("b", "chunk_id"), path, "ids", number, "b")
    _segment(_sketches(index["chunks"]), path, "sketches", number)
    new = Version(number, number, last.chunks, 0, last.chunks, last.buckets, last.dimensions)
    _commit(spark, path, new)
    for v in range(base, number):
        for name in TABLES:
            remove_path(spark, f"{path}/{name}/seg={v}")
    for v in made:
        remove_path(spark, f"{path}/manifest/v={v.number}")
    return new
