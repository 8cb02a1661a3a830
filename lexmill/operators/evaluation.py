"""Tables of an evaluation: questions from CSV, per-sample metrics to CSV, means and worst samples, samples of chunks."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.session import shared_path

METRICS = ("context_recall", "context_precision", "faithfulness")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """row and question of a CSV test set with a column ``user_input``, blank ones passed over, the first ``limit``; ValueError without the column."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "user_input" not in rows.columns:
        raise ValueError(f"no column user_input, but {rows.columns}")
    kept = rows.select(F.monotonically_increasing_id().alias("row"), strip("user_input").alias("question")).filter("question != ''")
    return kept.orderBy("row").limit(limit) if limit else kept


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    """question and reference of a test set of either version of its columns."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [new if new in rows.columns else old for new, old in (("user_input", "question"), ("reference", "ground_truth"))]
    return rows.select(F.col(names[0]).alias("question"), F.col(names[1]).alias("reference"))


def write_metrics(scores: DataFrame, path: str) -> None:
    """One row a sample, with a header."""
    scores.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def means(scores: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """metric and mean over the samples that have it."""
    have = [n for n in names if n in scores.columns]
    value = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    one = scores.agg(*[F.avg(value(n)).alias(n) for n in have])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("mean")) for n in have])).alias("x")).select("x.*")


def worst(scores: DataFrame, metric: str = "context_recall", n: int = 3) -> DataFrame:
    """The n samples with the least values of a metric; a report of so many rows."""
    return scores.filter(F.col(metric).isNotNull()).orderBy(metric, "sample_id").limit(n)


def diverse_sample(chunks: DataFrame, n: int, seed: int, least_chars: int = 500, least_words: int = 30) -> DataFrame:
    """n chunks of as many documents, in the order of a shuffle by seed: the first of each document that is long enough."""
    rows = chunks.filter((F.length("text") >= least_chars) & (F.size(F.split(strip("text"), r"\s+")) >= least_words))
    ticket = F.md5(F.concat(F.lit(str(seed)), F.col("chunk_id").cast("string")).cast("binary"))
    rows = rows.withColumn("ticket", ticket).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ticket")))
    return rows.filter("k = 1").drop("k").orderBy("ticket").limit(n)


def lexical_recall(samples: DataFrame) -> DataFrame:
    """sample_id, context_recall and context_precision by words: shares of the reference's words that the contexts have, and of the contexts' words that the reference has.

    An offline stand-in for a judge's verdict: it claims no agreement with one.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " ")), r"\s+"), lambda w: w != ""))
    rows = samples.select("sample_id", words("reference").alias("r"), words("contexts").alias("c")).withColumn("n", F.size(F.array_intersect("r", "c")))
    share = lambda c: F.when(F.size(c) > 0, F.round(F.col("n") / F.size(c), 6))
    return rows.select("sample_id", share("r").alias("context_recall"), share("c").alias("context_precision"))


def chunk_report(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents, chunks, mean, least and largest size, and how many chunks are in each class of sizes, with their share."""
    size = F.length("text")
    edges = (0, 400, 800, 1200, 1600, 2000)
    bins = {f"from_{lo}": F.count_if((size >= lo) & (size < hi) if hi else size >= lo) for lo, hi in zip(edges, (*edges[1:], None))}
    one = chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(size), 4).alias("mean_chars"), F.min(size).alias("least"), F.max(size).alias("largest"), *[c.alias(n) for n, c in bins.items()])
    shares = {f"share_{n}": F.round(F.col(n) / F.greatest("n_chunks", F.lit(1)) * 100, 4) for n in bins}
    rows = one.join(docs.agg(F.count("*").alias("n_documents")))  # single rows
    return rows.withColumn("chunks_per_document", F.round(F.col("n_chunks") / F.greatest("n_documents", F.lit(1)), 4)).withColumns(shares)


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """chunk_id and what is wrong with it: an empty text, a length that isn't the text's, an index that doesn't count up in its document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    rows = chunks.withColumn("place", place)
    error = F.when(strip("text") == "", "empty").when(F.col("char_len") != F.length("text"), "length").when(F.col("chunk_index") != F.col("place"), "index")
    return rows.select("doc_id", "chunk_id", error.alias("error")).filter("error IS NOT NULL")


#: Bins of a range of values in one pass, and passes, which together tell any two doubles apart.
BINS = 1024
PASSES = 12


def order_statistics(rows: DataFrame, group: str, value: str, at: Mapping[str, Column], bins: int = BINS) -> DataFrame:
    """The values at given ranks (from 1, by the group's size n; below 1 and beyond n they are the first and last) of each group, exactly, as columns named as in ``at``.

    Counts by bin narrow each rank's range until all in it are equal: a pass keeps the bin that holds the rank, with the least and greatest value in it. A pass shuffles sums by bin and
    never the rows, so a group of any size, however it is distributed, is never sorted nor in one task. Null and NaN values have no rank; groups of these only aren't in the result. Infinite values
    count as the largest and least double.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    rows = rows.withColumn("v", F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), F.col("v"))))
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank.cast("long"))).alias("rank")) for name, rank in at.items()]))
    state = whole.select("g", "lo", "hi", ranks.alias("r")).select("g", "r.name", "r.rank", "lo", "hi")
    schema = state.schema
    for _ in range(PASSES):
        # a row a group and rank: kept in the shared folder, so that each pass starts from what the last one found
        path = shared_path(spark, f"ranks-{uuid.uuid4().hex}")
        state.write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        left = state.filter("lo < hi")
        n = left.count()
        if not n:
            break
        ranges = left.select("g", "lo", "hi").distinct()  # ranks in one bin share its counts
        own = ranges.withColumnRenamed("g", "g2")
        met = rows.join(F.broadcast(own) if n <= 100_000 else own, F.col("g").eqNullSafe(F.col("g2")) & F.col("v").between(F.col("lo"), F.col("hi")))
        wide = F.col("hi") - F.col("lo") == float("inf")  # more than a double holds: by halves
        share = F.when(wide, F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)).otherwise(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")))
        bin_ = F.least(F.lit(bins - 1).cast("long"), F.floor(share * bins))
        counts = met.groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        placed = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("g", "lo", "hi").orderBy("bin")))  # over the bins
        new = left.alias("s").join(placed.alias("c"), F.col("s.g").eqNullSafe(F.col("c.g")) & (F.col("s.lo") == F.col("c.lo")) & (F.col("s.hi") == F.col("c.hi")))
        new = new.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("k")))
        new = new.select("s.g", "name", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        state = state.filter("lo = hi").unionByName(new)
    return state.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in at])
