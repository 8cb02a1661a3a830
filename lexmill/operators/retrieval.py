"""Retrieval: postings, sparse and dense scores, fusion, re-ranking, gating, per-document dedup, facets, suggestions.

Queries are a DataFrame (query_id, query), so any number of them runs in one plan; they and the buckets they touch are the small side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import bigrams, bucket, coverage, cut_at_space, normalize_search, search_tokens, token_runs

SMALL_ROWS = 500_000
DIMENSIONS = 64
QUERIES_MOST = 5000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has few rows; as it is beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def on_driver(df: DataFrame, rows: int) -> tuple[DataFrame, pa.Table | None]:
    """The frame as a local table, made once, and the table itself, if it has at most so many rows; else the frame as it is and None."""
    got = df.limit(rows + 1).toArrow()
    return (df.sparkSession.createDataFrame(got, schema=df.schema), got) if len(got) <= rows else (df, None)


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: scaled, rounded half away from zero and scaled back. round() goes by the shortest decimal text, which is another value where that ends in 5."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def rounded_array(x: np.ndarray, digits: int) -> np.ndarray:
    """The same in numpy, whose round() takes halves to even."""
    scaled = x * 10.0**digits
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits


def metadata_filter(df: DataFrame, **equal: str | None) -> DataFrame:
    """Conjunction of equalities; empty values are no condition. Applied below the ranking, so it reaches the scan."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, bucket, tf: the share of the chunk's tokens in each hash bucket."""
    # texts are dealt by id once; all that follows is by id as well, so nothing else is shuffled
    found = chunks.select(id_col, F.col(text_col).alias("text")).repartition(id_col).select(id_col, F.explode(token_runs("text")).alias("token"))
    kept = found.select(id_col, F.lower("token").alias("token")).filter(~F.col("token").isin(P.STOP_WORDS))
    counted = kept.groupBy(id_col, "token").agg(F.count("*").alias("k"))  # a token of a chunk is hashed once
    counted = counted.groupBy(id_col, bucket("token").alias("bucket")).agg(F.sum("k").alias("k"))
    return counted.select(id_col, "bucket", (F.col("k") / F.sum("k").over(Window.partitionBy(id_col))).alias("tf"))


def document_frequency(posts: DataFrame, n_chunks: Column | int) -> DataFrame:
    """bucket, n, idf = ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return idf_of(posts.groupBy("bucket").agg(F.count("*").alias("n")), n_chunks)


def idf_of(counts: DataFrame, n_chunks: Column | int) -> DataFrame:
    """The same from counts (bucket, n)."""
    total = F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks
    return counts.select("bucket", "n", F.log(1 + (total - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))


def sparse_scores(queries: DataFrame, posts: DataFrame, idf: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, score: sum of query tf, tf and idf over common buckets, rounded so that order doesn't depend on the plan."""
    return sparse_scores_of(postings(queries, "query_id", "query"), posts, idf, id_col)


def sparse_scores_of(query_posts: DataFrame, posts: DataFrame, idf: DataFrame, id_col: str = "chunk_id", few: bool = False) -> DataFrame:
    """The same for postings of queries; ``few`` says that they are known to be few, so that nothing is counted."""
    q = query_posts.withColumnRenamed("tf", "q_tf").join(F.broadcast(idf.select("bucket", "idf")), "bucket")  # one row a bucket
    q = F.broadcast(q) if few else small(q)
    met = posts.join(q, "bucket")
    return met.groupBy("query_id", id_col).agg(rounded(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), 6).alias("score"))


def hashed_vectors(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """id and a unit vector: signed feature hashing of tokens, the offline stand-in for a model's embedding."""
    return vectors_of(postings(chunks, id_col, text_col), dimensions, id_col)


def vectors_of(posts: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "chunk_id") -> DataFrame:
    """The same from postings."""
    sign = 1 - 2 * F.pmod(F.floor(F.col("bucket") / dimensions), F.lit(2))
    per = posts.groupBy(id_col, F.pmod("bucket", F.lit(dimensions)).alias("d")).agg(F.sum(sign * F.col("tf")).alias("v"))
    found = per.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at("m", d.cast("bigint")), F.lit(0.0)) / F.col("norm"))
    return found.filter("norm > 0").select(id_col, vector.alias("vector"))


def unit_vectors_of(posts: pa.Table, dimensions: int = DIMENSIONS, id_col: str = "query_id") -> tuple[pa.Array, np.ndarray]:
    """The same for the few postings of queries, on the driver: ids and their unit vectors."""
    ids = pc.unique(posts.column(id_col).combine_chunks())
    at = pc.index_in(posts.column(id_col).combine_chunks(), ids).to_numpy(zero_copy_only=False)
    bucket_ = posts.column("bucket").to_numpy()
    v = np.zeros((len(ids), dimensions))
    np.add.at(v, (at, bucket_ % dimensions), (1 - 2 * (bucket_ // dimensions % 2)) * posts.column("tf").to_numpy())
    norm = np.linalg.norm(v, axis=1)
    return ids.filter(pa.array(norm > 0)), v[norm > 0] / norm[norm > 0][:, None]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, score: cosine of every query (query_id, vector) with every row; queries are a stated set, broadcast while it is small."""
    cosine = dot("q", "vector") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("vector", "vector")))
    return vectors.crossJoin(small(queries.withColumnRenamed("vector", "q"))).select("query_id", id_col, rounded(cosine, 6).alias("score"))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "chunk_id", partition: str = "query_id", block: int = 256) -> DataFrame:
    """The k nearest rows of each query (query_id, vector) by cosine, ties by id: matrix products of blocks in each task, whose k best per query meet in one window.

    Rows and queries without a vector, or with one of another length, have no neighbours. Queries are a stated set: they are written as Arrow into each task's closure while they are few, and go through dense_scores() beyond that.
    """
    if queries.limit(QUERIES_MOST + 1).count() > QUERIES_MOST:
        return top_k(dense_scores(queries, vectors, id_col), k, id_col, partition)
    queries = queries.filter("size(vector) > 0")
    got = queries.select(partition, F.transform("vector", lambda x: x.cast("double")).alias("vector")).toArrow()
    ids = got.column(partition)
    if not len(ids):
        return top_k(dense_scores(queries, vectors, id_col), k, id_col, partition)
    q = np.stack([np.asarray(v) for v in got.column("vector").to_pylist()])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    return nearest_to(ids.combine_chunks(), q, dict(queries.dtypes)[partition], vectors, k, id_col, partition, block)


def nearest_to(ids: pa.Array, q: np.ndarray, id_kind: str, vectors: DataFrame, k: int, id_col: str = "chunk_id", partition: str = "query_id", block: int = 256) -> DataFrame:
    """The same for queries that the driver has: their ids (of a kind that Spark names so) and unit vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    rows = vectors.filter(F.size("vector") == q.shape[1]).select(id_col, F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    kinds = dict(rows.dtypes)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of the task so far: query, score, id
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                v = part.column("vector")
                x = np.asarray(v.flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                scores = rounded_array(m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 6)
                own = np.asarray(part.column(id_col).to_pylist(), dtype=object)
                query, at = np.divmod(np.arange(scores.size), part.num_rows)
                new = (query, scores.ravel(), own[at])
                best = new if best is None else tuple(np.concatenate([a, b]) for a, b in zip(best, new))
                order = np.lexsort((np.argsort(np.argsort(best[2], kind="stable")), -best[1], best[0]))
                best = tuple(c[order] for c in best)
                first = np.r_[0, np.flatnonzero(best[0][1:] != best[0][:-1]) + 1]
                rank = np.arange(len(best[0])) - np.repeat(first, np.diff(np.r_[first, len(best[0])]))
                best = tuple(c[rank < k] for c in best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[2].tolist(), type=part.column(id_col).type), pa.array(best[1])], names=[partition, id_col, "score"])

    found = rows.mapInArrow(nearest, f"{partition} {id_kind}, {id_col} {kinds[id_col]}, score double")
    return top_k(found, k, id_col, partition)


def top_k(scored: DataFrame, k: int, id_col: str = "chunk_id", partition: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1; ties by id."""
    w = Window.partitionBy(partition).orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(ranked: Mapping[str, DataFrame], k: int, id_col: str = "chunk_id", rrf_k: int = P.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: sum of 1 / (rrf_k + rank), then the k best."""
    parts = [df.select("query_id", id_col, "rank") for df in ranked.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scored = union.groupBy("query_id", id_col).agg(rounded(F.sum(1.0 / (rrf_k + F.col("rank"))), 8).alias("score"))
    return top_k(scored, k, id_col)


#: What re-ranking needs to know of a chunk by itself; an index keeps it with its chunks.
TERM_COLUMNS = ("t_tokens", "s_tokens", "b_tokens", "x_pairs", "x_norm", "t_norm")


def with_terms(chunks: DataFrame) -> DataFrame:
    """Chunks (title, section, text) with TERM_COLUMNS."""
    body = F.substring("text", 1, 1800)
    rows = chunks.select("*", search_tokens("title").alias("t_tokens"), search_tokens("section").alias("s_tokens"), search_tokens(body).alias("b_tokens"))
    return rows.select(
        "*",
        bigrams(F.concat(F.slice("t_tokens", 1, 24), F.slice("b_tokens", 1, 48))).alias("x_pairs"),
        normalize_search(F.concat_ws(" ", "title", "section", body)).alias("x_norm"),
        normalize_search("title").alias("t_norm"),
    )


def rerank(candidates: DataFrame) -> DataFrame:
    """Adds lexical, title_score and final score to (query_id, query, chunk_id, title, section, text, raw_score, rank), and the new order.

    TERM_COLUMNS are taken from the candidates where they have them, and aren't in the result. Windows run within a query's candidates, whose number the caller has bound.
    """
    out = [c for c in candidates.columns if c not in TERM_COLUMNS]
    q, title, section = F.col("q_tokens"), F.col("t_tokens"), F.col("s_tokens")
    rows = candidates if set(TERM_COLUMNS) <= set(candidates.columns) else with_terms(candidates)
    rows = rows.withColumn("q_tokens", search_tokens("query")).withColumn("q_pairs", bigrams(q)).withColumn("q_norm", normalize_search("query"))
    rows = rows.withColumn("c_title", coverage(q, title)).withColumn("c_body", coverage(q, F.col("b_tokens"))).withColumn("c_section", coverage(q, section))
    rows = rows.withColumn("c_pairs", coverage(F.col("q_pairs"), F.col("x_pairs")))
    lexical = F.least(
        F.lit(1.0),
        0.55 * F.col("c_title") + 0.25 * F.col("c_body") + 0.10 * F.col("c_section") + 0.10 * F.col("c_pairs")
        + F.when((F.col("q_norm") != "") & F.col("x_norm").contains(F.col("q_norm")), 0.12).otherwise(0.0)
        + F.when((F.col("q_norm") != "") & F.col("t_norm").contains(F.col("q_norm")), 0.08).otherwise(0.0),
    )
    own = Window.partitionBy("query_id")
    low, high, n = F.min("raw_score").over(own), F.max("raw_score").over(own), F.count("*").over(own)
    rows = rows.withColumn("lexical", lexical)
    rows = rows.withColumn("raw_norm", F.when(high <= low, 1.0).otherwise((F.col("raw_score") - low) / (high - low)))
    rows = rows.withColumn("prior", F.when(n > 1, 1.0 - (F.col("rank") - 1) / F.greatest(n - 1, F.lit(1))).otherwise(1.0))
    damp = F.when((F.col("lexical") < 0.08) & (F.col("c_title") == 0) & (F.col("c_body") < 0.08), 0.72).otherwise(1.0)
    author = F.when(F.trim("title").rlike("(?iu)" + P.AUTHOR_TITLE), 0.14).otherwise(0.0)
    score = 0.45 * F.col("raw_norm") * damp + 0.25 * F.col("prior") * damp + 0.30 * F.col("lexical") - author
    rows = rows.withColumn("score", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return rows.select(*out, rounded(F.col("lexical"), 4).alias("lexical_score"), rounded(F.col("c_title"), 4).alias("title_score"), "score", F.row_number().over(order).alias("new_rank"))


def confidence_gate(ranked: DataFrame) -> DataFrame:
    """Rows of rerank() that are first, good enough against the first, or lexically close."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    close = F.greatest("lexical_score", "title_score") >= 0.24
    return ranked.withColumn("best", best).filter((F.col("new_rank") == 1) | (F.col("score") >= F.greatest(F.lit(0.2), F.round(F.col("best") * 0.42, 8))) | close).drop("best")


def low_confidence(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id and whether its results are doubtful: none, a weak first score, or weak lexical scores of the first three."""
    got = ranked.groupBy("query_id").agg(F.max("score").alias("top"), F.avg(F.when(F.col("new_rank") <= 3, F.col("lexical_score"))).alias("lexical"))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce((F.col("top") < 0.34) | (F.round("lexical", 6) < 0.14), F.lit(True)).alias("low_confidence"))


def dedup_per_document(ranked: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """The first row of each document in rank order, then the k first documents."""
    first = Window.partitionBy("query_id", "doc_id").orderBy(rank_col)
    rows = ranked.withColumn("in_doc", F.row_number().over(first)).filter("in_doc = 1").drop("in_doc")
    return rows.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(rank_col))).filter(F.col("doc_rank") <= k)


def facets(results: DataFrame, names: list[str], rank_col: str = "rank") -> DataFrame:
    """query_id, facet, value, n of the non-empty values of some columns in each query's results, in the order of count and first appearance."""
    pairs = results.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.trim(F.col(n)).alias("value")) for n in names])).alias("x"), F.col(rank_col).alias("rank"))
    counts = pairs.filter("x.value IS NOT NULL AND x.value != ''").groupBy("query_id", "x.facet", "x.value").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    order = Window.partitionBy("query_id", "facet").orderBy(F.desc("n"), F.asc("first_rank"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).drop("first_rank")


def suggestions(results: DataFrame, doubtful: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Distinct title phrases of a query's results, at most 80 characters, first ones first; with ``doubtful`` (query_id, low_confidence) only where these are."""
    phrase = cut_at_space(F.trim("title"), 80, 0)
    if doubtful is not None:
        results = results.join(doubtful.filter("low_confidence"), "query_id", "left_semi")
    rows = results.filter("trim(title) != ''").select("query_id", "rank", phrase.alias("suggestion"))
    first = Window.partitionBy("query_id", F.lower("suggestion")).orderBy("rank")
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("position") <= most).select("query_id", "position", "suggestion")


def lookup(ids: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks by id in the order of (pos, id); missing ids are left out."""
    return chunks.join(small(ids), id_col).orderBy("pos")
