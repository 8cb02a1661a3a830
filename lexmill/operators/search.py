"""Search from an index that is built once: modes, over-fetch, re-ranking, gate, one result a document, doubts, and the article tools.

An index is a folder of tables: ``chunks`` (by journal), ``postings`` (sorted by bucket, so that a query's buckets prune row groups), ``idf``,
``vectors``, and ``titles`` and ``keywords`` for filters. A search reads the postings of the buckets its queries touch and nothing else of the corpus, then the candidates' chunks.
With ``ann`` an index has cells of vectors as well (see vector_index), and dense results come from the nearest ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import cut_at_space
from lexmill.operators import keyword_index, retrieval, vector_index
from lexmill.session import missing, remove_path, shuffles_released

MODES = ("hybrid", "dense", "sparse")
LONGEST_QUERY = 2000
FETCH_MOST = 100
#: Distinct buckets of a set of queries up to which they are pushed down to the scan as a list.
PUSHED = 2000
#: Results of a set of queries up to which the driver holds their ids and scores.
RESULTS_MOST = 200_000
# What a chunk row has, and what stands for a value left out.
CHUNK_COLUMNS = {"chunk_id": "", "doc_id": "", "text": "", "title": "", "section": "", "chunk_index": 0, "journal_id": "", "char_len": 0}
WARNING = "هذه النتائج أولية وقد تحتوي على تطابقات موضوعية عامة. جرّب إيقاف HyDE أو تضييق الاستعلام أو استخدام كلمات أكثر تحديداً."


def chunk_payload(chunks: DataFrame, titles: DataFrame, metadata: Column) -> DataFrame:
    """Chunks with their document's title and the fields of its id, as an index holds them."""
    rows = chunks.join(titles.select("doc_id", "title"), "doc_id", "left").withColumn("m", metadata)
    return rows.select("chunk_id", "doc_id", "text", F.coalesce("title", F.lit("")).alias("title"), "section", "char_len", "chunk_index", "m.*")


def with_defaults(points: DataFrame) -> DataFrame:
    """Points as results: fields left out are empty or 0, as is a score."""
    have = set(points.columns)
    rows = [(F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).alias(c) for c, v in CHUNK_COLUMNS.items()]
    return points.select(*rows, (F.coalesce("score", F.lit(0.0)) if "score" in have else F.lit(0.0)).alias("score"), *[c for c in points.columns if c not in CHUNK_COLUMNS and c != "score"])


def shown(results: DataFrame, snippet: bool = True, base_url: str = "") -> DataFrame:
    """Results as tools return them: empty fields as null, rounded scores, a snippet (or the whole text), the PDF's address."""
    text = cut_at_space("text", 700, 350) if snippet else F.col("text")
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("title", "section", "journal_id")]
    address = F.concat(F.lit(f"{base_url}/api/pdf/"), F.col("doc_id").cast("string"))
    keys = [c for c in ("query_id", "position") if c in results.columns]
    return results.select(*keys, "doc_id", *fields, F.round("score", 4).alias("score"), text.alias("snippet"), "chunk_index", address.alias("pdf_url"))


def checked_query(query: str | None, mode: str = "hybrid") -> str:
    """The query, stripped; ValueError for a blank or long one or an unknown mode."""
    query = (query or "").strip()
    if not query:
        raise ValueError("the query is empty")
    if len(query) > LONGEST_QUERY:
        raise ValueError(f"the query has more than {LONGEST_QUERY} characters")
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return query


def clamped(value: Column | int, least: int, most: int):
    """A number brought between two bounds."""
    return max(least, min(most, value)) if isinstance(value, int) else F.greatest(F.lit(least), F.least(F.lit(most), value))


def write_index(chunks: DataFrame, path: str, dimensions: int = retrieval.DIMENSIONS, recreate: bool = False, ann: bool = False) -> bool:
    """Build an index of chunks (see CHUNK_COLUMNS); whether it was built. One that is there and whole is kept as it is, points and all, and must have vectors as long; ``recreate`` replaces it.

    ``ann`` adds cells of vectors. To add chunks to an index, see increments.
    """
    spark = chunks.sparkSession
    if not recreate:
        have = index_dimensions(spark, path)
        if have is not None and have != dimensions:
            raise ValueError(f"the index has vectors of {have} dimensions, not {dimensions}; recreate it")
        if have is not None:
            return False
    with shuffles_released(spark):
        _write_tables(chunks, path, dimensions, ann)
    return True


def _write_tables(chunks: DataFrame, path: str, dimensions: int, ann: bool) -> None:
    spark, staged = chunks.sparkSession, f"{path}/staged"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    # a sort by range looks at its rows twice, so what is costly to make is written as it comes first
    made = write(with_defaults(chunks).drop("score"), "staged")
    # sorted by id, by which results are looked up; with what re-ranking needs, so that no search reads words out of texts again
    whole = made.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    rows = write(retrieval.with_terms(whole), "chunks").drop(*retrieval.TERM_COLUMNS)
    remove_path(spark, staged)
    # buckets are hashes, so equal ranges of them need no look at the rows; the stages below read postings, so texts are tokenised once
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = retrieval.postings(rows).repartition(n, F.floor(F.col("bucket") * n / P.BUCKETS)).sortWithinPartitions("bucket")
    stored = write(posts, "postings")
    write(retrieval.document_frequency(stored, rows.count()).coalesce(1), "idf")  # one row a bucket
    keyword_index.write_keyword_index(rows, path)
    vectors = retrieval.vectors_of(stored, dimensions)
    if ann:
        # these are read several times
        vectors = write(vectors, "staged")
        vector_index.write_vectors(vectors, f"{path}/ann")
    # these come last: an index that has them is whole
    write(vectors, "vectors")
    remove_path(spark, staged)


def index_dimensions(spark: SparkSession, path: str) -> int | None:
    """Length of an index's vectors; None without an index."""
    try:
        first = spark.read.parquet(f"{path}/vectors").select(F.size("vector").alias("n")).first()
    except Exception as e:
        if missing(e):
            return None
        raise
    return first["n"] if first else None


def read_index(spark: SparkSession, path: str, ann: bool = False) -> dict[str, DataFrame | str]:
    index: dict[str, DataFrame | str] = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "postings", "idf", "vectors", "titles", "keywords")}
    index["ranked"], index["chunks"] = index["chunks"], index["chunks"].drop(*retrieval.TERM_COLUMNS)
    return index | {"ann": f"{path}/ann"} if ann else index


def held_to(index: dict, title: str | None = None, phrase: bool = False, **equal: str | None) -> DataFrame | None:
    """chunk_id of the chunks that fit the equalities and whose title has the words; None without a condition. By the index of fields where there is one."""
    fields = {k: v for k, v in equal.items() if v}
    if not fields and not title:
        return None
    indexed = "keywords" in index and all(k in keyword_index.KEYWORDS for k in fields)
    found = keyword_index.chunks_with_values(index["keywords"], **fields) if fields and indexed else retrieval.metadata_filter(index["chunks"], **fields).select("chunk_id")
    if title:
        titles = index["titles"] if "titles" in index else index["chunks"].select("doc_id", F.posexplode(keyword_index.title_words("title")).alias("place", "word"))
        documents = keyword_index.documents_with_title(titles, title, phrase)
        found = found.join(index["chunks"].join(documents, "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    return found


def touched(posts: DataFrame, query_posts: DataFrame, known: pa.Table | None = None) -> DataFrame:
    """Postings of the queries' buckets (``known``, if the driver has them): few buckets go to the scan as a list, more go through the join that follows."""
    own = pc.unique(known.column("bucket")).to_pylist() if known is not None else [r["bucket"] for r in query_posts.select("bucket").distinct().limit(PUSHED + 1).collect()]
    return posts.filter(F.col("bucket").isin(own)) if len(own) <= PUSHED else posts


def search(index: dict[str, DataFrame], queries: DataFrame, top_k: int = 10, mode: str = "hybrid", prefetch: int | None = None, gated: bool = True, title: str | None = None, phrase: bool = False, **equal: str | None) -> DataFrame:
    """Results of queries (query_id, query): chunks that fit the equalities and whose title has the words of ``title``, retrieved, re-ranked and gated; position from 1.

    Hybrid search fuses the first ``prefetch`` (three times top_k) sparse and dense results of each query. Filters act below the ranking; filtered dense search reads all vectors that are left.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    spark = queries.sparkSession
    within = held_to(index, title, phrase, **equal)
    n = (prefetch or 3 * top_k) if mode == "hybrid" else top_k
    # queries are a stated set: while they are few, the driver holds them and what they come to, and nothing is counted or made twice
    queries, asked = retrieval.on_driver(queries, retrieval.QUERIES_MOST)
    q_posts, own = retrieval.postings(queries, "query_id", "query"), None
    if asked is not None:
        q_posts, own = retrieval.on_driver(q_posts, retrieval.SMALL_ROWS)
    few = own is not None
    found = {}
    if mode != "dense":
        posts = touched(index["postings"], q_posts, own)
        posts = posts.join(within, "chunk_id", "left_semi") if within is not None else posts
        found["sparse"] = retrieval.top_k(retrieval.sparse_scores_of(q_posts, posts, index["idf"], few=few), n)
    if mode != "sparse":
        vectors = index["vectors"] if within is None else index["vectors"].join(within, "chunk_id", "left_semi")
        if within is None and "ann" in index:
            found["dense"] = vector_index.nearest(spark, index["ann"], retrieval.vectors_of(q_posts, retrieval.DIMENSIONS, "query_id"), n)
        elif few:
            ids, unit = retrieval.unit_vectors_of(own)
            found["dense"] = retrieval.nearest_to(ids, unit, dict(queries.dtypes)["query_id"], vectors, n)
        else:
            found["dense"] = retrieval.dense_top_k(retrieval.vectors_of(q_posts, retrieval.DIMENSIONS, "query_id"), vectors, n)
    best = retrieval.fuse(found, top_k) if mode == "hybrid" else next(iter(found.values()))
    chunks = index.get("ranked", index["chunks"])
    if few and len(asked) * top_k <= RESULTS_MOST:
        # the results' chunks are looked up by id, which prunes what is read of them
        got = best.toArrow()
        best = F.broadcast(spark.createDataFrame(got, schema=best.schema))
        ids = pc.unique(got.column("chunk_id"))
        chunks = chunks.filter(F.col("chunk_id").isin(ids.to_pylist())) if len(ids) <= PUSHED else chunks
    else:
        best = retrieval.small(best)
    rows = best.join(chunks, "chunk_id").join(F.broadcast(queries) if few else queries, "query_id")
    ranked = retrieval.rerank(rows.withColumnRenamed("score", "raw_score"))
    kept = retrieval.confidence_gate(ranked) if gated else ranked
    order = Window.partitionBy("query_id").orderBy("new_rank")
    return kept.withColumn("position", F.row_number().over(order))


def search_articles(index: dict[str, DataFrame], queries: DataFrame, top_k: int = 10, mode: str = "hybrid", deduplicate: bool = True, **equal: str | None) -> tuple[DataFrame, DataFrame]:
    """Results, one a document, and the answers' heads: query_id, total, low_confidence, warning, suggestions."""
    top_k = clamped(top_k, 1, 25)
    found = search(index, queries, min(5 * top_k, FETCH_MOST) if deduplicate else top_k, mode, **equal)
    if deduplicate:
        found = retrieval.dedup_per_document(found, top_k, "new_rank").drop("position").withColumnRenamed("doc_rank", "position")
    return found, heads(queries, found)


def heads(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, total, low_confidence, warning, suggestions of results with positions."""
    placed = results.withColumn("new_rank", F.col("position"))
    doubt = retrieval.low_confidence(queries, placed)
    phrases = retrieval.suggestions(placed.withColumn("rank", F.col("position")), doubt)
    phrases = phrases.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "suggestion"))).alias("s"))
    total = results.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = doubt.join(total, "query_id", "left").join(phrases, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "low_confidence", F.when(F.col("low_confidence"), F.lit(WARNING)).alias("warning"), F.coalesce(F.transform("s", lambda x: x["suggestion"]), none).alias("suggestions"))


def with_hypotheses(queries: DataFrame, written: DataFrame, one_document: bool = False) -> DataFrame:
    """Queries with the paragraph that a model wrote for them (query_id, hypothesis) in their place, for retrieval and re-ranking alike; as they are without
    one, and in a search within one document."""
    if one_document:
        return queries
    rows = queries.join(written.select("query_id", "hypothesis"), "query_id", "left")
    return rows.withColumn("query", F.coalesce(F.nullif(F.trim("hypothesis"), F.lit("")), F.col("query"))).select(*queries.columns)


def scroll(index: dict[str, DataFrame], n: int, **equal: str | None) -> DataFrame:
    """The first n chunks by id that fit the equalities, without vectors or scores: a page of the table."""
    return retrieval.metadata_filter(index["chunks"], **equal).orderBy("chunk_id").limit(n)


def stored_result(spark: SparkSession, folder: str, request: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of a request, kept in the folder under a hash of the request: made at the first call, read by later ones."""
    path = f"{folder}/{hashlib.md5(json.dumps(request, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if not missing(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def passages(index: dict[str, DataFrame], queries: DataFrame, doc_id, top_k: int = 5, mode: str = "hybrid") -> DataFrame:
    """Results within one document, whole texts, several of it."""
    own = dict(index, chunks=index["chunks"].filter(F.col("doc_id") == F.lit(doc_id)))
    own.pop("ann", None)
    ids = own["chunks"].select("chunk_id")
    own["postings"], own["vectors"] = (index[n].join(retrieval.small(ids), "chunk_id", "left_semi") for n in ("postings", "vectors"))
    return search(own, queries, clamped(top_k, 1, 10), mode)


def article_pages(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """A part of an article's text for requests (request_id, doc_id, max_chars, offset): its title and journal, total_chars, offset, text, truncated; null text for unknown ids."""
    size, at = clamped(F.coalesce("max_chars", F.lit(8000)), 1000, 40_000), F.greatest(F.lit(0), F.coalesce("offset", F.lit(0)))
    rows = requests.select("request_id", "doc_id", size.alias("size"), at.alias("offset")).join(articles.select("doc_id", "title", "text"), "doc_id", "left")
    n = F.length("text")
    return rows.select(
        "request_id",
        "doc_id",
        F.nullif("title", F.lit("")).alias("title"),
        F.substring(F.col("doc_id").cast("string"), 1, 4).alias("journal_id"),
        n.alias("total_chars"),
        "offset",
        F.when(F.col("offset") >= n, "").otherwise(F.substring(F.col("text"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))).alias("text"),
        ((F.col("offset") < n) & (F.col("offset") + F.col("size") < n)).alias("truncated"),
        F.concat(F.lit("/api/pdf/"), F.col("doc_id").cast("string")).alias("pdf_url"),
    )


def with_neighbours(results: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Results with the chunks up to ``reach`` places before and after them in their documents, each once a query; offset tells how far."""
    around = results.select("query_id", "doc_id", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.struct(k.alias("offset"), (F.col("chunk_index") + k).alias("chunk_index")))).alias("x"))
    near = around.select("query_id", "doc_id", "x.chunk_index", F.abs("x.offset").alias("offset")).groupBy("query_id", "doc_id", "chunk_index").agg(F.min("offset").alias("offset"))
    return chunks.join(retrieval.small(near), ["doc_id", "chunk_index"])


def overview(chunks: DataFrame) -> DataFrame:
    """Documents and chunks of an index, and where it says what language it is in."""
    return chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks")).withColumn("language", F.lit("ar"))
