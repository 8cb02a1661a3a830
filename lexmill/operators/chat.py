"""Turns of a chat over the corpus or a document, as tables of prompts; what a model would write comes from a column or a stated stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.display import document_share
from lexmill.functions.text import strip
from lexmill.operators.evidence import bare_json

MOST_SUBQUERIES, MOST_FOLLOWUPS, DEEP_CHUNKS = 4, 3, 18
CHUNK_CHARS, SNIPPET_CHARS, DOCUMENT_CHARS = 1800, 200, 400_000
# What stands after a text that was cut.
CUT_DOCUMENT = "\n\n[... تم اختصار المستند لأن حجمه يتجاوز الحد المسموح به ...]"
CUT_ONE_OF_MANY = "\n\n[... تم اختصار المستند ...]"


def told_list(raw: Column | str, field: str) -> Column:
    """The strings, stripped and not blank, of a list in a model's JSON object; empty where it is broken or none."""
    got = F.from_json(F.get_json_object(bare_json(raw), f"$.{field}"), "array<string>")
    kept = F.filter(F.transform(got, lambda x: strip(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def sub_queries(raw: Column | str, query: Column | str, most: int = MOST_SUBQUERIES) -> Column:
    """Sub-queries that a model wrote, without repeats whatever their case, in order; the query itself without any."""
    found = told_list(raw, "subqueries")
    keys = F.transform(found, lambda x: F.lower(x))
    first = F.slice(F.filter(found, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)
    return F.when(F.size(first) > 0, first).otherwise(F.array(F.col(query) if isinstance(query, str) else query))


def follow_ups(raw: Column | str, most: int = MOST_FOLLOWUPS) -> Column:
    return F.slice(told_list(raw, "followups"), 1, most)


def json_or_null(value: Column) -> Column:
    """A list or map as JSON; null where it is null or empty."""
    return F.when(F.size(value) > 0, F.to_json(value))


def document_title(text: Column | str) -> Column:
    """The first line of the first 200 characters; ``Unknown`` for an empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(F.split(F.substring(c, 1, 200), "\n")[0])


def document_context(text: Column | str) -> Column:
    """A document as a prompt has it: its title, and its text cut with a notice where it is too long."""
    c = F.col(text) if isinstance(text, str) else text
    body = F.when(F.length(c) > DOCUMENT_CHARS, F.concat(F.substring(c, 1, DOCUMENT_CHARS), F.lit(CUT_DOCUMENT))).otherwise(c)
    return F.concat(F.lit("**Title:** "), document_title(c), F.lit("\n\n"), body)


def compared_documents(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """What each request (request_id, doc_id, compare_ids: array) compares with its document: used and missing ids in order, and whether nothing is usable
    though something was asked for. The document itself is passed over; those without text are missing."""
    asked = requests.select("request_id", "doc_id", F.posexplode_outer("compare_ids").alias("pos", "other"))
    held = docs.select(F.col("doc_id").alias("other"), (strip(F.coalesce("text", F.lit(""))) != "").alias("usable"))
    rows = asked.filter("other IS NULL OR other != doc_id").join(held, "other", "left")
    usable = F.coalesce("usable", F.lit(False))
    got = rows.groupBy("request_id").agg(*[F.array_sort(F.collect_list(F.when(ok & F.col("other").isNotNull(), F.struct("pos", "other")))).alias(n) for n, ok in (("used", usable), ("missing", ~usable))])
    ids = requests.select("request_id").join(got, "request_id", "left").select("request_id", *[F.coalesce(F.transform(n, lambda x: x["other"]), F.array().cast(rows.select(F.array("other")).schema[0].dataType)).alias(n) for n in ("used", "missing")])
    return ids.withColumn("not_found", (F.size("used") == 0) & (F.size("missing") > 0))


def comparison_prompts(compared: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    """request_id and the document part of a prompt over several documents, each with an even share of the budget; the first is the document asked about."""
    first = requests.select("request_id", F.lit(0).alias("pos"), "doc_id")
    others = compared.select("request_id", F.posexplode("used").alias("pos", "doc_id")).withColumn("pos", F.col("pos") + 1)
    rows = first.unionByName(others).join(docs.select("doc_id", "text"), "doc_id").join(compared.select("request_id", (F.size("used") + 1).alias("n")), "request_id")
    share = document_share(F.col("n"))
    body = F.when(F.length("text") > share, F.concat(F.substring(F.col("text"), F.lit(1), share.cast("int")), F.lit(CUT_ONE_OF_MANY))).otherwise(F.col("text"))
    title = F.when((F.col("text") == "") & (F.col("pos") > 0), F.col("doc_id").cast("string")).otherwise(document_title("text"))
    block = F.concat(F.lit("### المستند "), (F.col("pos") + 1).cast("string"), F.when(F.col("pos") == 0, " (الأساسي)").otherwise(""), F.lit(": "), title, F.lit("\n\n"), body, F.lit("\n\n"))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "").alias("documents"))


def chat_sources(results: DataFrame) -> DataFrame:
    """The sources of a turn: the best chunk of each document by rounded score, with text and snippet, ordered by score (source_rank)."""
    text = F.substring(strip(F.coalesce("text", F.lit(""))), 1, CHUNK_CHARS)
    rows = results.select(
        "query_id", "doc_id", F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string")).alias("title"), "chunk_id", F.round("score", 4).alias("score"), F.substring(text, 1, SNIPPET_CHARS).alias("snippet"), text.alias("text"),
        F.coalesce("section", F.lit("")).alias("section"), F.coalesce("journal_id", F.lit("")).alias("journal_id"), "rank",
    )
    # the first row of a document stands unless a later one is better; documents of one score stay in the order in which they came
    by_doc = rows.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("title", "chunk_id", "score", "snippet", "text", "section", "journal_id"), F.struct("score", -F.col("rank"))).alias("s"), F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s.score"), "first")
    return by_doc.withColumn("source_rank", F.row_number().over(order)).select("query_id", "doc_id", "s.*", "source_rank")


def chat_turns(messages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Corpus-chat turns from messages (query_id, message, history: array of (role, text) in order) and, on demand, what a model wrote for them
    (query_id, rewritten, subqueries, deep): the standalone query, sub-queries, the number of chunks to retrieve for deep turns, and the messages that go into the prompt."""
    model = answers if answers is not None else messages.sparkSession.createDataFrame([], f"query_id {dict(messages.dtypes)['query_id']}, rewritten string, subqueries string, deep boolean")
    rows = messages.join(model, "query_id", "left")
    users = F.filter("history", lambda m: m["role"] == "user")
    fallback = strip(F.concat(F.coalesce(F.try_element_at(users, F.lit(-1))["text"], F.lit("")), F.lit(" "), F.col("message")))
    query = F.when(F.size("history") == 0, F.col("message")).otherwise(F.coalesce(F.nullif(strip("rewritten"), F.lit("")), F.nullif(fallback, F.lit("")), F.col("message")))
    rows = rows.withColumn("query", query)
    subs = F.when(F.coalesce("deep", F.lit(False)), sub_queries("subqueries", "query")).otherwise(F.array().cast("array<string>"))
    n = F.size("history")
    last = F.when(n > 12, F.slice("history", F.greatest(n - 7, F.lit(1)), 8)).otherwise(F.slice("history", F.greatest(n - 19, F.lit(1)), 20))
    kept = F.filter(last, lambda m: m["role"].isin("user", "assistant") & (F.coalesce(m["text"], F.lit("")) != ""))
    return rows.select(
        "query_id",
        "query",
        F.when(F.size(subs) > 1, subs).otherwise(F.array().cast("array<string>")).alias("sub_queries"),
        F.when(strip("query") != strip("message"), F.col("query")).otherwise("").alias("rewritten_query"),
        F.when(n > 12, n - 8).otherwise(0).alias("n_summarised"),
        F.concat(kept, F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("text")))).alias("prompt"),
    )


def analysis(raw: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Analyses (doc_id, analysis as JSON) that a model wrote (doc_id, raw), fences off, those in the cache as they are; and the cache with the new ones. Broken JSON isn't kept."""
    fresh = raw if cache is None else raw.join(cache.select("doc_id"), "doc_id", "left_anti")
    bare = strip(F.regexp_replace(F.regexp_replace(strip("raw"), "^```[^\n]*\n", ""), "```$", ""))
    good = fresh.select("doc_id", F.to_json(F.try_parse_json(bare)).alias("analysis")).filter("analysis IS NOT NULL")
    every = good if cache is None else cache.select("doc_id", "analysis").unionByName(good)
    return every.join(raw.select("doc_id"), "doc_id", "left_semi"), every
