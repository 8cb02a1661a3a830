"""Queries over conversations, cited answers, alignment, and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.operators import citations, conversations, evaluation, evidence
from lexmill.plans import sql as S
from lexmill.plans.corpus_queries import documents, table
from lexmill.plans.registry import query
from lexmill.streaming import limiter


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(
    "conversation_list",
    """SELECT conv_id, n_messages, last_turn, substr(t, 1, 120) || CASE WHEN length(t) > 120 THEN '…' ELSE '' END AS preview FROM (SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, trim(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS t FROM conversations GROUP BY conv_id)""",
)
def conversation_list(spark, sf_dir):
    return conversations.conversation_list(messages(spark, sf_dir))


@query(
    "history_window",
    """SELECT conv_id, turn, role, kind, back FROM (SELECT *, CASE WHEN n > 12 AND back > 8 THEN 'summarised' WHEN n > 12 OR back <= 20 THEN 'verbatim' END AS kind FROM (
    SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND text != '')) WHERE kind IS NOT NULL""",
)
def history_window(spark, sf_dir):
    return conversations.history(messages(spark, sf_dir))


@query(
    "last_assistant",
    "SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id) x WHERE x.conv_id = c.conv_id AND x.turn = c.turn)",
)
def last_assistant(spark, sf_dir):
    return conversations.without_last_answer(messages(spark, sf_dir)).select("conv_id", "turn", "role")


@query(
    "recent_turns",
    """SELECT conv_id, turn, role, back, CASE WHEN back <= 6 THEN 'query' ELSE 'document' END AS goes_into FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS back FROM conversations) WHERE back <= 40""",
)
def recent_turns(spark, sf_dir):
    """The last six turns rewrite a query, the last forty go into a chat about one document."""
    return conversations.recent(messages(spark, sf_dir), 40).select("conv_id", "turn", "role", "back", F.when(F.col("back") <= 6, "query").otherwise("document").alias("goes_into"))


@query("without_open_question", "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE NOT (turn = last AND role = 'user')")
def without_open_question(spark, sf_dir):
    return conversations.without_open_question(messages(spark, sf_dir)).select("conv_id", "turn")


@query(
    "token_cost",
    """SELECT conv_id, tokens_in, tokens_out, round((tokens_in * 0.15::DOUBLE + tokens_out * 0.60::DOUBLE) / 1e6, 8) AS cost,
    CASE WHEN round((tokens_in * 0.15::DOUBLE + tokens_out * 0.60::DOUBLE) / 1e6, 8) < 0.001 THEN '<$0.001' ELSE '~$' || format('{:.3f}', round((tokens_in * 0.15::DOUBLE + tokens_out * 0.60::DOUBLE) / 1e6, 8)) END AS label FROM (
    SELECT conv_id, sum(CASE WHEN role != 'user' THEN 0 ELSE ceil(length(text) / 3.0) END)::BIGINT AS tokens_in, sum(CASE WHEN role != 'user' THEN ceil(length(text) / 3.0) ELSE 0 END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id)""",
)
def token_cost(spark, sf_dir):
    return conversations.token_cost(messages(spark, sf_dir))


@query(
    "fallback_query",
    "SELECT conv_id, turn, trim(concat_ws(' ', lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text)) AS query FROM conversations WHERE role = 'user'",
)
def fallback_query(spark, sf_dir):
    return conversations.fallback_query(messages(spark, sf_dir))


@query(
    "markdown_export",
    r"""SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || string_agg(CASE WHEN role = 'user' THEN '### 🧑 المستخدم' ELSE '### 🤖 المساعد' END || chr(10) || chr(10) || trim(text) || chr(10) || chr(10)
    || CASE WHEN role = 'assistant' THEN '**المصادر:**' || chr(10) || chr(10) || '1. A — `a1`' || chr(10) || '2. b2 — `b2`' || chr(10) || chr(10) ELSE '' END || '---' || chr(10), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""",
)
def markdown_export(spark, sf_dir):
    rows = messages(spark, sf_dir)
    made = F.array(F.struct(F.lit("a1").alias("doc_id"), F.lit("A").alias("title")), F.struct(F.lit("b2").alias("doc_id"), F.lit("").alias("title")))
    titles = rows.select("conv_id", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title")).distinct()
    return conversations.markdown(rows.withColumn("sources", made), titles)


@query("delete_cascade", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 != 0")
def delete_cascade(spark, sf_dir):
    rows = messages(spark, sf_dir)
    heads = rows.select("conv_id").distinct()
    return conversations.delete_conversations(heads, rows, heads.filter("conv_id % 4 = 0"))[1].select("conv_id", "turn")


# Answers are made of benchmark passages: a quote of the passage, one that is altered, and references in and out of range.
_HEAD = "substr(text, 1, 60)"
_ANSWER_SQL = f"""SELECT item_id AS answer_id, 'Intro sentence. «' || replace(replace({_HEAD}, chr(10), ' '), '  ', ' ') || '» (المستند [' || (item_id % 5) || ']). Then «altered ' || item_id || '» follows! (م ' || (item_id % 3 + 1) || ') end' AS answer,
text AS source, item_id FROM benchmark"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.replace(F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    answer = F.concat(F.lit("Intro sentence. «"), head, F.lit("» (المستند ["), (F.col("item_id") % 5).cast("string"), F.lit("]). Then «altered "), F.col("item_id").cast("string"), F.lit("» follows! (م "), (F.col("item_id") % 3 + 1).cast("string"), F.lit(") end"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), answer.alias("answer"), F.array("text").alias("sources"), F.lit(3).alias("n_sources"))


_QUOTES_SQL = "list_filter(list_transform(regexp_extract_all(answer, '«([^»]+)»', 1), lambda x: trim(x)), lambda x: x != '')"
_REF = r"\(\s*المستند\s*\[?\s*([0-9]+)\s*\]?\s*\)"
_REFS_SQL = f"list_transform(regexp_extract_all(answer, '{_REF}', 1), lambda x: CAST(x AS INT))"


@query(
    "quote_extract",
    f"""SELECT answer_id, {_QUOTES_SQL} AS quotes, {_REFS_SQL} AS refs, list_transform(regexp_extract_all(answer, '\\(م\\s*([0-9]+)\\)', 1), lambda x: CAST(x AS INT)) AS marks,
    array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i <= len(q) THEN '[«' || translate(trim(q[i]), '[]', '') || '»](#q-' || (i - 1) || ')' ELSE '' END), '') AS linked,
    regexp_replace(answer, '\\(م\\s*([0-9]+)\\)', ' [م\\1](#cite-\\1)', 'g') AS marked
    FROM (SELECT *, string_split_regex(r, '«[^»]+»') AS b, regexp_extract_all(r, '«([^»]+)»', 1) AS q FROM (SELECT *, regexp_replace(answer, '{_REF}', ' [المستند \\1](#s-\\1)', 'g') AS r FROM ({_ANSWER_SQL})))""",
)
def quote_extract(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "answer_id",
        citations.quotes("answer").alias("quotes"),
        citations.document_refs("answer").alias("refs"),
        citations.source_marks("answer").alias("marks"),
        citations.link_refs("answer").alias("linked"),
        citations.link_marks("answer").alias("marked"),
    )


_SCORES_SQL = f"""WITH a AS (SELECT answer_id, answer, {S.normalize_citation('source')} AS s, list_transform({_QUOTES_SQL}, lambda x: {S.normalize_citation('x')}) AS q, {_REFS_SQL} AS r,
      list_filter(regexp_extract_all(answer, '[^.!?؟\\n]+[.!?؟\\n]?'), lambda x: trim(x) != '') AS t FROM ({_ANSWER_SQL})),
    b AS (SELECT *, len(list_filter(q, lambda x: x != '' AND contains(s, x))) AS g, len(list_filter(t, lambda x: contains(x, '«') AND contains(x, '»'))) AS c, len(list_filter(r, lambda x: x BETWEEN 1 AND 3)) AS v FROM a)
    SELECT answer_id, len(q) AS n_quotes, g AS n_grounded, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(g::DOUBLE / len(q), 4) END AS quote_grounding, len(t) AS n_sentences, c AS n_cited_sentences,
    CASE WHEN len(t) = 0 THEN 0.0 ELSE round(c::DOUBLE / len(t), 4) END AS sentence_coverage, len(r) AS n_docrefs, v AS n_valid_docrefs, CASE WHEN len(r) = 0 THEN 1.0 ELSE round(v::DOUBLE / len(r), 4) END AS docref_validity, length(answer) AS answer_chars FROM b"""


@query("quote_grounding", _SCORES_SQL)
def quote_grounding(spark, sf_dir):
    return citations.score_answers(answers(spark, sf_dir))


@query("citation_means", f"SELECT count(*) AS n_answers, round(avg(quote_grounding), 4) AS mean_quote_grounding, round(avg(sentence_coverage), 4) AS mean_sentence_coverage, round(avg(docref_validity), 4) AS mean_docref_validity FROM ({_SCORES_SQL})")
def citation_means(spark, sf_dir):
    return citations.mean_scores(citations.score_answers(answers(spark, sf_dir)))


_QUOTED_SQL = f"SELECT answer_id, unnest(q) AS quote, generate_subscripts(q, 1) - 1 AS quote_no FROM (SELECT answer_id, {_QUOTES_SQL} AS q FROM ({_ANSWER_SQL}))"
# Sources of an answer: its own passage and its neighbours; every third has a snippet only.
_SOURCES_SQL = """SELECT a.item_id AS answer_id, b.item_id AS doc_id, (b.item_id - a.item_id + 2) AS source_rank, CASE WHEN b.item_id % 3 = 0 THEN '' ELSE b.text END AS text, substr(b.text, 1, 200) AS snippet
    FROM benchmark a JOIN benchmark b ON b.item_id BETWEEN a.item_id - 1 AND a.item_id + 1"""
_MET_SQL = f"""SELECT answer_id, quote_no, doc_id, source_rank, q, {S.normalize_citation('text', '')} AS s, {S.normalize_citation('snippet', '')} AS n
    FROM (SELECT *, {S.normalize_citation('quote', '')} AS q FROM ({_QUOTED_SQL})) JOIN ({_SOURCES_SQL}) USING (answer_id)"""


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    near = items.select(F.explode(F.sequence(F.col("item_id") - 1, F.col("item_id") + 1)).alias("answer_id"), F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.substring("text", 1, 200).alias("snippet"))
    return near.join(items.select(F.col("item_id").alias("answer_id")), "answer_id").withColumn("source_rank", F.col("doc_id") - F.col("answer_id") + 2)


def answer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("answer_id", F.posexplode(citations.quotes("answer")).alias("quote_no", "quote"))


@query(
    "cited_sources",
    f"""SELECT answer_id, quote_no, coalesce(arg_min(doc_id, source_rank) FILTER (q != '' AND contains(s, q)), arg_min(doc_id, source_rank) FILTER (q != '' AND contains(n, q)), arg_min(doc_id, source_rank)) AS doc_id,
    bool_or(q != '' AND (contains(s, q) OR contains(n, q))) AS grounded FROM ({_MET_SQL}) GROUP BY answer_id, quote_no""",
)
def cited_sources(spark, sf_dir):
    return citations.resolve_quotes(answer_quotes(spark, sf_dir), answer_sources(spark, sf_dir))


@query(
    "cited_documents",
    f"""SELECT DISTINCT answer_id, doc_id FROM (SELECT answer_id, quote_no, arg_min(doc_id, source_rank) AS doc_id FROM ({_MET_SQL}) WHERE q != '' AND contains(CASE WHEN s != '' THEN s ELSE n END, q) GROUP BY answer_id, quote_no)""",
)
def cited_documents(spark, sf_dir):
    return citations.cited_documents(answer_quotes(spark, sf_dir), answer_sources(spark, sf_dir))


@query(
    "cited_results",
    f"""SELECT answer_id, n, doc_id FROM (SELECT answer_id, unnest(list_transform(regexp_extract_all(answer, '\\(م\\s*([0-9]+)\\)', 1), lambda x: CAST(x AS INT))) AS n FROM ({_ANSWER_SQL})) JOIN (SELECT answer_id, source_rank AS n, doc_id FROM ({_SOURCES_SQL})) USING (answer_id, n)""",
)
def cited_results(spark, sf_dir):
    marks = answers(spark, sf_dir).select("answer_id", F.explode(citations.source_marks("answer")).alias("n"))
    return citations.cited_results(marks, answer_sources(spark, sf_dir).select("answer_id", F.col("source_rank").alias("rank"), "doc_id")).select("answer_id", "n", "doc_id")


_WORDS = f"SELECT doc_id, len(w) AS n_doc, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)"
_PHRASES = f"SELECT item_id AS phrase_id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM (SELECT item_id, list_filter({S.words('text')}, lambda w: w != '') AS w FROM benchmark)"


def _align_sql(allowed: str) -> str:
    return f"""SELECT phrase_id, doc_id, start, n_words, misses FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id, doc_id ORDER BY misses, start) AS r FROM (
    SELECT phrase_id, doc_id, n_doc, n_words, pos - k AS start, n_words - count(*) AS misses FROM ({_WORDS}) JOIN ({_PHRASES}) USING (word) GROUP BY phrase_id, doc_id, n_doc, n_words, pos - k)
    WHERE misses <= {allowed} AND start >= 0 AND start + n_words <= n_doc) WHERE r = 1"""


_ALLOWED = "CASE WHEN n_words >= 3 THEN greatest(1, floor(n_words * 0.1::DOUBLE)) ELSE 0 END"


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))


@query("align_exact", _align_sql("0"))
def align_exact(spark, sf_dir):
    return citations.align(phrases(spark, sf_dir), documents(spark, sf_dir))


@query("align_tolerant", _align_sql(_ALLOWED))
def align_tolerant(spark, sf_dir):
    return citations.align(phrases(spark, sf_dir), documents(spark, sf_dir), 0.1)


# A citation for each document: some of its own words, whole, spoilt, cut within words, or scattered.
_START = "(doc_id % 40) * 3 + 1"
_CITED_SQL = f"""SELECT doc_id AS phrase_id, doc_id, text, CASE doc_id % 4 WHEN 0 THEN array_to_string(x, ' ') WHEN 1 THEN 'zzzz ' || array_to_string(x[2:], ' ') WHEN 2 THEN substr(array_to_string(x, ' '), 3, 40) ELSE array_to_string(list_reverse(x), ' ') END AS phrase
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w != '')[{_START} : {_START} + 11] AS x FROM documents) WHERE len(x) > 0"""


def citations_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), ((F.col("doc_id") % 40) * 3 + 1).cast("int"), 12)
    rows = documents(spark, sf_dir).select("doc_id", "text", x.alias("x")).filter("size(x) > 0")
    kind, whole = F.col("doc_id") % 4, F.array_join("x", " ")
    phrase = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("zzzz "), F.array_join(F.slice("x", 2, 12), " "))).when(kind == 2, F.substring(whole, 3, 40)).otherwise(F.array_join(F.reverse("x"), " "))
    return rows.select(F.col("doc_id").alias("phrase_id"), "doc_id", "text", phrase.alias("phrase"))


_PAIR_SQL = f"SELECT phrase_id, doc_id, phrase, list_filter({S.words('phrase')}, lambda w: w != '') AS t, {S.words('text')} AS w FROM ({_CITED_SQL})"
_SUBSTRING_SQL = f"""SELECT phrase_id, doc_id, len(string_split(substr(s, 1, place - 1 + length(c) - length(ltrim(c))), ' ')) - 1 AS start, len(string_split(substr(s, 1, place + length(rtrim(c)) - 1), ' ')) - 1 AS "end" FROM (SELECT *, strpos(s, c) AS place FROM (
    SELECT phrase_id, doc_id, array_to_string(w, ' ') AS s, regexp_replace(trim(lower(regexp_replace(trim(phrase), {S.lit(P.TASHKEEL)}, '', 'g'))), {S.lit(P.MARKS)}, '', 'g') AS c FROM ({_PAIR_SQL})) WHERE length(c) >= 8) WHERE place > 0"""
_CLUSTER_SQL = f"""SELECT phrase_id, doc_id, pos AS start, last AS "end", n_hits FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id, doc_id ORDER BY n_hits DESC, pos) AS r FROM (
    SELECT a.phrase_id, a.doc_id, a.pos, a.n_keys, count(*) AS n_hits, max(b.pos) AS last FROM h a JOIN h b ON a.phrase_id = b.phrase_id AND b.pos >= a.pos AND b.pos - a.pos < a.width GROUP BY ALL) WHERE n_hits >= ceil(n_keys * 0.6::DOUBLE)) WHERE r = 1"""
_HIT_SQL = f"""h0 AS (SELECT *, list_filter(t, lambda x: length(x) >= 4) AS keys FROM ({_PAIR_SQL})),
    h1 AS (SELECT phrase_id, doc_id, len(keys) AS n_keys, ceil(len(t) * 1.5::DOUBLE) AS width, list_filter(range(len(w)), lambda i: list_contains(keys, w[i + 1])) AS places FROM h0 WHERE len(keys) >= 3),
    h AS (SELECT phrase_id, doc_id, n_keys, width, unnest(places) AS pos FROM h1 WHERE len(places) >= 3)"""


@query("align_cluster", f"WITH {_HIT_SQL} {_CLUSTER_SQL}")
def align_cluster(spark, sf_dir):
    return citations.align_cluster(citations_of_documents(spark, sf_dir))


@query("align_substring", _SUBSTRING_SQL)
def align_substring(spark, sf_dir):
    return citations.align_substring(citations_of_documents(spark, sf_dir))


@query(
    "align_cascade",
    f"""WITH {_HIT_SQL},
    o AS (SELECT phrase_id, doc_id, len(t) AS n_words, len(w) AS n_doc, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM ({_PAIR_SQL})), p AS (SELECT phrase_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS k FROM ({_PAIR_SQL})),
    g AS (SELECT phrase_id, doc_id, n_words, n_doc, pos - k AS start, n_words - count(*) AS misses FROM o JOIN p USING (phrase_id, word) GROUP BY phrase_id, doc_id, n_words, n_doc, pos - k),
    f AS (SELECT phrase_id, doc_id, CASE WHEN misses = 0 THEN 1 ELSE 2 END AS strategy, start, start + n_words - 1 AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY misses, start) AS r FROM g WHERE misses <= {_ALLOWED} AND start >= 0 AND start + n_words <= n_doc) WHERE r = 1
      UNION ALL SELECT phrase_id, doc_id, 3, start, "end" FROM ({_SUBSTRING_SQL}) UNION ALL SELECT phrase_id, doc_id, 4, start, "end" FROM ({_CLUSTER_SQL}))
    SELECT phrase_id, doc_id, strategy, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY strategy, start) AS r FROM f) WHERE r = 1""",
)
def align_cascade(spark, sf_dir):
    return citations.align_cascade(citations_of_documents(spark, sf_dir))


@query(
    "find_in_document",
    f"""SELECT doc_id, list_reduce(list_concat([[]::BIGINT[]], list_transform(fits, lambda i: [i])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] >= acc[-1] + 2 THEN list_concat(acc, x) ELSE acc END) AS starts
    FROM (SELECT doc_id, list_filter(range(0, greatest(len(w) - 1, 0)), lambda i: contains(w[i + 1], 'th') AND contains(w[i + 2], 'on')) AS fits FROM (SELECT doc_id, {S.words('text')} AS w FROM documents))""",
)
def find_in_document(spark, sf_dir):
    return citations.find_in_document(documents(spark, sf_dir), ["th", "on"])


@query(
    "stance_meter",
    """SELECT grp, n_support, n_contrast, n_mixed, n_neutral, round(n_support::DOUBLE / n * 100, 4) AS share_support, round(n_contrast::DOUBLE / n * 100, 4) AS share_contrast, round(n_mixed::DOUBLE / n * 100, 4) AS share_mixed, round(n_neutral::DOUBLE / n * 100, 4) AS share_neutral, CASE WHEN n_support = 0 AND n_contrast = 0 AND n_mixed = 0 THEN 'descriptive' WHEN n_support > 0 AND n_support >= 2 * n_contrast THEN 'support'
    WHEN n_contrast > 0 AND n_contrast >= 2 * n_support THEN 'oppose' ELSE 'conflicting' END AS verdict FROM (SELECT doc_id % 50 AS grp, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS n_support, count(*) FILTER (quality = 0 AND toxic = 1) AS n_contrast,
    count(*) FILTER (quality = 1 AND toxic = 1) AS n_mixed, count(*) FILTER (quality = 0 AND toxic = 0) AS n_neutral FROM labels GROUP BY doc_id % 50)""",
)
def stance_meter(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    stance = F.when(q & ~t, "support").when(~q & t, "contrast").when(q & t, "mixed").otherwise("unknown")
    return evidence.stance_meter(table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("grp"), stance.alias("stance")), "grp")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")


@query(
    "rate_limit_window",
    "SELECT user_id AS client, event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events",
)
def rate_limit_window(spark, sf_dir):
    return limiter.window_log(requests(spark, sf_dir), 3600).select("client", "request_id", "n_recent")


@query("rate_limit_exact")
def rate_limit_exact(spark, sf_dir):
    return limiter.limit_requests(requests(spark, sf_dir), limit=2, window=3600.0)


@query(
    "latency_percentiles",
    "SELECT event_type, round(median(value), 6) AS p50, list_sort(list(value))[CAST(floor(0.95::DOUBLE * count(*)) AS INT) + 1] AS p95 FROM events GROUP BY event_type",
)
def latency_percentiles(spark, sf_dir):
    """The median, and the element at index int(0.95 n) of the sorted values, from counts alone: no task sorts a group."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    n = F.col("n")
    at = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.floor(n * 0.95) + 1}
    found = evaluation.order_statistics(events, "event_type", "value", at)
    return found.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50"), "p95")


@query("role_summary", """SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, min(length(text)) AS least FROM conversations GROUP BY role""")
def role_summary(spark, sf_dir):
    n = F.length("text")
    return messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.min(n).alias("least"))
