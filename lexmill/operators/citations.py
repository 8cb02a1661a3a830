"""Citations in answers: quotes, source marks, grounding, resolution, and alignment of text to a document's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import normalize_citation, normalize_word, strip

QUOTE = "«([^»]+)»"
DOC_REF = r"\(\s*المستند\s*\[?\s*(\p{Nd}+)\s*\]?\s*\)"
SOURCE_MARK = r"\(م\s*([0-9]+)\)"
ANSWER_SENTENCE = r"[^.!?؟\n]+[.!?؟\n]?"
#: Words of a block by which phrases and documents meet; more make hits rarer, and leave fewer phrases that have so many.
BLOCK = 4
SMALL_ROWS = 500_000


def quotes(answer: Column | str) -> Column:
    """What stands between quotation marks, stripped; blank quotes are none."""
    return F.filter(F.transform(F.regexp_extract_all(answer, F.lit(QUOTE), F.lit(1)), lambda q: strip(q)), lambda q: q != "")


def _number(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789").try_cast("int")


def document_refs(answer: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(DOC_REF), F.lit(1)), _number)


def source_marks(answer: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(SOURCE_MARK), F.lit(1)), _number)


def merge_adjacent_quotes(answer: Column | str) -> Column:
    """Quotes parted only by a comma, a connector, or both, five characters at most, become one with what parts them."""
    gap = rf"\s*[،,]?\s*(?:{P.CONNECTORS})?\s*"
    return F.regexp_replace(answer, rf"»(?=\s*(?:\S|\S.{{0,3}}\S)?\s*«)({gap})«", "$1")


def link_marks(answer: Column | str) -> Column:
    """Source marks as markdown links."""
    return F.regexp_replace(answer, SOURCE_MARK, " [م$1](#cite-$1)")


def link_refs(answer: Column | str) -> Column:
    """Document references, then quotes by their number in the answer, as markdown links."""
    refs = F.regexp_replace(answer, DOC_REF, " [المستند $1](#s-$1)")
    between = F.split(refs, "«[^»]+»", -1)
    links = F.transform(F.regexp_extract_all(refs, F.lit(QUOTE), F.lit(1)), lambda q, i: F.concat(F.lit("[«"), F.translate(strip(q), "[]", ""), F.lit("»](#q-"), i.cast("string"), F.lit(")")))
    return F.array_join(F.zip_with(between, links, lambda b, q: F.concat(b, F.coalesce(q, F.lit("")))), "")


def score_answers(answers: DataFrame) -> DataFrame:
    """Per answer (answer_id, answer, sources: array of texts, n_sources): grounding of quotes, sentence coverage, validity of references."""
    q = F.transform(quotes("answer"), lambda x: normalize_citation(x))
    s = F.transform("sources", lambda x: normalize_citation(x))
    sentences = F.filter(F.regexp_extract_all("answer", F.lit(ANSWER_SENTENCE), F.lit(0)), lambda x: strip(x) != "")
    rows = answers.select("*", q.alias("q"), s.alias("s"), document_refs("answer").alias("refs"), sentences.alias("sentences"))
    grounded = F.size(F.filter("q", lambda x: (x != "") & F.exists("s", lambda y: y.contains(x))))
    cited = F.size(F.filter("sentences", lambda x: x.contains("«") & x.contains("»")))
    valid = F.size(F.filter("refs", lambda n: (n >= 1) & (n <= F.col("n_sources"))))

    def share(part: Column, whole: str, none: float) -> Column:
        return F.when(F.size(whole) == 0, F.lit(none)).otherwise(F.round(part / F.size(whole), 4))

    return rows.select(
        "answer_id",
        F.size("q").alias("n_quotes"),
        grounded.alias("n_grounded"),
        share(grounded, "q", 0.0).alias("quote_grounding"),
        F.size("sentences").alias("n_sentences"),
        cited.alias("n_cited_sentences"),
        share(cited, "sentences", 0.0).alias("sentence_coverage"),
        F.size("refs").alias("n_docrefs"),
        valid.alias("n_valid_docrefs"),
        share(valid, "refs", 1.0).alias("docref_validity"),
        F.length("answer").alias("answer_chars"),
    )


def mean_scores(scored: DataFrame) -> DataFrame:
    """The corpus means of score_answers()."""
    names = ("quote_grounding", "sentence_coverage", "docref_validity")
    return scored.agg(F.count("*").alias("n_answers"), *[F.round(F.avg(n), 4).alias(f"mean_{n}") for n in names])


def resolve_quotes(quoted: DataFrame, sources: DataFrame) -> DataFrame:
    """The document a quote (answer_id, quote_no, quote) came from: the first source (answer_id, source_rank, doc_id, text, snippet) whose text
    holds it, else the first whose snippet does, else the first source."""
    q = quoted.withColumn("q", normalize_citation("quote", ""))
    s = sources.select("answer_id", "source_rank", "doc_id", normalize_citation("text", "").alias("s"), normalize_citation("snippet", "").alias("n"))
    met = q.join(s, "answer_id").withColumn("in_text", (F.col("q") != "") & F.coalesce(F.col("s").contains(F.col("q")), F.lit(False)))
    met = met.withColumn("in_snippet", (F.col("q") != "") & F.coalesce(F.col("n").contains(F.col("q")), F.lit(False)))
    first = [F.min_by("doc_id", F.when(F.col(c), F.col("source_rank"))) for c in ("in_text", "in_snippet")]
    found = met.groupBy("answer_id", "quote_no").agg(F.coalesce(*first, F.min_by("doc_id", "source_rank")).alias("doc_id"), F.max(F.col("in_text") | F.col("in_snippet")).alias("grounded"))
    return found


def cited_documents(quoted: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, doc_id of the documents that are quoted: for each quote the first source that holds it, by its text or, without one, its snippet."""
    q = quoted.withColumn("q", normalize_citation("quote", "")).filter("q != ''")
    held = F.coalesce(F.nullif("text", F.lit("")), F.col("snippet"))
    s = sources.select("answer_id", "source_rank", "doc_id", normalize_citation(held, "").alias("s"))
    met = q.join(s, "answer_id").filter(F.col("s").contains(F.col("q")))
    return met.groupBy("answer_id", "quote_no").agg(F.min_by("doc_id", "source_rank").alias("doc_id")).select("answer_id", "doc_id").distinct()


def cited_results(answer_marks: DataFrame, results: DataFrame) -> DataFrame:
    """The result that each source mark (answer_id, n) points to, by its place from 1."""
    return answer_marks.join(results.withColumnRenamed("rank", "n"), ["answer_id", "n"])


def document_words(text: Column | str) -> Column:
    """The words of a text as alignment sees them; a word of marks is empty but keeps its place."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: normalize_word(w))


def phrase_words(phrase: Column | str) -> Column:
    return F.filter(document_words(phrase), lambda w: w != "")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def align(phrases: DataFrame, docs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Where phrases (phrase_id, phrase) stand in documents (doc_id, text): start, n_words, misses; one place per phrase and document.

    A window may miss ``tolerance`` of the phrase's words, one at least, where it has three words and more. With m misses allowed, one of m + 1
    blocks of the phrase has none, so phrases and documents meet by the hash of a block's first BLOCK words, and windows found so are
    compared word by word. No single frequent word makes rows, but in phrases that are as short as that.
    """
    p = phrases.select("phrase_id", phrase_words("phrase").alias("t")).filter("size(t) > 0").withColumn("n", F.size("t"))
    allowed = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.floor(F.col("n") * tolerance))).otherwise(0) if tolerance else F.lit(0)
    p = p.withColumn("most", F.least(allowed, F.col("n") - 1).cast("int")).withColumn("width", F.floor(F.col("n") / (F.col("most") + 1)).cast("int")).withColumn("k", F.least("width", F.lit(BLOCK)))
    blocks = p.select("phrase_id", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("most")), lambda b: F.struct((b * F.col("width")).alias("at"), F.xxhash64(F.slice("t", b * F.col("width") + 1, F.col("k"))).alias("hash")))).alias("b"))
    blocks = _few(blocks.select("phrase_id", "k", "b.at", "b.hash"))
    words = docs.select("doc_id", document_words("text").alias("w"))
    grams = words.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(BLOCK))).alias("k"), "w").filter(F.size("w") >= F.col("k"))
    grams = grams.select("doc_id", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("k"))))).alias("pos", "hash"))
    starts = grams.join(blocks, ["k", "hash"]).select("phrase_id", "doc_id", (F.col("pos") - F.col("at")).alias("start")).filter("start >= 0").distinct()
    met = starts.join(_few(p.select("phrase_id", "t", "n", "most")), "phrase_id").join(words, "doc_id").filter(F.col("start") + F.col("n") <= F.size("w"))
    misses = F.size(F.filter(F.zip_with(F.slice("w", F.col("start") + 1, F.col("n")), "t", lambda a, b: a != b), lambda x: x))
    good = met.select("phrase_id", "doc_id", "start", F.col("n").alias("n_words"), misses.alias("misses"), "most").filter("misses <= most")
    best = good.groupBy("phrase_id", "doc_id").agg(F.min(F.struct("misses", "start", "n_words")).alias("b"))
    return best.select("phrase_id", "doc_id", "b.start", "b.n_words", "b.misses")


def _pair_hits(pairs: DataFrame) -> DataFrame:
    """phrase_id, doc_id, t, w, n_keys: pairs of a phrase and a document (phrase_id, phrase, doc_id, text) as words."""
    return pairs.select("phrase_id", "doc_id", "phrase", phrase_words("phrase").alias("t"), document_words("text").alias("w"))


def align_substring(pairs: DataFrame) -> DataFrame:
    """phrase_id, doc_id, start, end: the words that the phrase touches as a string within the document's words, for phrases of eight characters and more."""
    bare = F.trim(F.lower(F.regexp_replace(F.trim("phrase"), P.TASHKEEL, "")))
    rows = _pair_hits(pairs).withColumn("c", F.regexp_replace(bare, P.MARKS, "")).withColumn("s", F.array_join("w", " "))
    rows = rows.filter("length(c) >= 8").withColumn("at", F.instr(F.col("s"), F.col("c"))).filter("at > 0")

    def word_at(n: Column) -> Column:
        head = F.substring(F.col("s"), F.lit(1), n)
        return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))

    last = F.col("at") + F.length(F.regexp_replace("c", r"\s+$", "")) - 1
    lead = F.length("c") - F.length(F.regexp_replace("c", r"^\s+", ""))
    return rows.select("phrase_id", "doc_id", word_at(F.col("at") + lead - 1).alias("start"), word_at(last).alias("end"))


def align_cluster(pairs: DataFrame) -> DataFrame:
    """The densest stretch of a phrase's key words (four letters and more, three of them, repeats counted) in its document: 60 % of them within 1.5 lengths."""
    rows = _pair_hits(pairs)
    keys = rows.select("phrase_id", "doc_id", F.filter("t", lambda w: F.length(w) >= 4).alias("keys"), F.size("t").alias("n")).filter("size(keys) >= 3")
    keys = keys.select("phrase_id", "doc_id", F.size("keys").alias("n_keys"), F.ceil(F.col("n") * 1.5).alias("width"), F.explode(F.array_distinct("keys")).alias("word"))
    hits = rows.select("phrase_id", "doc_id", F.posexplode("w").alias("pos", "word")).join(keys, ["phrase_id", "doc_id", "word"])
    hits = hits.withColumn("total", F.count("*").over(Window.partitionBy("phrase_id", "doc_id"))).filter("total >= 3").withColumn("x", F.col("pos") / F.col("width"))
    # places are scaled by the phrase's width, so that one range frame of just under 1 serves all phrases
    frame = "OVER (PARTITION BY phrase_id, doc_id ORDER BY x RANGE BETWEEN CURRENT ROW AND 0.9999999D FOLLOWING)"
    rows = hits.withColumn("n_hits", F.expr(f"count(*) {frame}")).withColumn("last", F.expr(f"max(pos) {frame}"))
    good = rows.filter(F.col("n_hits") >= F.ceil(F.col("n_keys") * 0.6))
    best = good.groupBy("phrase_id", "doc_id").agg(F.max(F.struct("n_hits", (-F.col("pos")).alias("order"), "last")).alias("b"))
    return best.select("phrase_id", "doc_id", (-F.col("b.order")).alias("start"), F.col("b.last").alias("end"), "b.n_hits")


def align_cascade(pairs: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """phrase_id, doc_id, strategy (1 exact, 2 tolerant, 3 substring, 4 cluster), start, end of the first strategy that finds the phrase in its document."""
    words = _pair_hits(pairs).filter("size(t) > 0")
    tokens = words.select("phrase_id", "doc_id", F.size("t").alias("n"), F.posexplode("t").alias("k", "word"))
    places = words.select("phrase_id", "doc_id", F.size("w").alias("n_doc"), F.posexplode("w").alias("pos", "word"))
    hits = places.join(tokens, ["phrase_id", "doc_id", "word"]).groupBy("phrase_id", "doc_id", "n", "n_doc", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("hits"))
    misses = F.col("n") - F.col("hits")
    most = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.floor(F.col("n") * tolerance))).otherwise(0)
    windows = hits.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_doc")) & (misses <= most))
    best = windows.groupBy("phrase_id", "doc_id").agg(F.min(F.struct(misses.alias("misses"), "start", "n")).alias("b"))
    by_words = best.select("phrase_id", "doc_id", F.when(F.col("b.misses") == 0, 1).otherwise(2).alias("strategy"), "b.start", (F.col("b.start") + F.col("b.n") - 1).alias("end"))
    found = by_words.unionByName(align_substring(pairs).withColumn("strategy", F.lit(3))).unionByName(align_cluster(pairs).drop("n_hits").withColumn("strategy", F.lit(4)))
    first = found.groupBy("phrase_id", "doc_id").agg(F.min(F.struct("strategy", "start", "end")).alias("f"))
    return first.select("phrase_id", "doc_id", "f.strategy", "f.start", "f.end")


def find_in_document(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Matches of consecutive words that contain the terms, left to right without overlap: doc_id, starts.

    Words and terms are compared as alignment sees them; a word of marks contains nothing and keeps its place, a term of marks is left out.
    """
    asked = docs.sparkSession.range(1).select(phrase_words(F.lit(" ".join(terms))).alias("t")).first()["t"]
    n, none = len(asked), F.array().cast("array<int>")
    # generated: a filter on the result, as explode() brings one, would put the words' making into the lambda, once a place
    rows = docs.select("doc_id", F.explode(F.array(document_words("text"))).alias("w"))
    if not n:
        return rows.select("doc_id", none.alias("starts"))
    # places where the first term fits, then all of them
    index = F.sequence(F.lit(0), F.size("w") - n)
    fits = F.filter(index, lambda i: _all(F.get("w", i + k).contains(t) for k, t in enumerate(asked)))
    rows = rows.withColumn("fits", F.when(F.size("w") >= n, fits).otherwise(none))
    greedy = F.aggregate("fits", none, lambda acc, i: F.when((F.size(acc) == 0) | (i >= F.element_at(acc, -1) + n), F.array_append(acc, i)).otherwise(acc))
    return rows.select("doc_id", F.when(F.size("fits") > 0, greedy).otherwise(none).alias("starts"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
