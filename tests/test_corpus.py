from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import display
from lexmill.functions import text as X
from lexmill.operators import chat, chunking, citations, conversations, evaluation, evidence, lines, retrieval, search, store, synthesis
from lexmill.sources import articles
from lexmill.streaming import limiter


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("x")).first()["x"]


def test_tokens_keep_what_normalisation_hides(spark):
    assert one(spark, "التعليم، في the Maps إلى", X.tokens) == ["التعليم،", "maps", "الي"]
    assert one(spark, "مُؤَسَّسة_x", X.normalize_arabic) == "موسسه x"
    assert one(spark, "a bc the", X.search_tokens) == ["bc"]


def test_citation_normalisers_differ(spark):
    assert one(spark, "A-b,  «C»", X.normalize_citation) == "a b c"
    assert one(spark, "A-b,  «C»", lambda c: X.normalize_citation(c, "")) == "ab c"


def test_cut_at_space(spark):
    assert one(spark, "word " * 200, lambda c: X.cut_at_space(c, 700, 350)).endswith("word…")
    assert one(spark, "x" * 900, lambda c: X.cut_at_space(c, 700, 350)) == "x" * 700 + "…"
    assert one(spark, "short", lambda c: X.cut_at_space(c, 700, 350)) == "short"


def test_chunk_id_beyond_three_digits(spark):
    assert spark.range(1).select(X.chunk_id("id", F.lit(1234)).alias("x")).first()["x"] == "0_chunk_1234"


def test_direction(spark):
    assert one(spark, "12 مرحبا abc", X.text_direction) == "rtl"
    assert one(spark, "12 abc مرحبا", X.text_direction) == "ltr"


ARTICLE = "\n".join(["عنوان طويل يكفي لان يكون عنوانا للمقال", "١٢", "abc", "ISSN: 1234-5678", "المقدمة:", "نص اول في المقدمة هنا", "Short heading here:", "more text in the section", "المراجع", "ref one is dropped", "الخاتمة"])


def test_line_classes_and_sticky_references(spark):
    rows = {r["line_no"]: r for r in lines.classify(spark.createDataFrame([(1, ARTICLE)], "doc_id long, text string")).collect()}
    assert [rows[i]["class"] for i in range(11)] == ["text", "page_number", "boilerplate", "boilerplate", "section_header", "text", "section_header", "text", "reference_header", "text", "section_header"]
    assert rows[5]["section"] == "المقدمة" and rows[7]["section"] == "Short heading here" and rows[10]["section"] == "Short heading here"
    assert not rows[7]["in_references"] and rows[9]["in_references"]
    assert rows[1]["char_offset"] == len("عنوان طويل يكفي لان يكون عنوانا للمقال") + 1


def test_title(spark):
    docs = spark.createDataFrame([(1, ARTICLE), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["title"] for r in lines.titles(docs).collect()} == {1: "عنوان طويل يكفي لان يكون عنوانا للمقال", 2: "", 3: ""}


def test_chunks_carry_and_merge():
    sentence = "x" * 99 + "."
    made = chunking.build_chunks([("", " ".join([sentence] * 30))])
    assert len(made) == 2 and len(made[0][1]) < 1600 and made[1][1].startswith(made[0][1][-160:])
    assert len(chunking.build_chunks([("", "y" * 3000)])[0][1]) == 2400  # no sentence end: a hard cut
    a, b, c = "a" * 1000, "b" * 100, "c" * 1000
    assert [(s, len(t)) for s, t in chunking.build_chunks([("s1", a), ("s2", b), ("s3", c)])] == [("s1", 1000 + 1 + 160 + 1 + 100), ("s3", 160 + 1 + 1000)]
    assert chunking.build_chunks([]) == [] and chunking.build_chunks([("s", " ")]) == []


def test_chunk_documents_drops_references(spark):
    rows = chunking.chunk_documents(spark.createDataFrame([(1, ARTICLE), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1} and not any("ref one" in r["text"] for r in rows)


def ranked(spark):
    rows = [("q", "alpha beta", "c1", "d1", "alpha beta", "", "", "alpha beta gamma", 3.0, 1), ("q", "alpha beta", "c2", "d2", "Dr. x", "", "", "nothing of it", 2.0, 2), ("q", "alpha beta", "c3", "d1", "other", "", "", "beta only", 1.0, 3)]
    return retrieval.rerank(spark.createDataFrame(rows, "query_id string, query string, chunk_id string, doc_id string, title string, section string, journal_id string, text string, raw_score double, rank int"))


def test_rerank_gate_dedup_confidence(spark):
    got = {r["chunk_id"]: r for r in ranked(spark).collect()}
    assert got["c1"]["score"] == 1.0 and got["c1"]["new_rank"] == 1 and got["c1"]["title_score"] == 1.0
    assert 0 <= got["c2"]["score"] < got["c3"]["score"] + 0.25
    kept = {r["chunk_id"] for r in retrieval.confidence_gate(ranked(spark)).collect()}
    assert "c1" in kept and "c2" not in kept
    assert [r["chunk_id"] for r in retrieval.dedup_per_document(ranked(spark), 5, "new_rank").orderBy("doc_rank").collect()][0] == "c1"
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r["query_id"]: r["low_confidence"] for r in retrieval.low_confidence(queries, ranked(spark)).collect()} == {"q": False, "none": True}


def test_fusion_ignores_score_scale(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, chunk_id string, rank int")
    got = [(r["chunk_id"], r["score"]) for r in retrieval.fuse({"a": a, "b": b}, 5).orderBy("rank").collect()]
    assert got == [("y", pytest.approx(1 / 61 + 1 / 62, abs=1e-8)), ("x", pytest.approx(1 / 61, abs=1e-8))]


def test_evidence_json(spark):
    raw = [("1", '```json\n{"title": "t", "stance": "support", "key_findings": [{"claim": "c"}], "doc_index": 9}\n```'), ("2", "broken {"), ("3", '{"stance": "Support", "key_findings": null}'), ("4", "[1, 2]")]
    df = spark.createDataFrame([(int(d), d, "given", r) for d, r in raw], "doc_index int, doc_id string, title string, raw string")
    got = {r["doc_id"]: (r["doc_index"], r["title"], r["stance"], len(r["key_findings"]), r["sample"], r["evidence_quality"]) for r in evidence.parse_evidence(df).collect()}
    told = ("غير مذكور", "medium")
    # the list of stances is case-sensitive
    assert got == {"1": (9, "t", "support", 1, *told), "2": (2, "given", "neutral", 0, *told), "3": (3, "given", "neutral", 0, *told), "4": (4, "given", "neutral", 0, *told)}


def test_alignment(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "one two THREE, four x six seven eight nine ten"), (3, "the ten three four five six seven eight nine")], "doc_id int, text string")
    phrases = spark.createDataFrame([(7, "three four five six seven eight nine ten")], "phrase_id int, phrase string")
    assert [(r["doc_id"], r["start"], r["misses"]) for r in citations.align(phrases, docs).collect()] == [(1, 2, 0)]
    # no window runs past the document's end, so the third has none
    assert {(r["doc_id"], r["start"], r["misses"]) for r in citations.align(phrases, docs, 0.1).collect()} == {(1, 2, 0), (2, 2, 1)}
    pairs = docs.crossJoin(phrases)
    assert {r["doc_id"] for r in citations.align_cluster(pairs).collect()} == {1, 2, 3}
    # two words and one: no tolerance below three words
    short = spark.createDataFrame([(1, "two THREE"), (2, "nine"), (3, "ten x")], "phrase_id int, phrase string")
    assert {(r["phrase_id"], r["doc_id"], r["start"]) for r in citations.align(short, docs, 0.1).collect()} == {(1, 1, 1), (1, 2, 1), (2, 1, 8), (2, 2, 8), (2, 3, 8)}


def test_alignment_cascade(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    cases = {1: "gamma delta epsilon", 2: "gamma XX epsilon zeta eta theta", 3: "mma delta eps", 4: "theta epsilon gamma delta", 5: "nothing of that here", 6: "«gamma, delta»"}
    pairs = spark.createDataFrame([(k, p, k, text) for k, p in cases.items()], "phrase_id int, phrase string, doc_id int, text string")
    got = {r["phrase_id"]: (r["strategy"], r["start"], r["end"]) for r in citations.align_cascade(pairs).collect()}
    assert got == {1: (1, 2, 4), 2: (2, 2, 7), 3: (3, 2, 4), 4: (4, 2, 7), 6: (1, 2, 3)}
    # repeats of a key word count: two of three keys are one word
    again = spark.createDataFrame([(1, "deltas deltas omegas", 1, "deltas x deltas y deltas")], "phrase_id int, phrase string, doc_id int, text string")
    assert [(r["start"], r["end"], r["n_hits"]) for r in citations.align_cluster(again).collect()] == [(0, 4, 3)]


def test_citation_marks(spark):
    answer = "قال «نص اول» (المستند 3) ثم «نص [ثان]» ( المستند[12] ) (م  2). بلا اقتباس! «وحده فقط"
    row = spark.createDataFrame([(answer,)], "t string").select(citations.quotes("t").alias("q"), citations.document_refs("t").alias("r"), citations.source_marks("t").alias("m"), citations.link_refs("t").alias("l")).first()
    assert (row["q"], row["r"], row["m"]) == (["نص اول", "نص [ثان]"], [3, 12], [2])
    assert row["l"] == "قال [«نص اول»](#q-0)  [المستند 3](#s-3) ثم [«نص ثان»](#q-1)  [المستند 12](#s-12) (م  2). بلا اقتباس! «وحده فقط"
    merged = lambda t: one(spark, t, citations.merge_adjacent_quotes)
    assert merged("«a»، و«b» «c»") == "«a، وb c»" and merged("«x»zzz«y»") == "«x»zzz«y»" and merged("«a» ، حيث «b»") == "«a ، حيث b»" and merged("«a»،  حيث«b»") == "«a»،  حيث«b»" and merged("«a»، حيث«b»") == "«a، حيثb»"


def test_answer_scores(spark):
    answer = "قال «السماء، زرقاء». ثم «غير موجود» (المستند 9).\nجملة بلا اقتباس (المستند 1)"
    df = spark.createDataFrame([(1, answer, ["إن السَّماء زرقاء اليوم"], 5), (2, "لا شيء", [], 5)], "answer_id int, answer string, sources array<string>, n_sources int")
    got = {r["answer_id"]: r.asDict() for r in citations.score_answers(df).collect()}
    assert {k: got[1][k] for k in ("n_quotes", "n_grounded", "n_sentences", "n_cited_sentences", "n_docrefs", "n_valid_docrefs")} == {"n_quotes": 2, "n_grounded": 1, "n_sentences": 3, "n_cited_sentences": 2, "n_docrefs": 2, "n_valid_docrefs": 1}
    assert (got[1]["quote_grounding"], got[1]["sentence_coverage"], got[1]["docref_validity"]) == (0.5, 0.6667, 0.5)
    assert (got[2]["quote_grounding"], got[2]["docref_validity"]) == (0.0, 1.0)


def test_quotes_resolve_by_text_then_snippet_then_rank(spark):
    sources = spark.createDataFrame([(1, 1, "d1", "", "some snippet words"), (1, 2, "d2", "the whole text", "x")], "answer_id int, source_rank int, doc_id string, text string, snippet string")
    quoted = spark.createDataFrame([(1, 0, "whole text"), (1, 1, "snippet"), (1, 2, "nowhere"), (1, 3, "!!")], "answer_id int, quote_no int, quote string")
    assert {r["quote_no"]: (r["doc_id"], r["grounded"]) for r in citations.resolve_quotes(quoted, sources).collect()} == {0: ("d2", True), 1: ("d1", True), 2: ("d1", False), 3: ("d1", False)}
    assert {r["doc_id"] for r in citations.cited_documents(quoted, sources).collect()} == {"d1", "d2"}


def test_direction_knows_presentation_forms(spark):
    assert one(spark, "É ﺍﺏ", X.text_direction) == "rtl" and one(spark, "É abc", X.text_direction) == "ltr"


def test_offsets_are_of_raw_lines(spark):
    rows = lines.classify(spark.createDataFrame([(1, "  ab  \nnext")], "doc_id int, text string")).collect()
    assert {r["line_no"]: r["char_offset"] for r in rows} == {0: 0, 1: 7}


def test_find_without_overlap(spark):
    docs = spark.createDataFrame([(1, "aa aa aa aa aa"), (2, "b"), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["starts"] for r in citations.find_in_document(docs, ["a", "a"]).collect()}[1] == [0, 2]


def test_limiter_denied_requests_do_not_count():
    # a hit exactly as old as the window still counts
    assert limiter.fold([0, 1, 2, 59, 60, 60.5, 61, 61.5], 2, 60) == ([True, True, False, False, False, True, False, True], [60.5, 61.5])


def test_limiter_takes_requests_without_a_client(spark):
    rows = [(None, k, datetime(2024, 1, 1, 0, 0, k)) for k in range(3)] + [("a", 9, datetime(2024, 1, 1))]
    got = {r["request_id"]: r["accepted"] for r in limiter.limit_requests(spark.createDataFrame(rows, "client string, request_id int, ts timestamp"), 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 9: True}


def test_limiter_batch_equals_stream(spark, tmp_path):
    rows = [("a", i, datetime(2024, 1, 1, 0, 0, i)) for i in range(8)] + [("b", 100 + i, datetime(2024, 1, 1, 0, 0, 2 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "client string, request_id int, ts timestamp")
    batch = {(r["request_id"], r["accepted"]) for r in limiter.limit_requests(df, 2, 4).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 4)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["request_id"], r["accepted"]) for r in spark.table("limited").collect()} == batch


def test_ingest_stream_skips_what_it_has(spark, tmp_path):
    from lexmill.streaming.ingest import ingest_stream

    text = "A sentence that is long enough to be kept as an article. " * 4
    spark.createDataFrame([("d1", text), ("d2", "short")], "doc_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()] == ["d1"]
    spark.createDataFrame([("d3", text), ("d4", text + "And more of it.")], "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == ["d1", "d4"]


def test_articles_and_state(spark, tmp_path):
    import json

    for name, content in (("0001-001-001-001", "x" * 150), ("0001-001-001-002", " ")):
        (tmp_path / "g" / name).mkdir(parents=True)
        page = {"pageNumber": 1, "width": 8.0, "height": 11.0, "words": [{"content": "w", "polygon": [1, 1, 2, 1, 2, 2, 1, 2], "confidence": 1}]}
        (tmp_path / "g" / name / f"{name}.json").write_text(json.dumps({"content": content, "pages": [page]}))
    (tmp_path / "g" / "0001-001-001-001" / "other.json").write_text("{}")
    found = articles.read_articles(spark, str(tmp_path))
    assert {r["doc_id"] for r in found.collect()} == {"0001-001-001-001", "0001-001-001-002"}
    assert [r["doc_id"] for r in articles.accepted(found).collect()] == ["0001-001-001-001"]
    assert [r["doc_id"] for r in articles.rejected(found).collect()] == ["0001-001-001-002"]
    words = articles.page_words(found)
    assert {(r["left"], r["bottom"]) for r in words.collect()} == {(200.0, 400.0)}
    assert articles.highlight_regions(words.withColumn("matched", F.lit(True))).count() == 2
    assert [(r["unit"], r["angle"], r["raster_width"], len(r["words"])) for r in articles.page_layout(found).collect()] == [("inch", 0.0, 0, 1)] * 2
    old = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    new = spark.createDataFrame([("b", 2)], "point_id string, v int")
    once = articles.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 2)} == {tuple(r) for r in articles.upsert(once, new).collect()}


@pytest.mark.parametrize("doc_id", ["../etc", "/0001-001-001-001", "0001_001_001_001", "001-001-001-001", "", "9" * 10_000, "0001-001-001-001\n", None])
def test_bad_document_ids(spark, doc_id):
    assert one(spark, doc_id, articles.valid_doc_id) is False


def test_history_windows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(13)] + [(2, t, "user", "x") for t in range(12)] + [(3, 0, "system", "s")]
    got = conversations.history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sum(r["conv_id"] == 1 and r["kind"] == "summarised" for r in got) == 5
    assert all(r["kind"] == "verbatim" for r in got if r["conv_id"] == 2) and not any(r["conv_id"] == 3 for r in got)


def test_layout_is_that_of_the_first_folder(spark, tmp_path):
    for path in ("a/a.json", "b/b.json", "c/x/x.json", ".h/.h.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text('{"content": "t"}')
    assert {r["doc_id"] for r in articles.read_articles(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_highlight_box_grows_with_its_words(spark):
    def word(k, left, top, bottom, matched=True):
        return (1, 1, k, float(left), float(top), float(left + 8), float(bottom), matched)

    rows = [word(0, 0, 0, 10), word(1, 10, 3, 13), word(2, 20, 6, 16), word(3, 30, 0, 0.5), word(4, 40, 8, 18), word(5, 50, 0, 10, False), word(6, 60, 0, 10)]
    df = spark.createDataFrame(rows, "doc_id int, page int, word_index int, left double, top double, right double, bottom double, matched boolean")
    got = sorted((r["left"], r["top"], r["right"], r["bottom"], r["n_words"]) for r in articles.highlight_regions(df).collect())
    # the fourth has no area; the fifth's middle is 13, the box's 8, its height 16
    assert got == [(-3.0, -3.0, 51.0, 21.0, 4), (57.0, -3.0, 71.0, 13.0, 1)]


def test_first_of_equal_chunks_by_number(spark):
    rows = spark.createDataFrame([(f"d_chunk_{k}", "same") for k in (1000, 999)], "chunk_id string, text string")
    assert [r["chunk_id"] for r in articles.unseen_paragraphs(rows, None).collect()] == ["d_chunk_999"]


def test_an_ingest_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    from lexmill.sources import lifecycle

    text = "A sentence that is long enough to be kept as an article. " * 4
    files = spark.createDataFrame([("p1", "d1", "h1", text), ("p2", "d2", "h2", "short"), ("p3", "d3", "h3", text + "More of it. " * 20)], "path string, doc_id string, sha1 string, text string")
    at = lambda name: str(tmp_path / name)

    def broken(write, *_):
        raise RuntimeError("no space")

    with monkeypatch.context() as m:
        m.setattr(lifecycle, "write_with_retries", broken)
        made = lifecycle.run(spark, files, at("v1"), at("state"), 1)
    assert (made.docs_processed, made.failed_docs) == (0, 3)
    made = lifecycle.run(spark, files, at("v1"), at("state"), 2)
    assert (made.docs_processed, made.failed_docs, made.skipped_file_dup) == (2, 1, 0) and made.total_chunks == spark.read.parquet(at("v1")).count() > 0
    assert {r["doc_id"] for r in lifecycle.failed(lifecycle.read_state(spark, at("state"))).collect()} == {"d2"}
    made = lifecycle.run(spark, files, at("v2"), at("state"), 3, at("v1"))
    assert (made.docs_processed, made.skipped_file_dup, made.total_chunks) == (0, 2, 0)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("again")

    waits = []
    lifecycle.write_with_retries(flaky, sleep=waits.append)
    assert waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        lifecycle.write_with_retries(lambda: (_ for _ in ()).throw(ValueError("fatal")), sleep=waits.append)
    assert lifecycle.progress(50, 100, 10, 100.0) == (0.1, "1.7m") and lifecycle.progress(0, 9, 0, 1.0)[1] == "..."


def test_index_is_searched_in_every_mode(spark, tmp_path):
    from lexmill.operators import search

    rows = [(f"c{k}", f"d{k // 2}", f"word{k} shared text about topic{k % 3}", f"title {k}", "results", k, "j1" if k < 6 else "j2", 30) for k in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, title string, section string, chunk_index int, journal_id string, char_len int")
    search.write_index(chunks, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(1, "word5 topic2"), (2, "xyzzy")], "query_id int, query string")
    for mode in search.MODES:
        results, heads = search.search_articles(index, queries, 3, mode)
        got = [r for r in results.orderBy("query_id", "position").collect() if r["query_id"] == 1]
        told = {r["query_id"]: r for r in heads.collect()}
        if mode == "dense":  # the two words of the first query cancel out in a vector of 64 signed buckets
            assert got == [] and told[1]["low_confidence"]
        else:
            assert got[0]["chunk_id"] == "c5" and len({r["doc_id"] for r in got}) == len(got) <= 3 and not told[1]["low_confidence"]
        assert told[2]["low_confidence"] and told[2]["warning"]
        assert (told[2]["total"] == 0) == (mode == "sparse")  # the nearest vectors are results, though doubtful ones
    assert {r["journal_id"] for r in search.search(index, queries, 5, "sparse", journal_id="j2").collect()} <= {"j2"}
    assert {r["doc_id"] for r in search.passages(index, queries, "d2").collect()} == {"d2"}
    written = spark.createDataFrame([(2, "word7 topic1"), (1, " ")], "query_id int, hypothesis string")
    assert {r["query_id"]: r["query"] for r in search.with_hypotheses(queries, written).collect()} == {1: "word5 topic2", 2: "word7 topic1"}
    assert search.with_hypotheses(queries, written, True) is queries
    assert [r["chunk_id"] for r in search.scroll(index, 2, journal_id="j2").collect()] == ["c10", "c11"]
    made = []
    for _ in range(2):
        kept = search.stored_result(spark, str(tmp_path / "kept"), {"q": "x", "k": 3}, lambda: made.append(1) or queries)
        assert kept.count() == 2
    assert made == [1]
    with pytest.raises(ValueError):
        search.write_index(chunks, str(tmp_path / "i"), dimensions=32)
    for bad in (("", "hybrid"), ("x" * 2001, "hybrid"), ("x", "other")):
        with pytest.raises(ValueError):
            search.checked_query(*bad)
    assert search.clamped(0, 1, 25) == 1 and search.clamped(999, 1, 25) == 25


def test_questions_of_a_csv(spark, tmp_path):
    from lexmill.operators import evaluation

    (tmp_path / "q.csv").write_text('user_input,reference\nfirst,a\n"  ",b\n"se, cond",c\nthird,d\n')
    assert [r["question"] for r in evaluation.read_questions(spark, str(tmp_path / "q.csv"), 2).collect()] == ["first", "se, cond"]
    (tmp_path / "odd.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        evaluation.read_questions(spark, str(tmp_path / "odd.csv"))


def test_guards_and_clients(spark):
    rows = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "p"), (None, "p"), ("", "p"), (None, None)], "fwd string, peer string")
    assert [r[0] for r in rows.select(limiter.client_key("fwd", "peer")).collect()] == ["1.1.1.1", "p", "p", "unknown"]
    probes = spark.createDataFrame([("ok",), ("slow",), (None,)], "status string")
    assert [r["state"] for r in limiter.health_state(probes).collect()] == ["online", "degraded", "offline"]


def test_lines_of_a_page_from_top_to_bottom(spark):
    def line(content, top, height=0.5):
        return {"content": content, "polygon": [1.0, top, 3.0, top, 3.0, top + height, 1.0, top + height]}

    page = {"pageNumber": 2, "lines": [line("c", 3.0), line("a", 1.0), line("flat", 1.5, 0.001), line("b", 1.0), {"content": "no box", "polygon": [1.0]}, {"content": "none"}]}
    found = spark.createDataFrame([("d", "", [page]), ("e", "", None)], T.StructType([T.StructField("doc_id", T.StringType()), *articles.ARTICLE.fields]))
    got = sorted((r["doc_id"], r["page"], r["line_no"], r["content"], r["left"], r["top"]) for r in articles.page_lines(found).collect())
    assert got == [("d", 2, 1, "a", 200.0, 200.0), ("d", 2, 2, "b", 200.0, 200.0), ("d", 2, 3, "c", 200.0, 600.0)]


def test_pages_with_a_match_or_all(spark):
    words = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 2), ("b", 1, 0), ("b", 2, 1)], "doc_id string, page int, word_index int")
    pages = words.select("doc_id", "page").distinct()
    one_, two = (spark.createDataFrame(x, "doc_id string, word_index int") for x in ([("a", 1)], [("a", 1), ("a", 2)]))
    matches = articles.matched_words(one_, two)
    assert sorted(map(tuple, matches.collect())) == [("a", 1), ("a", 2)]
    assert sorted(map(tuple, articles.pages_to_show(pages, words, matches).collect())) == [("a", 2), ("b", 1), ("b", 2)]
    assert sorted(map(tuple, articles.pages_to_show(pages, words, matches.limit(0)).collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_files_by_their_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x").mkdir()
    held = {"a.pdf": b"p" * 5000, "x/b.pdf": b"", "x/c.txt": b"t"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha1"], r["etag"]) for r in articles.read_files(spark, str(tmp_path)).collect()}
    assert got == {n.split("/")[-1]: (len(c), hashlib.sha1(c).hexdigest(), hashlib.md5(c[:1024]).hexdigest()) for n, c in held.items() if n.endswith("pdf") and c}


def test_messages_of_older_files(spark, tmp_path):
    old = spark.createDataFrame([("m1", "c", "user", "hi")], "msg_id string, conv_id string, role string, text string")
    new = spark.createDataFrame([("m2", "c", "assistant", "yo", "{}")], "msg_id string, conv_id string, role string, text string, meta_json string")
    for df in (old, new):
        df.write.mode("append").parquet(str(tmp_path / "m"))
    got = {r["msg_id"]: (r["text"], r["meta_json"], r["created_at"]) for r in store.read_messages(spark, str(tmp_path / "m")).collect()}
    assert got == {"m1": ("hi", None, None), "m2": ("yo", "{}", None)}


def test_analyses_come_from_the_cache(spark):
    raw = spark.createDataFrame([("a", '```json\n{"x": 1}\n```'), ("b", "{broken"), ("c", '{"x": 3}'), ("d", None)], "doc_id string, raw string")
    cache = spark.createDataFrame([("c", '{"x":9}'), ("z", '{"x":0}')], "doc_id string, analysis string")
    shown, kept = chat.analysis(raw, cache)
    assert {tuple(r) for r in shown.collect()} == {("a", '{"x":1}'), ("c", '{"x":9}')}
    assert {r["doc_id"] for r in kept.collect()} == {"a", "c", "z"}
    assert {tuple(r) for r in chat.analysis(raw)[0].collect()} == {("a", '{"x":1}'), ("c", '{"x":3}')}


def test_shares_of_words_in_common(spark):
    rows = [(1, "The cat, the mat.", "cat on a mat"), (2, "one", ""), (3, "", "one"), (4, None, "one")]
    got = {r["sample_id"]: (r["context_recall"], r["context_precision"]) for r in evaluation.lexical_recall(spark.createDataFrame(rows, "sample_id int, reference string, contexts string")).collect()}
    assert got[1] == (0.666667, 0.5) and got[2] == (0.0, None) and got[3] == (None, 0.0) and got[4] == (None, None)


def test_sources_and_payloads_have_plain_fields(spark):
    schema = "query_id int, chunk_id string, doc_id string, text string, title string, section string, journal_id string, score string, chunk_index string, char_len string"
    row = synthesis.as_sources(spark.createDataFrame([(1, " c ", "d", None, " t", "", None, "0.5", "x", None)], schema)).first().asDict()
    assert row == {"query_id": 1, "chunk_id": "c", "doc_id": "d", "text": "", "title": "t", "section": "", "journal_id": "", "score": 0.5, "chunk_index": 0, "char_len": 0}
    chunks = spark.createDataFrame([("k1", "0001-002-003-004", "x", "s", 1, 0), ("k2", "odd", "y", "s", 1, 0)], "chunk_id string, doc_id string, text string, section string, char_len int, chunk_index int")
    titles = spark.createDataFrame([("0001-002-003-004", "T")], "doc_id string, title string")
    got = {r["chunk_id"]: r for r in search.chunk_payload(chunks, titles, articles.path_metadata("doc_id")).collect()}
    assert (got["k1"]["title"], got["k1"]["journal_id"], got["k1"]["article_num"]) == ("T", "0001", "004")
    assert (got["k2"]["title"], got["k2"]["journal_id"]) == ("", None)


def test_fences_outlines_and_dialect(spark):
    text = "```markdown\n### First one \nx\n### Second\n#### no\n### First one\n```"
    df = spark.createDataFrame([(text, ["w", "x"])], "t string, w array<string>")
    r = df.select(display.outline(display.without_fence("t")).alias("o"), display.rewrite_dialect(F.col("w"), {"w": "v"}).alias("d"), display.rewrite_dialect(F.col("w"), {}).alias("e")).first()
    assert [tuple(x) for x in r["o"]] == [("syn-First-one", "First one"), ("syn-Second", "Second")]
    assert (r["d"], r["e"]) == (["v", "x"], ["w", "x"])
    assert synthesis.document_limits(2, 1) == (16, 48) and synthesis.document_limits(4, 10) == (40, 120) and synthesis.chunk_limits(5) == (20, 60) and synthesis.chunk_limits(1) == (5, 15)


def test_turns_for_a_query_and_without_the_open_question(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant") for t in range(9)] + [(2, 0, "user"), (2, 1, "assistant")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    assert sorted(r["turn"] for r in conversations.recent(df, 6).filter("conv_id = 1").collect()) == [3, 4, 5, 6, 7, 8]
    left = conversations.without_open_question(df).collect()
    assert sorted((r["conv_id"], r["turn"]) for r in left) == [*((1, t) for t in range(8)), (2, 0), (2, 1)]
