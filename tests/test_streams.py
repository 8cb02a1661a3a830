"""Streams with state, batches of an ingest, exact ranks, and values that plain Python gives for text functions."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import chunking, citations, evaluation, increments, lines, retrieval
from lexmill.sources import lifecycle
from lexmill.streaming import ingest, limiter

TEXT = "A sentence about {0} that is long enough to be kept as an article of its own. " * 3
ARTICLES = "doc_id string, text string"


def put(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, ARTICLES).coalesce(1).write.mode(mode).parquet(path)


def test_stream_state_survives_a_restart(spark, tmp_path):
    """The same paragraph or article is written once, whichever run brings it, and no run reads the index."""
    src, index, seg, cp = (str(tmp_path / n) for n in ("in", "index", "seg", "cp"))
    run = lambda: ingest.finish(ingest.ingest_stream(spark, src, index, cp, segments=seg))
    put(spark, src, [("d1", TEXT.format("one")), ("d2", TEXT.format("two"))])
    assert run()
    put(spark, src, [("d1", TEXT.format("one")), ("d3", TEXT.format("two")), ("d4", TEXT.format("four"))])
    assert run()
    put(spark, src, [("d5", TEXT.format("four")), ("d4", TEXT.format("four"))])
    assert run()
    rows = spark.read.parquet(index).select("doc_id", "batch").collect()
    assert sorted(r["doc_id"] for r in rows) == ["d1", "d2", "d4"]
    # the index in segments has what the batches' folders have, and is searched
    found = increments.read_index(spark, seg)
    assert sorted(r["doc_id"] for r in found["chunks"].collect()) == ["d1", "d2", "d4"]
    posts = retrieval.postings(spark.createDataFrame([(1, "four")], "query_id int, query string"), "query_id", "query")
    best = retrieval.top_k(retrieval.sparse_scores_of(posts, found["postings"], found["idf"]), 1).collect()
    assert [r["chunk_id"] for r in best] == ["d4_chunk_000"]


def test_stop_at_a_batch_and_resume(spark, tmp_path):
    src, index, cp, table = (str(tmp_path / n) for n in ("in", "index", "cp", "progress"))
    for k in range(5):
        put(spark, src, [(f"d{k}", TEXT.format(f"number {k}"))])
    asked = []
    listener = ingest.ProgressTable(spark, table, total=5)
    spark.streams.addListener(listener)
    try:
        stopped = ingest.ingest_stream(spark, src, index, cp, files_per_batch=1, stop=lambda: asked.append(1) or len(asked) > 2)
        assert not ingest.finish(stopped)
        assert spark.read.parquet(index).count() == 2
        assert ingest.finish(ingest.ingest_stream(spark, src, index, cp, files_per_batch=1))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.parquet(index).select("doc_id", "batch").collect()
    assert sorted(r["doc_id"] for r in rows) == [f"d{k}" for k in range(5)] and len({r["batch"] for r in rows}) == 5
    progress = {r["batch"]: r for r in ingest.read_progress(spark, table).collect()}
    assert set(progress) == set(range(5))
    last = progress[4]
    assert (last["documents"], last["chunks"], last["left"]) == (5, 5, "0s") and last["rate"] > 0


def test_limiter_stream_over_batches_drops_idle_clients(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows, n = [], 0
    for part in range(4):  # a client a part stays, others come and go
        for _ in range(60):
            n += 1
            at = start + timedelta(minutes=10 * part, seconds=rng.randrange(100))
            rows.append((rng.choice(["stays", f"only{part}", None]), n, at, "POST", rng.choice(["/api/search", "/api/health"])))
    rows.sort(key=lambda r: r[2])
    schema = "client string, request_id int, ts timestamp, method string, path string"
    df = spark.createDataFrame(rows, schema)
    want = {(r["request_id"], r["accepted"]) for r in limiter.limit_requests(limiter.in_scope(df), 5, 30).collect()}
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = limiter.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 5, 30, prefixes=limiter.LIMITED_PREFIXES)
    sizes = []
    for part in range(4):
        low = start + timedelta(minutes=10 * part)
        some = df.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(low + timedelta(minutes=10))))
        some.coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    got = {(r["request_id"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    assert {ok for _, ok in got} == {True, False}
    assert sizes[-1] <= 3  # of seven clients


def test_batches_end_with_the_document_that_fills_them(spark):
    def batches(sizes, size):
        rows = [("p", k) for k, n in enumerate(sizes) for _ in range(n)]
        found = lifecycle.document_batches(spark.createDataFrame(rows, "part string, doc_id int"), size, "part").select("doc_id", "batch.k").distinct().collect()
        out: dict = {}
        for r in sorted(found):
            out.setdefault(r["k"], []).append(r["doc_id"])
        return list(out.values())

    assert batches([5, 1, 1, 1, 1], 4) == [[0], [1, 2, 3, 4]]
    assert batches([1, 1, 5, 1], 3) == [[0, 1, 2], [3]]
    rows = spark.createDataFrame([(k,) for k in range(50) for _ in range(k % 3 + 1)], "doc_id int")
    found = lifecycle.document_batches(rows, 10).groupBy("batch").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).collect()
    assert sum(r["n"] for r in found) == rows.count()
    assert sum(r["n"] < 10 for r in found) <= len({r["batch"]["part"] for r in found})  # only the last of a part


def test_order_statistics(spark):
    rng = random.Random(2)
    groups = {"many": [rng.gauss(0, 1e6) for _ in range(3000)], "ties": [1.5] * 900 + [2.5] * 100 + [-1e300, 1e300], "one": [7.0], "two": [1.0, 2.0], "tiny": [5e-324, 0.0, 1e-320], None: [3.0, 1.0], "wide": [-1.7e308, 1.7e308, 0.0], "close": [1.0 + k * 2.0**-52 for k in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan")), ("none", None)]
    n = F.col("n")
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in evaluation.order_statistics(df, "g", "v", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.floor(n * 0.95) + 1, "far": n + 5}, bins=16).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        assert (got[g]["low"], got[g]["high"]) == (statistics.median_low(s), statistics.median_high(s))
        assert got[g]["p95"] == s[min(len(s) - 1, int(len(s) * 0.95))] and got[g]["far"] == s[-1]
    inf = evaluation.order_statistics(spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("-inf"))], "g string, v double"), "g", "v", {"x": F.lit(2)}).collect()
    assert [r["x"] for r in inf] == [1.0]


def test_no_window_ranks_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    plan = evaluation.order_statistics(df, "g", "v", {"x": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_text_is_stripped_as_python_strips(spark):
    samples = [" a b　", "\x1c\x85x ", "​kept﻿", " \t\n y \r\x0b\x0c", "    z", ""]
    got = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(samples)], "k int, s string").orderBy("k").select(X.strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_titles_without_digits_of_any_script_win(spark):
    clean, others = "a clean line of words here", ["a line with ۱۲۳ digits", "a line with १ digit in", "a line with m² in it", "a line with ① in it too", "a line with ١ digit in"]
    for other in others:
        assert any(c.isdigit() for c in other)
        row = spark.createDataFrame([(f"{other}\n{clean}",)], "text string").select(lines.title("text")).first()
        assert row[0] == clean
    # letters that count but are no digits carry no malus
    row = spark.createDataFrame([(f"a line with ½ and Ⅳ in\n{clean}",)], "text string").select(lines.title("text")).first()
    assert row[0].startswith("a line with ½")


def test_find_keeps_the_places_of_marks(spark):
    docs = spark.createDataFrame([(1, "aa – aa bb"), (2, "Aa bb, AA, bB!"), (3, "aaabb bb"), (4, ""), (5, None)], "doc_id int, text string")

    def starts(*terms):
        return {r["doc_id"]: r["starts"] for r in citations.find_in_document(docs, list(terms)).collect()}

    assert starts("bb")[1] == [3] and starts("aa", "bb")[1] == [2]
    assert starts("Aa")[2] == [0, 2] and starts("aa bb")[2] == [0, 2]
    assert starts("aa")[3] == [0] and starts("aa")[4] == []
    assert starts("–", ".")[1] == []


def test_sentences_are_stripped_before_they_are_counted():
    pad = " " * 3
    parts, rest = chunking.split_long(f"{'a' * 40}. {pad}{'b' * 40}.{pad} {'c' * 40}.", 86, 100, 0)
    assert parts == [f"{'a' * 40}. {'b' * 40}."] and rest == f"{'c' * 40}."


def test_dense_neighbours_of_rows_without_a_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0, 2.0]), (5, [0.5, 0.5])], "chunk_id int, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.dense_top_k(queries, rows, 3).orderBy("rank").collect()] == [(1, 1), (1, 5)]
