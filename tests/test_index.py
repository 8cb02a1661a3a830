"""Indexes: cells and codes of vectors, segments that grow, and fields. Each is held against a plain scan or a full build."""

from __future__ import annotations

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking, increments, keyword_index, retrieval, search, vector_index
from lexmill.plans import search_queries as Q

SF = "/root/testdata/sf0.001"


def vectors(spark, n: int, d: int = 16, groups: int = 12, seed: int = 1):
    """Vectors around some centres; a third are one and the same."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(groups)]
    rows = [(k, [c + rng.gauss(0, 0.35) for c in rng.choice(centres)] if k % 3 else [float(x) for x in centres[0]]) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(4)


def of(df) -> list:
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def files(path: str) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_all_cells_give_what_a_scan_gives(spark, tmp_path):
    v = vectors(spark, 900)
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [float("nan")] * 16), (-5, [1.0] * 3), (-6, [100.0] + [0.0] * 15)], "chunk_id long, vector array<float>")
    about = vector_index.write_vectors(v.unionByName(odd), str(tmp_path / "v"))
    assert (about.rows, about.dimensions) == (901, 16)
    queries = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    plain = v.unionByName(odd.filter("chunk_id = -6"))
    assert of(vector_index.nearest(spark, str(tmp_path / "v"), queries, 7, probes=0)) == of(retrieval.dense_top_k(queries, plain, 7))


def test_probes_reach_the_recall_and_read_their_cells_only(spark, tmp_path):
    v = vectors(spark, 1500)
    path = str(tmp_path / "v")
    about = vector_index.write_vectors(v, path, cells=24)
    queries = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(q, c) for q, c, _, _ in of(retrieval.dense_top_k(queries, v, 10))}
    got = vector_index.nearest(spark, path, queries, 10)
    assert len(exact & {(q, c) for q, c, _, _ in of(got)}) >= 0.9 * len(exact)
    assert about.probes < len(about.centroids) / 2
    one = vector_index.nearest(spark, path, queries.limit(1), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x or "Scan parquet" in x]
    assert scans and all("cell" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)
    codes = [x for x in scans if "code:binary" in x]
    assert codes and all("vector" not in x for x in codes)


def test_codes_are_a_quarter_of_the_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    vector_index.write_vectors(vectors(spark, 3000, d=256), path, cells=4)
    size = {n: sum(map(os.path.getsize, files(f"{path}/{n}"))) for n in ("codes", "full")}
    # a third of the vectors are the same and cost little in either; ids and bounds come with the codes
    assert size["codes"] < 0.3 * size["full"]


def test_clipped_components_and_wide_bounds_change_no_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "LEVELS", 3)
    v = vectors(spark, 300)
    vector_index.write_vectors(v, str(tmp_path / "v"), cells=5)
    queries = v.filter("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    assert of(vector_index.nearest(spark, str(tmp_path / "v"), queries, 5, probes=0)) == of(retrieval.dense_top_k(queries, v, 5))


@pytest.mark.parametrize("n", [0, 1])
def test_small_vector_indexes(spark, tmp_path, n):
    v = vectors(spark, 5).filter(F.col("chunk_id") < n)
    vector_index.write_vectors(v, str(tmp_path / "v"))
    queries = vectors(spark, 2).withColumnRenamed("chunk_id", "query_id")
    assert vector_index.nearest(spark, str(tmp_path / "v"), queries, 3).count() == 2 * n


def test_more_queries_than_a_block_holds(spark, tmp_path, monkeypatch):
    v = vectors(spark, 300)
    vector_index.write_vectors(v, str(tmp_path / "v"))
    queries = v.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    want = of(vector_index.nearest(spark, str(tmp_path / "v"), queries, 3))
    monkeypatch.setattr(vector_index, "QUERIES_MOST", 12)
    assert of(vector_index.nearest(spark, str(tmp_path / "v"), queries, 3)) == want


# --- segments ------------------------------------------------------------------------------------


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, title string, section string, journal_id string, chunk_index int, char_len int")


def made_rows(ids, word: str = "") -> list[tuple]:
    return [(f"c{k}", f"d{k // 3}", f"{word} common w{k} w{k % 7} text of chunk {k}", f"Title {k // 3}", f"s{k % 2}", f"j{k % 4}", k % 3, 30) for k in ids]


def found(index, queries) -> list:
    return sorted(map(tuple, search.search(index, queries, 8).select("query_id", "position", "chunk_id", "score", "raw_score").collect()))


def test_three_writes_equal_one_build(spark, tmp_path):
    path = str(tmp_path / "i")
    queries = spark.createDataFrame([(k, f"w{k} common chunk w{k % 7}") for k in range(0, 60, 4)], "query_id int, query string")
    first = increments.upsert(spark, path, chunk_rows(spark, made_rows(range(40), "stale") + made_rows(range(900, 905))), buckets=8)
    increments.upsert(spark, path, chunk_rows(spark, made_rows(range(40, 60))))
    third = increments.upsert(spark, path, chunk_rows(spark, made_rows(range(20)) + made_rows([3], "")), removed=chunk_rows(spark, made_rows(range(900, 910))).select("chunk_id"))
    assert (first.chunks, third.rows, third.deleted, third.chunks) == (45, 20, 25, 60)
    whole = chunk_rows(spark, made_rows(range(20)) + made_rows(range(20, 40), "stale") + made_rows(range(40, 60)))
    search.write_index(whole, str(tmp_path / "w"))
    want = found(search.read_index(spark, str(tmp_path / "w")), queries)
    assert found(increments.read_index(spark, path), queries) == want
    # a removed chunk that comes again, and goes again, is counted once
    increments.upsert(spark, path, chunk_rows(spark, made_rows([900])))
    assert increments.upsert(spark, path, chunk_rows(spark, []), removed=chunk_rows(spark, made_rows([900, 901])).select("chunk_id")).deleted == 1
    assert found(increments.read_index(spark, path), queries) == want
    compacted = increments.compact(spark, path)
    assert [v.number for v in increments.versions(spark, path)] == [compacted.number]
    assert {os.path.basename(os.path.dirname(f)) for f in files(f"{path}/postings")} == {f"seg={compacted.number}"}
    assert found(increments.read_index(spark, path), queries) == want
    increments.upsert(spark, path, chunk_rows(spark, made_rows([1], "new")))
    assert increments.read_index(spark, path)["chunks"].filter("chunk_id = 'c1'").first()["text"].startswith("new")
    assert {r["journal_id"]: r["documents"] for r in increments.document_estimates(spark, path).collect()} == {r["journal_id"]: r["n"] for r in whole.groupBy("journal_id").agg(F.count_distinct("doc_id").alias("n")).collect()}


def test_untouched_files_keep_their_names(spark, tmp_path):
    path = str(tmp_path / "i")
    increments.upsert(spark, path, chunk_rows(spark, made_rows(range(60))), buckets=16)
    before = files(f"{path}/chunks")
    increments.upsert(spark, path, chunk_rows(spark, made_rows([5, 6], "changed")))
    after = files(f"{path}/chunks")
    folders = {os.path.dirname(f) for f in before ^ after}
    assert 1 <= len(folders) <= 2 and len(before & after) >= 12
    assert spark.read.parquet(f"{path}/chunks").filter("text LIKE 'changed%'").count() == 2
    assert spark.read.parquet(f"{path}/chunks").count() == 60


def test_a_write_that_fails_is_not_seen_and_can_be_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    queries = spark.createDataFrame([(1, "common w1 w2")], "query_id int, query string")
    increments.upsert(spark, path, chunk_rows(spark, made_rows(range(20))), number=0, buckets=4)
    rows = chunk_rows(spark, made_rows(range(10, 30), "changed"))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(increments, "_commit", fail)
        with pytest.raises(OSError):
            increments.upsert(spark, path, rows, number=1)
    assert increments.versions(spark, path)[-1].number == 0
    again = increments.upsert(spark, path, rows, number=1)
    assert (again.deleted, again.chunks) == (10, 30)
    twice = increments.upsert(spark, path, rows, number=1)
    assert (twice.deleted, twice.chunks) == (10, 30)
    search.write_index(chunk_rows(spark, made_rows(range(10))).unionByName(rows), str(tmp_path / "w"))
    assert found(increments.read_index(spark, path), queries) == found(search.read_index(spark, str(tmp_path / "w")), queries)


def test_odd_rows_of_a_write(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = chunk_rows(spark, [(None, "d", "x y", "", "", "", 0, 3), ("a", "d", None, None, None, None, None, None), ("b", "d", "b text", "", "", "", 0, 1), ("b", "d", "a text", "", "", "", 0, 1)])
    made = increments.upsert(spark, path, rows, buckets=2)
    assert made.chunks == 2
    index = increments.read_index(spark, path)
    assert {r["chunk_id"]: r["text"] for r in index["chunks"].collect()} == {"a": "", "b": "b text"}
    assert {r["chunk_id"] for r in index["postings"].collect()} == {"b"}
    with pytest.raises(ValueError):
        increments.read_index(spark, str(tmp_path / "none"))


# --- fields --------------------------------------------------------------------------------------


def test_title_and_value_filters(spark, tmp_path):
    rows = [("c1", "d1", "alpha text", "The Sea of Stories", "s", "j", 0, 1), ("c2", "d1", "alpha more", "The Sea of Stories", "t", "j", 1, 1), ("c3", "d2", "alpha", "Stories of the sea, the sea!", "s", "k", 0, 1), ("c4", "d3", "alpha", None, "s", "", 0, 1)]
    path = str(tmp_path / "i")
    assert search.write_index(chunk_rows(spark, rows), path)
    index = search.read_index(spark, path)

    def ids(**kw):
        return sorted(r["chunk_id"] for r in search.held_to(index, **kw).collect())

    assert ids(title="sea STORIES") == ["c1", "c2", "c3"]
    assert ids(title="sea of", phrase=True) == ["c1", "c2"]
    assert ids(title="the sea", phrase=True) == ["c1", "c2", "c3"]
    assert ids(title="sea the sea", phrase=True) == ["c3"]
    assert ids(title="sea", section="s", journal_id="j") == ["c1"]
    assert ids(doc_id="d3") == ["c4"] and ids(title="missing") == []
    assert search.held_to(index, title="", journal_id=None) is None
    bare = {k: v for k, v in index.items() if k not in ("titles", "keywords")}
    assert sorted(r["chunk_id"] for r in search.held_to(bare, "the sea", True, section="s").collect()) == ["c1", "c3"]
    queries = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert {r["chunk_id"] for r in search.search(index, queries, 5, "sparse", title="stories of", phrase=True).collect()} == {"c3"}
    plan = keyword_index.documents_with_title(index["titles"], "sea of")._jdf.queryExecution().executedPlan().toString()
    assert "In(word, [of,sea])" in plan


def test_an_index_that_is_there_is_kept(spark, tmp_path):
    path = str(tmp_path / "i")
    assert search.write_index(chunk_rows(spark, made_rows(range(3))), path)
    assert not search.write_index(chunk_rows(spark, made_rows(range(3, 5))), path)
    assert search.read_index(spark, path)["chunks"].count() == 3
    assert search.write_index(chunk_rows(spark, made_rows(range(3, 5))), path, recreate=True)
    assert {r["chunk_id"] for r in search.read_index(spark, path)["chunks"].collect()} == {"c3", "c4"}


# --- from documents to results -------------------------------------------------------------------


def test_chunks_are_indexed_and_searched_as_sql_says(spark, tmp_path):
    """The oracle of the search queries, run over the chunks in place of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = chunking.chunk_documents(docs).join(docs.select("doc_id", F.col("source").alias("journal_id")), "doc_id").drop("embed_text")
    path = str(tmp_path / "i")
    search.write_index(chunks, path, ann=True)
    index = search.read_index(spark, path, ann=True)
    assert index["chunks"].groupBy("doc_id").count().filter("count > 3").count() > 0
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    con = duckdb.connect()
    own = index["chunks"].select("chunk_id", "doc_id", "title", "section", "journal_id", "text").toPandas()
    con.register("own", own)
    con.execute("CREATE TABLE documents AS SELECT chunk_id AS doc_id, doc_id AS parent, title, section AS lang, journal_id AS source, text FROM own")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    sql = Q.GATE_SQL.replace(f"({Q.TITLES_SQL})", "(SELECT doc_id, title FROM documents)").replace("d.lang AS section", "d.lang AS section, d.parent").replace("query_id, chunk_id, doc_id,", "query_id, chunk_id, doc_id, parent,")
    found = con.execute(f"SELECT query_id, chunk_id, parent, score, new_rank FROM ({sql})").fetchall()
    n = 3 * Q.K
    got = search.search(index, queries, n, "sparse").select("query_id", "chunk_id", "doc_id", "score", "new_rank").collect()
    assert sorted(map(tuple, got)) == sorted(found)
    # one result a document: the first of its chunks that passed the gate
    best: dict = {}
    for query, chunk, parent, _, rank in sorted(found, key=lambda r: (r[0], r[4])):
        best.setdefault((query, parent), (rank, chunk))
    shown = retrieval.dedup_per_document(search.search(index, queries, n, "sparse"), 5, "new_rank").collect()
    assert shown and all(best[(r["query_id"], r["doc_id"])] == (r["new_rank"], r["chunk_id"]) for r in shown)
    several = [k for k, rows in _by_query_and_document(found).items() if len(rows) > 1]
    assert several  # the dedup had something to do
    longest = index["chunks"].groupBy("doc_id").count().orderBy(F.desc("count")).first()["doc_id"]
    passages = search.passages(index, queries, longest, 5, "sparse").collect()
    assert {r["doc_id"] for r in passages} == {longest} and max(r["position"] for r in passages) > 1
    heads = search.search_articles(index, queries, 5, "hybrid")[1].collect()
    assert all(json.dumps(r["suggestions"]) and (r["warning"] is not None) == r["low_confidence"] for r in heads)


def _by_query_and_document(rows) -> dict:
    out: dict = {}
    for query, chunk, parent, _, _ in rows:
        out.setdefault((query, parent), []).append(chunk)
    return out
