import corpus_pipeline
from tests.llm.test_operators import words


def test_stages(spark, tmp_path):
    leak = "The quick benchmark question asks how many ways there are to walk home along the river at night."
    texts = {k: f"Plain document w{k}p about topic w{k}q.\n" + words(k, 60) for k in range(40)}
    texts[50] = "A document that quotes.\n" + words(50, 40) + " " + leak
    texts[51] = words(3, 60)  # only a line that another has
    texts[52] = words(52, 100) + " end one"
    texts[53] = words(52, 100) + " end two and more words here to be another line " + words(53, 5)
    for k in range(60, 100):
        texts[k] = f"{words(k, 12)} you blorgface {words(k + 100, 5)}"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(200, None, "en", "s", 0), (201, "", None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not left[0] & set(range(60, 100)) and {*range(40), 50, 200, 201} <= left[0]
    assert 51 not in left[1] and {*range(40), 50, 52, 200, 201} <= left[1]
    assert 50 not in left[3] and {*range(40), 200, 201} <= left[4]


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null and repeated ids, repeated rows, ties, long and empty texts, and columns named as what stages add."""
    leak = "The quick benchmark question asks how many ways there are to walk home along the river at night."
    rows = [(k, f"Plain document w{k}p about topic w{k}q.\n" + words(k, 60)) for k in range(12)]
    rows += [(None, "A row without an id that quotes.\n" + words(90, 40) + " " + leak), (None, "Another row without an id.\n" + words(91, 40)), (3, "Another text of id three.\n" + words(92, 30)), rows[5], rows[5]]
    rows += [(20, ""), (21, None), (22, "long " + " ".join(f"l{k}" for k in range(30_000)))]
    rows += [(30 + k, f"{words(k + 200, 12)} you blorgface {words(k + 300, 5)}") for k in range(12)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score int, predicted int, n_lines int, n_dropped int, row string, `odd name` int, common int"
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, 1, 1, "r", 1, 1) for i, t in rows], names).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 30)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        if name == "decontamination":
            left = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert not any(t and leak in t for _, t in left) and any(i is None and t.startswith("Another row") for i, t in left)
            assert {*range(12), 20, 21, 22} <= {i for i, _ in left} and not {*range(30, 42)} & {i for i, _ in left}
    assert {r["doc_id"] for r in docs.collect()} >= {None, *range(12), 20, 21, 22}


def test_stages_on_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
