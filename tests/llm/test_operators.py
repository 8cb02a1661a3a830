import hashlib
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common, decontaminate, exact_dedup, html_text, license_scan, line_dedup, ngram_join, packing, queries, toxicity, url_filter, warc
from lexmill.llm.common import keep
from lexmill.llm.components import connected_components, link_left
from lexmill.llm.gbt import BoostedTrees

DOCS = "doc_id long, text string, hash string, n long, h long"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids, texts)], DOCS)


def words(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


EDGES = [None, "", "   ", "one", "one", words(1), words(1), words(2) + " " + "z" * 50_000, words(3, 5000)]


# --- exact dedup ---------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    texts = [*EDGES, "dup"] + ["dup"] * 30
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), keep="max").collect()}
    assert len(got) == len(texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        own = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    assert least[12] == 9


def test_exact_dedup_group_over_many_partitions(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_dedup(rows, keep="max").filter("group_size > 1")
    assert {tuple(r) for r in got.select("keep_id", "group_size").distinct().collect()} == {(1998, 667)}
    assert got.filter("kept").count() == 1


def test_exact_dedup_null_ids_repeats_and_empty(spark):
    rows = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows, keep="max").collect()
    assert sorted((r["text_sha256"][:4], r["doc_id"] or -1, r["kept"]) for r in got if r["keep_id"] == 5) == sorted([("ca97", -1, False), ("ca97", 5, True), ("ca97", 5, False)])
    assert sum(r["kept"] for r in got) == 2
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


# --- WARC ----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/", big, "s"), (2, "http://b/\r\nX: y", big, "s"), (3, None, "small", "s"), (4, "http://c/", "small", "s"), (5, "http://d/", None, "s"), (6, "http://e/", big, "s")], "page_id long, url string, html string, sha256 string")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert [got[i]["record_type"] for i in range(1, 7)] == ["revisit", "revisit", "response", "response", "response", "response"]
    assert [got[i]["refers_to"] for i in range(1, 7)] == [6, 6, None, None, None, None]
    assert got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got[1]["payload_bytes"] == len(big.encode()) and got[5]["payload_bytes"] == 0
    path = warc.new_path(spark, "again")
    warc.write_archive(pages, path)
    records = warc.record_bytes(warc.read_archive(spark, path)).orderBy("id").collect()
    parsed = warc.parse_records(b"".join(r["record"] for r in records))
    assert len(parsed) == 6 and parsed[5][0]["WARC-Type"] == "response" and parsed[5][1].endswith(big.encode()) and parsed[0][1].endswith(b"\r\n\r\n")
    assert parsed[0][0]["WARC-Refers-To"] == parsed[5][0]["WARC-Record-ID"] and "X" not in parsed[1][0]
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert warc.archive_pages(pages.limit(0)).count() == 0


# --- URL filter ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("HTTP://A.EXAMPLE.com/en/7?x=/", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "block"),
        ("http://example.com?/en/", "example.com", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("x://org/es/#f", "org", "/es/", "org/es/", "block"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert url_filter.split_url(url) == (host, path)
    assert url_filter.Rules(queries.URL_RULES).find(host, path) == (rule, verdict)


def test_url_rules_have_the_verdicts_of_the_contract(spark, tmp_path):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    expected = {"com/en/": "com/en/", "com/en/7": "com/en/", "example.com/en/71": "example.com/en/7", "net/de/": "net/de/", "casino.net/de/8": "net/de/", "example.net/de/7": "net/de/", "a.example.net/de/88": "example.net/de/8", "b.org/es/": "org/es/"}
    rows = [(i, f"http://{url}") for i, url in enumerate(expected)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, contract[rule]) for i, rule in enumerate(expected.values())}


def test_url_filter(spark):
    rows = [(i, f"http://{'free-bets' if i % 9 == 0 else 'site' + str(i % 7)}.example.{'info' if i % 2 else 'edu'}/a/{i}", "x") for i in range(300)] + [(300, None, "x"), (301, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    model = url_filter.train_urls(url_filter.label_by_words(pages))
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, model, queries.URL_RULES).collect()}
    assert len(got) == 302 and all((got[i]["verdict"] == "block") == (i % 9 == 0) for i in range(300))
    assert url_filter.judge_urls(pages.limit(0), url_filter.train_urls(url_filter.label_by_words(pages.limit(0))), []).count() == 0


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = BoostedTrees(depth=3).fit(x, y).probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97
    assert (BoostedTrees().fit(x, np.zeros(2000)).probability(x) < 0.01).all()


# --- HTML ----------------------------------------------------------------------------------------------------


def test_html_text(spark):
    model = html_text.train_extractor(html_text.made_pages())
    fresh = html_text.made_pages(40, seed=99)
    assert sum(html_text.extract(h, model) == " ".join(a.split()) for h, a in fresh) >= 36
    body = "A first paragraph of the article, with enough words to be one. " * 3
    html = f"<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>Head</h1><p>{body}<p>Se&amp;cond<br>line <b>bo</b>ld</article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", html, 1), (2, None, None, 1), (3, "u", "", 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract_text(pages, model).collect()}
    assert got[1]["text"] == " ".join(f"Head {body} Se&cond line bold".split()) and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert html_text.extract_text(pages.limit(0), model).count() == 0


def test_html_decoding_is_consistent():
    page = html_text.Page("<div><p>" + "a" * 50 + "</p><section><p>" + "b" * 50 + "</p></section></div>" + "<div>" * 3000)
    keep = page.decode([(-1) ** k * 2.0 for k in range(len(page.tag))])
    assert len(keep) == len(page.tag)


@pytest.mark.parametrize("odd", ["<![ endif]-->", "<![foo[x]]>", "<p>a <![ b</p>", "<![endif]-->", "<![>", "<![1]>"])
def test_html_goes_on_after_odd_declarations(odd):
    page = html_text.Page(f"<p>first</p>{odd}<p>second</p>")
    said = page.text([True] * len(page.tag))
    assert said.startswith("first") and said.endswith("second")


# --- line dedup ----------------------------------------------------------------------------------------------


def full_sets(line):
    line = line.strip(" ").lower()
    return {line[j : j + 10] for j in range(max(1, len(line) - 9))}


def brute_lines(rows):
    """Which (id, line number) go, by comparing every line with every other."""
    sets, first = {}, {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, raw in enumerate(text.split("\n")):
            line = raw.strip(" ").lower()
            if line and line not in sets:
                sets[line] = full_sets(line)
                first[line] = (i, k)
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(sets)
    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                u, v = sorted((find(names[a]), find(names[b])), key=first.get)
                root[v] = u
    out = {}
    for i, text in rows:
        if text is not None:
            kept = [raw for k, raw in enumerate(text.split("\n")) if not raw.strip(" ") or first[find(raw.strip(" ").lower())] == (i, k)]
            out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    base = words(9, 60)
    near = [base.replace(f"w9x{k}", f"q{k}") for k in range(0, 60, 7)]
    rows = [(0, base + "\nunique line here"), (1, "\n".join(near)), (2, None), (3, ""), (4, "Les.\n\nLes."), (5, "  LES.\n" + words(4, 50)), (6, words(4, 49)), (7, words(8, 3000) + "\n" + "y" * 60_000)]
    got = {r["doc_id"]: r for r in line_dedup.fuzzy_line_dedup(docs(spark, [t for _, t in rows])).collect()}
    expected = brute_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == expected | {2: None}
    assert got[1]["n_dropped"] == len(near) and got[4]["n_dropped"] == 1 and got[2]["n_lines"] == 0
    assert line_dedup.fuzzy_line_dedup(docs(spark, ["x"]).limit(0)).count() == 0


def test_line_dedup_reads_all_characters(spark):
    urls = [" ".join(f"https://example.com/{k}{j}{'abcdefgh'[k] * 12}" for j in range(6)) for k in range(3)]
    tabs = "\t".join(f"cell{k}value" for k in range(20))
    han = "".join(chr(0x4E00 + 7 * k) for k in range(120))
    texts = [*urls, tabs, tabs.replace("cell7value", "cell7valve"), han, han[:60] + "\U0001F600" + han[60:], "x" * 3000]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.fuzzy_line_dedup(docs(spark, texts)).collect()}
    assert got == {k: int(k in (4, 6)) for k in range(len(texts))}
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, line string")
    sizes = {r["k"]: len(r["set"]) for r in lines.select("k", line_dedup.shingles(F.col("line")).alias("set")).collect()}
    assert sizes == {k: len(full_sets(t)) for k, t in enumerate(texts)}


def test_line_dedup_signature_finds_near_lines_of_any_length(spark):
    r = random.Random(3)
    rows, near = [], {}
    for n, more in ((4, 1), (8, 2), (16, 4), (40, 10), (55, 13), (62, 15), (64, 1), (100, 25), (400, 100)):
        for k in range(300):
            line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + more + 9))
            near[(len(rows), len(rows) + 1)] = n
            rows += [(len(rows), line[: n + 9]), (len(rows) + 1, line)]
    signed = line_dedup._signatures(spark.createDataFrame(rows, "h long, line string"))
    by_band = signed.select("h", F.explode("bands").alias("band")).groupBy("band").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    met = {(a, b) for row in by_band.filter("size(hs) > 1").collect() for i, b in enumerate(row["hs"]) for a in row["hs"][:i]}
    found = {n: sum(p in met for p, m in near.items() if m == n) / 300 for n in near.values()}
    assert all(v >= 0.95 for v in found.values()), found
    assert len(met) < 1.2 * len(near)


def test_line_dedup_of_lines_around_a_passage(spark):
    """Lines that share half and more, of which few are near, meet in buckets and go through the rare shingles."""
    r = random.Random(5)
    base = [f"{r.randrange(10**6)}" for _ in range(40)]
    texts = []
    for k in range(70):
        own = list(base)
        for at in r.sample(range(40), 4 + k % 5):
            own[at] = f"{r.randrange(10**6)}"
        texts.append(" ".join(own))
        if k % 3 == 0:
            texts.append(" ".join([*own[:20], "zz", *own[21:]]))
    got = {x["doc_id"]: x["text"] for x in line_dedup.fuzzy_line_dedup(docs(spark, texts)).collect()}
    expected = brute_lines(list(enumerate(texts)))
    assert sum(got[k] == expected[k] for k in expected) >= 0.98 * len(texts)


def test_line_dedup_edges(spark):
    """Null and repeated ids, rows that repeat whole, ties, and columns whose names clash."""
    rows = [(None, "null id line"), (None, "null id line"), (1, "same line here\nown line of one"), (1, "same line here\nown line of one"), (1, "another row of id one"), (2, "SAME LINE HERE"), (3, "null id line")]
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], "doc_id long, text string, h string, line string, drop int")
    got = sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in line_dedup.fuzzy_line_dedup(df, carry=["h", "line", "drop"]).collect())
    kept = [("None", "null id line", 0)] * 2 + [("1", "same line here\nown line of one", 0)] * 2 + [("1", "another row of id one", 0), ("2", "", 1), ("3", "", 1)]
    assert got == sorted(kept)


def test_large_groups_are_linked_before_their_pairs_are_made(spark):
    from lexmill.llm.components import link_by_heads

    sets = [(h, s, s) for h in range(100) for s in range(25)]
    lists = keep(spark.createDataFrame([(s, h, h, 100, pos) for h, s, pos in sets], "s long, h long, root long, n long, pos long"), "lists")
    tried = []

    def verified(pairs):  # sets are like those of the same remainder only
        tried.append(pairs.count())
        return pairs.filter("a % 2 = b % 2")

    def rooted(lists, links):
        roots = connected_components(links).withColumnRenamed("node", "h")
        return keep(lists.drop("root").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "lists")

    none = spark.createDataFrame([], "a long, b long")
    lists, links, _ = link_by_heads(lists, none, none, verified, rooted, 4, 5)
    assert lists.count() == len(sets) and tried and max(tried) <= 7 * 100
    assert links.filter("a % 2 != b % 2").count() == 0 and lists.select("root").distinct().count() <= 20


def test_link_left_finds_the_components_of_all_pairs(spark):
    """Thirty nodes of which each is linked with a part of the others, and a chain; pairs that fail are among those tried."""
    pairs = [(a, b) for a in range(30) for b in range(a)] + [(a + 1, a) for a in range(100, 112)]
    good = {(a, b) for a, b in pairs if a >= 100 or (a * 7 + b * 13) % 4 == 0} - {(106, 105)}
    across = keep(spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "a long, b long, room double"), "across")
    tried = []

    def verified(some):
        rows = [tuple(r) for r in some.collect()]
        tried.append(len(rows))
        return keep(spark.createDataFrame([r for r in rows if r in good], "a long, b long"), "links")

    links = link_left(across, spark.createDataFrame([], "a long, b long"), verified)
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in good:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert {x: found.get(x, x) for x in root} == root
    assert max(tried) <= 7 * len(root)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_pairs_get_the_values_of_both_ends(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    pairs = keep(spark.createDataFrame([(2, 1), (3, 1), (3, 2), (9, 1)], "a long, b long"), "pairs")
    values = spark.createDataFrame([(k, f"v{k}") for k in range(1, 6)], "h long, line string")
    got = sorted((r["a"], r["b"], r["x"], r["y"]) for r in common.join_both(pairs, values, "h", "line").collect())
    assert got == [(2, 1, "v2", "v1"), (3, 1, "v3", "v1"), (3, 2, "v3", "v2")]


def test_no_shuffle_files_are_left_by_operators_with_rounds(spark):
    def left():
        status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {status.apply(k).getName() for k in range(status.size()) if status.apply(k).getName().startswith("shuffle_")}

    near = words(7, 60)
    rows = spark.createDataFrame([(i, near + f" end{i}\n" + words(i)) for i in range(30)], "doc_id long, text string").repartition(3)
    rows = keep(rows, "rows")
    before = left()
    release = spark.conf.get(common._RELEASE, None)
    line_dedup._repeats(rows.select(F.col("doc_id").alias("id"), "text"))
    ngram_join.ngram_groups(rows)
    for _ in range(40):  # files go shortly after a query has ended
        if not left() - before:
            break
        time.sleep(0.25)
    assert not left() - before
    assert spark.conf.get(common._RELEASE, None) == release


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    from lexmill.llm import components

    kept = []
    monkeypatch.setattr(components, "keep", lambda df, name: kept.append(name) or keep(df, name))
    star = spark.createDataFrame([(i, i % 3) for i in range(3, 40)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(star).collect()} == {i: i % 3 for i in range(40)}
    assert kept == ["edges"]


def test_line_dedup_keeps_no_table_of_a_round_that_is_over(spark):
    near = words(7, 60)
    rows = spark.createDataFrame([(i, near + f" end{i}\n" + words(i)) for i in range(30)], "doc_id long, text string")
    made = []
    with common.collected(made):
        assert sum(r["n_dropped"] for r in line_dedup.fuzzy_line_dedup(rows).collect()) == 29
    left = [path.rsplit("/", 1)[-1] for _, path in made if any(Path(path.removeprefix("file:")).glob("part-*")) and spark.read.parquet(path).limit(1).count()]
    assert not {"members", "apart", "wide", "signed"} & set(left) and left.count("found") == 1


def test_ngram_lists_are_made_in_parts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "keep", lambda df, name: (made.append({r["s"] for r in df.collect()}) if name == "lists" else None) or keep(df, name))
    rows = spark.createDataFrame([(i, words(i // 2)) for i in range(20)] + [(99, words(0) + " one more end")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(rows).collect()}
    assert got == {i: i // 2 * 2 for i in range(20)} | {99: 0}
    assert len(made) > 1 and all(made) and not set.intersection(*made)


# --- packing: ids ---------------------------------------------------------------------------------------------


def test_tokenizer_keeps_frequent_words():
    tok = packing.WordTokenizer(queries.tokenizer_path(), cache_words=20)
    made, make = [], tok.cache.make
    tok.cache.make = lambda chunk: made.append(chunk) or make(chunk)
    texts = [f"often rare{chr(97 + i // 26)}{chr(97 + i % 26)} often, {i}." for i in range(300)]
    assert list(tok.ids_of(texts)) == [tok._whole(t) for t in texts]
    assert made.count("often") == made.count("often,") == 1 and len(made) > 600
    assert len(tok.cache) <= 20 and len(tok.cache.older) <= 20


def test_tasks_of_a_worker_share_the_tokenizer():
    assert packing._tokenizer(queries.tokenizer_path()) is packing._tokenizer(queries.tokenizer_path())


def test_word_tokenizer_equals_the_tokenizer():
    tok = packing.WordTokenizer(queries.tokenizer_path(), cache_words=50)
    letters = [chr(c) for c in range(9, 0x250) if chr(c).isprintable() or chr(c).isspace()]
    r = random.Random(1)
    texts = [f"ab{c}cd {c} {c}{c}X 1{c}2" for c in letters]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    texts += ["don't we'll I'VE 12345 x²", "a" * 200 + " " + "b" * 70, "<|endoftext|> x", "İstanbul ẞ \u212a \u2126", ""]
    whole = [np.asarray(tok.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    got = list(tok.ids_of(texts))
    assert [t for t, a, b in zip(texts, got, whole) if a != b] == []
    assert len(tok.cache) <= 50


def test_packing_slices_and_edges(spark):
    rows = [(None, "null id"), (1, "same id"), (1, "same id"), (2, None), (3, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, start int")
    got = packing.pack(df, queries.tokenizer_path(), with_ids=True).collect()
    tok = packing.WordTokenizer(queries.tokenizer_path()).tokenizer
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r["start"], list(r["ids"])) for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids))
        assert pieces and [x for _, p in pieces for x in p] == ids * (2 if i == 1 else 1)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    ends = {}
    for s, o, n in places:
        assert ends.get(s, 0) == o and o + n <= 4096
        ends[s] = o + n


# --- html: heads -----------------------------------------------------------------------------------------------


def test_html_head_without_an_end():
    def text(html):
        page = html_text.Page(html)
        return " ".join("".join(t for _, t, _, _ in page.pieces).split())

    assert text("<html><head><title>T</title><body><p>hello there</p>") == "hello there"
    assert text("<head><title>T</title><meta charset=x><p>one <b>two</b>") == "one two"
    assert text("<head><script>if (a<b) x()</script> words <p>more") == "words more"
    assert text("<head><title>T</title></head><body><![foo[x]]><p>after") == "after"
    deep = "<div>" * 900 + "bottom" + "</div>" * 900 + "<p>end"
    assert text(deep) == "bottomend" or text(deep) == "bottom end"


# --- n-gram join ---------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_groups(spark):
    base = words(5, 120).split()
    texts = [*EDGES, "ONE", "a b c d", "a  b\tc\nd", "A b c d e", "a b c d e f"]
    for k in range(12):  # a chain: each is near the next, the ends are not near each other
        base = base[:]
        base[k * 10] = f"changed{k}"
        texts.append(" ".join(base))
    texts += [f"{words(7, 30)} {words(20 + k, 10)}" for k in range(25)]  # a passage that many share without being near
    texts += [f"{words(6, 80)} tail{k}" for k in range(30)]  # a group of near copies
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(docs(spark, texts)).collect()}
    assert got == brute_groups(rows)
    assert ngram_join.ngram_groups(docs(spark, texts).limit(0)).count() == 0


def test_ngram_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, words(1)), (3, words(1)), (3, words(1)), (None, "zz yy")], "doc_id long, text string")
    got = ngram_join.ngram_groups(rows).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] > 1) == [(36, 3)] * 3
    assert [r["component_id"] for r in got if r["n_shingles"] == 1] == [None]


# --- licenses ------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    header = t["apache-2.0-header"].replace("except in compliance", "save in compliance").lower()
    texts = [f"é intro. {t['mit']} More.", None, "", f"x {header} y", "Released under the", "ALL RIGHTS\nreserved", f"{words(1)} {t['cc-by-nc-4.0']} {words(2)}", "z" * 70_000 + t["gpl-3.0"]]
    got = license_scan.scan_licenses(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(0, "mit"), (3, "apache-2.0-header"), (5, "all-rights-reserved"), (6, "cc-by-nc-4.0")} | {(7, "gpl-3.0")}
    spans = {r["doc_id"]: texts[r["doc_id"]][r["start_char"] : r["end_char"]] for r in got}
    assert spans[0] == "Released under the MIT License" and spans[5] == "ALL RIGHTS\nreserved"
    assert next(r["coverage"] for r in got if r["doc_id"] == 3) > 0.95
    assert license_scan.scan_licenses(docs(spark, texts).limit(0)).count() == 0


def test_license_scan_reports_adjacent_repeats(spark):
    t = license_scan.TEMPLATES
    texts = ["(c) 2001 A. All rights reserved. (c) 2002 B. All rights reserved.", "All rights reserved.\n" * 5, f"é {t['mit']} " * 4, f"{t['cc-by-sa-4.0']} {t['cc-by-nc-4.0']} " * 3, "Released under the MIT licence. " * 3, t["apache-2.0-header"] * 2]
    got = license_scan.scan_licenses(docs(spark, texts)).collect()
    spans = {k: [texts[k][r["start_char"] : r["end_char"]] for r in sorted(got, key=lambda r: r["start_char"]) if r["doc_id"] == k] for k in range(len(texts))}
    assert [len(spans[k]) for k in range(len(texts))] == [2, 5, 4, 6, 3, 2]
    assert set(spans[0] + spans[1]) == {"All rights reserved"} and set(spans[2]) == {"Released under the MIT License"} and set(spans[4]) == {"Released under the MIT"}


# --- toxicity ------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    insults = ["blorgface", "snivelwit", "grumblett"]
    texts, labels = [], []
    for k in range(160):
        clean = f"Some quiet sentence number w{k}a here. Another w{k}b of the same w{k % 7}c kind."
        toxic = k % 4 == 0
        texts.append(clean + (f" You {insults[k // 4 % 3]}!" if toxic else ""))
        labels.append((k, int(toxic), 1))
    texts += [None, "", "you blorg-face", "b l o r g f a c e", "x" * 40_000]
    model = toxicity.train_toxicity(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, texts), model).collect()}
    assert sum(got[k]["predicted"] == int(k % 4 == 0) for k in range(160)) >= 158
    assert got[162]["predicted"] == 1 and got[160]["predicted"] == got[161]["predicted"] == got[164]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = toxicity.fold_of(F.col("doc_id"))
    assert docs(spark, texts).filter(held == 0).count() == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(165))
    none = toxicity.train_toxicity(docs(spark, texts), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs(spark, texts), none).collect()} == {0}


def test_toxicity_is_learned_outside_the_driver(spark, monkeypatch):
    texts = [f"you {'vile grobnax' if i % 3 == 0 else 'kind friend'} number {i} came by" for i in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    used = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    here = toxicity.ToxicityModel().fit([t for _, t in used], [int(i % 3 == 0) for i, _ in used])

    def no_frame(*_):
        raise AssertionError("the sample came to the driver")

    monkeypatch.setattr(type(rows), "toPandas", no_frame)
    model = toxicity.train_toxicity(rows, labels)
    assert np.allclose(model.theta, here.theta, atol=1e-5) and np.isclose(model.bias, here.bias) and np.isclose(model.slope, here.slope)


def test_long_runs_of_letters_are_read_whole():
    for before in range(48, 64):
        text = " ".join("thisisanordinarysentencethatgoesonandonandonuntilitendsatlast"[:before] + "blorgface" + "moretext")
        assert any("b l o r g f a c e" in u for u in toxicity.units(text))
    assert toxicity.units("b l o r g") == ["b l o r g"]


def test_kernel_tolerates_gaps():
    k = toxicity._kernel(["idiot", "id-iot", "idxiot", "garden"], ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1, abs=1e-5) or k[0] > 0.9
    assert k[0] > k[1] > k[3] and k[0] > k[2] > k[3]


# --- decontamination -----------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "Alice has 12 apples and gives 5 apples to the boy Robert, so how many apples out of 12 does she keep after walking 3 km today?"
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    changed = item.replace("12", "17").replace("5", "4").replace("Robert", "Martin").replace("3 km", "9 miles")
    texts = ["Before. " + item + " After.", changed, changed.replace("17", "20", 1).replace("4", "7").replace("Martin", "Alan"), item[: len(item) // 3], None, "", "these two words.", words(1), item.replace("12", "12").replace("out of 12", "out of 99")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contaminated(docs(spark, texts), bench).collect()}
    assert {(0, 1), (1, 1), (6, 2)} <= set(got) and not any(d in (3, 4, 5, 7) for d, _ in got)
    assert got[(0, 1)]["kind"] == "verbatim" and got[(1, 1)]["kind"] == "reparameterised" and got[(1, 1)]["n_contradicted"] == 0
    assert decontaminate.find_contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.find_contaminated(docs(spark, texts).limit(0), bench).count() == 0


def test_toxicity_units_of_any_length_and_script(spark):
    assert toxicity.units("𝒷𝓁𝑜𝓇𝑔 ｂｌｏｒｇ ⓑⓛⓞⓡⓖ") == ["blorg"]
    assert set(toxicity.units("x" * 3 + "-" * 9 + "b-l-o-r-g" + "_" * 40 + "yy")) == {"xxx", "b-l-o-r-g", "yy"}
    part = "b-l-o-r-g-f-a-c-e"
    for before, after in itertools.product(range(0, 60, 7), repeat=2):
        assert any(part in u and len(u) <= toxicity.LONGEST for u in toxicity.units("q" * before + part + "q" * after))
    codes = [toxicity._code(c) for c in toxicity._KNOWN]
    assert len(set(codes)) == len(codes) and max(toxicity._code(chr(c)) for c in range(0x3000)) < toxicity._START
    assert toxicity._code("\u0640") == toxicity._code("-") == 0
    # letters beyond the basic plane are no gaps
    a, b = (toxicity._kernel([w], [w])[0, 0] for w in ("\U00010330\U00010331\U00010332", "abc"))
    assert abs(a - 1) < 1e-5 and abs(b - 1) < 1e-5


def test_toxicity_takes_odd_rows(spark):
    clean, toxic = "the garden was green and quiet", "you blorgface you"
    texts = [clean, toxic] * 40
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, 1), (7, None)], "doc_id long, toxic int")
    rows = docs(spark, [*texts, toxic, clean, toxic, "s" * 50_000 + " " + toxic, None], [*range(80), None, None, 1, 81, 82])
    model = toxicity.train_toxicity(rows, labels)
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score_toxicity(rows, model).collect()]
    assert got[80:] == [(None, 1), (None, 0), (1, 1), (81, 1), (82, 0)]
    assert [p for _, p in got[:80]] == [0, 1] * 40


def test_windows_are_hashed_by_doubling(spark):
    text = "one two three four. Five six seven eight nine. Ten eleven twelve " + " ".join(f"w{k}" for k in "abcdefgh")
    rows = decontaminate._hashed(spark.createDataFrame([(1, text), (2, "eleven twelve"), (3, " "), (4, None), (5, "x " + text)], "id long, text string"))
    windows = decontaminate._windowed(rows, [3, 8])
    got = [(r["id"], r["x"]["size"], r["x"]["at"], r["x"]["w"]) for r in windows.collect()]
    places = {size: sorted(at for i, s, at, _ in got if (i, s) == (1, size)) for size in (3, 8)}
    # each start once, and once more where the window holds a word that may be a name: Five, the fifth word, or Ten, the tenth
    assert places == {3: sorted([*range(18), 2, 3, 4, 7, 8, 9]), 8: sorted([*range(13), *range(10)])}
    assert {(s, at + 1, w) for i, s, at, w in got if i == 1} <= {(s, at, w) for i, s, at, w in got if i == 5}
    assert not {i for i, *_ in got} & {2, 3, 4}
    plan = decontaminate._windowed(rows, [8])._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert len(re.findall(r"(?:hashes|others)\d*#\d+\[", generate)) == 2  # looked up once for each of the two, not for each word


def test_decontamination_of_rows_without_id(spark):
    item = "A farmer named Jones has 24 cows and 310 sheep in 5 wide green fields near the old stone mill"
    changed = "A farmer named Smith has 81 cows and 977 sheep in 9 wide green fields near the old stone mill"
    other = "A farmer named Jones has 24 cows and " + words(4)
    texts = [item, changed, changed, other, None, words(6)]
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    columns = ("item_id", "n_windows", "n_matched", "n_slots", "n_contradicted", "kind")
    with_ids = {r["doc_id"]: tuple(r[c] for c in columns) for r in decontaminate.find_contaminated(docs(spark, texts), bench).collect()}
    without = [(r["doc_id"], *(r[c] for c in columns)) for r in decontaminate.find_contaminated(docs(spark, texts, [None] * len(texts)), bench).collect()]
    assert set(with_ids) == {0, 1, 2} and with_ids[1][-1] == "reparameterised"
    # each text by itself, for each of the two items; equal texts are one
    assert sorted(without) == sorted((None, *with_ids[k]) for k in (0, 1) for _ in range(2))


def test_decontamination_judges_each_occurrence(spark):
    item = "Alice has 12 apples and gives 5 apples to the boy Robert, so how many apples out of 12 does she keep after walking 3 km today?"
    series = "Find the next number in the series 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37 please."
    bench = spark.createDataFrame([(1, item), (2, series)], "item_id long, text string")
    once = item.replace("12", "17").replace("5", "4").replace("Robert", "Martin").replace("3 km", "9 miles")
    again = item.replace("12", "21").replace("5", "8").replace("Robert", "Edgar").replace("3 km", "7 miles")
    unlike = item.replace("12", "17", 1).replace("5", "4").replace("out of 12", "out of 99")
    texts = [f"{once} {again}", f"{item} {once}", f"{once} {again} {item}", series, f"Before. {series} After.", series + " " + series, "Numbers: " + ", ".join(map(str, range(40, 90)))]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_contaminated(docs(spark, [*texts, unlike]), bench).collect()}
    assert {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)} <= set(got) and not any(d == 6 for d, _ in got)
    assert got[(0, 1)] == "reparameterised" and got[(3, 2)] == got[(4, 2)] == "verbatim"


def test_decontamination_takes_names_at_sentence_starts(spark):
    item = "Anna has 12 red apples. Tom gives her 5 apples. Mary takes 3 of them. How many apples does Anna have now?"
    changed = "Berta has 17 red apples. Karl gives her 6 apples. Elsa takes 4 of them. How many apples does Berta have now?"
    other = "Berta has 17 green chairs. Karl sold her 6 tables. Elsa broke 4 of them. How many lamps did Berta buy then?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contaminated(docs(spark, [item, changed, f"So: {changed} Good.", other]), bench).collect()}
    assert set(got) == {0, 1, 2} and got[0]["kind"] == "verbatim" and got[1]["kind"] == "reparameterised"
    assert got[0]["n_windows"] == got[0]["n_matched"] == 15 and got[1]["coverage"] == 1


# --- packing -------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = [*EDGES, "It's <|endoftext|> we'll 12³ ½", "\x1cfoo\x85bar", "日本語 テスト", "naïve İstanbul ''s"] + [words(k, 30 + k) for k in range(60)]
    got = packing.pack(docs(spark, texts), path, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids and own[0]["doc_tokens"] == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for r in own)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(docs(spark, texts).limit(0), path).count() == 0


def test_pack_histogram_is_complete_and_tight():
    r = np.random.default_rng(1)
    lengths = np.minimum(4096, r.lognormal(6, 1, 20_000).astype(int) + 1)
    histogram = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
    patterns = packing.pack_histogram(histogram)
    back = {}
    for p, n in patterns:
        assert sum(p) <= 4096
        for k in p:
            back[k] = back.get(k, 0) + n
    assert back == histogram
    assert sum(packing.padding([sum(p)]) * n for p, n in patterns) < 0.005 * lengths.sum()
    sequence, offset = packing.Placement(patterns).find(lengths, np.zeros(len(lengths), dtype=np.int64))
    assert len(sequence) == len(lengths)


# --- what the last changes mend ------------------------------------------------------------------------------


def test_words_without_one_in_common_are_not_linked(spark):
    """Words made so that sums of their bytes by any odd base are equal modulo 2^64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(f"{'x' * (k % 2)}{word}{k}" for k in range(20)) for word in (one, other)]
    assert not set(texts[0].split()) & set(texts[1].split())
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(docs(spark, texts + texts[:1])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_word_hashes_are_of_the_word_alone():
    from lexmill.llm.common import LONG_WORD, word_hashes

    words_ = [b"a" * n for n in (1, 7, 8, 9, 16, 17, LONG_WORD, LONG_WORD + 1)] + [b"\0", b"\0\0", b"abcdefgh", b"abcdefgi", b"bacdefgh"]

    def hashes(rows):
        ends = np.cumsum([len(w) + 1 for w in rows]) - 1
        return word_hashes(np.frombuffer(b" ".join(rows), dtype=np.uint8), ends - [len(w) for w in rows], ends).tolist()

    found = hashes(words_)
    assert len(set(found)) == len(words_)
    assert hashes(words_[::-1]) == found[::-1] and hashes([b"other", *words_])[1:] == found
    assert hashes([]) == []


def page_text(html):
    return " ".join(t.strip() for _, t, _, _ in html_text.Page(html).pieces if t.strip())


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body><p>first</p><svg viewBox="0 0 1 1"/><p>second</p><div>third</div></body>', "first second third"),
        ("<p>first</p><math/><svg><path/><style/><title>t</title></svg><p>second</p>", "first second"),
        ("<p>a &#" + "1" * 5000 + "; b</p><p>c &#000000065; d</p>", "a � b c A d"),
        ("<p>first</p><![foo[x]]><p>second &#99999999999;</p>", "first second �"),
    ],
)
def test_nothing_after_odd_markup_is_lost(html, text):
    assert page_text(html) == text


def test_pages_of_articles_give_the_articles(spark):
    """Pages that are written around texts of ``documents``, which the model hasn't seen, give these texts."""
    articles = [" ".join(r["text"].split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) BETWEEN 300 AND 4000 AND text NOT LIKE '%<%' AND text NOT LIKE '%&%'").orderBy("doc_id").limit(40).collect()]
    shell = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><p>{}</p></article><div class='comments'><p>nice</p></div><footer><p>Copyright <a href='/c'>us</a></p></footer></body></html>"
    model = html_text.train_extractor(html_text.made_pages())
    pages = spark.createDataFrame([(k, "u", shell.format(a)) for k, a in enumerate(articles)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, model).collect()}
    assert sum(got[k] == a for k, a in enumerate(articles)) >= 0.9 * len(articles)
