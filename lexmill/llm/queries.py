"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, exact_dedup, html_text, license_scan, line_dedup, merkle, ngram_join, packing, secret_scan, toxicity, url_filter, vector_codes, warc
from lexmill.llm.common import table

# The rules of op10.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train_urls(url_filter.label_by_words(pages))
    return url_filter.judge_urls(pages, model, URL_RULES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (toxicity.fold_of(scored["doc_id"]) == toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_line_dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_text.train_extractor([*html_text.sample_articles(pages, table(spark, sf_dir, "documents")), *html_text.made_pages()])
    return html_text.extract_text(pages, model)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def leaf(text: Column) -> Column:
        return merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(lower))
    proofs = merkle.manifest(docs, "doc_id", "source", leaf(F.col("text")), {"tampered": tampered})
    folded = merkle.fold_up(F.coalesce("tampered", "leaf"), F.col("way"))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("way")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebooks_digest(made.codebooks))
    return made.vectors.select("vec_id", vector_codes.code_string(F.col("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in secret_scan.LEAST]
    base = secret_scan.span_list(of(list(secret_scan.LEAST)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.span_list(F.col("spans")).alias("spans"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_url_filter says that SQL can say as well: host, path and rule."""
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


URL_RULES_SQL = r"""
WITH r AS (SELECT *, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM (VALUES ('com/en/'), ('example.com/en/7'), ('net/de/'), ('example.net/de/8'), ('org/es/')) v(rule)),
     p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule FROM p
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM last_id THEN NULL ELSE last_id END AS refers_to
FROM w
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


OP11_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, *, CASE WHEN text IS NULL THEN NULL ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low FROM documents),
f AS (
  SELECT r, doc_id, source, text IS DISTINCT FROM low AS differs,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
                CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head,
         CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS own, CASE WHEN low IS NULL THEN '-' ELSE concat(strlen(low), ':', low) END AS low,
         list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda acc, c:
           list_reduce(list_concat([xor(acc, c)], list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc FROM d),
l AS (
  SELECT r, doc_id, concat(CASE WHEN source IS NULL THEN '' ELSE ':' END, coalesce(source, '')) AS g, sha256(head || own) AS leaf,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(head || low) ELSE sha256(head || own) END AS shown FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (
  SELECT 0 AS level, g, i, leaf AS h, n FROM p
  UNION ALL SELECT level + 1, g, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY level, g, i // 16, n),
s AS (SELECT g, h AS subroot, level AS depth, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, i, subroot AS h, n FROM s
  UNION ALL SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, i // 16, n),
-- all levels on one scale: a leaf's way goes through its group's tree, then through the tree of the groups
node AS (
  SELECT t.g, t.level AS lv, t.i, t.h, t.n FROM t WHERE t.n > 1
  UNION ALL SELECT s.g, s.depth + u.level, u.i, u.h, u.n FROM s, u WHERE u.n > 1),
way AS (
  SELECT p.r, x.lv, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < w), '') AS lft, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > w), '') AS rgt
  FROM (SELECT p.r, p.g, k.lv, CASE WHEN k.lv < s.depth THEN p.i // (16 ** k.lv)::BIGINT ELSE s.i // (16 ** (k.lv - s.depth))::BIGINT END AS w
        FROM p JOIN s ON s.g = p.g JOIN (SELECT DISTINCT g, lv FROM node) k ON k.g = p.g) p
  JOIN node x ON x.g = p.g AND x.lv = p.lv AND x.i // 16 = w // 16 GROUP BY p.r, x.lv),
fold AS (
  SELECT r, 0 AS lv, shown AS h FROM p
  UNION ALL SELECT fold.r, fold.lv + 1, sha256(way.lft || fold.h || way.rgt) FROM fold JOIN way ON way.r = fold.r AND way.lv = fold.lv),
proof AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY lv)) AS proof FROM way GROUP BY r),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(proof.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM p JOIN s ON s.g = p.g CROSS JOIN root LEFT JOIN proof ON proof.r = p.r JOIN (SELECT r, arg_max(h, lv) AS h FROM fold GROUP BY r) f ON f.r = p.r
"""


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain Lloyd rounds over all parts, a pair of tables each."""
    steps = [
        f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM v),
x AS (SELECT r, pos, v[pos * len(v) // {parts} + 1:(pos + 1) * len(v) // {parts}] AS part FROM r, range({parts}) t(pos)),
c0 AS (SELECT pos, r AS entry, part AS e FROM x WHERE r < {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""
a{k} AS (SELECT r, pos, any_value(part) AS part, min(d) AS error, arg_min(entry, (d, entry)) AS entry FROM (
  SELECT r, x.pos, part, entry, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - e[i]) * (part[i] - e[i])))::BIGINT AS d FROM x JOIN c{k} c ON c.pos = x.pos) GROUP BY r, pos)"""
        )
        if k < rounds:
            steps.append(
                f"""
m{k} AS (SELECT pos, entry, list(floor(s / n)::BIGINT ORDER BY i) AS e FROM (SELECT pos, entry, i, sum(part[i]) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(part) + 1)) t(i) GROUP BY pos, entry, i) GROUP BY pos, entry),
c{k + 1} AS (SELECT c.pos, c.entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m ON m.pos = c.pos AND m.entry = c.entry)"""
            )
    return f"""
WITH {",".join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY pos, entry)) AS h FROM c{rounds}),
o AS (SELECT r, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT r.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY r.label))::BIGINT AS label_error, b.h AS codebooks_sha256 FROM r JOIN o ON o.r = r.r CROSS JOIN b
"""


OP12_SQL = _op12_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_warc, op2_html_text, op3_line_dedup, op4_ngram_join, op5_license_scan, op6_toxicity, op7_decontamination, op8_packing, op9_exact_dedup, op10_url_filter, op11_merkle_manifest, op12_vector_codes, op13_secret_scan, url_rules]
    return {fn.__name__: fn for fn in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_ngram_join": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_vector_codes": OP12_SQL, "url_rules": URL_RULES_SQL}
