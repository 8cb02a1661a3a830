"""Article files, idempotent index writes, and the state that makes a second run cheap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = T.StructType([T.StructField("content", T.StringType()), T.StructField("polygon", T.ArrayType(T.DoubleType()))])
_WORD = T.StructType([*_LINE.fields, T.StructField("confidence", T.DoubleType())])
_PAGE = T.StructType(
    [
        T.StructField("pageNumber", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("unit", T.StringType()),
        T.StructField("angle", T.DoubleType()), T.StructField("words", T.ArrayType(_WORD)), T.StructField("lines", T.ArrayType(_LINE)),
    ]
)
ARTICLE = T.StructType([T.StructField("content", T.StringType()), T.StructField("pages", T.ArrayType(_PAGE))])
LEAST_CHARS = 100
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:/*"


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, content, pages of all ``X/X.json`` below root, ordered by nothing. The layout is that of the first folder (by name): flat, with
    ``X/X.json`` in it, or else nested, ``group/X/X.json``; files at another depth, in hidden folders or named otherwise are passed over."""
    rows = spark.read.schema(ARTICLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    parts, above = F.split(F.regexp_replace("path", _SCHEME, "/"), "/"), len(re.sub(_SCHEME, "/", root.rstrip("/")).split("/"))
    name, folder, top = F.regexp_replace(F.element_at(parts, -1), r"\.json$", ""), F.element_at(parts, -2), F.get(parts, F.lit(above))
    rows = rows.withColumn("depth", F.size(parts) - above).withColumn("top", top)
    rows = rows.filter((name == folder) & ~F.col("path").contains("Zone.Identifier") & ~F.col("top").startswith(".") & F.col("depth").isin(2, 3))
    first = rows.agg(F.min(F.struct("top", "depth")).alias("first")).select(F.col("first.depth").alias("depth"))
    rows = rows.join(F.broadcast(first), "depth", "left_semi")  # one row
    return rows.select(name.alias("doc_id"), "path", F.coalesce("content", F.lit("")).alias("content"), "pages")


def accepted(articles: DataFrame, text_col: str = "content") -> DataFrame:
    return articles.filter(F.length(_stripped(text_col)) >= LEAST_CHARS)


def rejected(articles: DataFrame, text_col: str = "content") -> DataFrame:
    return articles.filter(F.coalesce(F.length(_stripped(text_col)) < LEAST_CHARS, F.lit(True)))


def _stripped(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def path_metadata(doc_id: Column | str) -> Column:
    """journal_id, volume, issue, article_num of an id of four parts; null for others."""
    parts = F.split(doc_id, "-")
    return F.when(F.size(parts) == 4, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("journal_id", "volume", "issue", "article_num"))]))


def valid_doc_id(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.length(c) <= 64) & c.rlike(r"\A[0-9]{4}-[0-9]{3}-[0-9]{3}-[0-9]{3}\z"), F.lit(False))


def page_words(articles: DataFrame, dpi: float = 200.0) -> DataFrame:
    """One row a word: page, running word index over the document, bounding box in pixels."""
    pages = articles.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.pageNumber").alias("page"), F.coalesce("p.words", F.array().cast(T.ArrayType(_WORD))).alias("words"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("offset", F.coalesce(F.sum(F.size("words")).over(w), F.lit(0)))
    rows = pages.select("doc_id", "page", "offset", F.posexplode("words").alias("i", "word"))
    xs = F.filter("word.polygon", lambda v, i: i % 2 == 0)
    ys = F.filter("word.polygon", lambda v, i: i % 2 == 1)
    box = [(F.array_min(xs), "left"), (F.array_min(ys), "top"), (F.array_max(xs), "right"), (F.array_max(ys), "bottom")]
    return rows.select("doc_id", "page", (F.col("offset") + F.col("i")).alias("word_index"), F.col("word.content").alias("content"), *[(c * dpi).alias(n) for c, n in box])


def highlight_regions(words: DataFrame, pad: float = 3.0) -> DataFrame:
    """Boxes around runs of matched words on one line, from words (doc_id, page, word_index, left, top, right, bottom, matched).

    A matched word joins the box so far if its middle is within half of that box's height from the box's middle; another word ends the box, one without an
    area is passed over. The box grows with each word, so this is a fold over a page's words, an array as long as the page.
    """
    rows = words.filter((F.col("right") - F.col("left") >= 1) & (F.col("bottom") - F.col("top") >= 1))
    row = F.struct("word_index", "left", "top", "right", "bottom", "matched")
    return regions_of(rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("w")), pad)


def matched_pages(articles: DataFrame, dpi: float = 200.0) -> DataFrame:
    """doc_id, page, w: the words with an area, in order, of each page that has one of its document's matched words (doc_id, pages, hits: array of word indices).

    What page_words() and highlight_regions() come to for documents of one row each, within the row: no word goes through a shuffle.
    """
    sizes = F.transform("pages", lambda p: F.named_struct(F.lit("page"), p["pageNumber"], F.lit("n"), F.size(p["words"])))
    rows = articles.select("doc_id", "hits", sizes.alias("sizes"), F.explode("pages").alias("p"))
    before = F.aggregate(F.filter("sizes", lambda s: s["page"] < F.col("p.pageNumber")), F.lit(0), lambda a, s: a + F.greatest(s["n"], F.lit(0)))
    rows = rows.select("doc_id", "hits", F.col("p.pageNumber").alias("page"), F.col("p.words").alias("words"), before.alias("offset"))
    own = F.filter("hits", lambda i: (i >= F.col("offset")) & (i < F.col("offset") + F.size("words")))
    # generated, so that the optimizer doesn't put it into the lambda, once a word
    rows = rows.select("doc_id", "page", "words", "offset", F.explode(F.array(own)).alias("own")).filter("size(own) > 0")

    def boxed(word: Column, i: Column) -> Column:
        xs, ys = F.filter(word["polygon"], lambda v, k: k % 2 == 0), F.filter(word["polygon"], lambda v, k: k % 2 == 1)
        sides = [(F.array_min(xs), "left"), (F.array_min(ys), "top"), (F.array_max(xs), "right"), (F.array_max(ys), "bottom")]
        at = F.col("offset") + i
        return F.named_struct(F.lit("word_index"), at, *[x for c, n in sides for x in (F.lit(n), c * dpi)], F.lit("matched"), F.array_contains("own", at))

    w = F.filter(F.transform("words", boxed), lambda b: (b["right"] - b["left"] >= 1) & (b["bottom"] - b["top"] >= 1))
    return rows.select("doc_id", "page", w.alias("w"))


def regions_of(pages: DataFrame, pad: float = 3.0) -> DataFrame:
    """The boxes of highlight_regions() from pages (doc_id, page, w: words in order)."""
    box = "struct<left: double, top: double, right: double, bottom: double, n_words: int>"
    start = F.struct(F.array().cast(f"array<{box}>").alias("done"), F.lit(None).cast(box).alias("now"))

    def one(w: Column) -> Column:
        return F.struct(w["left"].cast("double").alias("left"), w["top"].cast("double").alias("top"), w["right"].cast("double").alias("right"), w["bottom"].cast("double").alias("bottom"), F.lit(1).alias("n_words"))

    def closed(s: Column) -> Column:
        return F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"]))

    def step(s: Column, w: Column) -> Column:
        b = s["now"]
        near = F.abs((w["top"] + w["bottom"]) / 2 - (b["top"] + b["bottom"]) / 2) < (b["bottom"] - b["top"]) * 0.5
        grown = F.struct(F.least(b["left"], w["left"]).alias("left"), F.least(b["top"], w["top"]).alias("top"), F.greatest(b["right"], w["right"]).alias("right"), F.greatest(b["bottom"], w["bottom"]).alias("bottom"), (b["n_words"] + 1).alias("n_words"))
        joined = F.struct(s["done"].alias("done"), grown.cast(box).alias("now"))
        new = F.struct(closed(s).alias("done"), one(w).cast(box).alias("now"))
        ended = F.struct(closed(s).alias("done"), F.lit(None).cast(box).alias("now"))
        return F.when(~w["matched"], ended).when(b.isNotNull() & near, joined).otherwise(new)

    found = pages.select("doc_id", "page", F.posexplode(F.aggregate("w", start, step, closed)).alias("region", "b"))
    return found.select("doc_id", "page", "region", (F.col("b.left") - pad).alias("left"), (F.col("b.top") - pad).alias("top"), (F.col("b.right") + pad).alias("right"), (F.col("b.bottom") + pad).alias("bottom"), "b.n_words")


def pages_to_show(pages: DataFrame, words: DataFrame, matches: DataFrame) -> DataFrame:
    """The pages (doc_id, page) with a matched word (doc_id, word_index), or all pages of documents without a match."""
    hit = words.join(matches.select("doc_id", "word_index").distinct(), ["doc_id", "word_index"], "left_semi").select("doc_id", "page").distinct()
    some = matches.select("doc_id").distinct()
    return pages.join(hit, ["doc_id", "page"], "left_semi").unionByName(pages.join(some, "doc_id", "left_anti"))


def matched_words(*found: DataFrame) -> DataFrame:
    """The union of matches (doc_id, word_index), each once."""
    out = found[0].select("doc_id", "word_index")
    for f in found[1:]:
        out = out.unionByName(f.select("doc_id", "word_index"))
    return out.distinct()


def page_lines(articles: DataFrame, dpi: float = 200.0) -> DataFrame:
    """doc_id, page, content, left, top of the lines of each page that have an area, numbered from top to bottom."""
    rows = articles.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.pageNumber").alias("page"), F.posexplode("p.lines").alias("i", "line")).filter("size(line.polygon) >= 8")
    corners = F.slice("line.polygon", 1, 8)
    xs, ys = F.filter(corners, lambda v, i: i % 2 == 0), F.filter(corners, lambda v, i: i % 2 == 1)
    box = {"left": F.array_min(xs), "top": F.array_min(ys), "right": F.array_max(xs), "bottom": F.array_max(ys)}
    rows = rows.select("doc_id", "page", "i", F.col("line.content").alias("content"), *[(c * dpi).alias(n) for n, c in box.items()])
    rows = rows.filter("right - left >= 1 AND bottom - top >= 1")
    order = Window.partitionBy("doc_id", "page").orderBy("top", "i")
    return rows.withColumn("line_no", F.row_number().over(order)).drop("i")


def page_layout(articles: DataFrame, raster: DataFrame | None = None) -> DataFrame:
    """doc_id, page, width, height, unit (inch), angle (0), raster_width and raster_height (from (doc_id, page, width_pt, height_pt) at 200 dots an inch; 0 without), words, lines."""
    rows = articles.select("doc_id", F.explode("pages").alias("p"))
    rows = rows.select(
        "doc_id", F.coalesce("p.pageNumber", F.lit(0)).alias("page"), "p.width", "p.height", F.coalesce("p.unit", F.lit("inch")).alias("unit"), F.coalesce("p.angle", F.lit(0.0)).alias("angle"),
        F.coalesce("p.words", F.array().cast(T.ArrayType(_WORD))).alias("words"), F.coalesce("p.lines", F.array().cast(T.ArrayType(_LINE))).alias("lines"),
    )
    if raster is None:
        return rows.withColumn("raster_width", F.lit(0)).withColumn("raster_height", F.lit(0))
    size = raster.select("doc_id", "page", *[F.bround(F.col(f"{k}_pt") * 200 / 72).cast("int").alias(f"raster_{k}") for k in ("width", "height")])
    return rows.join(size, ["doc_id", "page"], "left").fillna(0, ["raster_width", "raster_height"])


def read_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, sha1 and etag (MD5 of the first 1024 bytes) of files, with their content; the hashes leave a scan's other columns unread. Empty files are passed over, as Spark's scans do."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", "length", F.sha1("content").alias("sha1"), F.md5(F.substring("content", 1, 1024)).alias("etag"), "content")


def locate(requested: DataFrame, *places: DataFrame) -> DataFrame:
    """For each requested doc_id its row (doc_id, path, content) in the first of several sets of articles that has it; null where none has."""
    found = places[0].withColumn("place", F.lit(0))
    for k, p in enumerate(places[1:], 1):
        found = found.unionByName(p.withColumn("place", F.lit(k)))
    best = found.groupBy("doc_id").agg(F.min(F.struct("place", "path", "content")).alias("b"))
    return requested.join(best, "doc_id", "left").select("doc_id", "b.place", "b.path", "b.content")


def unseen_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, sha1) that aren't in the state by path and content."""
    return files.join(state, ["path", "sha1"], "left_anti")


def unseen_paragraphs(chunks: DataFrame, state: DataFrame | None, order: str = "chunk_id") -> DataFrame:
    """Chunks whose first 1024 characters neither the state nor an earlier chunk has; adds phash."""
    rows = chunks.withColumn("phash", F.md5(F.substring("text", 1, 1024).cast("binary")))
    if state is not None:
        rows = rows.join(state.select("phash"), "phash", "left_anti")
    kind = dict(rows.dtypes)[order]
    # by the number in an id first, as chunk 1000 comes after chunk 999
    place = F.struct(F.regexp_replace(order, "[0-9]+$", "").alias("head"), F.regexp_extract(order, "([0-9]+)$", 1).try_cast("long").alias("number"), F.col(order).alias("name")) if kind == "string" else F.struct(F.col(order).alias("name"))
    first = rows.groupBy("phash").agg(F.min(place).alias("first")).select("phash", F.col("first.name").alias(order))
    return rows.join(first, ["phash", order], "left_semi").dropDuplicates(["phash"])


def upsert(index: DataFrame | None, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The index with new rows in place of those with the same key, one of each key; writing the result twice changes nothing."""
    new = new.dropDuplicates([key])
    if index is None:
        return new
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def point_id(chunk_id: Column | str) -> Column:
    return F.md5(F.col(chunk_id).cast("binary") if isinstance(chunk_id, str) else chunk_id.cast("binary"))


def write_index(chunks: DataFrame, path: str, previous: str | None = None) -> None:
    """Write chunks by point id to a new version of the index; the previous version stays until the caller drops it."""
    new = chunks.withColumn("point_id", point_id("chunk_id"))
    old = chunks.sparkSession.read.parquet(previous) if previous else None
    upsert(old, new).write.mode("overwrite").parquet(path)
