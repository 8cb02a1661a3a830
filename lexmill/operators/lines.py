"""Lines of documents: classes, running section, reference tail, offsets, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import strip


#: P.DIGIT for Java: all of them are numbers, which one look at a character's category tells, so few characters meet the long list.
HAS_DIGIT = rf"[\p{{N}}&&[{P.DIGIT}]]"


def _is(c: Column, pattern: str) -> Column:
    return c.rlike("(?iu)" + pattern)


def split_lines(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, line_no, line (stripped), raw_chars (of the line as it stands) of every line; no shuffle."""
    rows = docs.select("doc_id", *carry, F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.withColumn("line", strip("raw")).withColumn("raw_chars", F.length("raw")).drop("raw")


def is_boilerplate(line: Column) -> Column:
    return (F.length(line) < 5) | _is(line, P.BOILERPLATE)


def is_section_header(line: Column) -> Column:
    return _is(line, P.SECTION_HEADER) | ((F.length(line) < 60) & line.rlike(P.HEADING_LIKE))


def line_class(line: Column) -> Column:
    """What a line is by itself; the order of tests matters."""
    return (
        F.when(line == "", "blank")
        .when(line.rlike(P.PAGE_NUMBER), "page_number")
        .when(_is(line, P.REFERENCE_HEADER), "reference_header")
        .when(is_boilerplate(line), "boilerplate")
        .when(is_section_header(line), "section_header")
        .otherwise("text")
    )


def classify(docs: DataFrame, *carry: str) -> DataFrame:
    """Adds class, whether the line is in the reference tail, the running section, and the running character offset.

    Windows run within a document, so a task holds one document's lines at most.
    """
    rows = split_lines(docs, *carry).withColumn("class", line_class(F.col("line")))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_references", F.max((F.col("class") == "reference_header").cast("int")).over(so_far) == 1)
    label = F.when((F.col("class") == "section_header") & ~F.col("in_references"), F.regexp_replace("line", r"[:\s]+$", ""))
    return rows.withColumn("section", F.coalesce(F.last(label, ignorenulls=True).over(so_far), F.lit(""))).withColumn(
        "char_offset", F.coalesce(F.sum(F.col("raw_chars") + 1).over(before), F.lit(0))
    )


def kept_lines(docs: DataFrame, *carry: str) -> DataFrame:
    """The text of the article: what is neither header, boilerplate nor reference."""
    return classify(docs, *carry).filter("class = 'text' AND NOT in_references")


def _title_score(line: Column, at: Column) -> Column:
    n = F.length(line)
    return (
        F.when(at < 5, 1.2).otherwise(0.0)
        + F.when(n.between(20, 140), 1.4).when(n.between(12, 180), 0.8).otherwise(0.0)
        + F.when(F.size(F.split(line, f"[{P.SPACE}]+")).between(4, 18), 0.6).otherwise(0.0)
        - F.when(line.rlike("[.:؛،]$"), 0.4).otherwise(0.0)
        - F.when(line.rlike(HAS_DIGIT), 0.25).otherwise(0.0)
    )


def title(text: Column | str) -> Column:
    """The best of the first 20 lines, the earliest of equals; empty without a candidate. One expression on the row: no shuffle."""
    first = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: strip(x))
    rows = F.transform(first, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    fit = F.filter(rows, lambda r: (F.length(r["line"]) >= 10) & line_class(r["line"]).isin("text", "reference_header") & ~_is(r["line"], P.AUTHOR_LINE))
    best = F.array_max(F.transform(fit, lambda r: F.struct(F.round(_title_score(r["line"], r["at"]), 4).alias("score"), (-r["at"]).alias("order"), r["line"].alias("line"))))
    return F.coalesce(best["line"], F.lit(""))


def titles(docs: DataFrame) -> DataFrame:
    """doc_id and title."""
    return docs.select("doc_id", title("text").alias("title"))
