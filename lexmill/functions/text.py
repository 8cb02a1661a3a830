"""Column functions on text. Each has a twin in lexmill.plans.sql for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import patterns as P


def strip(c: Column | str) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, f"^[{P.SPACE}]+|[{P.SPACE}]+$", "")


def normalize_arabic(c: Column | str) -> Column:
    """Without diacritics, with unified letter forms."""
    return F.translate(F.regexp_replace(c, P.DIACRITICS, ""), P.LETTERS_FROM, P.LETTERS_TO)



def token_runs(c: Column | str) -> Column:
    """Runs of letters and digits of a normalised text, as they are."""
    return F.regexp_extract_all(normalize_arabic(c), F.lit(P.TOKEN), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Index tokens: lower-cased runs of letters and digits without stop words; the list is compared after normalisation."""
    return F.filter(F.transform(token_runs(c), lambda t: F.lower(t)), lambda t: ~t.isin(P.STOP_WORDS))


def normalize_search(c: Column | str) -> Column:
    """Tokens of the re-ranker as one string."""
    return F.array_join(F.regexp_extract_all(F.lower(normalize_arabic(c)), F.lit(P.TOKEN), F.lit(0)), " ")


def search_tokens(c: Column | str) -> Column:
    """Tokens of the re-ranker: as tokens(), without single characters."""
    found = F.regexp_extract_all(F.lower(normalize_arabic(c)), F.lit(P.TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(P.STOP_WORDS))


def normalize_citation(c: Column | str, gap: str = " ") -> Column:
    """Text for grounding: no tashkeel, marks replaced by ``gap``, single spaces, lower case."""
    bare = F.regexp_replace(F.regexp_replace(c, P.TASHKEEL, ""), P.MARKS, gap)
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def normalize_word(c: Column | str) -> Column:
    """A word for alignment: no tashkeel, no marks, lower case; empty for a word of marks."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, P.TASHKEEL, ""), P.MARKS, "")))


def bucket(token: Column | str) -> Column:
    """Hash bucket of a token."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(token).cast("binary") if isinstance(token, str) else token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(P.BUCKETS))


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbouring tokens."""
    n = F.size(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    )


def coverage(query: Column, source: Column) -> Column:
    """Share of the distinct query terms that the source has; 0 if either is empty."""
    q = F.array_distinct(query)
    return F.when((F.size(q) == 0) | (F.size(source) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, source)) / F.size(q))


def cut_at_space(c: Column | str, size: int, least: int, mark: str = "…") -> Column:
    """At most ``size`` characters, cut at the last space if that is beyond ``least``, with a mark."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.substring(c, 1, size)
    space = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", head) > 0) & (space - 1 > least), F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(cut, F.lit(mark)))


def section_bucket(section: Column | str) -> Column:
    s = F.lower(F.translate(strip(F.coalesce(section, F.lit(""))), "_", " "))
    out = None
    for name, terms in P.SECTION_BUCKETS:
        hit = F.lit(False)
        for t in terms:
            hit = hit | s.contains(t)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def sentences(c: Column | str) -> Column:
    """Split after a terminator and white space; the terminator stays."""
    return F.filter(F.split(c, f"(?<=[.!?؟。])[{P.SPACE}]+"), lambda s: s != "")


def chunk_id(doc: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_chunk_%03d", F.col(doc).cast("string") if isinstance(doc, str) else doc.cast("string"), index)


def text_direction(c: Column | str) -> Column:
    """rtl or ltr by the first strong character; rtl without one."""
    first = F.regexp_extract(c, f"[A-Za-z{P.RIGHT_TO_LEFT}]", 0)
    return F.when(first.rlike("^[A-Za-z]"), "ltr").otherwise("rtl")
