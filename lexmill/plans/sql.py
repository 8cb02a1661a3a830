"""DuckDB SQL fragments for the oracles."""

from __future__ import annotations

from lexmill.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(lit(w) for w in P.STOP_WORDS) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{P.SPACE}]+|[{P.SPACE}]+$')}, '', 'g')"


def norm(x: str) -> str:
    return f"translate(regexp_replace({x}, {lit(P.DIACRITICS)}, '', 'g'), {lit(P.LETTERS_FROM)}, {lit(P.LETTERS_TO)})"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({norm(x)}, {lit(P.TOKEN)}), lambda t: lower(t)), lambda t: NOT list_contains({STOP}, t))"


def normalize_search(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({norm(x)}), {lit(P.TOKEN)}), ' ')"


def search_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({norm(x)}), {lit(P.TOKEN)}), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def normalize_citation(x: str, gap: str = " ") -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, {lit(P.TASHKEEL)}, '', 'g'), {lit(P.MARKS)}, {lit(gap)}, 'g')), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w != ''), lambda w: trim(lower(regexp_replace(regexp_replace(w, {lit(P.TASHKEEL)}, '', 'g'), {lit(P.MARKS)}, '', 'g'))))"


def bucket(x: str) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {P.BUCKETS})"


def bigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def coverage(q: str, s: str) -> str:
    return f"(CASE WHEN len({q}) = 0 OR len({s}) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({q}), {s})) AS DOUBLE) / len(list_distinct({q})) END)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + pattern)})"


def section_bucket(x: str) -> str:
    s = f"lower(replace({strip(f'coalesce({x}, {lit("")})')}, '_', ' '))"
    arms = " ".join(f"WHEN {' OR '.join(f'contains({s}, {lit(t)})' for t in terms)} THEN {lit(name)}" for name, terms in P.SECTION_BUCKETS)
    return f"(CASE {arms} ELSE 'other' END)"


#: doc_id, line_no and line of every line of documents.
LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"
