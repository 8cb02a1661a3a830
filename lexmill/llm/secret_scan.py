"""Secrets in texts: fixed rules, and random strings by how badly a tokenizer's vocabulary compresses them.

A vocabulary that was learned from text and code has long tokens for words, names and common code, and none for random letters and digits: a
string drawn at random has few characters a token. Candidates are the runs of at least ``SHORTEST`` letters, digits and ``+/_=-`` that lie outside
the rules' matches. Left out as known digests or identifiers: runs in hexadecimal of a digest's length, digests that name their algorithm, UUIDs, numbers, dates and
catalogue numbers (digits and separators with at most four letters), names (words with separators between them), and runs that are
part of an address or of embedded data (``://``, ``@`` or ``base64,`` earlier in the same word). Of the rest, those with at most ``RATIO`` characters a token are reported as
``random``.

Every document is scanned in a task on its own, in Arrow batches of a bounded size; nothing is shuffled, so no key can be hot.

Defined results: a null or empty text has no spans; a null id stays and is judged by its text; repeated rows give equal rows; very long texts are scanned whole, and
very long runs are tokenised in pieces of ``PIECE`` characters, the counts of which are added; an empty table gives an empty result; columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import sliced

# The rules' patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
# Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

SHORTEST = 16
RATIO = 2.0
PIECE = 256
SLICE_BYTES = 8 << 20

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-_=].*", re.IGNORECASE)
_NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[+/_=-]*|(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4})+")
_NUMBER = re.compile(r"[0-9+/_=-]*(?:[A-Za-z][0-9+/_=-]*){0,4}")
_SPACE = re.compile(r"\s+")
_SEPARATOR = re.compile(r"[+/_=-]")
_ADDRESS = ("://", "@", "base64,")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def rule_spans(text: str) -> list[Span]:
    """Matches of the rules, leftmost and non-overlapping for each kind, without those that are too short."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def known(run: str, before: str) -> bool:
    """Whether a run is a digest, an identifier, a number or a name, given what comes before it in its word."""
    if _HEX_RUN.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run) or _DIGEST.fullmatch(run):
        return True
    number = run.isdigit() or _SEPARATOR.search(run) and _NUMBER.fullmatch(run)
    return bool(number or _NAME.fullmatch(run) or any(x in before for x in _ADDRESS))


def random_spans(text: str, rules: list[Span], tokens: Callable[[str], int], ratio: float) -> list[Span]:
    """Runs outside the rules' matches that the vocabulary compresses to at most ``ratio`` characters a token."""
    found, at, taken = [], 0, -1
    word, seen = "", 0  # of the word that a run is in, what comes before: an address' mark, or the last characters
    for m in _RUN.finditer(text):
        while at < len(rules) and rules[at][0] < m.end():
            taken = max(taken, rules[at][2])
            at += 1
        if taken > m.start():
            continue
        # the word so far: from the last white space before the run on
        pieces = _SPACE.split(text[seen : m.start()])
        word = pieces[-1] if len(pieces) > 1 else word + pieces[-1]
        run = m.group()
        if not known(run, word) and len(run) <= ratio * sum(tokens(run[k : k + PIECE]) for k in range(0, len(run), PIECE)):
            found.append((m.start(), 3, m.end()))
        word, seen = next((x for x in _ADDRESS if x in word), word[-8:] + run[-8:]), m.end()
    return found


@functools.lru_cache(maxsize=2)
def token_counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a string by the ranks in a tiktoken file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _scan(path: str, ratio: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE_BYTES):
                rows = []
                for text in batch.column("text").to_pylist():
                    rules = rule_spans(text or "")
                    spans = sorted(rules + random_spans(text or "", rules, lambda run: token_counter(path)(run), ratio))
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(span))], names=["id", "spans"])

    return scan


def scan_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row per document: id, spans (kind, start, end, text; by start, then kind as in KINDS; code points, end exclusive).

    ``vocabulary`` is the path of a tiktoken file that every executor can open.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])))])
    return rows.mapInArrow(_scan(vocabulary, ratio), schema).withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
