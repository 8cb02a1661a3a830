"""Packing of tokenised documents into sequences of a fixed length: shortest-pack-first over the length histogram.

1. One narrow pass tokenises each text and cuts it into full pieces of ``limit`` ids and a remainder; it also numbers the
   pieces of each length within its task.
2. The histogram (at most ``limit`` lengths, whatever the input) goes to the driver, where lengths are placed longest first, each
   into the shortest pack that has room; only counts of packing patterns are kept, never documents.
3. Per-task counts become offsets, so every piece has a rank among those of its length, without one task ever holding a length;
   patterns own intervals of ranks, so that the join from pieces back to patterns is a binary search.

Batches are cut by the size of their texts and the cache of words is bounded, so that a worker's memory doesn't follow the input.

A sequence whose ids come to a power of two needs no padding; any other is padded to ``limit``.

Defined results: a null text counts as empty and is one piece with the end id; repeated rows are packed each by itself; null ids
are carried through; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import keep, sliced

LIMIT = 4096
END_ID = 2
#: Bounds of what a Python worker holds: words in either generation of the cache and characters of each, characters of text split at a time.
CACHE_WORDS = 150_000
CACHE_WORD = 64
SLICE_CHARS = 1 << 20

_LATIN = [chr(c) for c in range(0x250)]
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_CHUNK = re.compile(r"\S+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Texts with other characters, or with what may be a special token, go to the tokenizer as they are; so do letters whose lower case is none of these.
_BASE = {*range(9, 14), *range(32, 127), *range(160, 0x130), *range(0x131, 0x250)}
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_BASE) if {ord(x) for x in chr(c).lower()} <= _BASE) + "]*")

#: The vocabulary spells bytes as letters: printable Latin-1 as itself, the others by the letters from U+0100 on.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: b if b in _OWN else 256 + sum(x not in _OWN for x in range(b)) for b in range(256)}


class _Recent(dict):
    """What was made for keys, in two generations of at most so many: when the younger one is full it becomes the older one, from which what is asked for again moves back."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordTokenizer:
    """Ids of whole texts, as little-endian 32-bit integers, with a cache of the ids of what stands between white space.

    The vocabulary splits texts into words before it merges, so a text's ids are those of its words one after the other; that
    holds for texts in Latin letters (whose words the pattern above finds); others are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = _Recent(self._chunk, cache_words)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
        if len(words) != 1:
            return b"".join(map(self.cache.__getitem__, words))
        word = words[0]
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. White space always parts words, so what stands between is looked up as a whole."""
        of = self.cache.__getitem__
        for text in texts:
            if "<|" in text or not _PLAIN.fullmatch(text):
                yield self._whole(text)
            elif len(text) <= SLICE_CHARS:
                yield b"".join(map(of, text.lower().split()))
            else:
                yield b"".join(map(of, (m[0] for m in _CHUNK.finditer(text.lower()))))


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer: its tasks share the cache."""
    return WordTokenizer(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document: id, start, length, ids_crc32, doc_tokens, the task, the rank in the task among its length, and on demand the ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    arrow_id = pa.string() if rows.schema["id"].dataType.simpleString() == "string" else pa.int64()
    rows = rows.withColumn("id", F.col("id").cast("string" if arrow_id == pa.string() else "long"))
    schema = pa.schema(
        [("id", arrow_id), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("local_rank", pa.int64())]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in (b for whole in batches for b in sliced(whole, "text", SLICE_CHARS)):
            out: dict[str, list] = {k: [] for k in schema.names}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, found in zip(batch.column("id").to_pylist(), tok.ids_of(texts)):
                data = found + end
                n = len(data) // 4
                for start in range(0, n, limit):
                    part = data[4 * start : 4 * (start + limit)]
                    k = len(part) // 4
                    for name, v in zip(schema.names, (i, start, k, zlib.crc32(part), n, task, seen[k])):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<i4"))
                    seen[k] += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    kind = "string" if arrow_id == pa.string() else "long"
    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long" + (", ids array<int>" if with_ids else ""))


def pack_histogram(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, how often), for ``histogram[length]`` pieces of each length.

    Lengths are placed longest first; copies of a length go to the shortest open pack that exists, as many at a time as the
    pattern's count allows. A pattern is closed when full.
    """
    done: list[tuple[tuple, int]] = []
    by_size: dict[int, list[tuple[tuple, int]]] = {}  # open patterns: linked lengths and counts
    sizes: list[int] = []

    def put(pattern: tuple, size: int, count: int) -> None:
        if size == limit:
            done.append((pattern, count))
        elif size in by_size:
            by_size[size].append((pattern, count))
        else:
            by_size[size] = [(pattern, count)]
            insort(sizes, size)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not sizes or sizes[0] + length > limit:
                put(((), length), length, left)
                break
            size = sizes[0]
            pattern, count = by_size[size].pop()
            if not by_size[size]:
                del by_size[size]
                sizes.pop(0)
            # in one go: as many copies as fit while the pack stays the shortest
            room = (sizes[0] - size) // length if sizes else limit
            copies = max(1, min(room, (limit - size) // length, left // count if left >= count else 1))
            used = min(count, left // copies if left >= copies else 1)
            if used < count:
                put(pattern, size, count - used)
            for _ in range(copies):
                pattern = (pattern, length)
            put(pattern, size + copies * length, used)
            left -= used * copies
    done += [x for patterns in by_size.values() for x in patterns]

    def flat(pattern: tuple) -> tuple[int, ...]:
        out = []
        while pattern:
            pattern, length = pattern
            out.append(length)
        return tuple(reversed(out))

    return [(flat(p), n) for p, n in done]


class Placement:
    """Where the piece of a length and rank goes: intervals of ranks by length, each owned by a slot of a pattern."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        rank: dict[int, int] = {}
        base = 0
        for lengths, count in patterns:
            offset = 0
            for length in lengths:
                r = rank.get(length, 0)
                by_length.setdefault(length, []).append((r, base, offset))
                rank[length] = r + count
                offset += length
            base += count
        self.sequences = base
        self.table = {k: np.array(v, dtype=np.int64) for k, v in by_length.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of each piece."""
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for value in np.unique(length):
            own = np.flatnonzero(length == value)
            t = self.table[int(value)]
            k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
            sequence[own] = t[k, 1] + rank[own] - t[k, 0]
            offset[own] = t[k, 2]
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand the ids."""
    pieces = keep(cut_pieces(docs, tokenizer_path, limit, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = Placement(pack_histogram(histogram, limit))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("task", "base", "local_rank")
    shared = docs.sparkSession.sparkContext.broadcast(placement)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = p.find(length, batch.column("rank").to_numpy(zero_copy_only=False))
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    out = ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
    ids = ["ids"] if with_ids else []
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids)


def padding(histogram_of_sequences: list[int], limit: int = LIMIT) -> int:
    """Ids of padding that sequences of these sizes need."""
    return sum(0 if n & (n - 1) == 0 else limit - n for n in histogram_of_sequences)
