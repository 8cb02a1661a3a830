"""Compression of vectors to four codes: product quantisation by weighted Lloyd rounds over distinct integer parts.

Components become integers (floor of 1024 times the value), vectors are cut into consecutive parts, and equal parts of a position become
one weighted row, so a vector that a third of all rows repeat costs one. Each round assigns the distinct parts to the nearest of at most 256 entries a position
(squared Euclidean distance, ties to the lower index) in Arrow batches, and a task sends its sums by entry: at most 1024 rows. The driver holds the codebooks only. At last,
codes and errors are joined back to the vectors on the part. Parts of a weight above 1/``HOT`` of all rows, of which there are fewer than ``HOT`` a position, are
broadcast; the others are joined by shuffle.

Arithmetic is of integers throughout: in doubles where all sums are below 2^53, in Python's integers beyond that. A squared distance beyond a long is returned as the largest long.

Defined results: a null vector, one with null or non-finite components, an empty one, and one of another length than the shortest kept vector with the
smallest id are dropped; a length that four doesn't divide is cut at the floor of its quarters; null ids are kept, and are above all others; of rows that
repeat an id the lesser vectors come first; integers beyond a long are the largest or least long; fewer than 256 vectors make shorter codebooks; null labels are one label; repeated rows give equal rows; an empty table gives an empty result;
columns other than id, vector and label are ignored. There are no texts in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from lexmill.llm.common import join_small
from lexmill.llm.common import keep as keep_table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
HOT = 4096
#: Rows that are compared with a codebook at once: 8 MB of distances.
BLOCK = 4096
LARGEST = (1 << 63) - 1

Codebooks = list[list[list[int]]]  # by part, entry, position within the part


class Compressed(NamedTuple):
    """vectors: one row a kept vector with its id, label, codes (array), error and label_error; codebooks: final entries."""

    vectors: DataFrame
    codebooks: Codebooks


def integer_parts(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """Kept vectors: row (a key), id, label, v (all integers), p (its parts, an array of arrays)."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.cast("array<double>").alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.size("v")).select(F.size("v").alias("n")).first()
    n = first["n"] if first else parts
    cuts = [k * n // parts for k in range(parts + 1)]
    p = F.array(*[F.slice("v", a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    kept = rows.filter(F.size("v") == n).select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", p.alias("p"))
    return keep_table(kept, "vectors")  # keys stay the same when a task runs again


def distinct_parts(rows: DataFrame) -> DataFrame:
    """pos, part, weight: every distinct part of each position, with the number of vectors that have it."""
    return rows.select(F.posexplode("p").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))


def _largest(a: np.ndarray) -> int:
    """The largest absolute value, which may be one more than a long holds."""
    return max(int(a.max()), -int(a.min())) if a.size else 0


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance of each row; exact, ties to the lower index. x and book: integers or objects."""
    most = max(_largest(x), _largest(book))
    if x.dtype != object and 8 * max(x.shape[1], 1) * most * most < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        away = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        at = away.argmin(1)
        return at, away[np.arange(len(a)), at].astype(np.int64)
    a, b = x.astype(object), book.astype(object)
    found = [min((sum(int(d) * int(d) for d in row - entry), k) for k, entry in enumerate(b)) for row in a]
    return np.array([k for _, k in found], dtype=np.int64), np.array([min(d, LARGEST) for d, _ in found], dtype=np.int64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    pos = batch.column("pos").to_numpy()
    for k in np.unique(pos):
        at = np.flatnonzero(pos == k)
        for i in range(0, len(at), BLOCK):
            yield int(k), at[i : i + BLOCK]


def _sums(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrays = [np.array(b, dtype=np.int64) for b in books]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, dtype=object) for b in arrays]
        count = [np.zeros(len(b), dtype=np.int64) for b in arrays]
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for k, at in _by_position(batch):
                x = _matrix(batch.column("part").take(pa.array(at)), arrays[k].shape[1])
                entry, _ = nearest(x, arrays[k])
                w = weights[at]
                np.add.at(count[k], entry, w)
                if _largest(x) * int(w.sum()) < LARGEST:
                    some = np.zeros(arrays[k].shape, dtype=np.int64)
                    np.add.at(some, entry, x * w[:, None])
                    total[k] = total[k] + some.astype(object)
                else:
                    np.add.at(total[k], entry, x.astype(object) * w[:, None].astype(object))
        made = [(k, i, [str(s) for s in total[k][i]], int(n)) for k in range(len(arrays)) for i, n in enumerate(count[k]) if n]
        yield pa.RecordBatch.from_pydict({"pos": [m[0] for m in made], "entry": [m[1] for m in made], "sums": [m[2] for m in made], "n": [m[3] for m in made]}, schema=pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.string())), ("n", pa.int64())]))

    return fold


def _assign(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrays = [np.array(b, dtype=np.int64) for b in books]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for k, at in _by_position(batch):
                code[at], error[at] = nearest(_matrix(batch.column("part").take(pa.array(at)), arrays[k].shape[1]), arrays[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    return assign


def first_entries(rows: DataFrame, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, ascending."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("p").collect()
    return [[list(r["p"][k]) for r in first] for k in range(len(first[0]["p"]) if first else 0)]


def one_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floored means of the parts assigned to them; unused entries stay."""
    sums = distinct.mapInArrow(_sums(books), "pos int, entry int, sums array<string>, n long").groupBy("pos", "entry")
    wide = len(books[0][0]) if books and books[0] else 0
    width = max((len(b[0]) for b in books), default=wide)
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]).collect()
    books = [[list(e) for e in b] for b in books]
    for r in total:
        books[r["pos"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(len(books[r["pos"]][r["entry"]]))]
    return books


def with_codes(rows: DataFrame, coded: DataFrame, total: int) -> DataFrame:
    """The rows' codes (an array by position) and errors, joined back on the parts; parts of a great weight go by broadcast."""
    each = rows.select("row", F.posexplode("p").alias("pos", "part"))
    hot = keep_table(coded.filter(F.col("weight") * HOT > total), "hot")  # fewer than HOT a position, whatever the input
    found = each.join(broadcast(hot.select("pos", "part", "code", "error")), ["pos", "part"], "left")
    met = found.filter("code IS NOT NULL").select("row", "pos", "code", "error")
    rare = coded.filter(F.col("weight") * HOT <= total).select("pos", "part", "code", "error")
    others = found.filter("code IS NULL").select("row", "pos", "part").join(rare, ["pos", "part"]).select("row", "pos", "code", "error")
    whole = met.unionByName(others).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("c"), F.try_sum("error").alias("error"))
    return whole.select("row", F.transform("c", lambda c: c["code"]).alias("codes"), F.coalesce("error", F.lit(LARGEST)).alias("error"))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes and errors of all vectors that can be kept, and the final codebooks."""
    rows = integer_parts(vectors, id_col, vector_col, label_col, parts)
    distinct = keep_table(distinct_parts(rows), "distinct")
    books = first_entries(rows, entries)
    for _ in range(rounds if books else 0):
        books = one_round(distinct, books)
    if not books:
        empty = rows.limit(0).select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return Compressed(empty, [])
    coded = keep_table(distinct.mapInArrow(_assign(books), "pos int, part array<bigint>, weight long, code int, error long"), "coded")
    total = rows.count()
    joined = keep_table(rows.select("row", "id", "label").join(with_codes(rows, coded, total), "row"), "codes")
    by_label = joined.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(LARGEST)).alias("label_error")).select(F.struct("label").alias("k"), "label_error")
    out = join_small(joined.withColumn("k", F.struct("label")), by_label, "k")
    return Compressed(out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books)


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def code_string(codes) -> F.Column:
    """Codes as two lower-case hexadecimal digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
