"""What the training-data operators share: tables, shared storage, and hashing of bytes in numpy."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from lexmill.session import _RELEASE, shared_path, shuffles_released  # noqa: F401

BROADCAST_ROWS = 1_000_000

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; drop_kept() or remove_all() removes it."""
    path = shared_path(spark, f"{uuid.uuid4().hex}/{name}")
    _MADE.append((spark, path))
    return path


def releases_shuffles(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn(docs, ...), whose actions leave no shuffle files."""

    @functools.wraps(fn)
    def releasing(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with shuffles_released(docs.sparkSession):
            return fn(docs, *args, **kwargs)

    return releasing


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_kept(df: DataFrame) -> None:
    """Remove the files of a table that keep() wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        for i, (spark, path) in enumerate(_MADE):
            if path.split("://")[-1].split(":", 1)[-1].lstrip("/") in file:
                remove(spark, path)
                del _MADE[i]
                return


@contextlib.contextmanager
def collected(paths: list[tuple[SparkSession, str]]) -> Iterator[None]:
    """The tables kept meanwhile, so that remove_all() can remove them when no lazy result reads them any more."""
    before = list(_MADE)
    try:
        yield
    finally:
        paths += [x for x in _MADE if x not in before]


def remove_all(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        entry = paths.pop()
        if entry in _MADE:
            _MADE.remove(entry)
        remove(*entry)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts the right side only if it has few rows, and is left to Spark beyond that."""
    return left.join(broadcast(right) if right.count() <= most else right, on, how)


def join_both(pairs: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Kept pairs (a, b) with the values x of a and y of b. Of the values only those go through a shuffle that a pair needs, unless pairs are too many to be broadcast."""
    few = pairs.count() <= BROADCAST_ROWS
    side: Callable[[DataFrame], DataFrame] = broadcast if few else lambda df: df
    firsts, seconds = values.select(F.col(key).alias("a"), F.col(value).alias("x")), values.select(F.col(key).alias("b"), F.col(value).alias("y"))
    if few:
        firsts = firsts.join(broadcast(pairs.select("a").distinct()), "a", "left_semi")
    return seconds.join(side(pairs.select("a", "b")), "b").join(firsts, "a")


#: Earlier elements that a place carries; where there are more, a pair may be made at several places, and is made distinct.
BEFORE = 64
#: Words of a set's bitmap.
BITS = 8


def places(lists: DataFrame, more: int) -> DataFrame:
    """From lists (s, h, root, n, pos): adds before (the elements of h at earlier places, where they are few), w (elements of h on the lists) and bits (a bitmap of them).

    Sets that are on too few of the lists to be similar to any, one and one more for ``more`` elements, are left out.
    """
    word = F.pmod(F.col("s"), F.lit(BITS))
    bits = [F.bit_or(F.when(word == k, F.expr("shiftleft(1L, cast(pmod(shiftright(s, 8), 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(BITS)]
    own = lists.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("e"), F.first("n").alias("n"), F.first("root").alias("root"), F.count("*").alias("w"), *bits)
    own = own.filter(F.col("w") >= 1 + F.floor(F.col("n") / more))
    each = own.select("h", "n", "root", "w", F.array(*[f"b{k}" for k in range(BITS)]).alias("bits"), F.transform(F.slice("e", 1, BEFORE), lambda x: x["s"]).alias("xs"), F.posexplode("e").alias("i", "x"))
    before = F.when(F.col("i") <= BEFORE, F.slice("xs", F.lit(1), F.col("i"))).otherwise(F.array().cast("array<bigint>"))
    return each.select("h", "n", "root", "w", "bits", "x.s", "x.pos", before.alias("before"))


def first_met_pairs(at: DataFrame, num: int, den: int, lengths: Callable[[str], Column]) -> DataFrame:
    """Pairs (a, b, room; a > b) of sets of different components that may have a Jaccard similarity of num / den, each once, at the first list that they share.

    From places(): the rare elements s of sets h of n elements, of which the lists have the first ``lengths`` by one global order, pos their place there from 0. All pairs that
    are similar are among them: the smaller set of such a pair meets the other within its rarest ninth (for 0.8); sizes, and what is left from there on, leave room
    for the overlap; and so do the elements that both have on the lists, of which there are no more than the bitmaps say.
    """
    p, q = at.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * num / (num + den))).alias("p"), at.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * num / den)).alias("q")
    room = F.least(F.col("p.n") - F.col("p.pos"), F.col("q.n") - F.col("q.pos"))
    needed = F.ceil((F.col("p.n") + F.col("q.n")) * num / (num + den))
    may = (F.struct("p.n", "p.h") < F.struct("q.n", "q.h")) & (F.col("p.n") * den >= F.col("q.n") * num) & (room >= needed)
    # the set whose lists end first in the order has there all that they have in common on them
    common = F.least(*[needed - (F.col(f"{x}.n") - lengths(f"{x}.n")) for x in "pq"])
    for x, y in ("pq", "qp"):
        others = [F.bit_count(F.get(f"{x}.bits", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{y}.bits", F.lit(k))))) for k in range(BITS)]
        may = may & (F.col(f"{x}.w") - sum(others[1:], others[0]) >= common)
    may = may & (F.col("p.root") != F.col("q.root")) & ~F.arrays_overlap("p.before", "q.before")
    met = p.join(q, (F.col("p.s") == F.col("q.s")) & may).select(F.greatest("p.h", "q.h").alias("a"), F.least("p.h", "q.h").alias("b"), (room / (F.col("p.n") + F.col("q.n"))).alias("room"))
    return met.groupBy("a", "b").agg(F.max("room").alias("room"))


def first_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of the key, of rows with one key one.

    A threshold below which about as many keys are expected comes before the sort, so that each task sends its share and not ``most`` rows.
    """
    keys = df.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    share = (most + 8 * most**0.5 + 100) * 1.3 / max(keys, 1)  # well above what either estimate may miss
    some = df.filter(F.xxhash64(key) <= int(-(1 << 63) + min(share, 1.0) * ((1 << 64) - 1) // 1)) if share < 1 else df
    return some.dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(most)


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices, each of at most so many bytes of text in the column, or of one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


# --- hashing -------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        a = np.full(size, _BASE, dtype=np.uint64)
        a[0] = 1
        b = np.full(size, _INVERSE, dtype=np.uint64)
        b[0] = 1
        _powers, _inverses = np.cumprod(a), np.cumprod(b)


# The key of word hashes.
_WORD_KEYS = (np.uint64(0x8F1BBCDC2F6A4C15), np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))
#: Bytes of a word up to which it is hashed in numpy, eight at a time with all others.
LONG_WORD = 2048


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hashes of words, the byte spans [start, end) of data: eight bytes at a time go through a mixer, so that no sums of bytes cancel out, whatever the words.

    Words of up to eight bytes and one length have different hashes. Long words are hashed by BLAKE2b, one by one.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = (ends - starts).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    h = mix64(sizes ^ _WORD_KEYS[0])
    at = np.flatnonzero(sizes <= LONG_WORD)
    block = 0
    while len(at):
        left = sizes[at] - np.uint64(8 * block)
        unused = np.uint64(8) - np.minimum(left, np.uint64(8))
        v = eights[starts[at] + 8 * block] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * unused))
        h[at] = mix64((h[at] ^ mix64(v + _WORD_KEYS[1])) * _WORD_KEYS[2])
        block += 1
        at = at[left > 8]
    for k in np.flatnonzero(sizes > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=_WORD_KEYS[1].tobytes()).digest(), "little")
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data, one pass over the bytes for any number of spans.

    A polynomial modulo 2^64, for spans of a few dozen bytes: longer ones can be made that have the same hash (see word_hashes).
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))
