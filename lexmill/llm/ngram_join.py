"""Exact Jaccard self-join of documents on word shingles, and the groups that its links make.

T-occurrence search in the manner of DivideSkip. Each document (a set of n shingles) is a query for the others that share at least T
of its inverted lists, T = ceil(0.8 n). Its lists are divided by length: the T-m longest are skipped at first (m = 1 + n/20), and the
n-T+m short ones are merged; a document that shares T lists must be on m of the short ones. What the merge finds
is checked by binary probes in the sorted shingles of the candidate, against the exact bound on intersection and union.

Lists are divided by one global order, so both sides of a pair skip the same lists: shingles that recur within a part of the
input, by an estimate of their frequency, come last, others before them by hash. Only shingles before the division are
shuffled (about a quarter, in PASSES parts one after the other), so frequent passages meet in no task. Any order gives the same result; the order only saves time.

Links are wanted up to groups, so a list isn't expanded into its pairs: each member is paired with the list's head, pairs that look
alike are verified, components contracted, and lists within one component are done; so again, by other heads, for those that are left. On the lists that
still hold several components, each pair of classes is made once, at the first list that both are on and only where that leaves room for the
overlap, and verified; so no link between components is lost. Documents with equal sets are one class throughout.

Defined results: a null or blank text has no shingle (n_shingles 0) and is linked with nothing; a text of fewer than five words has
one shingle; null ids are carried through and never name a group that has another id; repeated rows are in one group; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import drop_kept, first_met_pairs, join_both, join_small, keep, mix64, places, releases_shuffles, word_hashes
from lexmill.llm.components import link_by_heads, link_left, star_roots, stars

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 4, 5
HOT_MOST = 400_000
NEEDED_MOST = 4_000_000
CHUNK_BYTES = 1 << 20
COUNT_MOST = 1_000_000
#: One more short list for so many shingles, so that one shared list isn't enough for a candidate.
MORE = 20
#: Share of the short lists that a pair has in common to be worth a look in the first round.
ALIKE = 0.3
#: Parts of the lists, by their shingles' hashes, that go through the shuffle one after the other, so that its files take only a part of the disk.
PASSES = 2
#: Rounds in which each class tries the likeliest of its lists' heads.
HEADS = 4

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (hi == lo or size < CHUNK_BYTES):
            parts.append((texts[hi] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            hi += 1
        out += _chunk_sets(parts, words)
        lo = hi
    return out


@np.errstate(over="ignore")
def _chunk_sets(parts: list[bytes], words: int) -> list[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)]
    gap = _SEPARATOR[data]
    inside = np.concatenate([[False], ~gap, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    word = word_hashes(data, starts, ends)
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    first = np.searchsorted(starts, begins)  # of each text's words
    n = len(word)
    total = np.zeros(max(n, 1), dtype=np.uint64)
    factor = np.uint64(1)
    for k in range(words):
        if n > k:
            total[: n - k] += word[k:] * factor
        factor = factor * _STEP
    rolled = mix64(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = mix64(np.array([h * _STEP + w]))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


@np.errstate(over="ignore")
def _set_keys(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    if not len(s):
        return 0, 0
    n = np.uint64(len(s))
    a = mix64(np.array([mix64(s ^ np.uint64(0xA5A5 + seed)).sum() + n]))[0]
    b = mix64(np.array([mix64(s + np.uint64(0x1234567)).sum() * _STEP + n]))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def _hot_counts(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur within a part of the input, and about how often; HOT_MOST at most, so that the arrays have a size bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                sets = shingle_sets(batch.column("text")[lo : lo + 500].to_pylist(), words)
                held += sets
                size += sum(map(len, sets))
                if size > COUNT_MOST:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = keep(docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "counts")
    levels = counts.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("k")).collect()  # about 4 rows for each doubling
    floor, total = None, 0
    for level, k in sorted(((r["level"], r["k"]) for r in levels), reverse=True):
        if total + k > HOT_MOST:
            break
        floor, total = level, total + k
    if floor is None:
        drop_kept(counts)
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = counts.filter(F.floor(F.log2("n") * 4) >= floor).toPandas()
    drop_kept(counts)
    s, n = rows["s"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def short_lists(s: np.ndarray, hot: np.ndarray, hot_n: np.ndarray) -> np.ndarray:
    """The shingles of a set whose lists are merged: the n-T+m first in the global order."""
    n = len(s)
    p = n - -(-NUM * n // DEN) + 1 + n // MORE
    if not len(hot):
        return s[:p]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    cold = s[~is_hot]
    if len(cold) >= p:
        return cold[:p]
    warm = s[is_hot]
    return np.concatenate([cold, warm[np.lexsort((warm, hot_n[at[is_hot]]))]])[:p]


def _index(docs: DataFrame, id_type: str, words: int, seed: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n, cid (the name of the class of equal sets), check, and the short lists' shingles where the class is new to the task."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    arrow_id = pa.string() if id_type == "string" else pa.int64()
    schema = pa.schema([("id", arrow_id), ("n", pa.int32()), ("cid", pa.int64()), ("check", pa.int64()), ("short", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: dict[str, list] = {k: [] for k in schema.names}
                for i, s in zip(part.column("id").to_pylist(), shingle_sets(part.column("text").to_pylist(), words)):
                    cid, check = _set_keys(s, seed)
                    rows["id"].append(i)
                    rows["n"].append(len(s))
                    rows["cid"].append(cid)
                    rows["check"].append(check)
                    rows["short"].append(None if cid in seen or not len(s) else short_lists(s, values, counts).view(np.int64))
                    seen.add(cid)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.mapInArrow(index, f"id {id_type}, n int, cid long, check long, short array<long>")


_POSTING = pa.schema([(k, pa.int64()) for k in ("s", "cid", "n", "pos", "hub", "hub_n", "hub_pos")])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, sorted by list and class, with the head of their list; lists of one class go."""
    head: tuple[int, ...] | None = None  # of the list at the end of the batch before
    told = False  # whether its head has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        s, cid, n, pos = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "cid", "n", "pos"))
        if head is not None:
            s, cid, n, pos = (np.concatenate([[h], x]) for h, x in zip(head, (s, cid, n, pos)))
        new = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        other = cid != cid[start]
        other &= np.concatenate([[True], (s[1:] != s[:-1]) | (cid[1:] != cid[:-1])])  # a class once a list
        wide = np.zeros(len(s), dtype=bool)
        wide[start[other]] = True  # heads of lists with another class
        pick = other | wide
        if head is not None and told:
            pick[0] = False
        if head is None or new[1:].any():
            last = start[-1]
            told = bool(wide[last])
        else:
            told = told or bool(wide[0])
        head = tuple(int(x[start[-1]]) for x in (s, cid, n, pos))
        k = np.flatnonzero(pick)
        h = start[k]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[k], cid[k], n[k], pos[k], cid[h], n[h], pos[h])], schema=_POSTING)


def _may_link(n: str, pos: str, other_n: str, other_pos: str):
    """Whether the sizes, and the places of a shared shingle, leave room for the overlap that a link needs."""
    a, b, p, q = F.col(n), F.col(other_n), F.col(pos), F.col(other_pos)
    bound = F.least(p, q) + 1 + F.least(a - p - 1, b - q - 1)
    return (bound * (NUM + DEN) >= (a + b) * NUM) & (F.least(a, b) * DEN >= F.greatest(a, b) * NUM)


def _short(n: str):
    """How many short lists a set has."""
    return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * NUM / DEN) + 1 + F.floor(F.col(n) / MORE))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose overlap, by binary probes of the larger set, makes a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            good.append(int((t[at] == s).sum()) * (NUM + DEN) >= (len(s) + len(t)) * NUM)
        mask = pa.array(good, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)


def _sets(docs: DataFrame, needed: DataFrame, words: int, seed: int) -> DataFrame:
    """cid and the shingles of the classes in ``needed``. Their names are broadcast if they are few enough, else joined."""
    spark = docs.sparkSession
    few = needed.count() <= NEEDED_MOST
    ids = np.sort(needed.toPandas()["cid"].to_numpy(dtype=np.int64)) if few else None
    shared = spark.sparkContext.broadcast(ids)
    schema = pa.schema([("cid", pa.int64()), ("set", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cids, data = [], []
                for s in shingle_sets(batch.column("text")[lo : lo + 500].to_pylist(), words):
                    cid = _set_keys(s, seed)[0]
                    if not len(s) or cid in seen:
                        continue
                    if wanted is not None:
                        at = np.searchsorted(wanted, cid)
                        if at == len(wanted) or wanted[at] != cid:
                            continue
                    seen.add(cid)
                    cids.append(cid)
                    data.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cids, type=pa.int64()), pa.array(data, type=pa.binary())], schema=schema)

    out = docs.select("text").mapInArrow(emit, "cid long, set binary")
    if not few:
        out = out.join(needed, "cid", "left_semi")
    return out.groupBy("cid").agg(F.first("set").alias("set"))


def _needed_sets(docs: DataFrame, pairs: DataFrame, words: int, seed: int) -> DataFrame:
    """The sets of all classes in pairs, kept: one pass over the documents, however often they are probed."""
    needed = keep(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "needed")
    return keep(_sets(docs, needed, words, seed), "sets")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    return keep(join_both(pairs, sets, "cid", "set").mapInArrow(_linked, "a long, b long"), "links")


def _rooted(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Postings (s, cid, n, pos, root) of lists that hold several components, of classes that are on enough of them to link at all (m of T-occurrence)."""
    roots = star_roots(links).select(F.col("node").alias("cid"), "root")
    named = join_small(lists.select("s", "cid", "n", "pos"), roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    wide = named.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("s")
    some = named.join(wide, "s", "left_semi")
    enough = some.groupBy("cid").agg(F.count("*").alias("w"), F.first("n").alias("n")).filter(F.col("w") >= 1 + F.floor(F.col("n") / MORE)).select("cid")
    return keep(join_small(some, keep(enough, "enough"), ["cid"], "left_semi"), "rest")


def _likeliest(rest: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b): each class with that one of its lists' heads, by another order each round, that it shares most lists with."""
    head = F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("order"), "cid", "n", "pos", "root")).alias("hub")
    heads = rest.groupBy("s").agg(head).select("s", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("cid", "n", "pos", "root")])
    met = rest.join(heads, "s").filter((F.col("root") != F.col("hub_root")) & _may_link("n", "pos", "hub_n", "hub_pos")).groupBy("cid", "hub_cid").agg(F.count("*").alias("common"))
    best = met.groupBy("cid").agg(F.max(F.struct("common", "hub_cid")).alias("best"))
    return best.select(F.greatest("cid", "best.hub_cid").alias("a"), F.least("cid", "best.hub_cid").alias("b")).distinct()


def _left_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b, room) of classes (h) of different components that may link: all that do are among them, and have enough short lists in common."""
    # lists of one component aren't among them: no pair meets there
    return first_met_pairs(keep(places(rest, MORE), "places"), NUM, DEN, _short)


@releases_shuffles
def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach)."""
    spark: SparkSession = docs.sparkSession
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    rows = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).alias("text"))
    hot = _hot_counts(rows, words)
    for seed in range(8):
        index = keep(_index(rows, id_type, words, seed, hot), "index")
        # two sets with one name, which needs some 10**10 sets, get other names
        if not index.groupBy("cid").agg((F.min("check") != F.max("check")).alias("bad")).filter("bad").limit(1).count():
            break
        drop_kept(index)
    postings = index.filter("short IS NOT NULL").select("cid", "n", F.posexplode("short").alias("pos", "s")).select("s", "cid", "n", "pos")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    passes = [postings.filter(F.pmod("s", F.lit(PASSES)) == k).repartition(parts, "s").sortWithinPartitions("s", "cid") for k in range(PASSES)]
    passes = [keep(some.mapInArrow(_heads, "s long, cid long, n long, pos long, hub long, hub_n long, hub_pos long"), "lists") for some in passes]
    lists = functools.reduce(DataFrame.unionByName, passes)
    ids = keep(index.select("id", "n", "cid"), "ids")
    drop_kept(index)
    starred = lists.filter((F.col("cid") != F.col("hub")) & _may_link("n", "pos", "hub_n", "hub_pos")).groupBy("cid", "hub").agg(F.count("*").alias("common"), F.first("n").alias("n"), F.first("hub_n").alias("hub_n"))
    alike = starred.filter(F.col("common") >= ALIKE * F.least(_short("n"), _short("hub_n")))
    tried = keep(alike.select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct(), "pairs")
    links = stars(_verify(tried, _needed_sets(rows, tried, words, seed)))
    rest = _rooted(lists, links)
    for some in passes:
        drop_kept(some)
    # the sets of all classes that are still in wide lists: one pass over the documents, however often they are probed
    sets = keep(_sets(rows, rest.select("cid").distinct(), words, seed), "sets") if rest.limit(1).count() else None
    for k in range(1, HEADS):
        if not rest.limit(1).count():
            break
        pairs = keep(_likeliest(rest, k).join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = stars(links.unionByName(_verify(pairs, sets))), tried.unionByName(pairs)
        before, rest = rest, _rooted(rest, links)
        drop_kept(before)
    rest, links, tried = link_by_heads(rest.withColumnRenamed("cid", "h"), links, tried, lambda pairs: _verify(pairs, sets), lambda lists, links: _rooted(lists.withColumnRenamed("h", "cid"), links).withColumnRenamed("cid", "h"), NUM, DEN)
    across = keep(_left_pairs(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = link_left(across, links, lambda pairs: _verify(pairs, sets))
    roots = star_roots(links)
    least = ids.filter("n > 0").groupBy("cid").agg(F.min("id").alias("least"))
    named = least.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    groups = keep(named.select("cid", "root").join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cid", "component_id"), "groups")
    out = ids.join(groups, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
