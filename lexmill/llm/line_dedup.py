"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line (trimmed, lower-cased) is the set of its character shingles: ``SHINGLE`` characters from each character on, the whole line where
it is shorter. Its signature is made where lines are read, in one aggregate over exploded shingles: each of VALUES values is the
least shingle hash after a mask has been xored in, which picks the shingle nearest to a point of the hash space; lines of at most FEW
shingles, for which such picks depend on each other, have a second signature of as many hash functions. The twelve bands of three
values are the lines of a plane of three by three points, so any two values are together in one band: they find a pair at 0.8 with
probability 0.990. Candidates are verified by exact Jaccard similarity (>= 0.8) of the whole sets, links are
closed to components by distributed union-find, and the first line (least id, then line number) of each component stays. Equal
lines are one from the start, whatever their number.

A bucket isn't expanded into its pairs. In each of STARS rounds all its members are paired with one of them, which then leaves it; pairs
are tried once, components contracted, and buckets within one component are done, so that a round has no more pairs than
members. Lines of buckets that still hold several components (lines that share a passage, say) are few and go through an exact
prefix-filter join instead: a pair at 0.8 shares one of the rarest ninth of the smaller set's shingles, at a place that leaves room for
the overlap; what lines of a bucket have in common is frequent among them, so doesn't make candidates.

Text is never shuffled but for lines that are candidates. What is broadcast is counted first (BROADCAST_ROWS), and joined by shuffle beyond that.

Defined results: blank lines are never dropped; a null text stays null; null ids sort first; a row repeated whole counts once, and each
copy keeps the same lines; very long lines are compared whole; an empty table gives an empty result; columns other than id, text and those
to carry are ignored. Should two unlike lines have one 64-bit name, all lines get other names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, drop_kept, first_met_pairs, join_both, join_small, keep, places, releases_shuffles
from lexmill.llm.components import link_by_heads, link_left, star_roots, stars

SHINGLE = 10
VALUES = 9
#: Bands: y = a x + b, and x = c, over the integers modulo 3; value 3 x + y is at the point (x, y).
BANDS = [[3 * x + (a * x + b) % 3 for x in range(3)] for a in range(3) for b in range(3)] + [[3 * c + y for y in range(3)] for c in range(3)]
FEW = 64
NUM, DEN = 4, 5
STARS = 4
#: One more rare shingle with a list for so many.
MORE = 20


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value taken once a row: inside a lambda it would be made again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(points: Column) -> Column:
    """Where shingles start in the UTF-32 of a line; with four bytes for each character, a shingle is cut out without a scan."""
    return F.sequence(F.lit(1), F.greatest(F.length(points) - 4 * (SHINGLE - 1), F.lit(1)), F.lit(4))


def _hash_at(points: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(points, start, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The hashes of the different shingles of a normalised line."""
    return F.array_distinct(_once(F.encode(line, "UTF-32"), lambda b: F.transform(_starts(b), lambda i: _hash_at(b, i))))


def _signatures(lines: DataFrame) -> DataFrame:
    """h, kind, n (lines of that name), and bands: hashes of the bands of the signature."""
    points = lines.select("h", F.encode("line", "UTF-32").alias("points"))
    few = F.length("points") <= 4 * (FEW + SHINGLE - 1)
    kinds = points.select("h", "points", F.explode(F.when(few, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"))
    each = kinds.select("h", "kind", "points", F.explode(_starts(F.col("points"))).alias("at")).select("h", "kind", "at", _hash_at(F.col("points"), F.col("at")).alias("x"))
    masks = [-(1 << 63) + k * ((1 << 64) // VALUES) for k in range(VALUES)]
    values = [F.min(F.when(F.col("kind") == 0, F.col("x").bitwiseXOR(F.lit(m))).otherwise(F.xxhash64("x", F.lit(m)))).alias(f"v{k}") for k, m in enumerate(masks)]
    found = each.groupBy("h", "kind").agg(F.count(F.when(F.col("at") == 1, 1)).alias("n"), *values)
    bands = [F.xxhash64(F.col("kind"), F.lit(b), *[F.col(f"v{k}") for k in of]) for b, of in enumerate(BANDS)]
    return found.select("h", "kind", "n", F.array(*bands).alias("bands"))


def _rooted(names: DataFrame, links: DataFrame | None, name: str = "h") -> DataFrame:
    """Adds ``root``, the name of the component, to names of lines; the links are stars."""
    if links is None:
        return names.withColumn("root", F.col(name))
    return join_small(names, star_roots(links).select(F.col("node").alias(name), "root"), name, "left").withColumn("root", F.coalesce("root", name))


def _near_roots(names: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``root``, a node of the component two links away at most: lines with one root are in one component, though not the other way round."""
    both = links.select(F.col("a").alias("h"), F.least("a", "b").alias("m")).unionByName(links.select(F.col("b").alias("h"), F.least("a", "b").alias("m")))
    near = keep(both.groupBy("h").agg(F.min("m").alias("m")), "near")
    side: Callable[[DataFrame], DataFrame] = F.broadcast if near.count() <= BROADCAST_ROWS else lambda df: df
    far = near.join(side(near.select(F.col("h").alias("m"), F.col("m").alias("far"))), ["m"], "left")
    roots = far.select("h", F.least("m", F.coalesce("far", "m")).alias("root"))
    return names.join(side(roots), "h", "left").withColumn("root", F.coalesce("root", "h"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = join_both(pairs, texts, "h", "line")
    near = _once(shingles(F.col("x")), lambda s: _once(shingles(F.col("y")), lambda t: F.size(F.array_intersect(s, t)) * (NUM + DEN) >= (F.size(s) + F.size(t)) * NUM))
    return keep(both.filter(near).select("a", "b"), "links")


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _apart(members: DataFrame, links: DataFrame | None, k: int) -> DataFrame:
    """The members, with the root of their component, of buckets that hold more than one, and the hub of the bucket, another one each round k."""
    named = members.withColumn("root", F.col("h")) if links is None else _near_roots(members, links)
    hub = F.min(F.struct(F.xxhash64("h", F.lit(k)).alias("order"), "h", "root")).alias("hub")
    wide = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), hub).filter("x != y").select("bucket", F.col("hub.h").alias("hub"), F.col("hub.root").alias("hub_root"))
    wide = keep(wide, "wide")
    apart = keep(join_small(named, wide, ["bucket"]), "apart")
    drop_kept(wide)
    return apart


def _listed(n: str) -> Column:
    """How many rare shingles of a set of n have lists: those of which similar sets share one, and some more, of which they share enough."""
    return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * NUM / DEN) + 1 + F.floor(F.col(n) / MORE))


def _rare_lists(names: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """Lists (s, h, root, n, pos): lines by rare shingles of theirs, n the size of a line's set, pos the shingle's place in it."""
    whole = join_small(texts, names, "h").select("h", shingles(F.col("line")).alias("set"))
    sets = keep(whole.select("h", F.size("set").alias("n"), F.explode("set").alias("x")), "shingles")
    often = keep(sets.groupBy("x").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    ranked = sets.join(often, "x").groupBy("h", "n").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("e"))
    # shingles that no other line has come first, as the rarest, so those that are left come after as many
    alone = F.col("n") - F.size("e")
    left = F.greatest(_listed("n") - alone, F.lit(0)).cast("int")
    first = ranked.select("h", "n", alone.alias("alone"), F.posexplode(F.slice("e", F.lit(1), left)).alias("i", "e")).select("h", "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("e.x").alias("s"))
    lists = keep(_rooted(first, links), "lists")
    drop_kept(sets)
    drop_kept(often)
    return lists


def _wide_lists(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one component."""
    wide = lists.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("s")
    return join_small(lists, keep(wide, "wide"), ["s"], "left_semi")


def _links(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Verified links (a, b) between names of lines that share a bucket; None if there is no candidate."""
    links: DataFrame | None = None
    tried: DataFrame | None = None
    before: DataFrame | None = None
    for k in range(STARS + 1):
        apart = _apart(members, links, k)
        drop_kept(members if before is None else before)
        if not apart.limit(1).count():
            drop_kept(apart)
            return links if links is None else stars(links)
        if k == STARS:
            break
        star = apart.filter("root != hub_root").select(*_pair("h", "hub")).distinct()
        star = keep(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = _verified(star, texts)
        links, tried = (new, star) if links is None or tried is None else (links.unionByName(new), tried.unionByName(star))
        members, before = apart.filter("h != hub").select("bucket", "h"), apart
    rest = keep(apart.select("h").distinct(), "rest")
    drop_kept(apart)
    links = stars(links)
    verified: Callable[[DataFrame], DataFrame] = lambda some: _verified(some, texts)
    lists, links, tried = link_by_heads(_rare_lists(rest, texts, links), links, tried, verified, lambda lists, links: keep(_rooted(lists.drop("root"), links), "lists"), NUM, DEN)
    pairs = keep(first_met_pairs(keep(places(_wide_lists(lists), MORE), "places"), NUM, DEN, _listed).join(tried, ["a", "b"], "left_anti"), "pairs")
    return link_left(pairs, links, verified)


def _lines(docs: DataFrame, seed: int) -> DataFrame:
    """id, k (the row's name), no, line and h (the line's name) of every line that isn't blank."""
    rows = docs.select("id", F.xxhash64("id", "text").alias("k"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.withColumn("line", normal_line(F.col("line"))).filter("line != ''").withColumn("h", F.xxhash64(F.lit(seed), "line"))


def _named(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Names of lines that share a bucket, by bucket; all lines that share a bucket or recur."""
    lines = _lines(docs, seed)
    signed = keep(_signatures(lines.select("h", "line")), "signed")
    buckets = signed.select("h", F.explode("bands").alias("bucket"))
    # a line is in a bucket once, so it takes no names to tell that there are several
    multi = keep(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "multi")
    members = keep(join_small(buckets, multi, ["bucket"]).distinct(), "members")
    again = signed.filter("kind = 0 AND n > 1").select("h", F.lit(False).alias("compared"))
    wanted = keep(members.select("h", F.lit(True).alias("compared")).unionByName(again).groupBy("h").agg(F.max("compared").alias("compared")), "wanted")
    found = join_small(lines, wanted, ["h"]).select("id", "k", "no", "h", F.xxhash64(F.lit(seed), F.lit(0), "line").alias("h2"), F.when(F.col("compared"), F.col("line")).alias("line"))
    found = keep(found, "found")
    drop_kept(signed)
    return members, found


@releases_shuffles
def _repeats(docs: DataFrame) -> DataFrame:
    """id, k and the numbers of the lines to drop."""
    for seed in range(8):
        members, found = _named(docs, seed)
        classes = keep(found.groupBy("h").agg(F.min(F.struct("id", "k", "no")).alias("first"), F.count("*").alias("n"), (F.min("h2") != F.max("h2")).alias("clash")), "classes")
        if not classes.filter("clash").limit(1).count():
            break
    texts = keep(found.filter("line IS NOT NULL").groupBy("h").agg(F.first("line").alias("line")), "texts")
    slim = keep(found.select("id", "k", "no", "h"), "found")
    drop_kept(found)
    links = _links(members, texts)
    rooted = _rooted(classes.select("h", "first", "n"), links)
    least = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1").select("root", "keep")
    kept = keep(rooted.join(least, "root").select("h", "keep"), "kept")
    repeats = slim.join(kept, "h").filter(~F.struct("id", "k", "no").eqNullSafe(F.col("keep")))
    return keep(repeats.groupBy("id", "k").agg(F.collect_set("no").alias("drop")), "dropped")


def _without(text: Column, drop: Column) -> Column:
    """The text without the lines of these numbers, in time linear in its lines."""
    return _once(F.split(text, "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop), lambda i: F.get(parts, i)), "\n"))


def fuzzy_line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, text (without the lines that repeat another), n_lines, n_dropped, and other columns to carry."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    dropped = _repeats(rows.select("id", "text"))
    few = dropped.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS
    side = dropped.withColumnRenamed("id", "drop_id").withColumnRenamed("k", "drop_k")
    named = rows.withColumn("k", F.xxhash64("id", "text"))
    joined = named.join(F.broadcast(side) if few else side, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("k") == F.col("drop_k")), "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("drop"))).alias(text_col),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *(F.col(f"carried.`{c}`").alias(c) for c in carry or []),
    )
