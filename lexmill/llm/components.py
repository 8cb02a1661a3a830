"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, drop_kept, keep

#: Rounds in which each node tries its likeliest partner and some others, before all pairs that are left are tried.
ROUNDS = 3
#: How many others: enough that nodes of which each is like a part of the others only are soon one component.
OTHERS = 6
#: Members of other components that a place on a list meets on average, beyond which heads of lists are tried before pairs are made.
MEETS = 16


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Links of each node to the least of its neighbours and itself: its larger neighbours' (large) or its own and smaller ones' (small)."""
    side = F.broadcast if few else lambda df: df
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(side(least), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))  # u > v in all edges
        out = edges.join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter(F.col("u") != F.col("v")).distinct()
    return out.coalesce(8) if few else out


def stars(links: DataFrame) -> DataFrame:
    """The components of the links (a, b) as links again, kept: one from each node that isn't the least of its component to that one. Hubs are handled by aggregates and split joins.

    Links that are stars already take no round, so components may be carried on as stars, with new links added.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    while True:
        # u > v in all edges; they are stars when each node has one end of its own, or is the other one of others'
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("own")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("own")).distinct())
        r = ends.groupBy("x").agg(F.count("*").alias("ends"), F.sum("own").alias("own")).agg(F.max("ends").alias("ends"), F.sum("own").alias("n")).first()
        if (r["ends"] or 0) < 2:
            return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
        few = r["n"] <= BROADCAST_ROWS  # no star has more links than twice the one before
        new = keep(_star(_star(edges, True, few), False, few), "edges")
        drop_kept(edges)
        edges = new


def star_roots(links: DataFrame) -> DataFrame:
    """node and root for every node of stars()."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the links (a, b)."""
    return star_roots(stars(links))


def _best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """For each node its pair with most room for an overlap, and OTHERS by a hash, another one each round: so many rows for each node at most."""
    pair = F.struct("a", "b").alias("pair")
    ends = pairs.select(F.col("a").alias("node"), "room", pair).unionByName(pairs.select(F.col("b").alias("node"), "room", pair))
    orders = [F.struct("room", "pair"), *[F.struct(F.xxhash64("pair", F.lit(k * OTHERS + i)).alias("room"), "pair") for i in range(OTHERS)]]
    some = ends.groupBy("node").agg(*[F.max(order).alias(f"o{i}") for i, order in enumerate(orders)])
    return some.select(F.explode(F.array(*[f"o{i}.pair" for i in range(len(orders))])).alias("pair")).select("pair.a", "pair.b").distinct()


def _meets(lists: DataFrame) -> float:
    """How many members of other components a place of the lists meets on average."""
    own = lists.groupBy("s", "root").agg(F.count("*").cast("double").alias("c")).groupBy("s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    r = own.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") - F.col("same")).alias("other")).first()
    return r["other"] / r["n"] if r["n"] else 0.0


def _head_pairs(lists: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets with heads of lists that hold one of their rarest ninth (for 0.8), another head each round: at most one row for a place, and a few pairs for each set."""
    heads = lists.groupBy("s").agg(F.min(F.struct(F.xxhash64("h", "s", F.lit(k)).alias("order"), "h", "n", "pos", "root")).alias("head"))
    heads = heads.select("s", *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("h", "n", "pos", "root")])
    n, m, p, q = F.col("n"), F.col("head_n"), F.col("pos"), F.col("head_pos")
    room = F.least(p, q) + 1 + F.least(n - p - 1, m - q - 1)
    may = (F.col("root") != F.col("head_root")) & (room * (num + den) >= (n + m) * num) & (F.least(n, m) * den >= F.greatest(n, m) * num)
    rare = lists.filter(p <= n - F.ceil(n * 2 * num / (num + den)))
    met = rare.join(heads, "s").filter(may).groupBy(F.greatest("h", "head_h").alias("a"), F.least("h", "head_h").alias("b")).agg(F.count("*").alias("room"))
    return _best_pairs(met, k)


def link_by_heads(lists: DataFrame, links: DataFrame, tried: DataFrame, verified: Callable[[DataFrame], DataFrame], rooted: Callable[[DataFrame, DataFrame], DataFrame], num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists (s, h, root, n, pos), links (stars, as those given) and pairs tried (a, b), after rounds in which sets try heads of their lists.

    Where lists hold many components their pairs grow with the square of a list, so as many as can be become one component before any are
    made, in rounds that have a row for a place at most; they end when places meet few others, or no fewer than before by a tenth. No pair is given up by it.
    """
    k, before = 0, None
    while (meets := _meets(lists)) > MEETS and (before is None or meets <= 0.9 * before):
        pairs = keep(_head_pairs(lists, k, num, den).join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = stars(links.unionByName(verified(pairs))), tried.unionByName(pairs)
        old, lists = lists, rooted(lists, links)
        drop_kept(old)
        k, before = k + 1, meets
    return lists, links, tried


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    x, y = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "room")


def link_left(across: DataFrame, links: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links (a, b; stars), and those among the kept pairs (a, b, room) that join other components, by ``verified``, as stars.

    Likely pairs come first, a few for each node, as each link makes others needless; in the end all go through that still have ends in
    different components, so the components are those of all pairs.
    """
    for k in range(ROUNDS + 1):
        if not across.limit(1).count():
            break
        now = keep(_best_pairs(across, k), "tried") if k < ROUNDS else across.select("a", "b")
        links = stars(links.unionByName(verified(now)))
        if k < ROUNDS:
            before = across
            across = keep(_apart(across, star_roots(links)).join(now, ["a", "b"], "left_anti"), "pairs")
            drop_kept(before)
            drop_kept(now)
    return links
