"""Merkle manifest of a dataset: an external-memory store of hash-tree nodes, with a proof for every row.

Leaves are digests of whole rows. They are sorted by group and id in range partitions and written as runs; a pass over each run counts
positions, so that a leaf has a coordinate in its group without one task ever holding a group. Each level is a Parquet table of its own and is made in one sequential pass over
the table below it: neighbours of one parent are hashed as they stream by, and only what lies across the end of a run (fewer than two parents a run) is put together
by a shuffle. A node's row has its children's digests. The groups' roots are leaves of one more tree, made by the same code. Proofs go the other way, from the top
level down: each level's table meets the one above by coordinate in a sort-merge join, and the last join hands a leaf the digests to the left and right of its way up.

No step holds a group, a level or a set of groups in one task or on the driver, which sees the number of levels and the root. A group with a
third of all rows is dealt over many partitions, as its coordinates are part of every key. Sizes of groups and first positions of runs are broadcast below a counted bound.

Defined results: null in a column is marked as such and differs from an empty text; a null group is a group, the first one; null ids come first in their
group; rows that repeat group and id are ordered by digest, and each is a leaf; very long texts are hashed whole where they are read, and only digests move;
an empty table gives an empty result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast

from lexmill.llm.common import join_small, keep

FANOUT = 16
#: Rows with ways to the root, of a few kilobytes each, up to which they are broadcast.
FEW_WAYS = 2_000


def field(c: Column) -> Column:
    """A value as it goes into a digest: "-" for null, else its bytes' count, a colon and the value."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))


def row_digest(columns: list[Column]) -> Column:
    """The leaf of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _group_key(c: Column) -> Column:
    """A group as a text that is never null and sorts as the group does, null first."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit(":"), c.cast("string")))


# --- leaves and their coordinates ----------------------------------------------------------------


def _positions(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds, to rows sorted by g, seq (the row's place in its group's rows of this run) and lead (whether the group is the run's first)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").dictionary_encode()
            codes = g.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            at = np.arange(batch.num_rows)
            seq = at - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            head = int(starts[1]) if len(starts) > 1 else batch.num_rows
            name = g.dictionary[int(codes[0])].as_py()
            if name == group:
                seq[:head] += seen
            else:
                first = first and group is None
            lead = np.zeros(batch.num_rows, dtype=bool)
            lead[:head] = first
            group, seen = g.dictionary[int(codes[-1])].as_py(), int(seq[-1]) + 1
            first = first and len(starts) == 1
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in fields], pa.array(seq), pa.array(lead)], names=[*fields, "seq", "lead"])

    return count


def indexed(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """Leaves (g, digest and others) with i, their place in the group by ``order`` and digest from 0, and n, the group's size. Kept as sorted runs."""
    leaves = keep(leaves, f"{name}-unsorted")
    keys = [*order, "digest"]
    runs = leaves.repartitionByRange("g", *keys).sortWithinPartitions("g", *keys).withColumn("run", F.spark_partition_id())
    schema = T.StructType([*runs.schema.fields, T.StructField("seq", T.LongType()), T.StructField("lead", T.BooleanType())])
    runs = keep(runs.mapInArrow(_positions(runs.columns), schema), f"{name}-runs")
    # a run can go on with the group that the run before it ends with: one offset a run, whatever the number of rows or groups
    counts = runs.groupBy("run", "g", "lead").agg(F.count("*").alias("rows"))
    ends = counts.groupBy("run").agg(F.min("g").alias("head"), F.max("g").alias("tail"), F.max_by("rows", "g").alias("last"))
    offsets, group, seen = [], None, 0
    for r in ends.orderBy("run").collect():  # a row a partition
        before = seen if r["head"] == group else 0
        offsets.append((r["run"], before))
        group, seen = r["tail"], r["last"] + (before if r["tail"] == r["head"] else 0)
    spark = leaves.sparkSession
    at = spark.createDataFrame(offsets, "run int, before long")
    sizes = keep(counts.groupBy("g").agg(F.sum("rows").alias("n")), f"{name}-sizes")
    placed = runs.join(broadcast(at), "run").withColumn("i", F.col("seq") + F.when(F.col("lead"), F.col("before")).otherwise(0))
    return join_small(placed.drop("run", "seq", "lead", "before"), sizes, "g")


# --- levels, bottom up ---------------------------------------------------------------------------

_NODE = pa.schema([("g", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("children", pa.list_(pa.string())), ("first", pa.int64()), ("whole", pa.bool_())])


def _gather(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parents of the nodes that stream by in order: with all their children, or with those of a run's end, and the place of the first of these."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, children = None, 0, 0, []
        out: list[tuple] = []

        def close() -> None:
            due = min(fanout, n - key[1] * fanout)
            out.append((key[0], key[1], n, children, first, first % fanout == 0 and len(children) == due))

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=f.type) for k, f in enumerate(_NODE)], schema=_NODE)
            out.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("g", "i", "n", "digest"))
            for g, i, size, digest in zip(*columns):
                if key == (g, i // fanout) and i == first + len(children):
                    children.append(digest)
                    continue
                if key:
                    close()
                key, n, first, children = (g, i // fanout), size, i, [digest]
            yield made()
        if key:
            close()
        yield made()

    return fold


def level_above(nodes: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """The parents (g, i, n, digest, children) of a level's nodes; groups of one node have none."""
    seen = nodes.filter("n > 1").select("g", "i", "n", "digest").mapInArrow(_gather(fanout), "g string, i long, n long, children array<string>, first long, whole boolean")
    seen = keep(seen, f"{name}-seen")
    ends = seen.filter("NOT whole").groupBy("g", "i").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "children"))).alias("e"))
    ends = ends.select("g", "i", "n", F.flatten(F.transform("e", lambda e: e["children"])).alias("children"))
    parents = seen.filter("whole").select("g", "i", "n", "children").unionByName(ends)
    up = F.ceil(F.col("n") / fanout)
    return keep(parents.select("g", "i", up.alias("n"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"), name)


def levels_above(leaves: DataFrame, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels above the leaves, the lowest first."""
    n = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    made: list[DataFrame] = []
    while n > 1:
        made.append(level_above(made[-1] if made else leaves, f"{name}/level={len(made) + 1}", fanout))
        n = -(-n // fanout)
    return made


# --- ways to the root, top down ------------------------------------------------------------------


def _step(children: Column, k: Column) -> Column:
    """What stands to the left and right of child k, as texts."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), k), "").alias("l"), F.array_join(F.slice(children, k + 2, F.greatest(F.size(children) - k - 1, F.lit(0))), "").alias("r"))


def _join_ways(left: DataFrame, right: DataFrame, on: str | list[str], few: bool = False) -> DataFrame:
    """A join with rows that have ways. Their files are small, as neighbours share most of their ways, and Spark would broadcast them for that, though in memory each has kilobytes."""
    return left.join(broadcast(right) if few and right.count() <= FEW_WAYS else right.hint("merge"), on)


def ways(levels: list[DataFrame], tops: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """The lowest level's nodes (g, i, children) with way, the steps from there to the root, lowest first, and what else ``tops`` (g, way) has.

    ``tops`` has the way of each group's own root. Groups of one leaf, which have no nodes, aren't in the result.
    """
    more = [c for c in tops.columns if c not in ("g", "way")]
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].select("g", "i", "n", "children")
        roots = _join_ways(nodes.filter("n = 1"), tops, "g", few=True)
        here = roots.select("g", "i", "children", "way", *more)
        if above is not None:
            each = above.select("g", (F.col("i") * fanout + F.col("k")).alias("i"), F.concat(F.array(_step(F.col("children"), F.col("k"))), F.col("way")).alias("way"), *more)
            here = here.unionByName(_join_ways(nodes.filter("n > 1").select("g", "i", "children"), each, ["g", "i"]))
        here = keep(here, f"{name}/ways={k + 1}")
        above = here.select("*", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("k")) if k else here
    return above


def fold_up(leaf: Column, way: Column) -> Column:
    """The root that a leaf leads to by its way."""
    return F.aggregate(way, leaf, lambda digest, s: F.sha2(F.concat(s["l"], digest, s["r"]), 256))


def proof_digest(way: Column) -> Column:
    """SHA-256 of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row: id, g (a key of the group), leaf, subroot, root, way (steps of left and right siblings from leaf to root), and carried values.

    ``leaf`` and the values of ``carry`` are columns of ``rows``; carried values go along with a leaf and are in no digest.
    """
    carry = carry or {}
    leaves = rows.select(_group_key(F.col(f"`{group_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), F.struct(F.lit(0), *[c.alias(k) for k, c in carry.items()]).alias("more"))
    leaves = indexed(leaves, ["id"], "leaves")
    levels = levels_above(leaves, "nodes", fanout)
    # the groups' roots, ordered by group, are the leaves of one more tree
    subroots = leaves.filter("n = 1").select("g", "digest")
    for nodes in levels:
        subroots = subroots.unionByName(nodes.filter("n = 1").select("g", "digest"))
    top_leaves = indexed(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group"], "roots")
    top_levels = levels_above(top_leaves, "top", fanout)
    tops = top_leaves.select("group", "digest", "i", (F.col("n") == 1).alias("lone"))
    no_way = F.array().cast("array<struct<l:string,r:string>>")
    if top_levels:
        root = top_levels[-1].select(F.col("digest").alias("root"))
        start = root.select(F.lit("").alias("g"), no_way.alias("way"), "root")
        above = ways(top_levels, start, "top", fanout).select(F.col("i").alias("p"), "children", "way", "root")
        tops = tops.withColumn("p", F.floor(F.col("i") / fanout))
        tops = _join_ways(tops, above, "p", few=True).select("group", "digest", F.concat(F.array(_step(F.col("children"), F.pmod(F.col("i"), F.lit(fanout)).cast("int"))), "way").alias("way"), "root")
    else:
        tops = tops.select("group", "digest", no_way.alias("way"), F.col("digest").alias("root"))
    tops = keep(tops.select(F.col("group").alias("g"), "way", F.col("digest").alias("subroot"), "root"), "tops")
    columns = ["id", "g", "leaf", "subroot", "root", "way", "more"]
    lone = _join_ways(leaves.filter("n = 1").withColumnRenamed("digest", "leaf"), tops, "g", few=True).select(columns)
    if not levels:
        out = lone
    else:
        lowest = ways(levels, tops, "nodes", fanout).withColumnRenamed("i", "p")
        each = _join_ways(leaves.filter("n > 1").withColumn("p", F.floor(F.col("i") / fanout)).withColumnRenamed("digest", "leaf"), lowest, ["g", "p"])
        way = F.concat(F.array(_step(F.col("children"), F.pmod(F.col("i"), F.lit(fanout)).cast("int"))), F.col("way"))
        out = each.withColumn("way", way).select(columns).unionByName(lone)
    return out.select(F.col("id").alias(id_col), "g", "leaf", "subroot", "root", "way", *[F.col(f"more.`{k}`").alias(k) for k in carry])
