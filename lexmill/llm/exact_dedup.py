"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by (leading bytes of the text, hash, id); each partition is sorted externally by
(leading bytes, hash, whole text, id), so equal texts lie next to each other, and neighbours are compared in full. The splitters hold
64 bytes of a text at most, so the sample that the driver sees is small. The id is part of the key, so that a group of
copies of any size is dealt over many partitions; only the first and last run of a partition can go on in the next, and
those (two a partition at most) are merged by digest.

Defined results: a null text counts as empty and equals other empty texts; null ids are never kept while the group has
another id; of rows that repeat an id and text one is kept; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import keep as keep_table

PREFIX_BYTES = 64


def _runs(keep: str, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema(
        [("id", id_type), ("digest", pa.string()), ("run_keep", id_type), ("run_n", pa.int64()), ("edge", pa.bool_()), ("lead", pa.bool_()), ("new_id", pa.bool_())]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        TaskContext.get()
        text, ids, first = None, [], True
        rows: dict[str, list] = {k: [] for k in schema.names}

        def close(last: bool) -> None:
            nonlocal first
            known = [x for x in ids if x is not None]
            best = (max(known) if keep == "max" else min(known)) if known else None
            n = len(ids)
            rows["id"] += ids
            rows["digest"] += [hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()] * n
            rows["run_keep"] += [best] * n
            rows["run_n"] += [n] * n
            rows["edge"] += [first or last] * n
            rows["lead"] += [True] + [False] * (n - 1)
            rows["new_id"] += [True] + [a != b for a, b in zip(ids, ids[1:])]
            first = False

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                if t != text:
                    if ids:
                        close(last=False)
                    text, ids = t, []
                ids.append(i)
            if len(rows["id"]) >= 4096:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)
                rows = {k: [] for k in schema.names}
        if ids:
            close(last=True)
        if rows["id"]:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return fold


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(t) if normalise else t).alias("t"))
    id_type = rows.schema["id"].dataType
    rows = rows.select("id", "t", F.substring(F.encode("t", "UTF-8"), 1, PREFIX_BYTES).alias("p"), F.xxhash64("t").alias("h"))
    ordered = rows.repartitionByRange("p", "h", "id").sortWithinPartitions("p", "h", "t", "id").select("id", "t")
    schema = T.StructType(
        [
            T.StructField("id", id_type), T.StructField("digest", T.StringType()), T.StructField("run_keep", id_type), T.StructField("run_n", T.LongType()),
            T.StructField("edge", T.BooleanType()), T.StructField("lead", T.BooleanType()), T.StructField("new_id", T.BooleanType()),
        ]
    )
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
    runs = keep_table(ordered.mapInArrow(_runs(keep, arrow_id), schema), "runs")
    best = F.max if keep == "max" else F.min
    # two runs a partition at most: a size bound by the number of partitions, whatever the input
    edges = runs.filter("edge AND lead").groupBy("digest").agg(best("run_keep").alias("all_keep"), F.sum("run_n").alias("all_n"))
    joined = runs.join(F.broadcast(edges), "digest", "left")
    keep_id = F.when(F.col("edge"), F.col("all_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.col("all_n")).otherwise(F.col("run_n")).alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & F.col("new_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
