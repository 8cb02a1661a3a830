"""An index of vectors: cells around centroids, one byte a component, and exact scores for the candidates that are left.

The index is a folder. ``codes`` and ``full`` are partitioned by cell, so a search lists and reads the folders of the cells that its queries probe and nothing else: from
``codes`` the codes (a byte a component and one bound a row), from ``full`` the vectors of the few rows that the codes leave as candidates. ``about`` has the centroids, the bounds of the
codes and the number of probes that reached the asked recall when the index was built. Centroids are fitted on a bounded sample; every vector is in the index.

Codes are linear between two quantiles of all components, as measured in one pass over all of them; what lies outside is clipped. The length of what coding takes from a vector is kept with
its code, so a score is known up to that much: a row stays a candidate unless its best possible score is below the k-th of the worst possible ones. A scan of all cells
therefore gives exactly what a scan of the vectors gives, whatever was clipped; a scan of some cells misses only what lies in the others.

Vectors that are null, empty, of another length, not finite or all zero aren't in the index: they have no direction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.retrieval import QUERIES_MOST, dense_top_k, rounded, small, top_k

#: Vectors a centroid is fitted on, at most; what the driver holds is that times the number of cells.
SAMPLE_A_CELL = 64
CELLS_MOST = 4096
#: Steps of the histogram of components, of which unit vectors have none beyond -1 and 1.
STEPS = 8192
# Fixed value: the share of all components that lies between the bounds of the codes.
QUANTILE = 0.99
LEVELS = 255
#: Rounding of scores, and of sums in doubles.
SLACK = 2e-6


@dataclass
class About:
    """What a search has to know of an index."""

    dimensions: int
    rows: int
    low: float
    step: float
    probes: int
    recall: float
    id_type: str
    centroids: list[list[float]] = field(default_factory=list)


def unit_vectors(vectors: DataFrame, dimensions: int, id_col: str = "chunk_id") -> DataFrame:
    """id, vector as it is, and unit, of length 1; rows without a direction are left out."""
    x = F.transform("vector", lambda v: v.cast("double"))
    rows = vectors.select(id_col, "vector", x.alias("x")).filter((F.size("x") == dimensions) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).filter("norm > 0 AND norm < double('infinity')")
    return rows.select(id_col, "vector", F.transform("x", lambda v: F.try_divide(v, F.col("norm"))).alias("unit"))


def component_bounds(units: DataFrame, quantile: float = QUANTILE) -> tuple[float, float]:
    """The values between which the middle ``quantile`` of all components lies, to 1 / STEPS: from counts by step, which are few whatever the rows."""
    counts = units.select(F.explode("unit").alias("v")).groupBy(F.floor(F.col("v") * STEPS).alias("at")).count().orderBy("at").collect()
    if not counts:
        return -1.0, 1.0
    at, n = np.array([r["at"] for r in counts]), np.cumsum([r["count"] for r in counts])
    out = (1 - quantile) / 2 * n[-1]
    low, high = at[np.searchsorted(n, out, side="right").clip(0, len(at) - 1)], at[np.searchsorted(n, n[-1] - out, side="left").clip(0, len(at) - 1)] + 1
    return max(-1.0, low / STEPS), min(1.0, high / STEPS)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centroids on the sphere, by Lloyd rounds from rows far apart in a fixed order; a cell that empties takes the row worst served."""
    if not len(sample):
        return np.zeros((0, 0))
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        scores = sample @ centroids.T
        own, best = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centroids


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def encode(x: np.ndarray, low: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bytes) of rows, and the length of what they lack."""
    codes = np.clip(np.rint((x - low) / step), 0, LEVELS).astype(np.uint8)
    return codes, np.linalg.norm(x - (low + step * codes), axis=1)


def _in_cells(units: DataFrame, about: About, id_col: str) -> DataFrame:
    centroids = units.sparkSession.sparkContext.broadcast(np.array(about.centroids))
    d, low, step = about.dimensions, about.low, about.step

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("unit"), d)
            cell = (x @ centroids.value.T).argmax(1).astype(np.int32)
            codes, lacks = encode(x, low, step)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lacks), pa.array(cell)], names=[id_col, "vector", "code", "lacks", "cell"])

    schema = T.StructType([units.schema[id_col], units.schema["vector"], *[T.StructField(n, t) for n, t in (("code", T.BinaryType()), ("lacks", T.DoubleType()), ("cell", T.IntegerType()))]])
    return units.mapInArrow(place, schema)


def _write(rows: DataFrame, path: str, id_col: str, mode: str) -> None:
    # by range of cell and id: a cell of any size is dealt over tasks, and its files are sorted by id, which is what candidates are looked up by
    dealt = rows.repartitionByRange("cell", id_col).sortWithinPartitions("cell", id_col)
    dealt.select("cell", id_col, "code", "lacks").write.mode(mode).partitionBy("cell").parquet(f"{path}/codes")
    dealt.select("cell", id_col, "vector").write.mode(mode).partitionBy("cell").parquet(f"{path}/full")


def write_vectors(vectors: DataFrame, path: str, id_col: str = "chunk_id", cells: int | None = None, k: int = 10, recall: float = 0.95) -> About:
    """Build the index of vectors (id, vector) and measure how many probes reach ``recall`` for the k nearest of a bounded sample of them."""
    spark = vectors.sparkSession
    first = vectors.filter("size(vector) > 0").select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    d = first["n"] if first else 0
    units = unit_vectors(vectors, d, id_col)
    n = units.count()
    cells = cells or max(1, min(CELLS_MOST, round(n**0.5)))
    most = SAMPLE_A_CELL * cells
    share = min(1.0, 1.2 * most / max(n, 1) + 0.001)
    chosen = units.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64(id_col), id_col).limit(most)
    held = chosen.select("unit").collect()
    sample = np.array([r["unit"] for r in held], dtype=np.float64).reshape(len(held), d)
    low, high = component_bounds(units)
    about = About(d, n, low, max(high - low, 1 / STEPS) / LEVELS, 1, 1.0, units.schema[id_col].dataType.simpleString(), fit_centroids(sample, cells).tolist())
    if n:
        _write(_in_cells(units, about, id_col), path, id_col, "overwrite")
        _calibrate(spark, path, about, chosen.limit(200).select(F.col(id_col).alias("query_id"), F.col("unit").alias("vector")), id_col, k, recall)
    spark.createDataFrame([(json.dumps(asdict(about)),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return about


def _calibrate(spark: SparkSession, path: str, about: About, queries: DataFrame, id_col: str, k: int, recall: float) -> None:
    """The least number of probes with which the queries find a share of ``recall`` of their k nearest, which are taken from all cells."""
    full = spark.read.parquet(f"{path}/full")
    near = dense_top_k(queries, full, k, id_col).select("query_id", id_col)
    held = near.join(small(queries), "query_id").join(full.select(id_col, "cell"), id_col).select("query_id", "vector", "cell").collect()
    centroids = np.array(about.centroids)
    places = [int((np.array(r["vector"]) @ centroids.T).argsort(kind="stable")[::-1].tolist().index(r["cell"])) for r in held]  # how many nearer cells are probed first
    found = np.cumsum(np.bincount(places, minlength=len(centroids))) / max(len(places), 1)
    about.probes = int(np.searchsorted(found, min(recall, found[-1]))) + 1
    about.recall = float(found[about.probes - 1])


def read_about(spark: SparkSession, path: str) -> About:
    return About(**json.loads(spark.read.text(f"{path}/about").first()["value"]))


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "chunk_id", block: int = 1024) -> DataFrame:
    """The k nearest rows of each query (query_id, vector) by cosine, as dense_top_k() gives them, among the ``probes`` nearest cells (as calibrated; 0: all, which is exact).

    Queries are a stated set; more than QUERIES_MOST go through in blocks by a hash of their id.
    """
    n = queries.count()
    blocks = -(-n // (QUERIES_MOST // 2)) if n > QUERIES_MOST else 1
    if blocks == 1:
        return _nearest(spark, path, queries, k, probes, id_col, block)
    parts = [_nearest(spark, path, queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, probes, id_col, block) for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None, id_col: str, block: int) -> DataFrame:
    about = read_about(spark, path)
    query_type = queries.schema["query_id"].dataType
    if not about.rows:
        return top_k(spark.createDataFrame([], f"query_id {query_type.simpleString()}, {id_col} {about.id_type}, score double"), k, id_col)
    codes, full = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/full")
    got = queries.select("query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector")).filter(F.size("vector") == about.dimensions).toArrow()
    id_type = codes.schema[id_col].dataType
    out = T.StructType([T.StructField("query_id", query_type), T.StructField(id_col, id_type), T.StructField("cell", T.IntegerType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())])
    if not len(got):
        none = spark.createDataFrame([], T.StructType([*out.fields[:2], T.StructField("score", T.DoubleType())]))
        return top_k(none, k, id_col)
    q = np.array(got.column("vector").to_pylist(), dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    order = np.argsort(-(q @ np.array(about.centroids).T), axis=1, kind="stable")[:, : (probes if probes is not None else about.probes) or None]
    probed = np.zeros((len(q), len(about.centroids)), dtype=bool)
    np.put_along_axis(probed, order, True, axis=1)
    cells = [int(c) for c in np.flatnonzero(probed.any(0))]
    shared = spark.sparkContext.broadcast((got.column("query_id").combine_chunks(), q, probed))
    d, low, step = about.dimensions, about.low, about.step

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m, asked = shared.value
        bar = np.full(len(m), -np.inf)  # of the task so far: the k-th best of each query's least scores
        tops = np.full((len(m), k), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def still(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            return tuple(c[part[3] >= bar[part[0]]] for c in part)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                cell = part.column("cell").to_numpy()
                x = low + step * np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, d)
                lacks = part.column("lacks").to_numpy() + SLACK
                scores = m @ x.T
                scores[~asked[:, cell]] = -np.inf
                least = scores - lacks
                tops = -np.sort(-np.concatenate([tops, least], axis=1), axis=1)[:, :k]
                bar = tops[:, k - 1]
                query, row = np.nonzero((scores + lacks >= bar[:, None]) & np.isfinite(scores))
                own = np.array(part.column(id_col).to_pylist(), dtype=object)
                held.append((query, own[row], cell[row], (scores + lacks)[query, row], least[query, row]))
                rows += len(query)
                if rows > 4 * k * len(m) + 100_000:
                    held = [still(tuple(np.concatenate(c) for c in zip(*held)))]
                    rows = len(held[0][0])
        if held:
            query, own, cell, most, least = still(tuple(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(own.tolist(), type=part.column(id_col).type), pa.array(cell.astype(np.int32)), pa.array(least), pa.array(most)], names=["query_id", id_col, "cell", "least", "most"])

    found = codes.filter(F.col("cell").isin(cells)).select(id_col, "code", "lacks", "cell").mapInArrow(scan, out)
    ranked = top_k(found.withColumnRenamed("least", "score"), k, id_col).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n"))
    bars = ranked.select("query_id", F.when(F.col("n") < k, F.lit(float("-inf"))).otherwise(F.col("bar")).alias("bar"))
    left = found.join(F.broadcast(bars), "query_id").filter("most >= bar").select("query_id", id_col, "cell")
    vectors = full.filter(F.col("cell").isin(cells))
    # at most QUERIES_MOST rows
    asked = F.broadcast(spark.createDataFrame(list(zip(got.column("query_id").to_pylist(), q.tolist())), T.StructType([T.StructField("query_id", query_type), T.StructField("q", T.ArrayType(T.DoubleType()))])))
    x = F.transform("vector", lambda v: v.cast("double"))
    rows = left.join(vectors, ["cell", id_col]).join(asked, "query_id")
    cosine = F.aggregate(F.zip_with("q", x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return top_k(rows.select("query_id", id_col, rounded(cosine, 6).alias("score")), k, id_col)
