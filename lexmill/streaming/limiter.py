"""Sliding-window request limiter: at most ``limit`` accepted requests per client in ``window`` seconds; denied ones don't count.

Whether a request is accepted depends on those accepted before, so the exact form is a fold over a client's requests in order; the state of
a client is the times of its accepted requests in the window, at most ``limit``. The same fold runs in batch and stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Routes that the limiter counts, and those that need no key.
LIMITED_PREFIXES = ("/api/search", "/api/chat", "/mcp")
OPEN_PATHS = ("/api/health", "/docs", "/openapi.json")


def fold(times: Iterable[float], limit: int, window: float, held: Iterable[float] = ()) -> tuple[list[bool], list[float]]:
    """Whether each request is accepted, and the accepted times that still count."""
    kept = deque(held)
    out = []
    for t in times:
        while kept and kept[0] < t - window:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, list(kept)


def window_log(requests: DataFrame, window: int = 60) -> DataFrame:
    """Requests with how many their client made in the window before (one exactly as old counts) and with them: an upper bound, in native windows."""
    w = Window.partitionBy("client").orderBy(F.col("micros")).rangeBetween(-window * 1_000_000, 0)
    return requests.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("n_recent", F.count("*").over(w)).drop("micros")


def limit_requests(requests: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """client, request_id, accepted; requests without a client are one client's. Rows are sorted by client and time and folded as they stream by, so a client isn't held in memory."""
    rows = requests.select("client", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")).repartition("client").sortWithinPartitions("client", "micros", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, held, first = None, [], True
        for batch in batches:
            accepted: list[bool] = []
            for name, part in batch.groupby("client", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if name != client or first:
                    first = False
                    client, held = name, []
                ok, held = fold(part["micros"] / 1e6, limit, window, held)
                accepted += ok
            yield pd.DataFrame({"client": batch["client"], "request_id": batch["request_id"], "accepted": accepted})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"client {kinds['client']}, request_id {kinds['request_id']}, accepted boolean")


def client_key(forwarded: Column | str, peer: Column | str) -> Column:
    """Who asks: the first forwarded address, else the peer, else ``unknown``."""
    first = F.trim(F.split_part(F.col(forwarded) if isinstance(forwarded, str) else forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(F.col(forwarded) != "", first) if isinstance(forwarded, str) else first, F.col(peer) if isinstance(peer, str) else peer, F.lit("unknown"))


def in_scope(requests: DataFrame, prefixes: tuple[str, ...] = LIMITED_PREFIXES) -> DataFrame:
    """The requests (method, path) that the limiter counts."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("path").startswith(p)
    return requests.filter((F.col("method") == "POST") & hit)


def guard_status(requests: DataFrame, api_key: str | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """Adds status to requests (method, path, key, content_length as text): 401 without the key, 413 for large and 400 for odd lengths of posts, else 200."""
    keyed = F.lit(False) if not api_key else ~((F.col("method") == "OPTIONS") | F.col("path").isin(*OPEN_PATHS)) & ~F.col("key").eqNullSafe(F.lit(api_key))
    post = (F.col("method") == "POST") & F.col("content_length").isNotNull()
    number = F.trim("content_length").try_cast("decimal(38,0)")
    odd = ~F.trim("content_length").rlike("^[+-]?[0-9]+$")
    return requests.withColumn("status", F.when(keyed, 401).when(post & odd, 400).when(post & (number > most_bytes), 413).otherwise(200))


def health_state(probes: DataFrame) -> DataFrame:
    """Adds state to probes (status, null where nothing answered): online, degraded or offline."""
    return probes.withColumn("state", F.when(F.col("status").isNull(), "offline").when(F.col("status") == "ok", "online").otherwise("degraded"))


def limit_stream(requests: DataFrame, limit: int = 60, window: float = 60.0, delay: float | None = None, prefixes: tuple[str, ...] | None = None) -> DataFrame:
    """The same on a stream of (client, request_id, ts), with the accepted times as state; with ``prefixes`` of the requests (method, path) in scope only.

    The state of a client goes when the watermark, ``delay`` seconds (the window) behind the latest request, is past all that still counts, so there is state for the clients of
    the last while only. Requests older than the watermark are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if prefixes is not None:
        requests = in_scope(requests, prefixes)
    kinds = dict(requests.dtypes)
    rows = requests.select("client", "request_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{window if delay is None else delay} seconds")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        part = pd.concat(list(frames)).sort_values(["ts", "request_id"], kind="stable")
        ok, held = fold(part["ts"].map(lambda t: t.timestamp()), limit, window, held)
        ends = int((held[-1] + window) * 1000) + 1 if held else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((held,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": part["client"], "request_id": part["request_id"], "accepted": ok})

    return rows.groupBy("client").applyInPandasWithState(update, f"client {kinds['client']}, request_id {kinds['request_id']}, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
