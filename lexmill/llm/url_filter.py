"""URL filter: longest-match rules over hosts and paths, then gradient-boosted trees on lexical features.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule
decides. Other urls get the verdict of boosted trees on length, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix. The trees are fitted on the driver on at most ``sample`` labelled urls, those first in the order of a
hash; scoring is one narrow pass in Arrow batches, with no shuffle.

The labelled urls of the query are urls of the table whose host has, or has not, one of the words of LABEL_WORDS between dots and
hyphens; the words themselves aren't features.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is scored like any other; an
empty table gives an empty result; repeated rows are judged alike; without both labels in the sample all urls get the base rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import first_by_hash
from lexmill.llm.gbt import BoostedTrees

# Words that mark a labelled host as unwanted.
LABEL_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track")
SAMPLE = 20_000

_LOWER = {c: c + 32 for c in range(65, 91)}
_FORM = re.compile(r"(?s)\A.*?://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for None or without ``://``."""
    m = _FORM.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Rules:
    """(verdict, rule) pairs by host, for the longest rule that fits."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host and at >= 0:
            suffix = host[at:]
            for start, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            at = host.find(".", at) + 1 or -1
        return best


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffix(host: str) -> str:
    return ".".join(host.rsplit(".", 2)[-2:])


def url_features(url: str | None, suffixes: dict[str, float], base: float) -> list[float]:
    u = url or ""
    host, path = split_url(url)
    name = host.rsplit(".", 2)[0] if host.count(".") > 1 else host
    query = u.split("?", 1)[1].split("#", 1)[0] if "?" in u else ""
    n = max(len(u), 1)
    return [
        len(u), len(host), len(path), len(query), path.count("/"), host.count("."), sum(c.isdigit() for c in u) / n, sum(c.isdigit() for c in host),
        host.count("-"), u.count("-"), u.count("_") + u.count("%"), _entropy(host), _entropy(path), query.count("=") + query.count("&"), float("#" in u), float(u.startswith("https")),
        sum(c in "aeiou" for c in name) / max(len(name), 1), max(map(len, re.split(r"[.-]", host))), len(set(host)) / max(len(host), 1), suffixes.get(_suffix(host), base), suffixes.get(host.rsplit(".", 1)[-1], base),
    ]


class UrlModel:
    """Boosted trees with the label rates of host suffixes."""

    def fit(self, urls: list[str | None], labels: list[int]) -> UrlModel:
        y = np.asarray(labels, dtype=float)
        self.base = float(y.mean()) if len(y) else 0.0
        sums: dict[str, list[float]] = {}
        for u, v in zip(urls, labels):
            host = split_url(u)[0]
            for s in {_suffix(host), host.rsplit(".", 1)[-1]}:
                a = sums.setdefault(s, [0.0, 0.0])
                a[0] += v
                a[1] += 1
        self.suffixes = {s: (a + 20 * self.base) / (n + 20) for s, (a, n) in sums.items() if n >= 5}
        self.trees = BoostedTrees(rounds=30, depth=3).fit(self._x(urls), y)
        return self

    def _x(self, urls: list[str | None]) -> np.ndarray:
        return np.array([url_features(u, self.suffixes, self.base) for u in urls], dtype=float).reshape(len(urls), 21)

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.probability(self._x(urls))


def train_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE) -> UrlModel:
    """Fit on at most ``sample`` labelled urls, those with the smallest hashes."""
    picked = labelled.filter(F.col(label_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(label_col).alias("y"))
    rows = first_by_hash(picked, "u", sample).toPandas()
    return UrlModel().fit([u if isinstance(u, str) else None for u in rows["u"]], [int(v) for v in rows["y"]])


def label_by_words(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """url and label: 1 where a word of LABEL_WORDS stands between dots and hyphens of the host."""
    host = F.lower(F.regexp_extract(url_col, "^[^/?#]*://([^/?#]*)", 1))
    return pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), host.rlike(rf"(^|[.-])({'|'.join(LABEL_WORDS)})([.-]|$)").cast("int").alias("label"))


def judge_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score of every url."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    id_type = rows.schema[id_col].dataType.simpleString()
    found = Rules(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            urls = [u if isinstance(u, str) else None for u in b["url"]]
            parts = [split_url(u) for u in urls]
            scores = model.score(urls)
            ruled = [found.find(h, p) for h, p in parts]
            yield pd.DataFrame(
                {
                    id_col: b[id_col],
                    "host": [h for h, _ in parts],
                    "path": [p for _, p in parts],
                    "rule": [r for r, _ in ruled],
                    "verdict": [v or ("block" if s >= 0.5 else "allow") for (_, v), s in zip(ruled, scores)],
                    "score": scores,
                }
            )

    return rows.mapInPandas(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, score double")
