"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks, learned from labelled sentences.

The unit that the kernel compares is what stands between white space in a sentence, in compatibility form (so that mathematical, full-width and
circled letters are plain ones), lower-cased and without outer punctuation; runs of single letters are one unit. What stands apart by as many gap
characters as no subsequence spans makes units of its own. Longer units are taken in windows of ``LONGEST`` characters, one from every ``STEP``
on, so that a stretch of up to ``LONGEST - STEP + 1`` characters lies whole in one wherever it stands. The kernel counts shared subsequences of three characters,
each worth ``DECAY`` to the power of the characters that it skips, normalised; characters that are neither letters nor digits only
widen gaps. So an insult with letters put in or taken apart stays near the insult.

Labels are given for documents, so training is by multiple instances: a labelled document is a bag of its sentences' units; a bag
is as toxic as its most toxic unit. Landmarks are the units most associated with toxic documents and a spread of others. The linear
machine on the landmarks' features K_mm^(-1/2) k(x) is then folded into one weight per character triple, so that scoring a
unit takes its own triples and no landmark; the largest unit score of a document becomes a probability by a logistic curve.

Training runs on the driver on at most ``per_class`` labelled documents of either label, those first by a hash of the id; the
sample is joined by broadcast, as its size has that bound; of rows that repeat an id the greatest text is learned from. Scoring is one narrow pass over whole texts, without a shuffle.

Defined results: a null or empty text has no unit and scores as the least toxic unit seen; very long texts are scored whole, as are very long words; a null id
stays and is judged by its text; null labels are not learned
from; without both labels nothing is toxic (score 0); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import pickle
import re
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import sliced

PER_CLASS = 2000
DECAY = 0.6
SPAN = 7
LONGEST = 24
STEP = 4
LANDMARKS = 200
#: What a Python worker holds: chunks in its cache and their characters, bytes of text at a time.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 1 << 23
SLICE_BYTES = 1 << 22
FOLDS, HELD_OUT = 5, 0

#: Letters with a code each: Latin, Arabic without the stretching mark, and Cyrillic.
_ARABIC = "".join(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)]))
_KNOWN = string.ascii_lowercase + "äöüßéèêëàâçñíóúáîïôûœæ" + _ARABIC + "".join(map(chr, range(0x430, 0x450)))
_SHARED = 9
_SIZE = 128
_START, _END = 126, 127
_CODE = {c: i + 1 for i, c in enumerate(_KNOWN)}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_WIDE = re.compile(r"[\W_]{%d,}" % (SPAN - 1))


def _code(c: str) -> int:
    """0: only a gap. Digits and letters outside the list share codes."""
    if c in _CODE:
        return _CODE[c]
    return len(_KNOWN) + 1 + ord(c) % _SHARED if c.isalnum() and c != "\u0640" else 0


_CODES = np.array([_code(chr(c)) for c in range(0x10000)], dtype=np.int32)
_SPACED = re.compile(r"(?:^|\s)[\W_]?[^\W_][\W_]?\s[\W_]?[^\W_][\W_]?\s[\W_]?[^\W_][\W_]?(?:\s|$)")
_RUN = re.compile(r"(?:(?<=\s)|^)(?:[\W_]*[^\W_][\W_]*\s+){2,}[\W_]*[^\W_][\W_]*(?=\s|$)")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def chunk_units(chunk: str) -> list[str]:
    """The units of what stands between white space: the word without outer punctuation, parted at wide gaps, in windows where long; none for a single character."""
    found = []
    for w in [chunk] if chunk.isalnum() else _WIDE.split(_OUTER.sub("", chunk)):
        if len(w) > LONGEST:
            found += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST + STEP, STEP)]
        elif len(w) > 1:
            found.append(w)
    return found


def runs(text: str) -> list[str]:
    """Single letters in a row, three at least: as one chunk, or where they are more than a unit takes, as one from each letter on."""
    if not _SPACED.search(text):
        return []
    n = LONGEST // 2
    letters = [m.split() for m in _RUN.findall(text)]
    return [" ".join(x[i : i + n]) for x in letters for i in range(max(1, len(x) - n + 1))]


def chunks(text: str) -> set[str]:
    """What the units of a text come from, each once."""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return {*text.split(), *runs(text)}


def units(sentence: str) -> list[str]:
    """What the kernel compares in a sentence."""
    return [u for c in chunks(sentence) for u in chunk_units(c)]


@lru_cache(maxsize=None)
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of three in n characters within SPAN, and their weights."""
    p = [(i, i + a, i + b) for i in range(n) for a, b in itertools.combinations(range(1, SPAN), 2) if i + b < n]
    at = np.array(p, dtype=np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] - 2.0)).astype(np.float32)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their rows, the triples in them, and the weights, normalised by the weight of all places."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, rows in by_length.items():
        i, j, k, place = _places(n + 2)
        for lo in range(0, len(rows), 4000):
            own = rows[lo : lo + 4000]
            points = np.frombuffer("".join([words[r] for r in own]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(own), n)
            codes = np.empty((len(own), n + 2), dtype=np.int32)
            codes[:, 0], codes[:, -1] = _START, _END
            codes[:, 1:-1] = _CODES[np.minimum(points, 0xFFFF)]
            far = points > 0xFFFF
            if far.any():
                codes[:, 1:-1][far] = [_code(chr(p)) for p in points[far].tolist()]
            triple = (codes[:, i] * _SIZE + codes[:, j]) * _SIZE + codes[:, k]
            if codes.all():
                weight = np.broadcast_to(place / max(np.sqrt(place @ place), 1e-6), triple.shape)
            else:  # a gap character is part of no subsequence
                weight = np.where((codes[:, i] > 0) & (codes[:, j] > 0) & (codes[:, k] > 0), place, np.float32(0))
                weight = weight / np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-6)
            yield np.array(own), triple, weight


def decide(words: list[str], theta: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias)
    for rows, triple, weight in features(words):
        out[rows] += np.einsum("nt,nt->n", theta[triple], weight)
    return out


def _spoilt(word: str) -> list[str]:
    """The unit with a character put in, as evasions do."""
    n = len(word)
    return [word[:k] + c + word[k:] for k, c in ((2, "*"), (n // 2, "-"), (n - 2, "x"), (n // 2 + 1, word[n // 2]))] if n > 4 else []


def _kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of words against landmarks; only triples that a landmark has matter."""
    parts = list(features(marks))
    known = np.unique(np.concatenate([t.ravel() for _, t, _ in parts]))
    column = np.zeros((len(known) + 1, len(marks)), dtype=np.float32)
    for rows, triple, weight in parts:
        np.add.at(column, (np.searchsorted(known, triple), rows[:, None]), weight)
    place = np.full(_SIZE**3, len(known), dtype=np.int32)
    place[known] = np.arange(len(known))
    out = np.zeros((len(words), len(marks)), dtype=np.float64)
    for rows, triple, weight in features(words):
        for r, t, w in zip(rows, place[triple], weight):
            has = t < len(known)
            out[r] = w[has] @ column[t[has]]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zo = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + cost * z[on].T @ zo, cost * zo.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class ToxicityModel:
    """theta: a weight per character triple; bias; slope and shift of the logistic curve."""

    def __init__(self) -> None:
        self.theta = np.zeros(_SIZE**3, dtype=np.float32)
        self.bias, self.floor, self.slope, self.shift = 0.0, 0.0, 0.0, -40.0

    def fit(self, texts: Iterable[str | None], labels: Iterable[int], landmarks: int = LANDMARKS) -> ToxicityModel:
        y = np.array(list(labels), dtype=float)
        bags = [sorted({u for s in sentences(t or "") for u in units(s)}) for t in texts]
        if not len(y) or y.min() == y.max():
            return self
        toxic, clean = Counter(), Counter()
        for bag, v in zip(bags, y):
            (toxic if v else clean).update(bag)
        share = y.sum() / len(y)
        lift = {u: np.sqrt(n) * np.log((n + 0.1) / (clean[u] + n + 0.2) / share) for u, n in toxic.items() if n > 1 and n > 2 * share / (1 - share) * clean[u]}
        seeds = sorted(lift, key=lambda u: (-lift[u], u))[: landmarks // 2]
        if not seeds:
            seeds = [u for u, _ in toxic.most_common(landmarks // 4)]
        common = [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: landmarks // 4]]
        spread = sorted(clean)[:: max(1, len(clean) // (landmarks // 4))]
        marks = list(dict.fromkeys([*seeds, *common, *spread]))[:landmarks]
        values, vectors = np.linalg.eigh(_kernel(marks, marks))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
        pool = sorted(set(clean) | set(toxic))
        score = np.array([lift.get(u, -1.0) for u in pool])
        number = {u: k for k, u in enumerate(pool)}
        rows = [np.array([number[u] for u in bag], dtype=np.int64) for bag in bags]
        negative = list(dict.fromkeys([*[number[u] for u in common], *[number[u] for u in sorted(clean)[:: max(1, len(clean) // 2500)]]]))
        mapped: dict[str, np.ndarray] = {}
        for _ in range(4):
            chosen: Counter[int] = Counter()
            for r, v in zip(rows, y):
                if v and len(r):
                    k = int(r[np.argmax(score[r])])
                    if score[k] > 0:
                        chosen[k] += 1
            hard = [int(r[np.argmax(score[r])]) for r, v in zip(rows, y) if not v and len(r)]
            negative = list(dict.fromkeys([*negative, *hard]))
            spoilt = [(v, n / 4) for k, n in chosen.items() if n > 1 for v in _spoilt(pool[k]) if v not in number]
            picked = [*(pool[k] for k in chosen), *(v for v, _ in spoilt), *(pool[k] for k in negative)]
            side = np.r_[np.ones(len(chosen) + len(spoilt)), -np.ones(len(negative))]
            # each unit counts as often as documents with it, up to a bound; toxic documents are fewer, so count for more
            times = np.r_[[min(n, 50) * (1 - share) / share for n in [*chosen.values(), *(n for _, n in spoilt)]], [min(clean[pool[k]], 50) for k in negative]]
            new = [u for u in picked if u not in mapped]
            mapped.update(zip(new, _kernel(new, marks) @ root))
            w = _svm(np.array([mapped[u] for u in picked]), side, np.maximum(times, 0.1))
            beta = root @ w[:-1]
            theta = np.zeros(_SIZE**3)
            for own, triple, weight in features(marks):
                np.add.at(theta, triple, weight * beta[own][:, None])
            self.theta, self.bias = theta.astype(np.float32), float(w[-1])
            score = decide(pool, self.theta, self.bias)
        self.floor = float(score.min())
        top = np.array([score[r].max() if len(r) else self.floor for r in rows])
        self.slope, self.shift = _logistic(top, y)
        return self

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -40, 40)))


def fold_of(id_: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(id_.cast("string").cast("binary")) % FOLDS


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on labelled documents that aren't held out, at most per_class of either label, smallest hashes of the id first."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold_of(F.col(id_col)) != HELD_OUT)).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    parts = [usable.filter(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(per_class) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k")
    rows = rows.groupBy("k", "y").agg(F.max("t").alias("t"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, some = ToxicityModel(), [b for b in batches if b.num_rows]
        if some:
            found = pa.Table.from_batches(some)
            found = found.set_column(2, "t", pc.fill_null(found.column("t"), "")).sort_by([("k", "ascending"), ("t", "ascending")])
            model.fit(found.column("t").to_pylist(), found.column("y").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], type=pa.binary())], names=["model"])

    # the sample goes to a task, so that the driver gets the model alone
    made = rows.select("k", "y", "t").coalesce(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(zlib.decompress(made["model"])) if made else ToxicityModel()


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The id (and other columns to carry), score, predicted."""
    names = list(dict.fromkeys([id_col, *(carry or [])]))
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[str, float] = {}
        held = 0
        for batch in (b for whole in batches for b in sliced(whole, "__text", SLICE_BYTES)):
            texts = batch.column("__text").to_pylist()
            top = np.full(len(texts), m.floor)
            for lo in range(0, len(texts), 512):
                bags = [chunks(t or "") for t in texts[lo : lo + 512]]
                if len(cache) > CACHE_CHUNKS or held > CACHE_CHARS:
                    cache.clear()
                    held = 0
                new = [c for c in set().union(*bags) if c not in cache]
                held += sum(map(len, new))
                parts = [chunk_units(c) for c in new]
                found = iter(decide([u for p in parts for u in p], m.theta, m.bias).tolist())
                cache.update((c, max((next(found) for _ in p), default=m.floor)) for c, p in zip(new, parts))
                for k, bag in enumerate(bags, lo):
                    if bag:
                        top[k] = max(map(cache.__getitem__, bag))
            p = m.probability(top)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(score, f"{fields}, score double, predicted int")
