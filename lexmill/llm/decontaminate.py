"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts are canonicalised: punctuation goes, and numbers, units after numbers, and names inside a sentence become typed placeholders. Other
capitalised words, as at the start of a sentence, may be names or not: windows over them are also taken with placeholders. Windows
of WINDOW canonical words are hashed and joined with the windows of the benchmark items; a document and an item match where windows
cover at least COVER of the item's. For items with slots, the words at the placeholders are compared: a re-parameterised question
puts one value for each of the item's, wherever it stands. Where more than a fifth of the slots contradict that over all places, each
occurrence is judged by itself: the windows at one shift between item and document, give or take DRIFT words, and at each slot the value
at the nearest shift. It is a match if an occurrence covers enough and is consistent, or if enough windows are there word for word. Items with fewer words than a window are one window of their own length.

Documents are read once for the windows; each word's hash is taken once, and windows are hashes of those, by steps that double them. The benchmark's windows are
broadcast only while they are few (BROADCAST_ROWS); beyond that the join shuffles the documents' windows. Matches are aggregated by
document and item, so a passage that a third of all documents share spreads over as many keys.

Defined results: null and blank texts match nothing; very long texts are read whole; rows that repeat an id are one document; rows without an id are each judged by
their own text, and those of equal text are one document; repeated items each match by themselves; empty tables give empty results; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import join_small, keep

WINDOW = 8
COVER = 0.5
CONTRADICTED = 0.2
DRIFT = 4
BROADCAST_ROWS = 1_000_000

# Words that are units where they follow a number.
UNITS = (
    "%|percent|°c|°f|km|kilometers?|kilometres?|m|meters?|metres?|cm|mm|miles?|mi|ft|feet|foot|inch|inches|yards?|kg|kilograms?|g|grams?|mg|lbs?|pounds?|oz|ounces?|tons?|"
    "l|liters?|litres?|ml|gallons?|cups?|s|sec|seconds?|min|minutes?|h|hr|hours?|days?|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|pence|yen|"
    "mph|kmh|km/h|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|v|volts?|watts?|joules?|j|n|newtons?|pa|bar|degrees?"
)
_MARK = "\x01"
_MAYBE = "\x02"  # before a word that may be a name
# the first character is looked at before what stands around it, which at most places needn't be
_NAME = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+"
_NUMBER = r"(?=[+\-\p{Nd}])(?<![\p{L}\p{N}])[+-]?\p{Nd}[\p{Nd}.,:/]*"
_UNIT = rf"(?i)({_MARK}num[ ]?)(?:{UNITS})(?![\p{{L}}\p{{N}}])"
_CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{_MARK}])\p{{Lu}}\p{{Ll}}+"
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}{_MARK}{_MAYBE}\s]+"


def _split(text: Column) -> Column:
    """Words without punctuation; no word for a blank text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _PUNCTUATION, ""), r"\s+", " "))
    return F.array_remove(F.split(bare, " "), "")


def canonical(text: Column) -> Column:
    """The text with placeholders for names, numbers and units; words keep their places."""
    sure = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _NAME, f"{_MARK}name"), _NUMBER, f"{_MARK}num"), _UNIT, f"$1{_MARK}unit")
    return F.regexp_replace(sure, _CAPITAL, f"{_MAYBE}$0")


def _paired(words: str, step: int) -> Column:
    """Hashes of each element and the one so many places on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + step)))


def _windowed(rows: DataFrame, sizes: list[int], *more: str) -> DataFrame:
    """id, more and x, a row per window: (at, size, w), the hashes of all windows of each size over ``hashes``, and over ``others`` where these differ.

    Hashes of 2, 4, 8, ... words are made of two of half as many, in a step each; a window is hashed from one of them for each power of two in its size.
    """
    powers = [1 << k for k in range(max(sizes).bit_length())]
    needed = {p for p in powers for size in sizes if size & p}
    rows = rows.select("id", *more, "maybe", *[F.col(c).alias(f"{c}1") for c in ("hashes", "others")])
    for p in powers[1:]:
        paired = [_paired(f"{c}{p // 2}", p // 2).alias(f"{c}{p}") for c in ("hashes", "others")]
        rows = rows.select("id", *more, "maybe", *[F.col(f"{c}{q}") for c in ("hashes", "others") for q in powers if q in needed | {1} and q < p], *paired)

    def of(size: int) -> Column:
        last = F.size("hashes1") - size
        none = F.array().cast("array<int>")
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)

        def first_over(p: Column, j: Column) -> Column:
            """Starts of the windows of which p is the first place in maybe."""
            lo, hi = F.greatest(p - size + 1, F.coalesce(F.get("maybe", j - 1) + 1, F.lit(0)), F.lit(0)), F.least(p, last)
            return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)

        again = F.flatten(F.transform("maybe", first_over))
        parts = [(p, size & ~(2 * p - 1)) for p in reversed(powers) if size & p]  # and where each starts in the window

        def hashed(at: Column, words: str) -> Column:
            return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), *[F.get(f"{words}{p}", i + k) for p, k in parts]).alias("w")))

        return F.concat(hashed(starts, "hashes"), hashed(again, "others"))

    return rows.select("id", *more, F.explode(of(sizes[0]) if len(sizes) == 1 else F.concat(*map(of, sizes))).alias("x"))


def _hashed(rows: DataFrame, *more: str) -> DataFrame:
    """words: canonical; hashes: of each word; others: with placeholders for words that may be names; maybe: where these are."""
    split = rows.select("id", *more, _split(canonical(F.col("text"))).alias("words"))
    return split.select(
        "id",
        *more,
        "words",
        F.transform("words", lambda w: F.xxhash64(F.replace(w, F.lit(_MAYBE), F.lit("")))).alias("hashes"),
        F.transform("words", lambda w: F.xxhash64(F.when(w.contains(_MAYBE), f"{_MARK}name").otherwise(w))).alias("others"),
        F.filter(F.transform("words", lambda w, i: F.when(w.contains(_MAYBE), i)), lambda i: i.isNotNull()).alias("maybe"),
    )


def _told(values: DataFrame, by: list[str]) -> DataFrame:
    """n_slots, n_contradicted and n_changed of distinct (slot, item_value, doc_value)."""
    told = values.groupBy(*by, "item_value", "doc_value").agg(F.count_distinct("slot").alias("n"))
    told = told.groupBy(*by, "item_value").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count_if(F.col("doc_value") != F.col("item_value")).alias("changed"))
    return told.groupBy(*by).agg(F.sum("n").alias("n_slots"), F.sum(F.col("n") - F.col("most")).alias("n_contradicted"), F.sum("changed").alias("n_changed"))


def _by_occurrence(lines_up: DataFrame, slots: DataFrame, words: DataFrame, counts: DataFrame, window: int, cover: float) -> DataFrame:
    """id, key and what _told() tells of the best occurrence, of those that are consistent; windows that are there word for word tell of no change."""
    lines_up = keep(lines_up.distinct(), "lines_up")
    at_slots = lines_up.join(slots, "key").filter(F.col("slot").between(F.col("item_at"), F.col("item_at") + window - 1))
    put = at_slots.withColumn("doc_at", F.col("slot") + F.col("shift")).join(words, ["id", "doc_at"])
    put = keep(put.select("id", "key", "shift", "item_at", "slot", "item_value", "doc_value"), "put")
    near = F.explode(F.sequence(F.col("shift") - DRIFT, F.col("shift") + DRIFT))
    enough = lines_up.withColumn("base", near).groupBy("id", "key", "base").agg(F.count_distinct("item_at").alias("n")).join(counts.select("key", "n_windows"), "key")
    enough = enough.filter(F.col("n") >= cover * F.col("n_windows")).select("id", "key", "base")
    nearest = F.min(F.struct(F.abs(F.col("shift") - F.col("base")).alias("off"), "shift", "item_value", "doc_value")).alias("x")
    values = put.select("id", "key", "shift", "slot", "item_value", "doc_value").distinct().withColumn("base", near).groupBy("id", "key", "base", "slot").agg(nearest)
    values = values.select("id", "key", "base", "slot", "x.item_value", "x.doc_value").join(enough, ["id", "key", "base"], "left_semi")
    told = _told(values, ["id", "key", "base"]).filter(F.col("n_contradicted") <= CONTRADICTED * F.col("n_slots"))
    best = told.groupBy("id", "key").agg(F.min(F.struct("n_contradicted", "n_changed", (-F.col("n_slots")).alias("less"))).alias("x"))
    best = best.select("id", "key", (-F.col("x.less")).alias("n_slots"), "x.n_contradicted", "x.n_changed")
    # word for word: windows without a changed slot
    whole = lines_up.join(put.filter("doc_value != item_value").select("id", "key", "shift", "item_at").distinct(), ["id", "key", "shift", "item_at"], "left_anti")
    whole = whole.groupBy("id", "key").agg(F.count_distinct("item_at").alias("n")).join(counts.select("key", "n_windows"), "key").filter(F.col("n") >= cover * F.col("n_windows"))
    literal = whole.join(slots.groupBy("key").agg(F.count("*").alias("n_slots")), "key").select("id", "key", "n_slots", F.lit(0).cast("long").alias("n_contradicted"), F.lit(0).cast("long").alias("n_changed"))
    return literal.unionByName(best.join(literal, ["id", "key"], "left_anti"))


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, cover: float = COVER
) -> DataFrame:
    """One row per matching document and item: id, item, n_windows, n_matched, coverage, n_slots, n_contradicted, kind (verbatim or reparameterised)."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    items = keep(_hashed(items, "item", "text").filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window))), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW values at most
    # a row is known by its id, or where it has none by its text, so that no join loses it and no two of them mix
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(F.struct(id_.alias("id"), F.when(id_.isNull(), F.sha2(text, 256)).alias("text")).alias("id"), text.alias("text"))
    if not sizes:
        sizes = [window]
    own = _windowed(items, sizes, "item", "size")
    wanted = keep(own.filter("x.size = size").select("item", F.col("id").alias("key"), F.col("x.at").alias("item_at"), F.col("x.w").alias("w")).distinct(), "wanted")
    counts = wanted.groupBy("key").agg(F.first("item").alias("item"), F.count_distinct("item_at").alias("n_windows"))
    found = _windowed(_hashed(rows), sizes).select("id", F.col("x.at").alias("at"), F.col("x.w").alias("w"))
    side = wanted.select("w", "key", "item_at")
    hits = keep(found.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, "w").select("id", "at", "key", "item_at"), "hits")
    matched = hits.groupBy("id", "key").agg(F.count_distinct("item_at").alias("n_matched"))
    covered = keep(matched.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "key").filter(F.col("n_matched") >= cover * F.col("n_windows")), "covered")

    # slots: the words that stand at the placeholders of items that matched
    raw_items = items.select(F.col("id").alias("key"), "words", _split(F.col("text")).alias("raw"))
    slots = raw_items.select("key", F.posexplode("words").alias("slot", "word"), "raw").filter(F.col("word").contains(_MARK) | F.col("word").contains(_MAYBE)).select("key", "slot", F.get("raw", F.col("slot")).alias("item_value"))
    slots = keep(slots, "slots")
    if not slots.limit(1).count():
        judged = covered.withColumn("n_slots", F.lit(0).cast("long")).withColumn("n_contradicted", F.lit(0).cast("long")).withColumn("n_changed", F.lit(0).cast("long"))
    else:
        few_slots = slots.count() <= BROADCAST_ROWS
        pairs = covered.select("id", "key").join(F.broadcast(slots.select("key").distinct()) if few_slots else slots.select("key").distinct(), "key", "left_semi")
        lines_up = hits.join(pairs, ["id", "key"], "left_semi").select("id", "key", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
        at_slots = lines_up.join(F.broadcast(slots) if few_slots else slots, "key").filter(F.col("slot").between(F.col("item_at"), F.col("item_at") + window - 1))
        places = keep(at_slots.select("id", "key", "slot", "item_value", (F.col("slot") + F.col("shift")).alias("doc_at")).distinct(), "places")
        wanted_docs = places.select("id").distinct()
        some = rows.join(F.broadcast(wanted_docs) if wanted_docs.count() <= BROADCAST_ROWS else wanted_docs, "id", "left_semi")
        words = some.select("id", F.posexplode(_split(F.col("text"))).alias("doc_at", "doc_value"))
        values = words.join(places, ["id", "doc_at"]).select("id", "key", "slot", "item_value", "doc_value").distinct()
        # each value of the item must have one value in the document; the commonest counts as right
        told = keep(_told(values, ["id", "key"]), "told")
        agreed = F.col("n_contradicted") <= CONTRADICTED * F.col("n_slots")
        apart = keep(told.filter(~agreed).select("id", "key"), "apart")
        if apart.limit(1).count():
            told = told.filter(agreed).unionByName(_by_occurrence(join_small(lines_up, apart, ["id", "key"], "left_semi"), slots, words, counts, window, cover))
        judged = covered.join(told, ["id", "key"], "left").fillna(0, ["n_slots", "n_contradicted", "n_changed"])
        judged = judged.join(apart, ["id", "key"], "left_anti").unionByName(judged.join(apart, ["id", "key"], "left_semi").filter("n_slots > 0"))
    return judged.filter(F.col("n_contradicted") <= CONTRADICTED * F.col("n_slots")).select(
        F.col("id.id").alias(id_col),
        F.col("item").alias(item_col),
        "n_windows",
        "n_matched",
        (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        "n_slots",
        "n_contradicted",
        F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )
