"""Benchmark decontamination by template windows, in DataFrame operations only.

Numbers, units and names become typed placeholders, so a question whose numbers
or names were replaced keeps its template. Windows of ``WINDOW`` template words
of the documents are hash-joined to those of the benchmark. A leak is a run of
``NEEDED`` consecutive windows of an item that a document holds in one alignment
with consistent slots: within the run each value of the item stands for one
value of the document, and the other way round. Windows elsewhere, whatever
their values, take nothing away from a run. Windows with names are joined a second time with the names as words, so a copy
whose names are not marked (lower-case, or the first word of a line) is met too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, without_keys

WINDOW = 8
#: Consecutive windows that make a leak: 13 words. A shorter item needs all of its windows.
NEEDED = 6
#: Literal words that a window must have to be joined by its template; with fewer it is joined by its values.
LITERALS = 4
#: The benchmark's windows are broadcast up to so many, and so many bytes of slots, and shuffled beyond.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20

NUMBER, NAME, UNIT = "", "", ""
MARKS = f"{NUMBER}-{UNIT}"
# Units that may follow a number.
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|feet|foot|yd|yards?|mi|miles?|mg|g|kg|t|tons?|tonnes?|lb|lbs|pounds?|oz|ounces?|ml|cl|dl|l|liters?|litres?|gallons?"
    "|ms|s|sec|secs|seconds?|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?"
    "|dollars?|euros?|cents?|usd|eur|gbp|percent|pct|degrees?|hz|khz|mhz|ghz|w|kw|mw|v|a|kb|mb|gb|tb|mph|kmh"
)

# Signs and white space, as plain ranges: what is none of these is a word's character.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\xD7\xF7 -⁯　-〿"
_GAP_BUT_SEPARATORS = r"\x00-\x2B\x2D\x3B-\x40\x5B-\x60\x7B-\xBF\xD7\xF7 -⁯　-〿"


def _named(text):
    """Marks names: capitalised words right after a lower-case word, a number, a comma or a semicolon."""
    raw = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    return F.regexp_replace(raw, r"\p{Lu}(?<=[\p{Ll}0-9,;] \p{Lu})(?=\p{Ll})", NAME + "$0")


def _numbered(named):
    """Marks numbers and the units after them; separators stay inside numbers only."""
    marked = F.regexp_replace(named, r"[0-9](?<![\p{L}0-9].)(?<![0-9][.,:/].)", NUMBER + "$0")
    parted = F.regexp_replace(marked, r"([0-9])(?=\p{L})", "$1 ")
    united = F.regexp_replace(F.regexp_replace(parted, r"([0-9]) ?[%°€£$]", f"$1 {UNIT}"), rf"([0-9] )(?i)(?=(?:{UNITS})(?!\p{{L}}))", f"$1{UNIT}")
    return F.regexp_replace(united, rf"(?:[{_GAP_BUT_SEPARATORS}]|[.,:/](?<![0-9].)|[.,:/](?![0-9]))+", " ")


def surface(text):
    """The words of a text, lower-case and without signs; slots carry their mark and their value."""
    named = _named(text)
    return F.trim(F.lower(F.when(named.rlike("[0-9]"), _numbered(named)).otherwise(F.regexp_replace(named, f"[{_GAP}]+", " "))))


def _windows(rows: DataFrame, id_col: str, lengths: list[int], wanted: DataFrame | None = None) -> DataFrame:
    """(id, row, length, place, literal, form, key, slots) of every template window of the given lengths; ``literal`` ones hold names as words.

    ``form`` is the hash of a window's words whatever the values of its slots.
    Windows of equal keys have equal forms, so with ``wanted``, a small table of
    forms, all others go before their slots and keys are worked out. Up to there
    no function takes a lambda: Spark compiles the loop over the windows.
    """
    words = rows.select(F.col(id_col).alias("id"), surface(F.col("text")).alias("surface"))
    slotted = F.col("surface").rlike(f"[{MARKS}]")
    template = F.when(slotted, F.regexp_replace("surface", f"([{MARKS}])[^ ]*", "$1")).otherwise(F.col("surface"))
    # the same as the template where no name is
    literal = F.when(F.col("surface").contains(NAME), F.split(F.translate(F.regexp_replace("surface", f"([{NUMBER}{UNIT}])[^ ]*", "$1"), NAME, ""), " "))
    # the number of the row stands here so that no filter is pushed below and works out the words once more
    words = words.select("id", F.monotonically_increasing_id().alias("row"), literal.alias("literals"), F.when(slotted, F.split("surface", " ")).alias("surface"), F.split(template, " ").alias("template"))
    words = words.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length") if len(lengths) > 1 else F.lit(lengths[0]).alias("length"))
    # first the places of the template, then as many of the literal words
    n = "(size(template) - length + 1)"
    at = F.expr(f"CASE WHEN template[0] <> '' AND {n} > 0 THEN sequence(1, {n} * CASE WHEN literals IS NULL THEN 1 ELSE 2 END) END")
    windows = words.select("*", F.explode(at).alias("at"))
    windows = windows.withColumn("form", F.expr(f"CASE WHEN at <= {n} THEN xxhash64(slice(template, at, length), length) ELSE xxhash64(slice(literals, at - {n}, length), length) END"))
    if wanted is not None:
        windows = windows.join(F.broadcast(wanted.select("form")), "form", "left_semi")
    windows = windows.selectExpr("id", "row", "length", f"(at - 1) % {n} + 1 AS place", f"at > {n} AS literal", "form", "template", "surface")
    windows = windows.selectExpr("id", "row", "length", "place", "literal", "form", "slice(template, place, length) AS template", "slice(surface, place, length) AS surface")
    windows = windows.where(f"NOT literal OR array_contains(template, '{NAME}')")
    slots = f"filter(surface, w -> substr(w, 1, 1) BETWEEN '{NUMBER}' AND '{UNIT}' AND NOT (literal AND substr(w, 1, 1) = '{NAME}'))"
    windows = windows.select("*", F.expr(slots).alias("slots"))
    # with more slots than this a window is joined by its values
    most = f"(length - least(length, {LITERALS}))"
    key = f"CASE WHEN size(slots) > {most} THEN xxhash64(CASE WHEN literal THEN transform(surface, w -> ltrim('{NAME}', w)) ELSE surface END, length, 'values') ELSE form END"
    return windows.select("id", "row", "length", "place", "literal", "form", F.expr(key).alias("key"), "slots")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, needed: int = NEEDED) -> DataFrame:
    """(doc_id, item_id, n_windows): documents that hold a benchmark item, and how many of its windows stand in runs.

    Texts of documents and items may be null or empty: such a row has no windows
    and matches nothing. Rows with equal ids count as one document, but a run
    lies within one row. A row with a null id takes no part. A very long text
    has as many windows as any; columns of other names are not read. An empty
    table on either side gives no rows.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL")
    n_words = F.size(F.split(surface(F.col("text")), " "))
    # at most `window` different lengths
    lengths = [r[0] for r in items.where(surface(F.col("text")) != "").select(F.least(n_words, F.lit(window)).alias("n")).distinct().collect()]
    if not lengths:
        return docs.select("doc_id").where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"))
    own_length = items.select(F.col("item_id").alias("id"), F.least(n_words, F.lit(window)).alias("own"))
    of_items = _windows(items, "item_id", sorted(lengths)).join(own_length.distinct(), "id").where("length = own")
    of_items = settled(of_items.select(F.col("id").alias("item_id"), F.col("literal").alias("item_literal"), "form", "key", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")))
    # the windows of an item in order; a run is of neighbours
    of_items = settled(of_items.withColumn("rank", F.dense_rank().over(Window.partitionBy("item_id").orderBy("item_place"))))
    needs = of_items.groupBy("item_id").agg(F.least(F.max("rank"), F.lit(needed)).alias("need"))
    size = of_items.agg(F.count(F.lit(1)), F.sum(F.length(F.array_join("item_slots", "")))).first()
    small = size[0] <= BROADCAST_WINDOWS and (size[1] or 0) <= BROADCAST_BYTES  # else the join shuffles and adaptive execution splits a frequent window
    of_docs = _windows(docs.where("doc_id IS NOT NULL"), "doc_id", sorted(lengths), of_items if small else None).drop("form")
    met = of_docs.join(F.broadcast(of_items) if small else of_items, "key")
    pairs = F.arrays_zip(F.coalesce("item_slots", F.array().cast("array<string>")).alias("i"), F.coalesce("slots", F.array().cast("array<string>")).alias("d"))
    # a window that is met with its names as words needs no values for them
    best = F.min(F.struct((~(F.col("literal") | F.col("item_literal"))).alias("named"), pairs.alias("pairs")))
    met = met.groupBy("row", F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "rank").agg(best.alias("best"))
    aligned = met.groupBy("row", "doc_id", "item_id", "shift").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("best.pairs").alias("pairs")))).alias("w"))
    aligned = aligned.join(F.broadcast(needs) if small else needs, "item_id").where("size(w) >= need")
    runs = F.expr(
        """filter(sequence(1, size(w) - need + 1), at -> w[at + need - 2].rank - w[at - 1].rank = need - 1
            AND size(array_distinct(flatten(transform(slice(w, at, need), x -> x.pairs)))) = size(array_distinct(flatten(transform(slice(w, at, need), x -> transform(x.pairs, p -> p.i)))))
            AND size(array_distinct(flatten(transform(slice(w, at, need), x -> x.pairs)))) = size(array_distinct(flatten(transform(slice(w, at, need), x -> transform(x.pairs, p -> p.d))))))"""
    )
    covered = F.expr("size(array_distinct(flatten(transform(runs, at -> sequence(at, at + need - 1)))))")
    found = aligned.withColumn("runs", runs).where("size(runs) > 0").groupBy("doc_id", "item_id").agg(F.max(covered).cast("long").alias("n_windows"))
    return found.select("doc_id", "item_id", "n_windows")


def label_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), n_windows of the best item."""
    leaks = find_leaks(docs, benchmark).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.count(F.lit(1)).alias("n"), F.max("n_windows").alias("most"))
    rows = docs.select("doc_id").join(leaks, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("most", F.lit(0)).cast("long").alias("n_windows"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows with a null id stay."""
    return without_keys(docs, F.col("doc_id"), find_leaks(docs, benchmark).select("doc_id"))
