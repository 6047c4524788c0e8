"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Frequent digests are found by a mergeable Misra-Gries summary. Spark's own
``approx_top_k`` aggregate is one (the frequent-items sketch keeps a bounded
table of counters, lowers all of them when it is full, and merges by adding
tables), so each task sends at most one table of counters. Its candidates are
then counted exactly. The verified winners, at most ``TRACKED`` of them whatever
the input, are broadcast and resolved without moving a row; the remaining
digests, none of which can hold a large share of the rows, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_IDS, fresh_name, own_columns, settled, without_keys

#: Counters of the summary. A digest with more than 8 / TRACKED of the rows is
#: always found; fewer rows than that are no skew.
TRACKED = 4096


def digest(text):
    """Lowercase hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def heavy_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """At most ``tracked`` rows (text_sha256, keep, group_size): the frequent digests, counted exactly."""
    summary = rows.agg(F.expr(f"approx_top_k(key64, {tracked}, {tracked})").alias("top"))
    hot = summary.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("key64"))
    found = (
        rows.join(F.broadcast(hot), "key64", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    return found.where("group_size > 1")


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest id
    stays. A null text is the empty text, so null and empty texts are copies of
    each other. A null id is smaller than any other. Of rows that tie in the id
    and the text exactly one is kept. An empty table gives no rows; further
    columns of ``docs``, whatever their names, are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
    rows = settled(rows.withColumns({"row_no": F.monotonically_increasing_id(), "key64": F.xxhash64("text_sha256")}))
    heavy = settled(heavy_digests(rows, tracked))
    known = F.broadcast(heavy)
    of_group = Window.partitionBy("text_sha256")
    light = rows.join(known, "text_sha256", "left_anti").withColumns(
        {"keep": F.max(F.struct("doc_id", "row_no")).over(of_group), "group_size": F.count(F.lit(1)).over(of_group)}
    )
    columns = ["doc_id", "row_no", "keep", "group_size", "text_sha256"]
    both = rows.join(known, "text_sha256").select(columns).unionByName(light.select(columns))
    return both.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows that tie in the id and the text are one row afterwards; otherwise as
    :func:`label_copies`.
    """
    rows = settled(label_copies(docs, id_col, text_col))
    key = _row_key(F.col(f"`{id_col}`"), digest(F.col(f"`{text_col}`")))
    of_rows = rows.withColumn("row_key", _row_key(F.col("doc_id"), F.col("text_sha256")))
    gone = of_rows.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("row_key")
    stay = without_keys(docs, key, gone)
    # a row that is not kept though its id is the kept one repeats another row
    again = settled(of_rows.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("row_key").distinct())
    n = again.count()
    if n == 0:
        return stay
    name = fresh_name(docs, "again_key")
    again = again.toDF(name)
    again = F.broadcast(again) if n <= MOST_IDS else again
    repeated = stay.join(again, key == F.col(name)).dropDuplicates([name]).select(own_columns(docs))
    return stay.join(again, key == F.col(name), "left_anti").select(own_columns(docs)).unionByName(repeated)


def _row_key(id_column, digest_column):
    """The id and as much of the digest as tells texts of one id apart."""
    return F.concat(F.substring(digest_column, 1, 24), F.lit(":"), F.coalesce(id_column.cast("string"), F.lit("")))
