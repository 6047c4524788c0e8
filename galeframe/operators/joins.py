"""Alignment, gathering, reshaping, key sets and nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both frames by key, with ``value`` of each. A key that one side lacks, or that repeats, is an error."""
    pair = a.select(*keys, F.col(value).alias("value_a"), F.lit(1).alias("__a")).join(b.select(*keys, F.col(value).alias("value_b"), F.lit(1).alias("__b")), keys, "full_outer")
    whole = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("frames do not hold the same keys"))).otherwise(F.col("value_a"))
    return pair.withColumn("value_a", whole.cast("double")).drop("__a", "__b")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_unrepeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is not NULL and occurs once: every copy of a repeated key goes."""
    once = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return df.where(present).withColumn("__n", once).where("__n = 1").drop("__n")


def key_difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from, or extra in, ``observed``."""
    missing = expected.select(*keys).distinct().join(observed, keys, "left_anti").withColumn("status", F.lit("missing"))
    extra = observed.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def replace_row(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of ``new`` instead of those with the same key."""
    return df.join(new.select(key).distinct(), key, "left_anti").select(df.columns).unionByName(new.select(df.columns))


def method_pairs(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Every unordered pair of methods of a key, as method_a < method_b. The design is small: a row a method."""
    a = df.select(*keys, F.col(method).alias("method_a")).distinct()
    b = df.select(*keys, F.col(method).alias("method_b")).distinct()
    return a.join(b, keys).where("method_a < method_b")


def first_by_signature(df: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*signature).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def resolve_alias(df: DataFrame, key: str, alias: str, value: str, depth: int = 4) -> DataFrame:
    """Follows aliases to the row that has a value; a longer chain or a circle leaves it NULL."""
    out = df.select(F.col(key), F.col(alias).alias("__next"), F.col(value).alias("__value"))
    names = df.select(F.col(key).alias("__k"), F.col(alias).alias("__a"), F.col(value).alias("__v"))
    for _ in range(depth):
        step = out.join(names, F.col("__next") == F.col("__k"), "left")
        out = step.select(key, F.when(F.col("__next").isNotNull(), F.col("__a")).alias("__next"), F.when(F.col("__next").isNotNull(), F.col("__v")).otherwise(F.col("__value")).alias("__value"))
    return out.select(key, F.when(F.col("__next").isNull(), F.col("__value")).alias(value))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, d: s + d.cast("double"))


#: Landmarks that a kernel matrix or a nearest-landmark join takes.
MOST_LANDMARKS = 512


def kernel_rows(df: DataFrame, landmarks: DataFrame, vector: str, gamma: float, id_column: str) -> DataFrame:
    """exp(-gamma |x - c|^2) for every row and landmark.

    The landmarks are a model, at most ``MOST_LANDMARKS`` rows, and are checked
    before they are broadcast.
    """
    if landmarks.limit(MOST_LANDMARKS + 1).count() > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
    centres = landmarks.agg(F.collect_list(F.struct(F.col(id_column).alias("landmark"), F.col(vector).alias("centre"))).alias("__c"))
    rows = df.select(id_column, F.col(vector).alias("__x")).join(F.broadcast(centres), F.lit(True))
    rows = rows.select(id_column, "__x", F.explode("__c").alias("__l")).select(id_column, "__x", "__l.*")
    return rows.select(id_column, "landmark", F.exp(-gamma * squared_distance(F.col("__x").cast("array<double>"), F.col("centre").cast("array<double>"))).alias("kernel"))


def nearest_landmarks(kernel: DataFrame, id_column: str, k: int) -> DataFrame:
    """The k landmarks nearest to each row, the smaller id of equally near ones."""
    w = Window.partitionBy(id_column).orderBy(F.desc("kernel"), "landmark")
    return kernel.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
