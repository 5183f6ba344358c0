"""Column expressions over dense vectors, and the hashed bag-of-words vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import word_tokens


def doubles(v: str | Column) -> Column:
    """Double precision, so that ranks don't depend on the storage type."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Length of a vector; 1 for a zero vector, so that its cosines are 0."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def hash_bow(df: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, vector) of signed token counts by SHA-256: bucket from the last four bytes, sign from the byte before.

    Texts without tokens have a zero vector. A text's tokens are summed by bucket where it lies, so it shuffles one row
    for each bucket at the most, however long it is.
    """
    digest = F.sha2("token", 256)
    tokens = df.select(id_col, F.explode(word_tokens(F.lower(text_col))).alias("token")).select(id_col, digest.alias("digest"))
    hashed = tokens.select(
        id_col,
        (F.conv(F.substring("digest", 57, 8), 16, 10).cast("long") % dims).cast("int").alias("bucket"),
        F.when(F.conv(F.substring("digest", 56, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("w"),
    )
    sums = hashed.groupBy(id_col, "bucket").agg(F.sum("w").alias("w"))
    held = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("held"))
    rows = df.select(id_col).distinct().join(held, id_col, "left")
    value = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0)).cast("double")
    return rows.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("vector"))
