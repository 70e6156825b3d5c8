"""Vectors, bits and text distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dims


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either side has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def centered(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def normalized_text(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"\s+", "")


def edit_rate(a: Column, b: Column) -> Column:
    """Edits over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def bits_match(a: Column, b: Column, width: int = 48) -> Column:
    return F.lit(width) - F.bit_count(a.bitwiseXOR(b))


def bits_to_long(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s * 2 + x.cast("long"))


def open_watermark(bits48: Column) -> Column:
    """The scheme whose 48-bit payload agrees in enough bits; null for none."""
    found = [F.when(bits_match(bits48, F.lit(ref)) >= dims.MATCH_48, F.lit(name)) for name, ref in dims.PAYLOADS_48]
    return F.coalesce(*found)


def psnr(mse: Column, peak: float = 255.0) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(peak) / F.sqrt(mse)))


def has_script(t: Column, script: str) -> Column:
    return t.rlike(rf"\p{{Is{script}}}")


def bit_votes(rows: DataFrame, by: list[str], index: str, value: str, n: int) -> DataFrame:
    """Per bucket index mod n: 1 where the mean of value (0 to 1) exceeds 127/255, by whole sums."""
    return rows.groupBy(*by, F.pmod(F.col(index), F.lit(n)).alias("bucket")).agg((F.sum(value) * 255 > F.count("*") * 127).alias("bit"))


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last edge is closed, values outside are left out."""
    width = (high - low) / bins
    inside = rows.where(f"{value} >= {low} AND {value} <= {high}")
    return inside.groupBy(*by, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def benford_deviation(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean absolute deviation of the leading digits' shares from Benford's law, over values of 1 or more."""
    digit = F.substring(F.format_string("%.10e", F.abs(F.col(value)).cast("double")), 1, 1).cast("int")
    got = rows.where(F.abs(value) >= 1).groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(digit == d).alias(f"_{d}") for d in range(1, 10)])
    terms = [F.abs(F.col(f"_{d}") / F.col("n") - F.log10(F.lit(1.0 + 1.0 / d))) for d in range(1, 10)]
    return got.select(*by, "n", F.round(sum(terms[1:], terms[0]) / 9, 6).alias("deviation"))


def mean_vector(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean of vectors by position, scaled to length 1."""
    parts = rows.select(*by, F.posexplode(vector).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("m"))
    return whole.withColumn("m", F.when(dot(F.col("m"), F.col("m")) > 0, F.transform("m", lambda x: x / F.sqrt(dot(F.col("m"), F.col("m"))))).otherwise(F.col("m")))


def random_baseline(spark, n: int, size: int, seed: int) -> DataFrame:
    """n vectors of normal numbers that depend on the seed alone."""
    cell = lambda i: F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 40)) + 1) / (1 << 40))) * F.cos(2 * 3.141592653589793 * F.pmod(F.xxhash64(F.lit(seed + 1), "id", i), F.lit(1 << 40)) / (1 << 40))
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell).alias("embedding"))
