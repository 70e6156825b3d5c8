"""Corpus audits: counts, cohorts, verdict changes, precision, gaps, samples.  Every function is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probes import wilson
from . import dims


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def bucket(value: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the first edge above the value, the last label beyond all, unknown for null."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value < edge, label).otherwise(out)
    return F.when(value.isNull(), "unknown").otherwise(out)


def statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, nearest-rank p50, p90 and p99, and the mean of the rows that have a value.

    Equal values are counted first and a running count finds the ranks, so no group's values are held in a buffer.
    """
    per = df.where(f"{value} IS NOT NULL").groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    ranked = per.withColumns({"_to": F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    rank = lambda q: F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * q - 1e-9), F.col(value)))
    return ranked.groupBy(*by).agg(F.sum("_n").alias("n"), rank(0.5).alias("p50"), rank(0.9).alias("p90"), rank(0.99).alias("p99"), F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6).alias("mean"))


def segmented_statistics(df: DataFrame, segments: dict[str, Column], value: str) -> DataFrame:
    """statistics() under every segmentation at once: rows are expanded in place and aggregated in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(name).alias("segment"), c.cast("string").alias("label")) for name, c in segments.items()])
    return statistics(df.select(F.explode(pairs).alias("s"), value).select("s.segment", "s.label", value), ["segment", "label"], value)


def correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r where both are present; null under three pairs or for a constant side."""
    found = df.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    return found.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.round(F.col("_c") / (F.col("_sx") * F.col("_sy")), 6)).alias("r"))


def cohorts(rows: DataFrame, entity: str, fired: str, product: str, min_size: int = 1, top: int = 4) -> DataFrame:
    """Per entity its rows, the share that fired, its distinct products, and its most frequent products.

    Products are counted before they are ranked, so a large entity is never gathered row by row.
    """
    per = rows.groupBy(entity).agg(F.count("*").alias("n"), F.round(F.avg(F.col(fired).cast("double")), 6).alias("fire_rate"), F.count_distinct(product).alias("n_products"))
    ranked = counts(rows.where(F.col(product).isNotNull()), entity, product).withColumn("r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), product))).where(F.col("r") <= top)
    tops = ranked.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(product).cast("string").alias("p")))), lambda x: x["p"]), "|").alias("top_products"))
    return per.where(F.col("n") >= min_size).join(tops, entity, "left")


def precision_report(rows: DataFrame, by: list[str], fired: str, present: str) -> DataFrame:
    """Confusion counts over the rows in scope, precision and recall with their score intervals."""
    hit, real = F.col(fired), F.col(present)
    c = rows.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count("*").alias("scope"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return c.select(*by, "scope", "tp", "fp", "fn", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.round(low, 6).alias("precision_low"), F.round(high, 6).alias("precision_high"))


def family_of(description: Column) -> Column:
    low = F.lower(description)
    out = F.lit("other")
    for family, tokens in reversed(dims.FAMILIES):
        some = F.lit(False)
        for t in tokens:
            some = some | F.contains(low, F.lit(t))
        out = F.when(some, family).otherwise(out)
    return out


def verdict_changes(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """One row per key of old: classes of change, lost and new families; status missing where new has no row.

    Columns of both: key, is_ai (boolean), platform, confidence, families (array of strings).
    """
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    missing = F.col(f"n.{key}").isNull()
    was, now = F.coalesce(F.col("o.is_ai"), F.lit(False)), F.coalesce(F.col("n.is_ai"), F.lit(False))
    lost, gained = F.array_sort(F.array_except("o.families", "n.families")), F.array_sort(F.array_except("n.families", "o.families"))
    classes = F.array_compact(F.array(
        F.when(was & ~now, "lost_ai"), F.when(~was & now, "new_ai"), F.when(F.size(lost) > 0, "lost_signal"), F.when(F.size(gained) > 0, "new_signal"),
        F.when(~F.col("o.platform").eqNullSafe(F.col("n.platform")), "platform"), F.when(~F.col("o.confidence").eqNullSafe(F.col("n.confidence")), "confidence"),
    ))
    return j.select(F.col(f"o.{key}").alias(key), F.when(missing, "missing").otherwise("ok").alias("status"), F.when(~missing, F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("unchanged")))).alias("classes"), F.when(~missing, lost).alias("lost_families"), F.when(~missing, gained).alias("new_families"))


def change_counts(changes: DataFrame) -> DataFrame:
    return counts(changes.select(F.explode(F.coalesce("classes", F.array("status"))).alias("class")), "class")


def gap_candidates(rows: DataFrame, text: str, markers: tuple[str, ...] = dims.GAP_MARKERS, known: Column | None = None) -> DataFrame:
    """Rows not known to be AI whose text holds a marker, with the markers in table order."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(m)), F.lit(m)) for m in markers]))
    df = rows.withColumn("markers", found)
    return df.where((F.size("markers") > 0) & (F.lit(True) if known is None else ~known))


def first_by_hash(rows: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of every distinct content: a hash aggregate, so a third of all rows may be one content."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the sampling operator of the audits."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties go by value."""
    return counts(df, column).orderBy(F.desc("n"), column).limit(n)


def terciles(df: DataFrame, value: str, key: str) -> DataFrame:
    """Thirds by the exact nearest-rank thirds of the value; equal values share the lower third, whatever their key."""
    edge = df.agg(F.expr(f"percentile_disc(0.3333333333333333) WITHIN GROUP (ORDER BY {value})").alias("a"), F.expr(f"percentile_disc(0.6666666666666666) WITHIN GROUP (ORDER BY {value})").alias("b"))
    return df.crossJoin(F.broadcast(edge)).withColumn("tercile", F.when(F.col(value) <= F.col("a"), 1).when(F.col(value) <= F.col("b"), 2).otherwise(3)).drop("a", "b")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one view has, as often as it has them more, with the side they are on: one aggregation of both."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    more = both.groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return more.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.abs("_n")))).drop("_n")
