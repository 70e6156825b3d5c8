"""Visible-mark decisions over score tables: gates, trust, and the keep rule.  Scores come from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probes import iou, uscc
from . import dims
from .shared import materialize

# Marks of the same label regime whose presence names another product.
REGIME = ("doubao", "qwen", "kling", "yuanbao", "baidu", "liblib", "runninghub")
OWN, PILL = "jimeng", "jimeng_pill"


def gates(scores: DataFrame, mark: str = "mark", score: str = "score") -> DataFrame:
    """Adds strict (score reaches the mark's gate) and relaxed (the gate times its factor); the dimension is broadcast."""
    d = dims.marks(scores.sparkSession).select(F.col("mark").alias("_m"), "gate", F.coalesce("relaxed_factor", F.lit(1.0)).alias("_f"))
    return scores.join(F.broadcast(d), F.col(mark) == F.col("_m")).withColumn("strict", F.col(score) >= F.col("gate")).withColumn("relaxed", F.col(score) >= F.col("gate") * F.col("_f")).drop("_m", "_f", "gate")


def rival_margin(scores: DataFrame, by: tuple[str, ...] = ("path", "blob"), mark: str = "mark", score: str = "score") -> DataFrame:
    """Adds margin: a mark's score less the best score that one of its rivals has on the same blob; null without a rival's score.

    Rivals are a dimension of a few rows, so the scores meet each other once per blob and rival.
    """
    rivals = dims.marks(scores.sparkSession).select(F.col("mark").alias("_m"), F.explode("rivals").alias("_rival"))
    own = scores.join(F.broadcast(rivals), F.col(mark) == F.col("_m"), "left").drop("_m")
    other = scores.groupBy(*by, F.col(mark).alias("_rival")).agg(F.max(score).alias("_best"))
    met = own.join(other, [*by, "_rival"], "left").groupBy(*scores.columns).agg(F.max("_best").alias("_best"))
    return met.withColumn("margin", F.col(score) - F.col("_best")).drop("_best")


def best_rung(scores: DataFrame, by: tuple[str, ...], rung: str = "rung", score: str = "score") -> DataFrame:
    """Per group the rung of the highest score, the earliest on a tie; a group in which no score is over 0 has no rung and score 0."""
    best = scores.groupBy(*by).agg(F.max_by(F.struct(rung, score), F.struct(F.col(score), -F.col(rung))).alias("_b"))
    return best.select(*by, F.when(F.col(f"_b.{score}") > 0, F.col(f"_b.{rung}")).alias(rung), F.greatest(F.lit(0.0), F.coalesce(F.col(f"_b.{score}"), F.lit(0.0))).alias(score))


def top_apart(candidates: DataFrame, by: str, k: int = 3, score: str = "score", region: str = "region", most: float = 0.0) -> DataFrame:
    """Per group the k best candidates of which none overlaps a better one by more than most, ties by place.

    In k rounds each takes the best that is left and drops what overlaps it, so no group is gathered in one task.
    """
    left = candidates.withColumn("_o", F.struct(F.col(score), -F.col(f"{region}.y"), -F.col(f"{region}.x")))
    taken: DataFrame | None = None
    for rank in range(1, k + 1):
        best = materialize(left.groupBy(by).agg(F.max_by(F.struct(*candidates.columns), "_o").alias("_b")).select("_b.*").withColumn("rank", F.lit(rank)), "taken")
        taken = best if taken is None else taken.union(best)
        if rank < k:
            met = best.select(F.col(by).alias("_by"), F.col(region).alias("_r"))
            left = materialize(left.join(met, (F.col(by) == F.col("_by")) & ((iou(F.col(region), F.col("_r")) > most) | (F.col(region) == F.col("_r"))), "left_anti"), "candidates")
    return taken


def keep_pill(fired: Column, provenance: Column, flat: Column) -> Column:
    """Never beside another product's mark; with the own word mark; else only on a flat ground that provenance vouches for."""
    other = F.arrays_overlap(fired, F.array(*[F.lit(m) for m in REGIME]))
    return F.when(other, False).when(F.array_contains(fired, OWN), True).when(F.array_contains(provenance, OWN), flat).otherwise(False)


def trust(decisions: DataFrame, provenance: str = "provenance", by: str = "path") -> DataFrame:
    """Adds trust: confirmed where provenance names the mark or a sibling of its product is strictly seen.

    Columns: path, mark, product, strict, vouches (marks too weak to vouch for a sibling have false).
    """
    strong = decisions.where("strict AND vouches").groupBy(by, "product").agg(F.min("mark").alias("_lo"), F.max("mark").alias("_hi"))
    j = decisions.join(strong, [by, "product"], "left")
    sibling = F.coalesce((F.col("_lo") != F.col("mark")) | (F.col("_hi") != F.col("mark")), F.lit(False))
    return j.withColumn("trust", F.when(F.array_contains(provenance, F.col("mark")) | sibling, "confirmed").otherwise("strict")).drop("_lo", "_hi")


# Producer codes of labelled products, the pair that an unmapped producer leaves, and the sparkle's gates.
PRODUCERS = {
    "91110102MACQD9K640": "doubao", "doubao": "doubao", "9144030008867405X2": "jimeng", "91440101MA9Y9T4H7A": "qwen", "91110108335469089C": "kling", "91440300708461136T": "yuanbao",
    "91340100MAEB4N8H76": "runninghub", "RunningHub": "runninghub", "91110000802100433B": "baidu", "91110105MACJ6K1C8A": "liblib",
}
FALLBACK = ("doubao", "jimeng")
SPARKLE_CONFIDENT, SPARKLE_MARGIN, SPARKLE_GRADIENT, SPARKLE_KEEP, SPARKLE_WHITE, SPARKLE_DEMOTED = 0.65, 5.0, 0.55, 0.52, 0.20, 0.30


def visible_keys(platform: Column, signal_names: Column, producer: Column) -> Column:
    """Marks that a verdict confirms: by platform, by signal, and for a TC260 label by its producer's code."""
    low = F.lower(F.coalesce(platform, F.lit("")))
    coded = F.coalesce(*[F.when(uscc(producer) == code, F.array(F.lit(mark))) for code, mark in PRODUCERS.items()], F.array(*[F.lit(m) for m in FALLBACK]))
    own = F.array_compact(F.array(F.when(F.contains(low, F.lit("google")) | F.contains(low, F.lit("gemini")), "gemini"), F.when(F.array_contains(signal_names, "samsung_genai"), "samsung")))
    return F.array_union(own, F.when(F.array_contains(signal_names, "aigc"), coded).otherwise(F.array().cast("array<string>")))


def sparkle_place(width: Column, height: Column) -> Column:
    """Margins and side of the sparkle: the large tier needs both axes over 1024."""
    large = (width > 1024) & (height > 1024)
    return F.struct(F.when(large, 64).otherwise(32).alias("margin_x"), F.when(large, 64).otherwise(32).alias("margin_y"), F.when(large, 96).otherwise(48).alias("side"))


def sparkle_confidence(spatial: Column, gradient: Column, variance: Column, margin: Column, saturation: Column, trusted: Column | None = None) -> Column:
    """Fused component scores, demoted where core and edges do not stand out, unless provenance is trusted."""
    fused = F.when(spatial < 0.25, F.greatest(F.lit(0.0), spatial * 0.5)).otherwise(spatial * 0.5 + gradient * 0.3 + variance * 0.2)
    low_margin, low_gradient = F.coalesce(margin < SPARKLE_MARGIN, F.lit(False)), gradient < SPARKLE_GRADIENT
    neutral = ~low_margin & F.coalesce(saturation <= SPARKLE_WHITE, F.lit(False))
    keep = (~low_margin & ~low_gradient) | ((fused >= SPARKLE_KEEP) & neutral)
    gated = (spatial >= 0.25) & (fused < SPARKLE_CONFIDENT) & ~(F.lit(False) if trusted is None else trusted)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(gated & ~keep, F.least(fused, F.lit(SPARKLE_DEMOTED))).otherwise(fused)))


def decide(candidates: DataFrame, by: str = "path") -> DataFrame:
    """The marks of each path that are reported: strict ones, relaxed ones under trust, the pill by its keep rule.

    Columns: path, mark, product, strict, relaxed, flat, provenance.
    """
    judged = trust(candidates.withColumn("vouches", F.col("mark") != PILL), "provenance", by)
    fired = judged.where(F.when(F.col("trust") == "confirmed", F.col("relaxed")).otherwise(F.col("strict")))
    seen = fired.groupBy(by).agg(F.collect_set("mark").alias("_seen"))
    kept = (F.col("mark") != PILL) | keep_pill(F.col("_seen"), F.col("provenance"), F.col("flat"))
    return fired.join(seen, by).where(kept).drop("_seen", "vouches")
