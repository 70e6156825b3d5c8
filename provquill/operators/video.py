"""Video verdicts from metadata markers and stable marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probes as P

# Marks in the order in which the first stable one is reported, and the vendors whose metadata confirms each.
VIDEO_MARKS = (("sora", "OpenAI"), ("veo", "Google"), ("seedance", "ByteDance"), ("dola", "ByteDance"), ("hailuo", "MiniMax"), ("kling", "Kuaishou"))


def platform(markers: Column) -> Column:
    """The vendor of the joined marker values, in any case."""
    return P.vendor_of(F.array_join(markers, " "))


def confirmations(markers: Column) -> dict[str, Column]:
    """One boolean per mark: its vendor, or its own name, is in the metadata."""
    text = F.lower(F.array_join(markers, " "))
    return {mark: F.coalesce(F.contains(text, F.lit(mark)) | (P.vendor_of(text) == vendor), F.lit(False)) for mark, vendor in VIDEO_MARKS}


def video_verdicts(videos: DataFrame, stable: DataFrame) -> DataFrame:
    """Verdicts of (path, markers ARRAY) with (path, mark) rows of stable marks; confidence is high or unknown."""
    rank = F.lit(len(VIDEO_MARKS))
    for k, (mark, _) in reversed(list(enumerate(VIDEO_MARKS))):
        rank = F.when(F.col("mark") == mark, k).otherwise(rank)
    first = stable.groupBy("path").agg(F.min_by("mark", F.struct(rank.alias("r"), F.col("mark").alias("m"))).alias("visible_mark"))
    j = videos.join(first, "path", "left")
    marked = (F.size("markers") > 0) | F.col("visible_mark").isNotNull()
    return j.select("path", F.when(marked, True).alias("is_ai_generated"), F.coalesce(platform(F.col("markers")), F.col("visible_mark")).alias("platform"), F.when(marked, "high").otherwise("unknown").alias("confidence"), "visible_mark")
