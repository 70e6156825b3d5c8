"""Sequence queries: events per user stand in for frames; a region follows from each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators.matching import overlapping_pairs
from .registry import load, query

_FRAMES = """frames AS (SELECT user_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame_index, (event_id % 10) / 10.0 AS confidence,
  CASE WHEN event_id % 6 <> 0 THEN (event_id // 40) % 3 * 5 END AS x, 0 AS y, 20 AS w, 20 AS h FROM events)"""
_IOU = "(greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    region = F.struct((F.expr("event_id div 40") % 3 * 5).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(20).alias("w"), F.lit(20).alias("h"))
    return e.select(F.col("user_id").alias("sequence"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("frame_index"), (F.col("event_id") % 10 / 10.0).alias("confidence"), F.when(F.col("event_id") % 6 != 0, region).alias("region"))


_SEEN = f"""WITH {_FRAMES}, seen AS (SELECT *, lag(x) OVER q AS px, lag(frame_index) OVER q AS pf FROM frames WHERE x IS NOT NULL AND confidence >= 0.2 WINDOW q AS (PARTITION BY sequence ORDER BY frame_index)),
m AS (SELECT *, CASE WHEN pf IS NULL OR frame_index - pf > 3 OR greatest(0, least(x, px) + 20 - greatest(x, px)) * 20.0 / (800 - greatest(0, least(x, px) + 20 - greatest(x, px)) * 20) < 0.55 THEN 1 ELSE 0 END AS new FROM seen),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY sequence ORDER BY frame_index) AS BIGINT) AS run FROM m)"""


@query(_SEEN + " SELECT sequence, run, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame, round(max(confidence), 3) AS top FROM r GROUP BY sequence, run")
def w01_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run segmentation by gap and overlap."""
    r = S.runs(frames(spark, sf_dir), 0.2)
    return r.groupBy("sequence", "run").agg(F.count("*").alias("n"), F.min("frame_index").cast("long").alias("first_frame"), F.max("frame_index").cast("long").alias("last_frame"), F.round(F.max("confidence"), 3).alias("top"))


@query(_SEEN + " SELECT sequence, frame_index, run FROM (SELECT *, count(*) OVER (PARTITION BY sequence, run) AS c, max(confidence) OVER (PARTITION BY sequence, run) AS t FROM r) WHERE c >= 4 AND t >= 0.9")
def w03_accepted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run acceptance: long enough and once strong."""
    r = S.accepted_runs(S.runs(frames(spark, sf_dir), 0.2), 4, 0.9)
    return r.select("sequence", F.col("frame_index").cast("long").alias("frame_index"), "run")


def _over(a: str, b: str) -> str:
    """SQL for the overlap of two regions of side 20 at one height."""
    inside = f"greatest(0, 20 - abs({a} - {b})) * 20"
    return f"({inside} * 1.0 / (800 - {inside}))"


@query(f"""WITH {_FRAMES}, g AS (SELECT sequence, list({{'f': frame_index, 'x': x, 'run': CAST(1 AS BIGINT), 'first': x}} ORDER BY frame_index) AS p FROM frames WHERE x IS NOT NULL AND confidence >= 0.2 GROUP BY sequence),
r AS (SELECT sequence, unnest(list_reduce(list_transform(p, lambda c: [c]), lambda a, c: list_concat(a, [CASE WHEN c[1].f - a[-1].f <= 3 AND {_over("a[-1].x", "c[1].x")} >= 0.55 AND {_over("a[-1].first", "c[1].x")} >= 0.7
  THEN {{'f': c[1].f, 'x': c[1].x, 'run': a[-1].run, 'first': a[-1].first}} ELSE {{'f': c[1].f, 'x': c[1].x, 'run': a[-1].run + 1, 'first': c[1].x}} END]))) AS z FROM g)
SELECT sequence, z.run AS run, count(*) AS n FROM r GROUP BY ALL""")
def w02_anchored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored run segmentation (W02): a run also ends where the region leaves its first one."""
    return S.anchored_runs(frames(spark, sf_dir), 0.2, 0.7).groupBy("sequence", "run").agg(F.count("*").alias("n"))


def _filled(seen: str, enough: str) -> str:
    """SQL that goes on from the runs: confirmed regions, those filled in between, and the nearest ones about a frame."""
    spot = "CASE WHEN kept IS NOT NULL THEN {'k': kept, 'p': pos, 'r': run} END"
    back, ahead = (f"OVER (PARTITION BY sequence ORDER BY frame_index ROWS BETWEEN {b})" for b in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    return f"""{seen}, good AS (SELECT sequence, frame_index, x AS kept, run FROM (SELECT *, count(*) OVER (PARTITION BY sequence, run) AS c, max(confidence) OVER (PARTITION BY sequence, run) AS t FROM r) WHERE {enough}),
j AS (SELECT f.*, kept, run, row_number() OVER (PARTITION BY sequence ORDER BY frame_index) AS pos FROM frames f LEFT JOIN good USING (sequence, frame_index)),
s AS (SELECT *, last_value({spot} IGNORE NULLS) {back} AS l, first_value({spot} IGNORE NULLS) {ahead} AS n FROM j),
a AS (SELECT *, CASE WHEN kept IS NOT NULL THEN kept WHEN l.r = n.r AND {_over("l.k", "n.k")} >= 0.55 THEN CASE WHEN pos - l.p <= n.p - pos THEN l.k ELSE n.k END END AS acc FROM s),
c AS (SELECT *, last_value(acc IGNORE NULLS) {back} AS before, first_value(acc IGNORE NULLS) {ahead} AS after FROM a)"""


@query(_filled(_SEEN, "c >= 4 AND t >= 0.9") + f""" SELECT sequence, frame_index, CAST(coalesce(acc, CASE WHEN x IS NOT NULL AND confidence >= 0.1 AND EXISTS (SELECT 1 FROM (SELECT DISTINCT sequence, acc FROM a) b WHERE b.sequence = c.sequence AND {_over("c.x", "b.acc")} >= 0.55) THEN x END, before, after) AS BIGINT) AS x FROM c""")
def w05_stabilized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap filling and cover after confirmation."""
    out = S.stabilize(frames(spark, sf_dir), S.Policy(0.2, 0.9, 0.1, 4, cover=True))
    return out.select("sequence", F.col("frame_index").cast("long").alias("frame_index"), F.col("accepted.x").cast("long").alias("x"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1")
def w07_first_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First by priority."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return S.first_stable(e.withColumn("_p", F.struct(rank.alias("r"), "event_type")), "user_id", "_p").drop("_p")


@query("SELECT user_id, max(g) - min(g) > 60 AS variable FROM (SELECT user_id, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS g FROM (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS t FROM events)) GROUP BY 1")
def w09_variable_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven time steps."""
    e = load(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("t"))
    return S.variable_interval(e, "user_id", "t", 60)


@query("""WITH b AS (SELECT p_brand, p_partkey % 97 AS top, p_size AS h, max(p_partkey % 97 + p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey % 97, p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 97, p_size) AS k FROM (SELECT DISTINCT p_brand, p_partkey, p_size FROM part))
SELECT p_brand, CAST(sum(CASE WHEN reach IS NULL OR reach - top < 0.5 * h THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM b GROUP BY 1""")
def w13_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grouping by vertical overlap."""
    b = load(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey % 97 AS top", "p_size AS h")
    return S.line_groups(b, "p_brand", "top", "h").groupBy("p_brand").agg(F.max("line").alias("lines"))


@query("SELECT p_partkey, list_aggregate(list_distinct(CASE WHEN w <= 16 THEN [0] ELSE list_append(list_filter(range(0, w - 15, 12), lambda p: p + 16 <= w), w - 16) END), 'count') AS n, CASE WHEN w <= 16 THEN 0 ELSE w - 16 END AS last FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS w FROM part)")
def w14_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile plan along an axis with a flush last tile."""
    t = S.tiles(load(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(10).alias("one")), "p_size", "one", 16, 4)
    return t.groupBy("p_partkey").agg(F.count("*").alias("n"), F.max("tile_x").cast("long").alias("last"))


@query("SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE greatest(0, least(a.p_size, b.p_size)) * 1.0 / greatest(a.p_size, b.p_size) >= 0.8")
def j15_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial overlap join within a group."""
    p = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("p_size").alias("w"), F.lit(1).alias("h")).alias("region"))
    return overlapping_pairs(p, ["p_brand", "p_type"], "p_partkey", "region", 0.8)


@query(f"""WITH plain AS ({_filled(_SEEN.replace("confidence >= 0.2", "confidence >= 0.6"), "c >= 5 AND t >= 0.65")} SELECT sequence, count(acc) AS plain FROM c GROUP BY 1),
relaxed AS ({_filled(_SEEN.replace("confidence >= 0.2", "confidence >= 0.58"), "c >= 5")} SELECT sequence, count(coalesce(acc, before, after)) AS relaxed FROM c GROUP BY 1)
SELECT * FROM plain JOIN relaxed USING (sequence)""")
def w06_mark_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark's policy over its candidates, with and without provenance."""
    f = frames(spark, sf_dir)
    plain = S.stabilize_mark(f, "sora").select("sequence", "frame_index", F.col("accepted").isNotNull().alias("plain"))
    relaxed = S.stabilize_mark(f, "sora", True).select("sequence", "frame_index", F.col("accepted").isNotNull().alias("relaxed"))
    return plain.join(relaxed, ["sequence", "frame_index"]).groupBy("sequence").agg(F.count_if("plain").alias("plain"), F.count_if("relaxed").alias("relaxed"))
