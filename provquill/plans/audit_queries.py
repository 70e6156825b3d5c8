"""Audit queries: counts, cohorts, precision, changes, gaps, samples, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.probes import wilson
from ..operators import audits as A
from .registry import load, query


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def a01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count by category."""
    return A.counts(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT l_returnflag, l_linestatus, coalesce(y, -1) AS y, n FROM (SELECT l_returnflag, l_linestatus, y, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus, y), (l_linestatus)))")
def a02_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under several groupings in one pass."""
    load(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "year(l_shipdate) AS y").createOrReplaceTempView("provquill_lineitem")
    found = spark.sql("SELECT l_returnflag, l_linestatus, y, count(*) AS n FROM provquill_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus, y), (l_linestatus))")
    return found.withColumn("y", F.coalesce("y", F.lit(-1)))


_STATS = "count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99, round(avg(v), 6) AS mean"


@query(f"""WITH t AS (SELECT o_totalprice AS v, o_orderstatus AS s, CASE WHEN o_totalprice < 50000 THEN '<50k' WHEN o_totalprice < 150000 THEN '50-150k' ELSE '>150k' END AS b FROM orders)
SELECT 'status' AS segment, s AS label, {_STATS} FROM t GROUP BY s UNION ALL SELECT 'price', b, {_STATS} FROM t GROUP BY b""")
def a03_segmented_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles by several segmentations at once."""
    o = load(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"), "o_orderstatus")
    return A.segmented_statistics(o, {"status": F.col("o_orderstatus"), "price": A.bucket(F.col("v"), (50000, 150000), ("<50k", "50-150k", ">150k"))}, "v")


@query("""SELECT l_returnflag, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN round(corr(l_quantity, l_extendedprice), 6) END AS r FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'const', count(*), NULL FROM lineitem""")
def a05_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation, null on a constant side."""
    li = load(spark, sf_dir, "lineitem")
    constant = A.correlation(li.select(F.lit("const").alias("l_returnflag"), F.lit(1.0).alias("one"), "l_quantity"), ["l_returnflag"], "one", "l_quantity")
    return A.correlation(li, ["l_returnflag"], "l_quantity", "l_extendedprice").union(constant)


@query("""WITH r AS (SELECT c_mktsegment AS entity, o_orderkey % 3 = 0 AS fired, o_orderpriority AS product FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, product) AS k FROM (SELECT entity, product, count(*) AS n FROM r GROUP BY 1, 2))
SELECT a.*, t.top_products FROM (SELECT entity, count(*) AS n, round(avg(fired::INT), 6) AS fire_rate, count(DISTINCT product) AS n_products FROM r GROUP BY 1) a JOIN (SELECT entity, string_agg(product, '|' ORDER BY k) AS top_products FROM c WHERE k <= 4 GROUP BY 1) t USING (entity)""")
def a06_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts with fire rate and top products."""
    r = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("entity"), (F.col("o_orderkey") % 3 == 0).alias("fired"), F.col("o_orderpriority").alias("product"))
    return A.cohorts(r, "entity", "fired", "product")


_PRECISION_SQL = """WITH r AS (SELECT lang, n_chars < 600 AS fired, quality = 0 AS present FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS scope, count(*) FILTER (fired AND present) AS tp, count(*) FILTER (fired AND NOT present) AS fp, count(*) FILTER (NOT fired AND present) AS fn FROM r GROUP BY lang),
w AS (SELECT *, tp + fp AS n, tp / nullif(tp + fp, 0) AS p FROM c)
SELECT lang, scope, tp, fp, fn, round(p, 6) AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall,
 CASE WHEN n = 0 THEN 0.0 ELSE round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) END AS precision_low,
 CASE WHEN n = 0 THEN 0.0 ELSE round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) END AS precision_high FROM w"""


@query(_PRECISION_SQL)
def a07_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, precision, recall and score intervals by language."""
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") < 600).alias("fired"), (F.col("quality") == 0).alias("present"))
    return A.precision_report(rows, ["lang"], "fired", "present")


@query("SELECT k, n, CASE WHEN n = 0 THEN 0.0 ELSE round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) END AS low, CASE WHEN n = 0 THEN 0.0 ELSE round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) END AS high FROM (SELECT p_size::BIGINT AS n, p_size::BIGINT // 3 AS k FROM part GROUP BY ALL UNION ALL SELECT 0, 0)")
def a08_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson score interval, (0, 0) for no trials."""
    t = load(spark, sf_dir, "part").selectExpr("cast(p_size AS bigint) AS n", "cast(p_size AS bigint) div 3 AS k").distinct().union(spark.sql("SELECT 0L, 0L"))
    low, high = wilson(F.col("k"), F.col("n"))
    return t.select("k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH e AS (SELECT quantile_disc(p_retailprice, 0.3333333333333333) AS a, quantile_disc(p_retailprice, 0.6666666666666666) AS b FROM part)
SELECT CASE WHEN p_retailprice <= a THEN 1 WHEN p_retailprice <= b THEN 2 ELSE 3 END AS tercile, count(*) AS n, round(avg((p_size > 25)::INT), 6) AS rate FROM part, e GROUP BY ALL""")
def a09_response_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rate by tercile."""
    return A.terciles(load(spark, sf_dir, "part"), "p_retailprice", "p_partkey").groupBy("tercile").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_size") > 25).cast("double")), 6).alias("rate"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a09_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response by two axes as a pivot."""
    t = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return t.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.select(k.alias("path"), F.when(k % 2 == 0, True).alias("is_ai"), F.when(k % 3 == 0, "A").otherwise("B").alias("platform"), F.lit("high").alias("confidence"), F.array_compact(F.array(F.when(k % 2 == 0, "c2pa"), F.when(k % 5 == 0, "iptc"))).alias("families"))
    new = o.where("o_orderkey % 13 <> 0").select(k.alias("path"), F.when(k % 4 == 0, True).alias("is_ai"), F.when(k % 6 == 0, "A").otherwise("B").alias("platform"), F.when(k % 7 == 0, "none").otherwise("high").alias("confidence"), F.array_compact(F.array(F.when(k % 2 == 0, "c2pa"), F.when(k % 11 == 0, "aigc"))).alias("families"))
    return old, new


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE coalesce(nullif(concat_ws(',',
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'lost_ai' END, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 4 = 0 THEN 'new_ai' END, CASE WHEN o_orderkey % 5 = 0 THEN 'lost_signal' END, CASE WHEN o_orderkey % 11 = 0 THEN 'new_signal' END,
  CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 6 = 0) THEN 'platform' END, CASE WHEN o_orderkey % 7 = 0 THEN 'confidence' END), ''), 'unchanged') END AS classes FROM orders""")
def j07_verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar against fresh verdict: change classes, missing status."""
    return A.verdict_changes(*_views(spark, sf_dir)).select("path", "status", F.when(F.col("classes").isNotNull(), F.array_join("classes", ",")).alias("classes"))


@query("""WITH c AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 13 = 0 THEN ['missing'] ELSE
  CASE WHEN len(x) > 0 THEN x ELSE ['unchanged'] END END) AS class FROM (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'lost_ai' END, CASE WHEN o_orderkey % 5 = 0 THEN 'lost_signal' END, CASE WHEN o_orderkey % 11 = 0 THEN 'new_signal' END,
  CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 6 = 0) THEN 'platform' END, CASE WHEN o_orderkey % 7 = 0 THEN 'confidence' END], lambda v: v IS NOT NULL) AS x FROM orders)) SELECT class, count(*) AS n FROM c GROUP BY class""")
def a11_regression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression class counts."""
    return A.change_counts(A.verdict_changes(*_views(spark, sf_dir)))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a12_first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct by content hash, the first kept."""
    return A.first_by_hash(load(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "doc_id")


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'license') THEN 'license' END, CASE WHEN contains(text, 'Licensed') THEN 'Licensed' END, CASE WHEN contains(text, 'token') THEN 'token' END], lambda x: x IS NOT NULL), '|') AS markers
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND (contains(text, 'license') OR contains(text, 'Licensed') OR contains(text, 'token'))""")
def a27_gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker gap candidates: unlabelled documents with a marker."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return A.gap_candidates(d, "text", ("license", "Licensed", "token")).select("doc_id", F.array_join("markers", "|").alias("markers"))


@query("SELECT family, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_type), 'brass') THEN 'exif_generator' WHEN contains(lower(p_type), 'tin') THEN 'c2pa' ELSE 'other' END AS family FROM part) GROUP BY 1")
def f09_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a description, first match."""
    low = F.lower("p_type")
    text = F.when(F.contains(low, F.lit("brass")), "EXIF software").when(F.contains(low, F.lit("tin")), "Content Credentials").otherwise("nothing")
    return A.counts(load(spark, sf_dir, "part").select(A.family_of(text).alias("family")), "family")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def j08_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip what is done (J08, S37): customers without orders."""
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT DISTINCT a.p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND b.p_size >= 49 WHERE a.p_size < 10")
def j10_sibling_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak keys with a strong sibling of the same product."""
    p = load(spark, sf_dir, "part")
    strong = p.where("p_size >= 49").groupBy("p_brand").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    return p.where("p_size < 10").join(strong, "p_brand").where("lo <> p_partkey OR hi <> p_partkey").select("p_partkey")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def t03_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common values, ties by value."""
    return A.most_common(load(spark, sf_dir, "part"), "p_brand", 5)


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def t05_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample (T05): the sampling operator of the audits."""
    return A.seeded_sample(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS only_a, len(list_distinct(list_concat(a, b))) AS n_union, len(list_filter(a, lambda x: list_contains(b, x))) > 0 AS overlap
FROM (SELECT c_custkey, [c_custkey % 3, c_custkey % 5 + 10] AS a, [c_custkey % 3 + (c_custkey % 2), c_custkey % 7 + 10] AS b FROM customer)""")
def t07_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference, union and intersection tests on arrays."""
    k = F.col("c_custkey")
    t = load(spark, sf_dir, "customer").select(k, F.array(k % 3, k % 5 + 10).alias("a"), F.array(k % 3 + k % 2, k % 7 + 10).alias("b"))
    return t.select("c_custkey", F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("only_a"), F.size(F.array_union("a", "b")).cast("long").alias("n_union"), F.arrays_overlap("a", "b").alias("overlap"))


_RECORD_VIEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 200 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 300 <> 0"


@query(f"""SELECT *, 'left' AS side FROM (SELECT o_orderkey, o_orderstatus AS status FROM orders EXCEPT ALL {_RECORD_VIEW})
UNION ALL SELECT *, 'right' FROM ({_RECORD_VIEW} EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""")
def h02_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File view against record view (H02): multiset difference both ways; the record view lacks some orders and has another status for some."""
    o = load(spark, sf_dir, "orders")
    record = o.where("o_orderkey % 300 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 200 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    return A.parity(o.select("o_orderkey", F.col("o_orderstatus").alias("status")), record)


@query(_PRECISION_SQL.replace("SELECT lang, scope, tp, fp, fn, round(p, 6) AS precision", "SELECT lang, round(p - 0.5, 6) AS delta, round(p, 6) AS precision").split(", CASE WHEN tp + fn")[0] + " FROM w")
def h18_precision_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision with its difference to a snapshot."""
    now = a07_precision(spark, sf_dir)
    snapshot = now.select("lang", F.lit(0.5).alias("before"))
    return now.join(snapshot, "lang").select("lang", F.round(F.col("precision") - F.col("before"), 6).alias("delta"), "precision")


@query("SELECT user_id, count(*) AS processed, count(*) FILTER (value IS NULL OR value < 1) AS failed, CAST(count(*) FILTER (value >= 1) AS BIGINT) AS succeeded FROM events GROUP BY 1")
def a22_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch outcomes: processed, failed, succeeded."""
    ok = F.coalesce(F.col("value") >= 1, F.lit(False))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("processed"), F.count_if(~ok).alias("failed"), F.count_if(ok).alias("succeeded"))


@query("SELECT conv_id, count(DISTINCT lower(role)) = 1 AND min(length(text)) >= 20 AS stable FROM conversations GROUP BY 1")
def t10_stable_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads agree and the least score is high enough."""
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(((F.count_distinct(F.lower("role")) == 1) & (F.min(F.length("text")) >= 20)).alias("stable"))


@query("SELECT l_returnflag, CASE WHEN count(*) > 0 THEN round(avg(l_tax), 6) END AS mean_tax, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1")
def a25_means_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and medians."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("mean_tax"), F.median("l_quantity").alias("median_quantity"))


@query("""SELECT event_type, n, round(t, 6) AS total, rk FROM (SELECT event_type, count(*) AS n, sum(value) AS t, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk FROM events GROUP BY 1)""")
def a23_priority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of grouped counts."""
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))


@query("""WITH c AS (SELECT a.p_brand || ' ' || a.p_type AS product, a.p_partkey AS l, b.p_partkey AS r, 1.0 / (1 + abs(a.p_size - b.p_size)) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size % 2 = 0 AND b.p_size % 2 = 1),
g AS (SELECT product, list({'s': -score, 'l': l, 'r': r} ORDER BY -score, l, r) AS p FROM c WHERE score >= 0.05 GROUP BY product),
t AS (SELECT product, unnest(list_reduce(list_transform(p, lambda c: [c]), lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: y.l = x[1].l OR y.r = x[1].r)) > 0 THEN taken ELSE list_concat(taken, x) END)) AS x FROM g)
SELECT product, x.l AS l, x.r AS r, round(-x.s, 6) AS score FROM t""")
def j14_greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching (J14) of every product's parts of even and of odd size, the nearest sizes first."""
    from ..operators.matching import nearest_pairs

    p = load(spark, sf_dir, "part").where("p_size % 2 IN (0, 1)").select("p_brand", "p_type", "p_partkey", "p_size", F.expr("p_size % 2 = 0").alias("even"))
    n = nearest_pairs(p, ["p_brand", "p_type"], "p_partkey", "p_size", "even", 19)  # a score of 0.05 or more
    return n.select(F.concat_ws(" ", "p_brand", "p_type").alias("product"), "l", "r", F.round(1.0 / (1 + F.col("distance")), 6).alias("score"))


@query("SELECT r_regionkey, array_to_string(list_filter(['head', CASE WHEN r_regionkey % 2 = 0 THEN 'even' END, 'tail'], lambda x: x IS NOT NULL), '>') AS parts FROM region")
def t09_ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation of optional parts."""
    return load(spark, sf_dir, "region").select("r_regionkey", F.array_join(F.array_compact(F.array(F.lit("head"), F.when(F.col("r_regionkey") % 2 == 0, "even"), F.lit("tail"))), ">").alias("parts"))
