"""Vector, bit, text-distance and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .registry import load, query


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS ncc FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE b.vec_id % 50 = 0")
def j13_pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of carriers within a label (J12, J13, F06, H15): a search whose queries are the vectors with an id divisible by 50, each against all others."""
    e = load(spark, sf_dir, "embeddings")
    a, b = e.alias("a"), e.where("vec_id % 50 = 0").alias("b")
    j = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id")))
    return j.select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 5).alias("ncc"))


@query("""WITH p AS (SELECT label, i, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT label, round(max(m) / sqrt(sum(m * m)), 5) AS top, count(*) AS dims FROM p GROUP BY label""")
def a20_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector, renormalised."""
    m = V.mean_vector(load(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", F.round(F.array_max("m"), 5).alias("top"), F.size("m").cast("long").alias("dims"))


@query("SELECT e.label, e.vec_id % 8 AS bucket, sum(CASE WHEN e.embedding[1] > 0 THEN 1 ELSE 0 END) * 255 > count(*) * 127 AS bit FROM embeddings e GROUP BY ALL")
def a13_bit_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit votes by index mod n."""
    e = load(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0] > 0).cast("int").alias("v"))
    return V.bit_votes(e, ["label"], "vec_id", "v", 8)


@query("SELECT l_returnflag, CAST(least(floor((l_quantity - 1) / 4.9), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY ALL")
def a14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram over fixed edges, the last one closed."""
    return V.histogram(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 1.0, 50.0, 10)


@query("""WITH d AS (SELECT l_returnflag, CAST(left(format('{:.10e}', abs(l_extendedprice)), 1) AS INT) AS d FROM lineitem WHERE abs(l_extendedprice) >= 1), n AS (SELECT l_returnflag, count(*) AS n FROM d GROUP BY 1)
SELECT n.l_returnflag, n.n, round(avg(abs(coalesce(c, 0) / n.n - log10(1 + 1.0 / k))), 6) AS deviation FROM n, range(1, 10) r(k) LEFT JOIN (SELECT l_returnflag AS f, d, count(*) AS c FROM d GROUP BY ALL) x ON x.d = r.k AND x.f = n.l_returnflag GROUP BY ALL""")
def a15_benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading-digit deviation."""
    return V.benford_deviation(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("SELECT l_returnflag, round(stddev_pop(l_extendedprice), 4) AS sd, round(kurtosis_pop(l_extendedprice), 5) AS kurtosis FROM lineitem GROUP BY 1")
def a16_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation and excess kurtosis."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_extendedprice"), 4).alias("sd"), F.round(F.kurtosis("l_extendedprice"), 5).alias("kurtosis"))


@query()
def f02_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised edit distance of whole neighbouring texts (F01, F02); DuckDB counts by bytes, so the tests hold it against a plain distance."""
    b = load(spark, sf_dir, "benchmark").select("item_id", V.normalized_text(F.col("text")).alias("t"))
    j = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return j.select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("other"), F.round(V.edit_rate(F.col("a.t"), F.col("b.t")), 6).alias("rate"))


@query("SELECT p_partkey, CAST(48 - bit_count(xor(p_partkey * 7919, 1234567)) AS BIGINT) AS same FROM part")
def f04_bits_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreeing bits of 48."""
    return load(spark, sf_dir, "part").select("p_partkey", V.bits_match(F.col("p_partkey") * 7919, F.lit(1234567).cast("long")).cast("long").alias("same"))


@query("SELECT p_partkey, p_partkey % 16 AS bits_value FROM part")
def f05_bits_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits to integer."""
    k = F.col("p_partkey")
    bits = F.array(*[F.shiftright(k, i).bitwiseAND(F.lit(1)) for i in (3, 2, 1, 0)])
    return load(spark, sf_dir, "part").select("p_partkey", V.bits_to_long(bits).alias("bits_value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Stable Diffusion XL' WHEN p_partkey % 3 = 1 THEN 'FLUX.2 (Black Forest Labs)' END AS scheme FROM part")
def f16_open_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-watermark payload match with a few flipped bits."""
    from ..operators import dims

    k = F.col("p_partkey")
    noise = F.pmod(k, F.lit(4)) * 257
    bits = F.when(k % 3 == 0, F.lit(dims.PAYLOADS_48[0][1])).when(k % 3 == 1, F.lit(dims.PAYLOADS_48[1][1])).otherwise(F.lit(0).cast("long"))
    return load(spark, sf_dir, "part").select("p_partkey", V.open_watermark(bits.bitwiseXOR(noise)).alias("scheme"))


@query("SELECT p_size, CASE WHEN p_size = 1 THEN CAST('inf' AS DOUBLE) ELSE round(20 * log10(255 / sqrt(p_size - 1)), 6) END AS psnr FROM (SELECT DISTINCT p_size FROM part)")
def f07_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR, infinite for identical input."""
    return load(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.round(V.psnr(F.col("p_size") - 1.0), 6).alias("psnr"))


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '[äöüß]')) AS umlauts, count(*) FILTER (regexp_matches(text, '\\p{Cyrillic}')) AS cyrillic FROM documents GROUP BY 1")
def f03_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script detection."""
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("[äöüß]")).alias("umlauts"), F.count_if(V.has_script(F.col("text"), "Cyrillic")).alias("cyrillic"))


@query()
def f34_pixel_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel evidence (F10-F13, F34, F39, A17, A19) of gray rasters spelled from the vectors' values."""
    from ..functions.pixels import pixel_evidence

    e = load(spark, sf_dir, "embeddings").where("size(embedding) >= 64")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 64), lambda x: F.lpad(F.hex(F.pmod(F.floor(x * 127), F.lit(256)).cast("int")), 2, "0")), ""))
    return pixel_evidence(e.select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))).select("path", "status", "phash", F.round("noise_std", 6).alias("noise_std"), F.round("gradient_median", 6).alias("gradient_median"))
