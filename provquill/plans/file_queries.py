"""File queries: the tables hold no media, so small files are spelled from part keys and walked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verdict import verdicts
from ..sources import files
from . import spelled
from .registry import load, query

# What each spelled file is: container, entries, verdict, confidence, platform, signals, tail bytes, AI fields.
_LOCAL, _META, _TC260 = "Stable Diffusion / local pipeline (Automatic1111, ComfyUI, InvokeAI)", "Made-with-AI tag (e.g. Meta AI); platform not specified", "China AIGC-labeled generator (TC260; e.g. Doubao)"
_EXPECTED = {
    "parameters": ("png", 4, "true", "high", _LOCAL, "gen_params"),
    "plain": ("png", 4, "unknown", "none", "", ""),
    "software": ("png", 4, "true", "high", "Midjourney v6 (embedded generator tag)", "exif_generator"),
    "bare_jpeg": ("jpeg", 1, "unknown", "none", "", ""),
    "empty": ("unknown", 0, "unknown", "none", "", ""),
    "png_late": ("png", 4, "true", "high", _META, "iptc"),
    "png_packed": ("png", 4, "true", "high", _META, "iptc"),
    "png_store": ("png", 4, "true", "medium", "Adobe Firefly", "c2pa"),
    "jpeg_exif": ("jpeg", 3, "true", "high", "Stable Diffusion (embedded generator tag)", "exif_generator"),
    "jpeg_store": ("jpeg", 7, "true", "medium", "Adobe Firefly", "c2pa"),
    "jpeg_broken": ("jpeg", 6, "true", "medium", "", "c2pa"),
    "jpeg_noise": ("jpeg", 4, "unknown", "none", "", "c2pa"),
    "jpeg_samsung": ("jpeg", 2, "true", "medium", "Samsung Galaxy (Galaxy AI editing)", "samsung_genai"),
    "webp_late": ("webp", 3, "true", "high", _META, "iptc"),
    "webp_noise": ("webp", 2, "true", "medium", "", "c2pa"),
    "avi": ("avi", 1, "true", "high", _TC260, "aigc"),
    "mp4": ("isobmff", 7, "true", "high", _TC260, "aigc"),
    "mp4_store": ("isobmff", 8, "true", "medium", "Adobe Firefly", "c2pa"),
    "mkv": ("ebml", 7, "true", "high", _TC260, "aigc"),
    "flv": ("flv", 0, "true", "high", _TC260, "aigc"),
}
_N = len(spelled.FILES)
_WHICH = "WITH kinds(k, name, container, entries, is_ai, confidence, platform, signals) AS (VALUES " + ", ".join(f"({k}, '{name}', " + ", ".join(repr(v) for v in _EXPECTED[name]) + ")" for k, (name, _) in enumerate(spelled.FILES)) + f"), f AS (SELECT CAST(p_partkey AS VARCHAR) AS path, kinds.* FROM part JOIN kinds ON p_partkey % {_N} = k)"


def spelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the spelled files per part."""
    kinds = spark.createDataFrame([(k, bytearray(data)) for k, (_, data) in enumerate(spelled.FILES)], "k int, content binary")
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % _N).cast("int").alias("k"))
    return part.join(F.broadcast(kinds), "k").select("path", "content")  # a row for each kind


def walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelled files, walked with a head so short that some of their metadata is late."""
    return files.walk(spelled_files(spark, sf_dir), spelled.HEAD)


@query(_WHICH + " SELECT path, container, CAST(entries AS BIGINT) AS entries FROM f")
def s19_container_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sniff and inventories of PNG, JPEG, WebP, AVI, ISO and EBML files."""
    return walked_files(spark, sf_dir).select("path", "container", F.size("entries").cast("long").alias("entries"))


@query(_WHICH + " SELECT path, is_ai, confidence, platform, signals FROM f")
def p32_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to verdicts (P02, P19, P32, P41, S01-S05, S07-S11, S16, S22, S24, S25): late and packed metadata, native labels, stores, tokens in coded pixels."""
    v = verdicts(files.evidence(walked_files(spark, sf_dir)), "region")
    return v.select("path", F.when(F.col("is_ai_generated"), "true").otherwise("unknown").alias("is_ai"), "confidence", F.coalesce("platform", F.lit("")).alias("platform"), F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"))


@query(_WHICH + " SELECT 'same' AS state, is_ai, count(*) AS n FROM f GROUP BY is_ai")
def p31_record_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's verdict, as identify() gives it, equals its portable record's."""
    walked = walked_files(spark, sf_dir)
    fields = ("is_ai_generated", "platform", "confidence", "ai_source_kind", "signals", "watermarks", "integrity_clashes", "credential_level")
    judged = lambda e: verdicts(e, "region").select("path", F.to_json(F.struct(*fields)).alias("verdict"), "is_ai_generated")
    a, b = judged(files.evidence(walked)).alias("a"), judged(files.evidence_from_records(files.records(walked))).alias("b")
    state = F.when(F.col("a.verdict") == F.col("b.verdict"), "same").otherwise("differs")
    return a.join(b, F.col("a.path") == F.col("b.path")).groupBy(state.alias("state"), F.when(F.col("a.is_ai_generated"), "true").otherwise("unknown").alias("is_ai")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 5 WHEN 0 THEN 'exif_generator' WHEN 1 THEN 'iptc' WHEN 2 THEN 'aigc' WHEN 3 THEN 'hf_job' ELSE '' END AS signals,
  CASE p_partkey % 5 WHEN 0 THEN 'Midjourney ' || p_size || ' (embedded generator tag)' WHEN 1 THEN 'Made-with-AI tag (e.g. Meta AI); platform not specified' WHEN 2 THEN 'China AIGC-labeled generator (TC260; e.g. Doubao)' WHEN 3 THEN 'HuggingFace-hosted job (model not identified)' ELSE '' END AS platform FROM part""")
def p29_external_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of other collectors (P29, P30): hex and base64 values, keys at any depth, and diagnostics that are no evidence."""
    k, part = F.col("p_partkey"), load(spark, sf_dir, "part")
    named = F.concat(F.lit('{"exif":{"0th":[{"Software":"hex:'), F.lower(F.hex(F.concat(F.lit("Midjourney "), F.col("p_size").cast("string")))), F.lit('"}]}}'))
    coded = F.concat(F.lit('{"a":{"xmp_base64":"'), F.base64(F.lit("DigitalSourceType trainedAlgorithmicMedia").cast("binary")), F.lit('"}}'))
    label = F.lit('{"png":[{"info:AIGC":"{\\"Label\\":\\"1\\"}"}]}')
    job = F.lit('{"pil":{"hf-job-id":"42"}}')
    text = F.when(k % 5 == 0, named).when(k % 5 == 1, coded).when(k % 5 == 2, label).when(k % 5 == 3, job).otherwise('{"filename":"trainedAlgorithmicMedia.png","signals":["AISystemUsed"],"x":1}')
    v = verdicts(files.evidence_from_records(part.select(k.cast("string").alias("path"), text.alias("record"))), "region")
    return v.select("path", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"), F.coalesce("platform", F.lit("")).alias("platform"))


@query(_WHICH + """ SELECT path, CASE name WHEN 'jpeg_broken' THEN 'a camera' WHEN 'jpeg_noise' THEN 'a camera' ELSE 'ChatGPT' END AS generator, CASE WHEN name IN ('jpeg_broken', 'jpeg_noise') THEN '' ELSE 'OpenAI, Adobe' END AS issuer,
  CASE WHEN name IN ('jpeg_broken', 'jpeg_noise') THEN 'edited' ELSE 'created, converted, edited' END AS actions, CASE WHEN name IN ('jpeg_broken', 'jpeg_noise') THEN '' ELSE 'generated' END AS kind, 'unknown' AS integrity FROM f WHERE name IN ('png_store', 'jpeg_store', 'jpeg_broken', 'jpeg_noise', 'mp4_store')""")
def s11_credential_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores read out of PNG, JPEG and ISO files (S11, P37-P39): issuers, generator and actions along the usable chain, dimensions unknown."""
    w = walked_files(spark, sf_dir).where("store IS NOT NULL")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return w.select("path", F.col("credential.claim_generator").alias("generator"), blank(F.col("credential.issuer")).alias("issuer"), F.col("credential.actions").alias("actions"), blank(F.col("credential.source_kind")).alias("kind"), files.credential(F.col("store"), F.col("credential"))["integrity"].alias("integrity"))


@query(_WHICH + " SELECT path, CASE name WHEN 'jpeg_exif' THEN 'Software' ELSE '' END AS fields FROM f")
def p28_ai_exif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which EXIF fields mark AI, for audits."""
    return files.evidence(walked_files(spark, sf_dir)).select("path", F.array_join("ai_exif_fields", ",").alias("fields"))


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN contains(text, 'http') THEN 'link' ELSE 'plain' END AS kind, right(text, 16) AS tail FROM documents WHERE text IS NOT NULL")
def s28_hash_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, sniff by content, tail window."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.when(F.contains("text", F.lit("http")), "link").otherwise("plain").alias("kind"), F.expr("substring(text, greatest(1, length(text) - 15), 16)").alias("tail"))


@query("""SELECT e.event_id, e.k AS value FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) e WHERE e.k IS NOT NULL AND e.event_id % 10 <> 0""")
def s37_jsonl_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a done set (S37): permissive parse, then skip what is done."""
    e = load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("value")).where("value IS NOT NULL")
    return e.join(e.where("event_id % 10 = 0").select("event_id"), "event_id", "left_anti")


@query(_WHICH + " SELECT path, CASE is_ai WHEN 'true' THEN 'true' ELSE '' END AS is_ai, replace(signals, ',', '|') AS signals FROM f")
def s40_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat report rows."""
    from ..sources.sinks import report_rows

    r = report_rows(verdicts(files.evidence(walked_files(spark, sf_dir)), "region"))
    return r.select("path", F.coalesce(F.col("is_ai").cast("string"), F.lit("")).alias("is_ai"), "signals")


@query(_WHICH + " SELECT path, container, CASE name WHEN 'parameters' THEN 'a cat, steps 20' END AS parameters, CASE name WHEN 'jpeg_exif' THEN 'Stable Diffusion' END AS software, CASE WHEN container = 'jpeg' AND name <> 'bare_jpeg' THEN '32' END AS width, CAST(CASE name WHEN 'jpeg_samsung' THEN 762 WHEN 'empty' THEN 0 ELSE 0 END AS BIGINT) AS tail FROM f WHERE container IN ('png', 'jpeg', 'webp')")
def s18_forensic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forensic records of images (S16, S18-S22, S25, H12): text, EXIF, frame size, what follows the end mark."""
    from ..sources.sinks import forensic_records

    r = forensic_records(spelled_files(spark, sf_dir))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    r = r.select("path", field("container").alias("container"), field("text.parameters").alias("parameters"), field("exif.Software").alias("software"), field("jpeg.width").alias("width"), field("trailer_bytes").cast("long").alias("tail"))
    return r.where("container IN ('png', 'jpeg', 'webp')")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL)")
def s38_manifest_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows for a corpus manifest: unseen hashes, each once."""
    from ..sources.sinks import new_manifest_rows

    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("filename"), "doc_id")
    return new_manifest_rows(d.where("doc_id % 4 = 0"), d).select("sha256")
