"""Token matching, evidence and verdict queries.  The tables hold no media, so evidence is spelled from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probes as P
from ..operators import dims, verdict
from ..operators.manifests import edges, parse_store, reachable, status_codes, validation
from .registry import load, query

# Which key gets which token: every k-th part carries it.
_PLANTED = ((7, "jumb c2pa "), (5, "OpenAI "), (11, "Adobe "), (13, "Google "), (3, "trainedAlgorithmicMedia "), (17, "compositeSynthetic "), (19, "NIKON "), (23, "AISystemUsed "), (29, "TC260:AIGC "), (31, "c2pa.watermarked "), (37, "com.digimarc "))
_SCAN_SQL = " || ".join(f"CASE WHEN p_partkey % {k} = 0 THEN '{t}' ELSE '' END" for k, t in _PLANTED)


def planted_text(key: str) -> Column:
    return F.concat(*[F.when(F.col(key) % k == 0, t).otherwise("") for k, t in _PLANTED])


def planted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        k.cast("string").alias("path"), k, planted_text("p_partkey").cast("binary").alias("scan"), F.when(k % 41 == 0, "Midjourney v6").alias("exif_generator"), (k % 43 == 0).alias("xai_signature"),
        F.when(k % 47 == 0, F.concat(F.lit("job-"), k.cast("string"))).alias("hf_job"), F.when(k % 53 == 0, 1).alias("samsung_genai"), F.when(k % 23 == 0, F.when(k % 2 == 0, "Gemini").otherwise("fields present")).alias("iptc_ai_system"),
    )


_ORGS = [(v.token, v.org) for v in dims.VENDORS if v.token in ("OpenAI", "Adobe", "Google")]
_LIST = lambda pairs, text: "list_filter([" + ", ".join(f"CASE WHEN contains({text}, '{t}') THEN '{o}' END" for t, o in pairs) + "], lambda x: x IS NOT NULL)"

_EVIDENCE_SQL = f"""
WITH e AS (SELECT p_partkey, {_SCAN_SQL} AS scan,
    CASE WHEN p_partkey % 41 = 0 THEN 'Midjourney v6' END AS gen, p_partkey % 43 = 0 AS xai,
    CASE WHEN p_partkey % 47 = 0 THEN 'job-' || p_partkey END AS job, p_partkey % 53 = 0 AS sam,
    CASE WHEN p_partkey % 23 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Gemini' ELSE 'fields present' END END AS sys FROM part),
a AS (SELECT *, contains(scan, 'jumb') AND contains(lower(scan), 'c2pa') AS has, list_sort({_LIST(_ORGS, "scan")}) AS issuers,
    CASE WHEN contains(scan, 'trainedAlgorithmicMedia') THEN 'generated' WHEN contains(scan, 'compositeSynthetic') THEN 'enhanced' END AS kind,
    contains(scan, 'NIKON') AS cam, contains(scan, 'AISystemUsed') AS fields, contains(scan, 'TC260:AIGC') AS aigc, contains(scan, 'com.digimarc') AS bind,
    contains(scan, 'trainedAlgorithmicMedia') OR contains(scan, 'compositeSynthetic') AS marked FROM e),
b AS (SELECT *, marked AND NOT has AS iptc, kind IS NOT NULL AS ai, len(list_filter(issuers, lambda x: x = 'Google LLC')) > 0 OR (contains(scan, 'OpenAI') AND contains(scan, 'c2pa.watermarked')) AS sidv,
    array_to_string(list_filter([CASE WHEN contains(scan, 'Google') THEN 'Google LLC' END, CASE WHEN contains(scan, 'OpenAI') AND contains(scan, 'c2pa.watermarked') THEN 'OpenAI' END], lambda x: x IS NOT NULL), ', ') AS sids FROM a),
c AS (SELECT *, CASE WHEN contains(scan, 'trainedAlgorithmicMedia') AND has AND sidv THEN 'present according to ' || sids || ' provenance' END AS sid, has AND ai AS c2pa_ai FROM b),
d AS (SELECT *, CASE WHEN contains(scan, 'Adobe') THEN 'Adobe Firefly' WHEN contains(scan, 'OpenAI') THEN 'OpenAI (ChatGPT / gpt-image / DALL-E / Sora)' WHEN contains(scan, 'Google') THEN 'Google (Gemini / Imagen)' END AS named,
    (has AND (ai OR sid IS NOT NULL)) AS c2pa_arm, iptc OR fields OR aigc OR gen IS NOT NULL OR xai AS others FROM c),
f AS (SELECT *, CASE WHEN has THEN coalesce(CASE WHEN cam THEN 'Nikon (camera, C2PA capture)' END, CASE WHEN ai THEN named END, CASE WHEN len(issuers) > 0 THEN 'C2PA signer: ' || array_to_string(issuers, ', ') || ' (no known AI generator named)' END) END AS chain,
    list_filter([
      CASE WHEN has AND ai AND named IS NOT NULL THEN {{'f': 'c2pa', 'v': CASE WHEN contains(scan, 'Adobe') THEN 'Adobe' WHEN contains(scan, 'OpenAI') THEN 'OpenAI' ELSE 'Google' END}} END,
      CASE WHEN sid IS NOT NULL THEN {{'f': 'synthid', 'v': CASE WHEN contains(lower(sid), 'openai') THEN 'OpenAI' ELSE 'Google' END}} END,
      CASE WHEN fields AND sys = 'Gemini' THEN {{'f': 'iptc_ai_system', 'v': 'Google'}} END, CASE WHEN aigc THEN {{'f': 'aigc', 'v': 'China AIGC (TC260)'}} END,
      CASE WHEN xai THEN {{'f': 'xai', 'v': 'xAI'}} END], lambda x: x IS NOT NULL) AS claims FROM d)
"""


@query(_EVIDENCE_SQL + """
SELECT p_partkey, CASE WHEN c2pa_arm OR others OR job IS NOT NULL OR sam THEN 'true' ELSE 'unknown' END AS is_ai_generated,
  coalesce(chain, CASE WHEN iptc THEN 'Made-with-AI tag (e.g. Meta AI); platform not specified' END, CASE WHEN fields AND sys = 'Gemini' THEN 'Gemini (IPTC AISystemUsed)' END,
    CASE WHEN aigc THEN 'China AIGC-labeled generator (TC260; e.g. Doubao)' END, CASE WHEN gen IS NOT NULL THEN gen || ' (embedded generator tag)' END, CASE WHEN xai THEN 'xAI (Grok / Aurora)' END,
    CASE WHEN job IS NOT NULL THEN 'HuggingFace-hosted job (model not identified)' END, CASE WHEN sam THEN 'Samsung Galaxy (Galaxy AI editing)' END) AS platform,
  CASE WHEN c2pa_arm OR others THEN CASE WHEN others THEN 'high' ELSE 'medium' END WHEN job IS NOT NULL OR sam THEN 'medium' ELSE 'none' END AS confidence,
  CASE WHEN (c2pa_arm OR others OR job IS NOT NULL OR sam) AND (has OR iptc) THEN kind END AS ai_source_kind,
  array_to_string(list_filter([CASE WHEN has THEN 'c2pa:medium' END, CASE WHEN bind THEN 'soft_binding:medium' END, CASE WHEN iptc THEN 'iptc:high' END, CASE WHEN fields THEN 'iptc_ai_system:high' END,
    CASE WHEN aigc THEN 'aigc:high' END, CASE WHEN gen IS NOT NULL THEN 'exif_generator:high' END, CASE WHEN xai THEN 'xai_signature:high' END, CASE WHEN job IS NOT NULL THEN 'hf_job:medium' END,
    CASE WHEN sam THEN 'samsung_genai:medium' END], lambda x: x IS NOT NULL), ',') AS signals
FROM f""")  # fmt: skip
def p40_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict assembly (P09-P14, P22, P23, P36, P40, P41, F27) over planted evidence of every part."""
    v = verdict.verdicts(planted_evidence(spark, sf_dir))
    return v.select("p_partkey", F.when(F.col("is_ai_generated"), "true").otherwise("unknown").alias("is_ai_generated"), "platform", "confidence", "ai_source_kind", F.array_join(F.transform("signals", lambda s: F.concat(s["name"], F.lit(":"), s["confidence"])), ",").alias("signals"))


@query(_EVIDENCE_SQL + """
, g AS (SELECT p_partkey, cam, has, c.f AS fam, c.v AS vendor, CASE WHEN c.f IN ('c2pa', 'synthid') THEN 'c2pa_manifest' ELSE c.f END AS source FROM (SELECT p_partkey, cam, has, unnest(claims) AS c FROM f))
SELECT p_partkey, coalesce((SELECT bool_or(a.source <> b.source AND a.vendor <> b.vendor) FROM g a JOIN g b USING (p_partkey) WHERE a.p_partkey = f.p_partkey), false) AS conflict,
  coalesce((SELECT string_agg(DISTINCT vendor, '|' ORDER BY vendor) FROM g WHERE g.p_partkey = f.p_partkey), '') AS vendors,
  has AND cam AND coalesce((SELECT bool_or(source <> 'c2pa_manifest') FROM g WHERE g.p_partkey = f.p_partkey), false) AS capture_clash_c2pa
FROM f""")  # fmt: skip
def p42_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity clashes between independent claims."""
    v = verdict.verdicts(planted_evidence(spark, sf_dir))
    text = F.array_join("integrity_clashes", "\n")
    vendors = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(F.exists("signals", lambda s: s["name"] == "c2pa") & F.col("_ai"), F.coalesce(P.vendor_of(P.issuer_platform(F.col("_issuers"), F.lit(True))), F.lit(None).cast("string"))),
        F.when(F.col("_sid").isNotNull(), P.vendor_of(F.col("_sid"))), F.when(F.col("iptc_ai_system") == "Gemini", "Google"), F.when(P.has(F.col("scan"), "TC260:AIGC", True), "China AIGC (TC260)"), F.when(F.col("xai_signature"), "xAI"),
    ))))
    trained, marker = P.has(F.col("scan"), "trainedAlgorithmicMedia", True), P.c2pa_marker(F.col("scan"))
    sid = P.synthid_vendors(F.col("scan"))
    v = v.withColumns({"_issuers": P.sorted_matches(F.col("scan"), [(x.token, x.org) for x in dims.VENDORS], True), "_ai": P.source_kind(F.col("scan"), F.lit(None).cast("string")).isNotNull(), "_sid": F.when(trained & marker & (F.size(sid) > 0), F.array_join(sid, ", "))})
    return v.select("p_partkey", F.contains(text, F.lit("Conflicting AI-origin")).alias("conflict"), F.array_join(vendors, "|").alias("vendors"), (marker & F.contains(text, F.lit("Camera-capture"))).alias("capture_clash_c2pa"))


@query(f"""SELECT p_partkey, {_LIST(_ORGS, 'scan')}[1] AS first_org, array_to_string(list_sort({_LIST(_ORGS, 'scan')}), '|') AS orgs,
  CASE WHEN contains(replace(scan, 'compositeSynthetic', ''), 'trainedAlgorithmicMedia') THEN 'generated' WHEN contains(scan, 'compositeSynthetic') THEN 'enhanced' END AS kind
FROM (SELECT p_partkey, {_SCAN_SQL} AS scan FROM part)""")  # fmt: skip
def p06_token_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, all and ordered token matches and the source kind (P06-P09) over planted text."""
    t = load(spark, sf_dir, "part").select("p_partkey", planted_text("p_partkey").alias("t"))
    ordered = [(v.token, v.org) for v in dims.VENDORS]
    return t.select("p_partkey", P.first_match(F.col("t"), ordered).alias("first_org"), F.array_join(P.sorted_matches(F.col("t"), ordered), "|").alias("orgs"), P.source_kind(F.col("t"), F.lit(None).cast("string"), False).alias("kind"))


_WORDS = ("license", "token", "http", "@", "password")


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in _WORDS) + " END AS first_word, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in _WORDS) + "], lambda x: x IS NOT NULL), '|') AS words FROM documents")
def p08_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority lookup and ordered matches over whole texts."""
    pairs = [(w, w) for w in _WORDS]
    return load(spark, sf_dir, "documents").select("doc_id", P.first_match(F.col("text"), pairs).alias("first_word"), F.array_join(P.ordered_matches(F.col("text"), pairs), "|").alias("words"))


@query("SELECT token, count(*) AS n, min(doc_id) AS first_doc FROM documents JOIN (VALUES ('license'), ('token'), ('@'), ('Licensed')) d(token) ON contains(text, token) GROUP BY token")
def j02_dimension_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension token join (J02): a four-row literal dimension, so the nested loop is over four tokens a row."""
    d = spark.createDataFrame([("license",), ("token",), ("@",), ("Licensed",)], "token string")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(d), F.contains("text", "token")).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT p_type AS text, CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' ELSE NULL END AS family, count(*) AS n FROM part GROUP BY ALL")
def p10_vendor_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First token in the lower-cased text (P10, P12, P46) with a caller's own dimension."""
    t = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("n"))
    return t.select("text", P.first_match(F.lower("text"), (("steel", "steel"), ("brass", "brass"))).alias("family"), "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) > 0 AND list_contains(json_keys(props), 'k') AS known, strlen(props) <= 1048576 AS sized FROM events WHERE props IS NOT NULL")
def p17_json_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON object to map, key overlap and size cap."""
    m = F.from_json("props", "map<string,string>")
    return load(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", m["k"].alias("k"), F.arrays_overlap(F.map_keys(m), F.array(F.lit("k"))).alias("known"), (F.octet_length("props") <= 1 << 20).alias("sized"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, replace(replace(replace(replace(replace(replace(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') AS plain,
 len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""")
def p18_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex extraction and single-pass entity unescaping."""
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return load(spark, sf_dir, "pages").select("page_id", title.alias("title"), P.unescape_entities(title).alias("plain"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query("SELECT c_custkey, code, CASE WHEN length(code) >= 22 AND left(code, 3) = '001' THEN substring(code, 5, 18) ELSE code END AS uscc FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0011' ELSE '9' END || lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS code FROM customer)")
def p20_company_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company code slice of a producer code (P20)."""
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, "0011").otherwise("9"), F.lpad(F.col("c_custkey").cast("string"), 18, "0"))
    return load(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).withColumn("uscc", P.uscc(F.col("code")))


@query("""SELECT o_orderkey, CASE WHEN k IN (0, 3) THEN CASE k WHEN 0 THEN 'ByteDance Dreamina' END WHEN k = 1 THEN 'ByteDance Aweme AI' WHEN k = 2 THEN 'Embedded app AIGC disclosure' END AS generator,
 CASE k WHEN 0 THEN 'ByteDance Dreamina' WHEN 3 THEN 'ByteDance Doubao' END AS product FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)""")
def p25_app_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App export metadata (P24-P26): products and generators from JSON-shaped text."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, '{"product": "dreamina", "exportType":"generation"}').when(k == 1, '{\\"aigc_info\\":{\\"aigc_type\\":1}, \\"product\\":\\"aweme\\"}').when(k == 2, '{"aigc_info": {"aigc_label_type": 2}}').when(k == 3, '{"product":"Doubao"}').otherwise("{}")
    product, generator = P.app_evidence(text)
    return load(spark, sf_dir, "orders").select("o_orderkey", generator.alias("generator"), product.alias("product"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS paired FROM customer")
def p27_signature_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature and UUID pair."""
    k = F.col("c_custkey")
    description = F.when(k % 2 == 0, F.concat(F.lit("Signature: "), F.repeat(F.lit("Ab+/"), 16))).otherwise("Signature: short")
    artist = F.when(k % 3 == 0, "someone").otherwise("123e4567-e89b-12d3-a456-426614174000")
    return load(spark, sf_dir, "customer").select("c_custkey", P.xai_pair(description, artist).alias("paired"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'parameters' WHEN 1 THEN 'Title' WHEN 2 THEN 'my_openai_id' ELSE 'Comment' END AS k, c_custkey % 4 IN (0, 2) OR c_custkey % 8 = 3 AS kept, CAST(CASE WHEN c_custkey % 4 IN (0, 2) OR c_custkey % 8 = 3 THEN least(201, CASE WHEN c_custkey % 8 = 3 THEN 10 ELSE 250 END) ELSE -1 END AS BIGINT) AS chars FROM customer")
def p05_metadata_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI metadata map (P03-P05, S41): key and value predicates, values cut at 200 characters."""
    k = F.col("c_custkey")
    key = F.when(k % 4 == 0, "parameters").when(k % 4 == 1, "Title").when(k % 4 == 2, "my_openai_id").otherwise("Comment")
    value = F.when(k % 8 == 3, "Midjourney").otherwise(F.repeat(F.lit("x"), 250))
    kept = P.ai_metadata(F.create_map(key, value))
    return load(spark, sf_dir, "customer").select("c_custkey", key.alias("k"), (F.size(kept) > 0).alias("kept"), F.coalesce(F.length(kept[key]), F.lit(-1)).cast("long").alias("chars"))


_STORE = """concat('{"active_manifest":"m', n_nationkey, '","validation_state":"Valid","validation_results":{"activeManifest":{"success":[{"code":"claimSignature.validated"},{"code":"assertion.dataHash.match"}',
  CASE WHEN n_nationkey % 2 = 0 THEN ',{"code":"signingCredential.trusted"}' ELSE '' END, CASE WHEN n_nationkey % 3 = 0 THEN ',{"code":"claimSignature.insideValidity"}' ELSE '' END, '],"failure":[', CASE WHEN n_nationkey % 5 = 0 THEN '{"code":"assertion.dataHash.mismatch"}' ELSE '' END, ']}}}')"""


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'invalid' ELSE 'valid' END AS integrity, 'valid' AS signature, CASE WHEN n_nationkey % 2 = 0 THEN 'trusted' ELSE 'unknown' END AS trust, CASE WHEN n_nationkey % 3 = 0 THEN 'valid' ELSE 'unknown' END AS validity,
 CAST(2 + (n_nationkey % 2 = 0)::INT + (n_nationkey % 3 = 0)::INT + (n_nationkey % 5 = 0)::INT AS BIGINT) AS codes, CASE WHEN n_nationkey % 5 = 0 THEN 'invalid' WHEN n_nationkey % 6 = 0 THEN 'verified' ELSE 'unverified' END AS level FROM nation""")
def p35_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential validation (P34-P36, P39, P53, P54): status codes to four dimensions and a level."""
    v = load(spark, sf_dir, "nation").select("n_nationkey", parse_store(F.expr(_STORE)).alias("store")).withColumn("v", validation(F.col("store")))
    return v.select("n_nationkey", "v.integrity", "v.signature", "v.trust", "v.validity", F.size("v.codes").cast("long").alias("codes"), verdict.credential_level(F.col("v")).alias("level"))


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'c' || c_custkey, 'r0' FROM customer),
 t(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT t.root, e.child, depth + 1 FROM t JOIN e ON e.parent = t.node WHERE depth < 6)
SELECT root, depth, count(*) AS n FROM (SELECT root, node, min(depth) AS depth FROM t GROUP BY ALL) GROUP BY ALL""")
def j01_ingredient_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle-safe breadth-first traversal over links that are not bad (J01): regions, nations and customers."""
    nation, customer, region = (load(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    roots = region.select(tag("r", "r_regionkey").alias("path"), tag("r", "r_regionkey").alias("root"))
    links = (
        nation.select(tag("r", "n_regionkey").alias("parent"), tag("n", "n_nationkey").alias("child"), F.lit(False).alias("bad"))
        .union(customer.select(tag("n", "c_nationkey"), tag("c", "c_custkey"), F.col("c_custkey") % 7 == 0))
        .union(customer.select(tag("c", "c_custkey"), F.lit("r0"), F.lit(False)))
    )
    found = reachable(roots, links)
    return found.groupBy(F.col("path").alias("root"), F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS n, 'a|b' AS nodes FROM part")
def j01_store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and traversal of JSON stores (J01, P37): an ingredient chain with a cycle and one bad link per store."""
    part = load(spark, sf_dir, "part")
    text = F.expr("""concat('{"active_manifest":"a","manifests":{"a":{"ingredients":[{"active_manifest":"b"},{"active_manifest":"x","validation_status":[{"code":"claimSignature.mismatch"}]}]},"b":{"ingredients":[{"active_manifest":"a"}]},"x":{"claim_generator":"', p_name, '"}}}')""")
    stores = part.select(F.col("p_partkey").cast("string").alias("path"), parse_store(text).alias("store"))
    found = reachable(stores.select("path", F.col("store.active_manifest").alias("root")), edges(stores))
    return found.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("nodes"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS fallback, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM customer")
def p34_status_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status codes fall back to the flat list only where the results name none."""
    text = F.when(F.col("c_custkey") % 2 == 0, '{"validation_status":[{"code":"general.error"}]}').otherwise('{"validation_results":{"activeManifest":{"success":[{"code":"ok"}]}},"validation_status":[{"code":"general.error"}]}')
    _, _, bad = status_codes(parse_store(text))
    return load(spark, sf_dir, "customer").select("c_custkey", (F.size(bad) > 0).alias("fallback"), F.size(bad).cast("long").alias("failures"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'vetoed' WHEN c_custkey % 7 = 0 THEN 'kept' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'dropped' END ELSE 'dropped' END AS pill FROM customer")
def f28_pill_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep rule of a weak mark (F27, F28, F30): vetoed by another product's mark, kept with its own or by provenance on a flat ground."""
    from ..operators.marks import keep_pill

    k = F.col("c_custkey")
    fired = F.array_compact(F.array(F.when(k % 3 == 0, "doubao"), F.when(k % 7 == 0, "jimeng")))
    kept = keep_pill(fired, F.when(k % 5 == 0, F.array(F.lit("jimeng"))).otherwise(F.array().cast("array<string>")), k % 2 == 0)
    vetoed = F.array_contains(fired, "doubao")
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(kept, "kept").when(vetoed, "vetoed").otherwise("dropped").alias("pill"))


@query("""SELECT p_partkey, mark, p_size / 100.0 >= gate AS strict, p_size / 100.0 >= gate * factor AS relaxed FROM part, (VALUES ('doubao', 0.5, 0.7), ('jimeng', 0.45, 0.7), ('kling', 0.35, 1.0)) m(mark, gate, factor)""")
def f22_mark_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and relaxed gates of marks over a score table."""
    from ..operators.marks import gates

    scores = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("score"), F.explode(F.array(*[F.lit(m) for m in ("doubao", "jimeng", "kling")])).alias("mark"))
    return gates(scores).select("p_partkey", "mark", "strict", "relaxed")


@query("""WITH s AS (SELECT p_partkey AS path, m AS mark, ((p_size * k) % 97) / 97.0 AS score FROM part, (VALUES ('doubao', 7), ('qwen', 13), ('jimeng', 5), ('baidu', 3)) d(m, k)), r(mark, rival) AS (VALUES ('jimeng', 'doubao'), ('baidu', 'doubao'), ('baidu', 'qwen'))
SELECT s.path, s.mark, round(s.score, 6) AS score, round(s.score - max(o.score), 6) AS margin FROM s LEFT JOIN r ON r.mark = s.mark LEFT JOIN s o ON o.path = s.path AND o.mark = r.rival GROUP BY s.path, s.mark, s.score""")
def j11_rival_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of a mark's score over its best rival on the same blob."""
    from ..operators.marks import rival_margin

    marks = F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(k).alias("k")) for m, k in (("doubao", 7), ("qwen", 13), ("jimeng", 5), ("baidu", 3))])
    s = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", F.explode(marks).alias("x")).select("path", F.col("x.mark").alias("mark"), (F.pmod(F.col("p_size") * F.col("x.k"), F.lit(97)) / 97.0).alias("score"))
    return rival_margin(s, ("path",)).select("path", "mark", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("""WITH s AS (SELECT p_partkey AS path, r AS rung, greatest((p_size * (r + 3)) % 50 - 25, -5) / 25.0 AS score FROM part, range(0, 6) t(r)),
b AS (SELECT path, rung, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, rung) AS k FROM s) SELECT path, CASE WHEN score > 0 THEN rung END AS rung, round(greatest(score, 0), 6) AS score FROM b WHERE k = 1""")
def t02_best_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rung of a scale ladder, the earliest on a tie, none under a score of 0."""
    from ..operators.marks import best_rung

    r = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("rung"))
    s = r.select("path", "rung", (F.greatest(F.pmod(F.col("p_size") * (F.col("rung") + 3), F.lit(50)) - 25, F.lit(-5)) / 25.0).alias("score"))
    return best_rung(s, ("path",)).select("path", "rung", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT p_brand AS path, p_partkey AS id, (p_partkey * 7) % 1000 AS x, ((p_partkey * 13) % 89) / 89.0 AS score FROM part),
g AS (SELECT path, list({'id': id, 'x': x, 's': score} ORDER BY score DESC, x, id) AS p FROM c GROUP BY path),
t AS (SELECT path, unnest(list_reduce(list_transform(p, lambda c: [c]), lambda taken, n: CASE WHEN len(taken) >= 3 OR len(list_filter(taken, lambda y: abs(y.x - n[1].x) < 40)) > 0 THEN taken ELSE list_concat(taken, n) END)) AS z FROM g)
SELECT path, z.x AS x, round(z.s, 6) AS score FROM t""")
def t01_top_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of a group that do not overlap."""
    from ..operators.marks import top_apart

    k = F.col("p_partkey")
    c = load(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), (F.pmod(k * 13, F.lit(89)) / 89.0).alias("score"), F.struct(F.pmod(k * 7, F.lit(1000)).alias("x"), F.lit(0).alias("y"), F.lit(40).alias("w"), F.lit(20).alias("h")).alias("region"))
    return top_apart(c, "path").select("path", F.col("region.x").alias("x"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey, greatest(p_size * 3 - 8 * p_size // 10 - 5, 0) AS x, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS tier FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def f18_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size tier and placement by integer arithmetic."""
    from ..operators.audits import bucket

    w = F.col("p_size").cast("long")
    return load(spark, sf_dir, "part").select("p_partkey", F.expr("greatest(cast(p_size AS bigint) * 3 - 8 * cast(p_size AS bigint) div 10 - 5, 0L)").alias("x"), bucket(w, (10, 30), ("small", "medium", "large")).alias("tier"))


@query("SELECT p_partkey, 'gen ' || p_name AS generator FROM part")
def p33_cbor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CBOR text after a key."""
    name = F.concat(F.lit("gen "), F.col("p_name"))
    size = F.length(name)
    head = F.when(size < 24, F.char(size + 0x60)).otherwise(F.concat(F.lit("x"), F.char(size)))
    buf = F.encode(F.concat(F.lit("..claim_generator"), head, name, F.lit("tail")), "ISO-8859-1")
    return load(spark, sf_dir, "part").select("p_partkey", P.cbor_text_after(buf, "claim_generator").alias("generator"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 'true' ELSE 'unknown' END AS is_ai, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'OpenAI' END, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'veo' ELSE 'kling' END END) AS platform,
 CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 'high' ELSE 'unknown' END AS confidence FROM part""")
def p48_video_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video verdicts from markers and the first stable mark."""
    from ..operators.video import video_verdicts

    k = F.col("p_partkey")
    v = load(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.when(k % 3 == 0, F.array(F.lit("Made with Sora"))).otherwise(F.array().cast("array<string>")).alias("markers"))
    s = load(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.explode(F.when(k % 8 == 0, F.array(F.lit("kling"), F.lit("veo"))).when(k % 4 == 0, F.array(F.lit("kling"))).otherwise(F.array().cast("array<string>"))).alias("mark"))
    return video_verdicts(v, s).select("path", F.when(F.col("is_ai_generated"), "true").otherwise("unknown").alias("is_ai"), "platform", "confidence")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'OpenAI|Adobe' AS issuers, 'a0|b' || (p_partkey % 3) AS generators FROM part")
def p37_structured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers and generators along a store's usable chain."""
    from ..operators.manifests import structured_fields

    text = F.expr("""concat('{"active_manifest":"a","manifests":{"a":{"claim_generator":"a0","signature_info":{"issuer":"OpenAI"},"ingredients":[{"active_manifest":"b"},{"active_manifest":"x","validation_status":[{"code":"claimSignature.mismatch"}]}]},"b":{"claim_generator":"b', p_partkey % 3, '","signature_info":{"issuer":"Adobe"}},"x":{"claim_generator":"never"}}}')""")
    stores = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), parse_store(text).alias("store"))
    f = structured_fields(stores)
    return f.select("path", F.array_join("issuers", "|").alias("issuers"), F.array_join("claim_generators", "|").alias("generators"))
