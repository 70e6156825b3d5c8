"""Evidence to verdict: one projection per file, no I/O.

Input columns (all but path may be null): scan BINARY, c2pa STRUCT<issuer, claim_generator, ai_tool, source_type,
source_kind, integrity, signature, trust, validity: string, identity_ai: boolean, codes: array<string>>,
ai_metadata MAP, aigc_label MAP, exif_generator STRING, xai_signature BOOLEAN, hf_job STRING, samsung_genai INT,
iptc_ai_system STRING, open_watermark STRING, trustmark STRING.  is_ai_generated is true or null, never false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probes as P
from ..functions.tokens import Tokens, seen
from . import dims

C2PA_TYPE = "struct<issuer:string,claim_generator:string,ai_tool:string,source_type:string,source_kind:string,integrity:string,signature:string,trust:string,validity:string,identity_ai:boolean,codes:array<string>>"
EVIDENCE = {
    "scan": "binary", "c2pa": C2PA_TYPE, "ai_metadata": "map<string,string>", "aigc_label": "map<string,string>", "exif_generator": "string", "xai_signature": "boolean", "hf_job": "string",
    "samsung_genai": "int", "iptc_ai_system": "string", "open_watermark": "string", "trustmark": "string",
}
LOCAL_KEYS = tuple(k for k in dims.METADATA_KEYS if k not in ("c2pa", "c2pa_chunk", "software"))


def with_evidence_columns(df: DataFrame) -> DataFrame:
    """Adds the evidence columns that are missing, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in EVIDENCE.items() if c not in df.columns})


def credential_level(c: Column) -> Column:
    invalid = F.coalesce((c["integrity"] == "invalid") | (c["signature"] == "invalid"), (c["integrity"] == "invalid"), (c["signature"] == "invalid"), F.lit(False))
    verified = (c["integrity"] == "valid") & (c["signature"] == "valid") & (c["trust"] == "trusted") & (c["validity"] == "valid")
    return F.when(invalid, "invalid").when(verified, "verified").otherwise("unverified")


def _signal(when: Column, name: str, detail: Column, confidence: Column | str) -> Column:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.when(when, F.struct(F.lit(name).alias("name"), detail.alias("detail"), level.alias("confidence")))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda x: x != ""), ", ")


def clashes(claims: Column, camera: Column) -> Column:
    """Contradictions between independent claims, an array of (family, vendor) structs.

    The manifest and SynthID are one source.  A generic TC260 label counts as ByteDance's where ByteDance is
    claimed elsewhere.  Vendors are compared within the row, so no join is needed.
    """
    generic = "China AIGC (TC260)"
    own = F.exists(claims, lambda c: (c["family"] != "aigc") & (c["vendor"] == "ByteDance"))
    settled = F.transform(claims, lambda c: F.struct(c["family"].alias("family"), F.when((c["family"] == "aigc") & (c["vendor"] == generic) & own, "ByteDance").otherwise(c["vendor"]).alias("vendor"), F.when(c["family"].isin("c2pa", "synthid"), "c2pa_manifest").otherwise(c["family"]).alias("source")))
    conflict = F.exists(settled, lambda a: F.exists(settled, lambda b: (a["source"] != b["source"]) & (a["vendor"] != b["vendor"])))
    names = F.array_sort(F.array_distinct(F.transform(settled, lambda c: c["vendor"])))
    by_vendor = F.transform(names, lambda v: F.concat(v, F.lit(" (via "), F.array_join(F.array_sort(F.transform(F.filter(settled, lambda c: c["vendor"] == v), lambda c: c["family"])), ", "), F.lit(")")))
    attribution = F.concat(F.lit("Conflicting AI-origin attributions from independent signals: "), F.array_join(by_vendor, " vs "))
    capture = F.concat(F.lit("Camera-capture C2PA credentials ("), camera, F.lit(") coexist with AI-generation markers ("), F.array_join(names, ", "), F.lit(")"))
    independent = F.exists(settled, lambda c: c["source"] != "c2pa_manifest")
    return F.array_compact(F.array(F.when(conflict, attribution), F.when(camera.isNotNull() & independent, capture)))


def verdicts(evidence: DataFrame, region: str | None = None) -> DataFrame:
    """Adds the verdict columns to evidence rows.

    region names a column with the scan's metadata region (coded pixels cut out), which the short vendor tokens
    are looked up in; longer markers read the whole scan.  Without it the whole scan serves both.  A column seen, as
    the file and record sources give it, holds the tokens of both already; else one Arrow pass finds them.
    """
    df = with_evidence_columns(evidence)
    if "seen" not in df.columns:
        df = df.withColumn("_seen", seen(F.col("scan").cast("binary"), F.col(region or "scan").cast("binary")))
    found_in = "seen" if "seen" in df.columns else "_seen"
    head, reg, c = Tokens(F.col(f"{found_in}.head")), Tokens(F.col(f"{found_in}.region")), F.col("c2pa")
    df = df.withColumns({
        "_level": credential_level(c), "_has": c.isNotNull() | P.c2pa_marker(head), "_camera": P.first_match(reg, dims.DEVICES, True), "_signer": P.first_match(reg, dims.SIGNERS, True),
        "_issuers": F.when(c["issuer"].isNotNull() & (c["issuer"] != ""), F.array(c["issuer"])).otherwise(P.sorted_matches(reg, [(v.token, v.org) for v in dims.VENDORS], True)),
        "_kind": P.source_kind(head, c["source_kind"]), "_tools": P.sorted_matches(reg, dims.AI_TOOLS, True), "_meta": F.coalesce("ai_metadata", F.create_map().cast("map<string,string>")),
        "_bindings": F.array_join(P.sorted_matches(reg, dims.SOFT_BINDINGS, True), ", "), "_sid_vendors": P.synthid_vendors(reg),
    })
    usable, has = F.col("_level") != "invalid", F.col("_has")
    identity = has & (F.coalesce(c["identity_ai"], F.lit(False)) | P.has_any(F.array_join("_issuers", " "), [v.org for v in dims.VENDORS if v.asserts_ai]))
    generator = F.coalesce(F.nullif(c["claim_generator"], F.lit("")), F.nullif(F.array_join("_tools", ", "), F.lit("")))
    trained = P.has_any(head, ("trainedAlgorithmicMedia", "TrainedAlgorithmicMedia"), True)
    given = F.nullif(F.col("_meta")["synthid_watermark"], F.lit(""))
    found = F.when(trained & P.c2pa_marker(head) & (F.size("_sid_vendors") > 0), F.concat(F.lit("present according to "), F.array_join("_sid_vendors", ", "), F.lit(" provenance")))
    df = df.withColumns({
        "_ai": usable & (F.col("_kind").isNotNull() | identity), "_generator": generator, "_synthid": F.coalesce(given, found),
        "_binding": F.coalesce(F.nullif(F.col("_meta")["soft_binding"], F.lit("")), F.nullif("_bindings", F.lit(""))),
        "_iptc": P.has_any(head, dims.IPTC_MARKERS, True) & ~has, "_fields": P.has_any(head, dims.IPTC_FIELDS, True),
        "_named": F.col("iptc_ai_system").isNotNull() & ~F.col("iptc_ai_system").isin("", "fields present"),
        "_aigc": F.col("aigc_label").isNotNull() | P.has_any(head, dims.AIGC_MARKERS, True),
        "_local": F.array_sort(F.filter(F.map_keys("_meta"), lambda k: F.lower(k).isin(*LOCAL_KEYS))),
        "_cloud": F.when(~has & P.has(head, "dcterms:provenance", True), P.first_match(head, dims.MANIFEST_HOSTS, True)),
        "_exif": F.nullif("exif_generator", F.lit("")), "_xai": F.coalesce("xai_signature", F.lit(False)), "_job": F.nullif("hf_job", F.lit("")),
    })
    ai, level = F.col("_ai"), F.when(F.col("_level") == "verified", "high").otherwise("medium")
    failed = F.array_join(F.filter(F.coalesce(c["codes"], F.array().cast("array<string>")), lambda x: F.contains(x, F.lit("mismatch")) | F.contains(x, F.lit("invalid"))), ", ")
    detail = _joined(F.array_join("_issuers", ", "), F.col("_generator"), c["source_type"])
    invalid_detail = F.concat(F.lit("C2PA manifest present, credential integrity invalid"), F.when(failed != "", F.concat(F.lit("; "), failed)).otherwise(F.lit("")))
    system, producer = F.col("iptc_ai_system"), F.coalesce(F.col("aigc_label")["ContentProducer"], F.lit(""))
    signals = F.array_compact(F.array(
        _signal(has, "c2pa", F.when(usable, F.coalesce(F.nullif(detail, F.lit("")), F.lit("C2PA manifest present"))).otherwise(invalid_detail), F.when(usable, level).otherwise("medium")),
        _signal(F.col("_cloud").isNotNull(), "c2pa_cloud", F.concat(F.lit("cloud manifest store: "), F.col("_cloud")), "medium"),
        _signal(F.col("_binding").isNotNull(), "soft_binding", F.concat(F.lit("C2PA soft binding: "), F.col("_binding")), level),
        _signal(F.col("_iptc"), "iptc", F.lit("digitalSourceType (Made with AI)"), "high"),
        _signal(F.col("_fields"), "iptc_ai_system", F.when(F.col("_named"), F.concat(F.lit("IPTC AI disclosure ("), system, F.lit(")"))).otherwise("IPTC AI disclosure fields"), "high"),
        _signal(F.col("_aigc"), "aigc", F.concat(F.lit("TC260 AIGC label"), F.when(producer != "", F.concat(F.lit(" (producer "), producer, F.lit(")"))).otherwise(F.lit(""))), "high"),
        _signal(F.size("_local") > 0, "gen_params", F.concat(F.lit("embedded keys: "), F.array_join("_local", ", ")), "high"),
        _signal(F.col("_exif").isNotNull(), "exif_generator", F.concat(F.lit("Embedded generator tag: "), F.col("_exif")), "high"),
        _signal(F.col("_xai"), "xai_signature", F.lit("EXIF Signature blob + UUID Artist"), "high"),
        _signal(F.col("_job").isNotNull(), "hf_job", F.concat(F.lit("HuggingFace job "), F.col("_job")), "medium"),
        _signal(F.col("samsung_genai").isNotNull(), "samsung_genai", F.concat(F.lit("Samsung genAIType="), F.col("samsung_genai").cast("string")), "medium"),
        _signal(F.col("open_watermark").isNotNull(), "invisible_watermark", F.col("open_watermark"), "high"),
        _signal(F.col("trustmark").isNotNull(), "trustmark", F.col("trustmark"), "high"),
    ))
    chain = F.when(has & usable, F.coalesce(
        "_camera", "_signer", F.when(ai, P.claim_platform(F.col("_generator"))), F.when(ai, P.claim_platform(c["ai_tool"])), P.issuer_platform(F.col("_issuers"), ai),
    ))
    platform = F.coalesce(
        chain, F.when(F.col("_cloud").isNotNull(), F.concat(F.lit("C2PA signer: "), F.col("_cloud"), F.lit(" (cloud manifest)"))),
        F.when(F.col("_iptc"), F.when(P.has(head, "Apple Photos Clean Up", True), "Apple Photos (Clean Up AI edit)").otherwise("Made-with-AI tag (e.g. Meta AI); platform not specified")),
        F.when(F.col("_fields") & F.col("_named"), F.concat(system, F.lit(" (IPTC AISystemUsed)"))), F.when(F.col("_aigc"), "China AIGC-labeled generator (TC260; e.g. Doubao)"),
        F.when(F.size("_local") > 0, "Stable Diffusion / local pipeline (Automatic1111, ComfyUI, InvokeAI)"), F.when(F.col("_exif").isNotNull(), F.concat(F.col("_exif"), F.lit(" (embedded generator tag)"))),
        F.when(F.col("_xai"), "xAI (Grok / Aurora)"), F.when(F.col("_job").isNotNull(), "HuggingFace-hosted job (model not identified)"), F.when(F.col("samsung_genai").isNotNull(), "Samsung Galaxy (Galaxy AI editing)"),
        F.when(F.col("open_watermark").isNotNull(), F.concat(F.col("open_watermark"), F.lit(" (open DWT-DCT watermark)"))), F.when(F.col("trustmark").isNotNull(), "Adobe (TrustMark / Content Credentials)"),
    )
    claim = lambda when, family, vendor: F.when(when & vendor.isNotNull(), F.struct(F.lit(family).alias("family"), vendor.alias("vendor")))
    claims = F.array_compact(F.array(
        claim(has & ai, "c2pa", F.coalesce(P.vendor_of(P.issuer_platform(F.col("_issuers"), F.lit(True))), P.vendor_of(F.col("_generator")), P.vendor_of(c["ai_tool"]))),
        claim(F.col("_synthid").isNotNull() & usable, "synthid", P.vendor_of(F.col("_synthid"))), claim(F.col("_fields") & F.col("_named"), "iptc_ai_system", P.vendor_of(system)),
        claim(F.col("_aigc"), "aigc", F.lit("China AIGC (TC260)")), claim(F.col("_exif").isNotNull(), "exif_generator", P.vendor_of(F.col("_exif"))), claim(F.col("_xai"), "xai", F.lit("xAI")),
    ))
    synthid = F.col("_synthid").isNotNull()
    others = F.col("_iptc") | F.col("_fields") | F.col("_aigc") | (F.size("_local") > 0) | F.col("open_watermark").isNotNull() | F.col("_exif").isNotNull() | F.col("_xai")
    df = df.withColumns({
        "signals": signals, "platform": platform, "_claims": claims, "ai_from_metadata": (has & usable & (ai | synthid)) | others,
        "_high": (has & (F.col("_level") == "verified") & (ai | synthid)) | others, "_lift": F.col("_job").isNotNull() | F.col("samsung_genai").isNotNull(),
    })
    marks = F.array_compact(F.array(
        F.when(has, F.when(usable, F.concat(F.lit("C2PA Content Credentials ("), F.coalesce(F.nullif(F.array_join("_issuers", ", "), F.lit("")), F.lit("unknown signer")), F.lit(")"))).otherwise("C2PA Content Credentials (invalid asset binding or signature)")),
        F.when(F.col("_cloud").isNotNull(), F.concat(F.lit("C2PA Durable Content Credentials (cloud manifest at "), F.col("_cloud"), F.lit("; embedded manifest absent)"))),
        F.when(synthid, F.concat(F.when(usable, "SynthID watermark (").otherwise("SynthID watermark claimed by invalid C2PA credentials ("), F.col("_synthid"), F.lit(")"))),
        F.when(F.col("_binding").isNotNull(), F.concat(F.lit("Forensic watermark soft binding ("), F.col("_binding"), F.lit(")"))), F.when(F.col("_iptc"), "IPTC digitalSourceType (Made with AI)"),
        F.when(F.col("_fields"), F.when(F.col("_named"), F.concat(F.lit("IPTC 2025.1 AI disclosure ("), system, F.lit(")"))).otherwise("IPTC 2025.1 AI disclosure fields")),
        F.when(F.col("_aigc"), "China AIGC label (TC260 standard)"), F.when(F.size("_local") > 0, "Embedded generation parameters (Stable Diffusion / ComfyUI)"),
        F.when(F.col("_exif").isNotNull(), F.concat(F.lit("Embedded generator tag: "), F.col("_exif"))), F.when(F.col("_xai"), "xAI/Grok EXIF signature"), F.when(F.col("_job").isNotNull(), "HuggingFace-hosted job (hf-job-id)"),
        F.when(F.col("samsung_genai").isNotNull(), "Samsung Galaxy AI editing marker (genAIType)"), F.when(F.col("open_watermark").isNotNull(), F.concat(F.lit("Open invisible watermark: "), F.col("open_watermark"))),
        F.when(F.col("trustmark").isNotNull(), F.concat(F.lit("Adobe TrustMark invisible watermark ("), F.col("trustmark"), F.lit(")"))),
    ))
    is_ai = F.when(F.col("ai_from_metadata") | F.col("_lift"), F.lit(True))
    broken = F.when(has & ~usable, F.concat(F.lit("C2PA credentials failed integrity validation"), F.when(failed != "", F.concat(F.lit(": "), failed)).otherwise(F.lit("."))))
    df = df.withColumns({
        "is_ai_generated": is_ai, "confidence": F.when(F.col("ai_from_metadata"), F.when(F.col("_high"), "high").otherwise("medium")).when(F.col("_lift"), "medium").otherwise("none"),
        "ai_source_kind": F.when(is_ai & ((has & usable) | F.col("_iptc")), F.col("_kind")), "watermarks": marks,
        "integrity_clashes": F.array_compact(F.concat(F.array(broken), clashes(F.col("_claims"), F.when(usable, F.col("_camera"))))),
        "credential_level": F.when(has, F.col("_level")),
    })
    return df.drop("seen", *[x for x in df.columns if x.startswith("_")])


def verdict_json(df: DataFrame, version: int = 1) -> DataFrame:
    """(path, report): the versioned JSON report; the path stays outside of it."""
    if version != 1:
        raise ValueError(f"unsupported report version {version}")
    fields = ["is_ai_generated", "platform", "confidence", "ai_source_kind", "ai_from_metadata", "watermarks", "signals", "integrity_clashes"]
    return df.select("path", F.to_json(F.struct(F.lit(version).alias("schema_version"), *fields), {"ignoreNullFields": "false"}).alias("report"))
