"""Evidence probes as column expressions.  ``buf`` is BINARY or STRING; matching is case-sensitive unless said."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import dims
from . import tokens
from .tokens import Tokens

Pairs = Sequence[tuple[str, str]]


def has(buf: Column | Tokens, token: str, binary: bool = False) -> Column:
    """contains, false for null."""
    if isinstance(buf, Tokens):
        return buf.has(token)
    return F.coalesce(F.contains(buf, F.lit(bytearray(token.encode())) if binary else F.lit(token)), F.lit(False))


def has_any(buf: Column | Tokens, tokens: Iterable[str], binary: bool = False) -> Column:
    if isinstance(buf, Tokens):
        return buf.has_any(tokens)
    out = F.lit(False)
    for t in tokens:
        out = out | has(buf, t, binary)
    return out


def first_match(buf: Column | Tokens, pairs: Pairs, binary: bool = False) -> Column:
    """The label of the first pair, in table order, whose token occurs; null for none."""
    return F.coalesce(*[F.when(has(buf, t, binary), F.lit(label)) for t, label in pairs], F.lit(None).cast("string"))


def ordered_matches(buf: Column | Tokens, pairs: Pairs, binary: bool = False) -> Column:
    """Distinct labels of all tokens that occur, in table order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(has(buf, t, binary), F.lit(label)) for t, label in pairs])))


def sorted_matches(buf: Column | Tokens, pairs: Pairs, binary: bool = False) -> Column:
    return F.array_sort(ordered_matches(buf, pairs, binary))


def c2pa_marker(buf: Column | Tokens) -> Column:
    """The provenance box's UUID, or a jumb box together with c2pa in any case."""
    if isinstance(buf, Tokens):
        return buf.has_named(tokens.UUID) | buf.has_named(tokens.NAMED)
    uuid = F.contains(buf, F.lit(bytearray.fromhex("d8fec3d61b0e483c92975828877ec481")))
    jumb = F.contains(buf, F.lit(bytearray(b"jumb")))
    named = F.contains(F.lower(F.decode(buf, "ISO-8859-1")), F.lit("c2pa"))
    return F.coalesce(uuid | (jumb & named), F.lit(False))


def source_kind(buf: Column | Tokens, structured: Column, binary: bool = True) -> Column:
    """generated, enhanced or null; composite markers hold the other marker's letters and are taken out first."""
    if isinstance(buf, Tokens):
        return F.when(F.coalesce(structured == "generated", F.lit(False)) | buf.has_named(tokens.BARE), "generated").when(F.coalesce(structured == "enhanced", F.lit(False)) | buf.has_any(tokens.COMPOSITES), "enhanced")
    text = F.decode(buf, "ISO-8859-1") if binary else buf
    bare = F.replace(F.replace(text, F.lit("compositeWithTrainedAlgorithmicMedia"), F.lit("")), F.lit("compositeSynthetic"), F.lit(""))
    generated = (structured == "generated") | has_any(bare, ("trainedAlgorithmicMedia", "TrainedAlgorithmicMedia"))
    enhanced = (structured == "enhanced") | has_any(text, ("compositeWithTrainedAlgorithmicMedia", "compositeSynthetic"))
    return F.when(F.coalesce(generated, has_any(bare, ("trainedAlgorithmicMedia", "TrainedAlgorithmicMedia"))), "generated").when(F.coalesce(enhanced, has_any(text, ("compositeWithTrainedAlgorithmicMedia", "compositeSynthetic"))), "enhanced")


def vendor_of(text: Column) -> Column:
    """The coarse vendor of a platform or generator name; null for none."""
    return first_match(F.lower(text), dims.VENDOR_TOKENS)


def claim_platform(generator: Column) -> Column:
    return first_match(F.lower(generator), dims.CLAIM_GENERATORS)


def issuer_platform(issuers: Column, is_ai: Column) -> Column:
    """The generating platform of issuers of AI content; a neutral signer label else; null without issuers."""
    joined = F.array_join(issuers, " ")
    named = first_match(joined, [(v.needle, v.platform) for v in dims.VENDORS if v.needle])
    neutral = F.when(F.size(issuers) > 0, F.concat(F.lit("C2PA signer: "), F.array_join(issuers, ", "), F.lit(" (no known AI generator named)")))
    return F.coalesce(F.when(is_ai, named), neutral)


def synthid_vendors(buf: Column | Tokens, binary: bool = True) -> Column:
    action = has(buf, "c2pa.watermarked", binary)
    found = [F.when(has(buf, v.token, binary) & (action if v.needs_watermark_action else F.lit(True)), F.lit(v.org)) for v in dims.VENDORS if v.synthid]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def is_ai_key(key: Column) -> Column:
    low = F.lower(key)
    return low.isin(*dims.METADATA_KEYS) | has_any(low, dims.METADATA_KEYWORDS)


def ai_metadata(pairs: Column) -> Column:
    """Entries whose key or generator value marks AI, values cut at 200 characters."""
    kept = F.map_filter(pairs, lambda k, v: is_ai_key(k) | has_any(F.lower(v), dims.GENERATOR_TOKENS))
    return F.transform_values(kept, lambda k, v: F.when(F.length(v) > 200, F.concat(F.substring(v, 1, 200), F.lit("…"))).otherwise(v))


def tc260_map(value: Column, namespaced: Column | None = None) -> Column:
    """A TC260 label from its JSON: null over 1 MiB, for no object, or (outside its name space) without a normative field."""
    parsed = F.from_json(value, "map<string,string>")
    known = F.arrays_overlap(F.map_keys(parsed), F.array(*[F.lit(f) for f in dims.TC260_FIELDS]))
    ok = (F.octet_length(value) <= 1 << 20) & (known if namespaced is None else (known | namespaced))
    return F.when(ok, parsed)


def uscc(code: Column) -> Column:
    """The 18-character company code inside a producer code of 22 or more that begins 001."""
    return F.when((F.length(code) >= 22) & (F.substring(code, 1, 3) == "001"), F.substring(code, 5, 18)).otherwise(code)


def app_evidence(text: Column) -> tuple[Column, Column]:
    """(product provenance, generator) of an app's export metadata."""
    flat = F.replace(text, F.lit('\\"'), F.lit('"'))
    products = F.transform(F.regexp_extract_all(flat, F.lit(r'(?i)"product"\s*:\s*"([a-z0-9_]+)"'), F.lit(1)), F.lower)
    exports = F.transform(F.regexp_extract_all(flat, F.lit(r'(?i)"exportType"\s*:\s*"([a-z0-9_]+)"'), F.lit(1)), F.lower)
    named = F.transform(products, lambda p: F.coalesce(*[F.when(p == k, F.lit(v)) for k, v in dims.APP_PRODUCTS], F.lit(None).cast("string")))
    product = F.get(F.array_compact(named), F.lit(0))
    generation = F.arrays_overlap(products, F.array(F.lit("dreamina"), F.lit("dreamina_oversea"))) & F.array_contains(exports, "generation")
    info = F.contains(F.lower(flat), F.lit('"aigc_info"'))
    aweme = F.array_contains(products, "aweme") & flat.rlike(r'(?i)"aigc_type"\s*:\s*1(?=\s*[,}])')
    label = flat.rlike(r'(?i)"aigc_label_type"\s*:\s*[12](?=\s*[,}])')
    return product, F.when(generation, "ByteDance Dreamina").when(info & aweme, "ByteDance Aweme AI").when(info & label, "Embedded app AIGC disclosure")


def xai_pair(description: Column, artist: Column) -> Column:
    """A long base64 signature in the description together with a UUID as artist."""
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.coalesce(description.rlike(r"^Signature:\s*[A-Za-z0-9+/=]{64,}") & F.trim(artist).rlike(uuid), F.lit(False))


def unescape_entities(text: Column) -> Column:
    """XML's five entities in one pass: the ampersand's comes last, so that nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two regions (x, y, w, h); 0 for an empty union."""
    width = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    height = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - width * height
    return F.when(union > 0, width * height / union).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % score interval; (0, 0) for no trials."""
    p = k / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n == 0, F.lit(0.0)).otherwise((mid - half) / scale), F.when(n == 0, F.lit(0.0)).otherwise((mid + half) / scale)


def cbor_text_after(buf: Column, key: str) -> Column:
    """The CBOR text string that follows a key in a buffer: short, one-byte and two-byte lengths; null for anything else."""
    latin = F.decode(buf, "ISO-8859-1")
    at = F.locate(key, latin)
    rest = F.substring(latin, at + len(key), F.lit(70_000))
    byte = lambda k: F.ascii(F.substring(rest, k, 1))
    text = F.when(byte(1).between(0x60, 0x77), F.substring(rest, F.lit(2), byte(1) - 0x60)).when(byte(1) == 0x78, F.substring(rest, F.lit(3), byte(2))).when(byte(1) == 0x79, F.substring(rest, F.lit(4), byte(2) * 256 + byte(3)))
    plain = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when((at > 0) & plain.rlike(r"^[^\x00-\x1F\x7F]+$"), plain)
