"""Files and records as rows: container evidence from bytes, in one Arrow pass a row.

The pass walks the container, reads the credential store, finds all tokens at once, and drops the content, so file
bytes never reach a shuffle.  A row that cannot be walked carries its error and the rest goes on.  A portable record
is read by the same functions over the bytes that it carries, so its verdict is the file's.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probes as P
from ..functions import tokens as T
from ..operators import dims, manifests, verdict
from . import credentials, walkers
from .ranged import Ranged

cloudpickle.register_pickle_by_value(sys.modules["provquill"])

HEAD = 1 << 20
SUFFIXES = ("png", "jpg", "jpeg", "webp", "avif", "heic", "heif", "jxl", "gif", "bmp", "tif", "tiff", "mp4", "mov", "m4v", "mkv", "webm", "avi", "flv")
_WALKED = f"path string, container string, scan binary, region binary, tail binary, pairs map<string,string>, exif map<string,string>, labels array<string>, samsung int, store string, credential {credentials.SUMMARY}, seen {T.SEEN}, entries array<struct<kind:string,offset:bigint,size:bigint>>, sha256 string, length bigint, head_size bigint, error string"
_S = pa.string()
_TEXT = pa.map_(_S, _S)
_CREDENTIAL = pa.struct([(n, pa.bool_() if n == "identity_ai" else _S) for n in ("issuer", "claim_generator", "ai_tool", "actions", "source_type", "source_kind", "identity_ai", "synthid", "soft_binding")])
_KINDS = {
    "path": _S, "container": _S, "scan": pa.binary(), "region": pa.binary(), "tail": pa.binary(), "pairs": _TEXT, "exif": _TEXT, "labels": pa.list_(_S), "samsung": pa.int32(), "store": _S, "credential": _CREDENTIAL, "seen": T.ARROW,
    "entries": pa.list_(pa.struct([("kind", _S), ("offset", pa.int64()), ("size", pa.int64())])), "sha256": _S, "length": pa.int64(), "head_size": pa.int64(), "error": _S,
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Supported files under a folder, as path, length and content."""
    return _listed(spark, path).select("path", "length", "content")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters (BGR) of the images under a folder, as pixel_evidence takes them; undecodable files are dropped."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def _late(data: Any, head: int) -> bytes:
    """Metadata behind the head window: late PNG and RIFF chunks, and provenance boxes."""
    kind = walkers.sniff(data)
    if kind == "png":
        first = data[:head]
        late = [b for c, at, _, b in walkers.png_chunks(data) if at >= head]
        shown = [s for s in (v.encode("utf-8", "replace") for _, v in walkers.png_text(data)) if s not in first]
        return b"".join(late) + b"".join(b"\0" + s for s in shown)
    if kind in ("webp", "avi", "riff"):
        return b"".join(b for _, at, _, b in walkers.riff_chunks(data) if at >= head)[: 4 << 20]
    return walkers.iso_provenance(data) if kind == "isobmff" else b""


def _entries(data: Any, kind: str) -> list[dict]:
    found = {"png": walkers.png_chunks, "jpeg": walkers.jpeg_segments, "isobmff": walkers.iso_boxes, "ebml": walkers.ebml_elements}.get(kind, walkers.riff_chunks if kind in ("webp", "avi", "riff", "wav") else lambda _: ())
    return [{"kind": k, "offset": at, "size": n} for k, at, n, _ in found(data)]


def _walked(path: str, data: Any, head: int, find: T.Finder) -> dict:
    """One file's row; data is bytes, or a Ranged file of which the walk reads what it needs."""
    first = data[:head]
    row: dict = {"path": path, "length": len(data), "sha256": hashlib.sha256(data).hexdigest() if isinstance(data, bytes) else None, "head_size": len(first), "scan": first, "region": first, "tail": b"", "pairs": [], "exif": [], "labels": [], "samsung": None, "store": None, "credential": None, "entries": [], "container": walkers.sniff(data), "error": None}
    try:
        store = credentials.store_of(credentials.store_bytes(data))
        row |= {
            "scan": first + _late(data, head), "region": walkers.metadata_region(first), "tail": walkers.trailer(data), "pairs": list(walkers.metadata_pairs(data).items()), "exif": list(walkers.exif_of(data).items()),
            "labels": walkers.tc260_payloads(data), "samsung": walkers.samsung_edit(data), "store": json.dumps(store) if store else None, "credential": credentials.summary(store) if store else None, "entries": _entries(data, row["container"]),
        }
    except Exception as e:  # one file's fault is that file's
        row["error"] = type(e).__name__
    return row | {"seen": find.both(row["scan"], row["region"])}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in _KINDS.items()], names=list(_KINDS))


def walk(files: DataFrame, head: int = HEAD) -> DataFrame:
    """Container evidence of (path, content) rows: see _WALKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = T.Finder()
        for batch in batches:
            yield _batch([_walked(path, data or b"", head, find) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return files.select("path", "content").mapInArrow(run, _WALKED)


def _open(path: str) -> Any:
    import pyarrow.fs

    system, inner = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inner)


def walk_heads(spark: SparkSession, path: str, head: int = HEAD, opener: Callable[[str], Any] = _open) -> DataFrame:
    """walk() of the supported files under a folder that reads each file's head, entry heads and tail only.

    Spark lists the files and the tasks read ranges through opener (by default Arrow's file systems: local, HDFS, S3,
    GCS), so a file of any size costs a few blocks; sha256 is null, as the content is never read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = T.Finder()
        for batch in batches:
            rows = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with opener(name) as handle:
                        rows.append(_walked(name, Ranged(handle, size), head, find))
                except Exception as e:  # one file's fault is that file's
                    rows.append(_walked(name, b"", head, find) | {"error": type(e).__name__})
            yield _batch(rows)

    listed = _listed(spark, path).select("path", "length")
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, _WALKED)


def evidence(walked: DataFrame) -> DataFrame:
    """Evidence rows for verdicts() from walked files or records."""
    latin = F.decode("scan", "ISO-8859-1")
    found = T.Tokens(F.col("seen.head"))
    # A pattern is only looked for where its token has been found.
    taken = lambda token, pattern: F.when(found.has(token), F.nullif(F.regexp_extract(latin, pattern, 1), F.lit("")))
    values = F.filter(
        F.array(*[F.col("exif")[k] for k in ("Software", "Make", "ImageDescription", "Artist", "UserComment")], *[F.col("pairs")[k] for k in ("Software", "Source", "Title", "Description", "Comment")], taken("CreatorTool", r'CreatorTool(?:>|=")([^<"]{1,200})')),
        lambda v: P.has_any(F.lower(v), dims.GENERATOR_TOKENS),
    )
    label = F.coalesce(P.tc260_map(F.get("labels", F.lit(0))), P.tc260_map(F.col("pairs")["AIGC"]), P.tc260_map(P.unescape_entities(taken("TC260:AIGC", r'TC260:AIGC(?:>|=["\'])([^<]*?\})')), F.lit(True)))
    named = taken("AISystemUsed", r'AISystemUsed(?:>|=")([^<"]{1,200})')
    app = F.when(found.has_named(T.APP), P.app_evidence(latin)[1])
    chain = F.col("credential")
    said = F.map_filter(F.create_map(F.lit("synthid_watermark"), chain["synthid"], F.lit("soft_binding"), chain["soft_binding"]), lambda k, v: v.isNotNull())
    own = P.ai_metadata(F.col("pairs"))
    return walked.select(
        "path", "container", "scan", "region", "seen", credential(F.col("store"), chain).alias("c2pa"), F.map_concat(F.map_filter(own, lambda k, v: ~k.isin("synthid_watermark", "soft_binding")), F.coalesce(said, F.create_map().cast("map<string,string>"))).alias("ai_metadata"),
        label.alias("aigc_label"), F.coalesce(F.get(values, F.lit(0)), app).alias("exif_generator"), P.xai_pair(F.col("exif")["ImageDescription"], F.col("exif")["Artist"]).alias("xai_signature"),
        F.nullif(F.trim(F.col("pairs")["hf-job-id"]), F.lit("")).alias("hf_job"), F.col("samsung").alias("samsung_genai"), F.when(P.has_any(found, dims.IPTC_FIELDS), F.coalesce(named, F.lit("fields present"))).alias("iptc_ai_system"),
        ai_exif_fields(F.col("exif")).alias("ai_exif_fields"), "error",
    )


def credential(store: Column, chain: Column) -> Column:
    """The verdict's credential of a store (JSON) and its chain's summary: dimensions from the store's status codes; null for no store."""
    v = manifests.validation(manifests.parse_store(store))
    fields = [chain[k].alias(k) for k in ("issuer", "claim_generator", "ai_tool", "source_type", "source_kind")] + [v[k].alias(k) for k in ("integrity", "signature", "trust", "validity")]
    return F.when(store.isNotNull(), F.struct(*fields, chain["identity_ai"].alias("identity_ai"), v["codes"].alias("codes")))


def ai_exif_fields(exif: Column) -> Column:
    """Names of the fields that mark AI (for audits): the signature pair, generator names, a label, an app's disclosure."""
    label = lambda v: P.tc260_map(F.regexp_extract(v, r'(\{.*\})', 1)).isNotNull()
    app = lambda v: F.coalesce(*P.app_evidence(v)).isNotNull()
    marks = {k: P.has_any(F.lower(exif[k]), dims.GENERATOR_TOKENS) for k in ("Software", "Make", "Artist", "ImageDescription")}
    pair = P.xai_pair(exif["ImageDescription"], exif["Artist"])
    marks["Artist"] |= pair
    marks["ImageDescription"] |= pair | F.coalesce(label(exif["ImageDescription"]) | app(exif["ImageDescription"]), F.lit(False))
    marks["UserComment"] = F.coalesce(label(exif["UserComment"]) | app(exif["UserComment"]), F.lit(False))
    return F.when(F.size(exif) > 0, F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in marks.items()]))).otherwise(F.array().cast("array<string>"))


def records(walked: DataFrame, version: int = 1) -> DataFrame:
    """(path, record): the portable metadata record as JSON; head_size parts the head of metadata_base64 from late metadata."""
    if version != 1:
        raise ValueError(f"unsupported record version {version}")
    issues = F.when(F.col("error").isNull(), F.array().cast("array<struct<stage:string,code:string>>")).otherwise(F.array(F.struct(F.lit("walk").alias("stage"), F.col("error").alias("code"))))
    fields = [
        F.lit(1).alias("schema_version"), F.lit("metadata").alias("record_type"), F.when(F.col("error").isNull(), "complete").otherwise("partial").alias("status"), issues.alias("issues"), "container",
        F.element_at(F.split("path", "/"), -1).alias("name"), F.base64("scan").alias("metadata_base64"), "head_size", F.base64("tail").alias("tail_base64"), F.col("pairs").alias("pil"), "exif", "labels", "samsung", F.col("store").alias("c2pa_store"),
    ]
    return walked.select("path", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


class BadRecord(ValueError):
    pass


def external(record: Any) -> tuple[list[tuple[str, Any]], bytes]:
    """(key, value) pairs of a nested record in their order, and its texts and encoded bytes, joined by line feeds.

    Keys that describe the collector are listed, but not entered.  Values of keys that end in base64 and texts that
    begin with hex: are decoded if they can be.
    """
    pairs: list[tuple[str, Any]] = []
    parts: list[bytes] = []
    todo: list[tuple[bool, str, Any]] = [(False, "", record)]  # (belongs to a key, key, value)
    while todo:
        keyed, key, value = todo.pop()
        if keyed:
            pairs.append((key, value))
            if key.lower() in dims.DIAGNOSTIC_KEYS:
                continue
        if isinstance(value, dict):
            todo += [(True, str(k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(False, "", v) for v in reversed(value)]
        elif value is not None:
            parts.append(_decoded(key, value))
    return pairs, b"\n".join(parts)


def _decoded(key: str, value: Any) -> bytes:
    if isinstance(value, str) and (key == "base64" or key.endswith("_base64")):
        try:
            return base64.b64decode(value.split("...TRUNCATED", 1)[0], validate=True)
        except ValueError:
            pass
    if isinstance(value, str) and value.startswith("hex:"):
        try:
            return bytes.fromhex(value[4:])
        except ValueError:
            pass
    return str(value).encode("utf-8", "replace")


def external_text(value: Any) -> str:
    """A value as text; hex: texts are the latin-1 text of their bytes."""
    if isinstance(value, str) and value.startswith("hex:"):
        return _decoded("", value).decode("latin-1").strip()
    return str(value).strip()


#: Names under which external records carry what a file's EXIF and text chunks carry.
_EXIF_NAMES = {n.lower(): n for n in ("Software", "Make", "Artist", "ImageDescription", "UserComment")}
_PAIR_NAMES = {n.lower(): n for n in ("Source", "Title", "Description", "Comment", "AIGC")} | {"creatortool": "Source", "hf-job-id": "hf-job-id"}


def _from_record(path: str, text: str | None, find: T.Finder) -> dict:
    """The walked row of a record: a portable one by what it carries, any other by its nested keys and texts."""
    record = json.loads(text or "null")
    if not isinstance(record, dict):
        raise BadRecord(f"{path}: not a record")
    if record.get("record_type") not in (None, "metadata"):
        raise BadRecord(f"{path}: unsupported record type {record['record_type']!r}")
    row: dict = {"path": path, "container": None, "tail": b"", "labels": [], "samsung": None, "entries": [], "sha256": None, "length": None, "error": None}
    versioned = record.get("record_type") == "metadata" or {"schema_version", "status"} <= record.keys()
    if versioned and (record.get("schema_version") != 1 or record.get("status") != "complete"):
        raise BadRecord(f"{path}: unsupported or incomplete record")
    if versioned or {"container", "metadata_base64", "tail_base64"} <= record.keys():
        scan = base64.b64decode(record.get("metadata_base64") or "")
        size = record.get("head_size")
        head, tail = scan[: len(scan) if size is None else size], base64.b64decode(record.get("tail_base64") or "")
        row |= {"container": record.get("container"), "scan": scan, "region": walkers.metadata_region(head), "tail": tail, "head_size": len(head), "labels": record.get("labels") or [], "samsung": record["samsung"] if "samsung" in record else walkers.samsung_edit(scan + b"\n" + tail)}
        pil, exif = ({str(k).removeprefix("info:"): str(v) for k, v in (record.get(n) or {}).items()} for n in ("pil", "exif"))
    else:
        pairs, scan = external(record)
        exif, pil = {}, {}
        for key, value in pairs:
            name = key.lower().removeprefix("info:")
            if isinstance(value, str):
                if name in _EXIF_NAMES:
                    exif.setdefault(_EXIF_NAMES[name], external_text(value))
                elif name in _PAIR_NAMES:
                    pil.setdefault(_PAIR_NAMES[name], external_text(value))
                elif key == "text" and "\0" in value:
                    pil.setdefault(*value.split("\0", 1))
        for key, value in (record.get("pil") or {}).items() if isinstance(record.get("pil"), dict) else ():
            if not isinstance(value, (dict, list)):
                pil.setdefault(str(key).lower().removeprefix("info:"), str(value))
        row |= {"scan": scan, "region": scan, "head_size": len(scan), "samsung": walkers.samsung_edit(scan)}
    store = record.get("c2pa_store")
    if isinstance(store, str):
        try:
            store = json.loads(store)
        except ValueError:
            store = None
    usable = isinstance(store, dict) and store and not store.get("error")
    row |= {"pairs": list(pil.items()), "exif": list(exif.items()), "store": json.dumps(store) if usable else None, "credential": credentials.summary(store) if usable else None}
    return row | {"seen": find.both(row["scan"], row["region"])}


def walk_records(rows: DataFrame) -> DataFrame:
    """Walked rows from (path, record) rows; a record of another version, type or status than it should have raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = T.Finder()
        for batch in batches:
            yield _batch([_from_record(path, text, find) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return rows.select("path", "record").mapInArrow(run, _WALKED)


def evidence_from_records(rows: DataFrame) -> DataFrame:
    """Evidence from (path, record) rows, portable or external: see walk_records."""
    return evidence(walk_records(rows))


def identify(spark: SparkSession, path: str, heads_only: bool = False) -> DataFrame:
    """Verdicts of the files under a folder; heads_only reads ranges of the files, not their whole content."""
    walked = walk_heads(spark, path) if heads_only else walk(read_files(spark, path))
    return verdict.verdicts(evidence(walked), "region")
