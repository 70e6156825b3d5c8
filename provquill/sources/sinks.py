"""Sinks and corpus tables: JSON and CSV reports, forensic records, the corpus manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verdict import verdict_json
from . import walkers

MANIFEST = "sha256 string, filename string, label string, source string, model string, width int, height int, format string, c2pa_issuer string, synthid_metadata string, verified_via string, added timestamp, notes string"


def write_report_json(verdicts: DataFrame, path: str) -> None:
    verdict_json(verdicts).write.mode("error").json(path)


def report_rows(verdicts: DataFrame) -> DataFrame:
    """One flat row per file; lists are joined by a bar."""
    bar = lambda c: F.array_join(c, "|")
    return verdicts.select("path", F.col("is_ai_generated").alias("is_ai"), "platform", "confidence", bar("watermarks").alias("watermarks"), bar(F.transform("signals", lambda s: s["name"])).alias("signals"), bar("integrity_clashes").alias("integrity_clashes"))


def write_report_csv(verdicts: DataFrame, path: str) -> None:
    report_rows(verdicts).write.mode("error").option("header", "true").csv(path)


def safe_text(c: Column, most: int = 4096) -> Column:
    """Control characters replaced, long values cut with a mark."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "�")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def capped_base64(c: Column, most: int = 65536) -> Column:
    """Base64 of at most so many bytes, with a mark where some are missing."""
    return F.concat(F.base64(F.substring(c, 1, most)), F.when(F.octet_length(c) > most, F.lit("…")).otherwise(F.lit("")))


def forensic_records(files: DataFrame, version: int = 1, whole_most: int = 256 << 20) -> DataFrame:
    """(path, record): the wide record of a file's structure as JSON; files over whole_most bytes by their head only."""
    if version != 1:
        raise ValueError(f"unsupported record version {version}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                data = data or b""
                head = data if len(data) <= whole_most else data[: 1 << 20]
                kind = walkers.sniff(head)
                record: dict = {"schema_version": 1, "container": kind, "length": len(data), "sha256": hashlib.sha256(data).hexdigest(), "head_only": len(head) < len(data), "error": None}
                try:
                    walk = {"png": walkers.png_chunks, "jpeg": walkers.jpeg_segments, "webp": walkers.riff_chunks, "avi": walkers.riff_chunks, "isobmff": walkers.iso_boxes, "ebml": walkers.ebml_elements}.get(kind)
                    record["entries"] = [[k, at, n] for k, at, n, _ in walk(head)] if walk else []
                    record |= {"text": walkers.metadata_pairs(head), "exif": walkers.exif_of(head), "jpeg": walkers.jpeg_tables(head) if kind == "jpeg" else None, "trailer_bytes": len(walkers.trailer(head))}
                except Exception as e:  # one file's fault is that file's
                    record["error"] = type(e).__name__
                out.append(json.dumps(record))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, record string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", "true").csv(path)


def new_manifest_rows(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose hash is not in the manifest, the first by filename of each hash."""
    fresh = candidates.join(manifest.select("sha256"), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("filename").alias("filename"))
    return fresh.join(first, ["sha256", "filename"], "left_semi").dropDuplicates(["sha256"])
