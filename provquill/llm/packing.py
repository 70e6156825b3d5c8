"""Harmonic packing of token sequences.

A text's ids are cut into pieces whose lengths are reciprocals of the capacity (capacity // j for j = 1, 2, ...)
while at least ``tail`` ids remain, and one last piece of its own length.  Lengths fall into reciprocal classes:
a bin for length s holds exactly capacity // s pieces, so a piece's place follows from its rank among pieces of
its length alone.  Workers rank their own pieces; running totals of the counts per (worker, length) turn those
into global ranks, and no piece moves.  The one incomplete bin of each length is joined with others first-fit on
the driver, from at most tail + capacity / tail counts.

Defined results: a null or empty text is the end id alone; ties and repeated rows are separate documents, each
packed; a null doc_id is carried along; an empty table gives no pieces; columns beside doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, materialize, small_batches, table
from .tokens import encoder

CAPACITY = 4096
#: Below this many remaining ids a piece takes its own length instead of being cut once more.
TAIL = 256


def cut(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Piece lengths of a text of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= tail:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return [*out, n] if n else out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """One row per piece, with its worker's number and its rank among that worker's pieces of the same length."""
    small_batches(docs.sparkSession, 2000, "16m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(tokenizer).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                raw, start = raw + end, 0
                for length in cut(len(raw) // 4, capacity, tail):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, part, rank))
                    start += length
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return bare(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long")


def layout(totals: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first bin, pieces in full bins, shared bin, offset there) from the count of pieces per length."""
    out, next_bin, rests = [], 0, []
    for length in sorted(totals, reverse=True):
        per_bin = capacity // length
        full = totals[length] // per_bin * per_bin
        rests.append((length * (totals[length] - full), length, next_bin, full))
        next_bin += full // per_bin
    room: list[int] = []
    for size, length, first, full in sorted(rests, key=lambda r: (-r[0], r[1])):
        k = next((k for k, free in enumerate(room) if free >= size), len(room)) if size else 0
        if size and k == len(room):
            room.append(capacity)
        out.append((length, first, full, next_bin + k, capacity - room[k] if size else 0))
        if size:
            room[k] -= size
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """Every piece with its sequence and its offset there; offsets in a sequence have no gaps."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, tokenizer, end_id, capacity, tail), "pieces")
    counts = cut_up.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = materialize(before, "piece-counts")
    totals = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(layout(totals, capacity), "length long, first long, full long, shared long, shared_offset long")
    ranked = cut_up.join(before.select("part", "length", "before"), ["part", "length"]).join(F.broadcast(plan), "length")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumn("per_bin", F.expr(f"{capacity}L div length"))
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("CASE WHEN rank < full THEN first + rank div per_bin ELSE shared END").alias("sequence_id"),
        F.expr("CASE WHEN rank < full THEN rank % per_bin * length ELSE shared_offset + (rank - full) * length END").alias("offset"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids of the word vocabulary, each document ended by id 2."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
