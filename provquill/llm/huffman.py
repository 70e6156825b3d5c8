"""Token ids as length-limited canonical Huffman code, in independent blocks with bit-offset checkpoints.

Format of a written folder (version 1): ``codebook`` holds (id, bits), from which the canonical codes follow
(shorter first, then smaller ids); ``blocks`` holds one row per block: its part and first row there (parts by
their first doc_id, then rows, are in ascending doc_id order), the doc_ids and id counts of its whole texts, the number of ids, the
bit offset of every CHECKPOINT-th id, and the bits, first bit highest.  Each block decodes by itself, and each
checkpoint starts an own lane, so one block's lanes are decoded together through one 2^16-entry table.

Rows are Parquet, so a lost executor's task is written again as a whole.  Ids are counted over all documents.
Defined results: a null or empty text has the end id alone; repeated rows and ids are kept apart, in the order
of the table's rows; null doc_ids come first; an empty table gives an empty folder and no rows; columns
beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, delete, shared_dir, small_batches, table, write_shared
from .tokens import encoder

MAX_BITS = 16
CHECKPOINT = 256
#: A block ends with the text that reaches so many ids.
BLOCK_IDS = 1 << 18

_TOKENS = "doc_id long, ids binary, part long, row long"
_BLOCKS = "part long, row long, doc_ids array<long>, counts array<long>, n_ids long, checkpoints array<long>, bits binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, flags = np.empty(0), []
    for _ in range(limit):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        at = np.argsort(both, kind="stable")
        level = both[at]
        flags.append(at < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(flags):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in code order, their codes)."""
    order = np.lexsort((ids, bits))
    codes, code, width = np.zeros(len(ids), dtype=np.int64), 0, 0
    for length in np.unique(bits):
        here = np.flatnonzero(bits[order] == length)
        code <<= int(length) - width
        width = int(length)
        codes[here] = code + np.arange(len(here))
        code += len(here)
    return ids[order], codes


def encode_block(ids: np.ndarray, code: np.ndarray, bits: np.ndarray, step: int = CHECKPOINT) -> tuple[np.ndarray, bytes]:
    """(checkpoints, packed bits) of ids, by tables over ids.

    A code begins in one 32-bit word and, if it is the word's last, may end in the next; as no code is longer
    than 16 bits, every word has a beginning, so the words are sums over runs of codes plus what spills over.
    """
    if not len(ids):
        return np.zeros(0, dtype=np.int64), b""
    width = bits[ids]
    ends = np.cumsum(width)
    starts = ends - width
    window = (code[ids] << (48 - width - (starts & 31))).view(np.uint64)
    word = starts >> 5
    later = np.flatnonzero(word[1:] != word[:-1]) + 1
    sums = np.add.reduceat(window >> np.uint64(16), np.concatenate(([0], later)))
    spill = (window[np.concatenate((later - 1, [len(ids) - 1]))] & np.uint64(0xFFFF)) << np.uint64(16)
    packed = np.zeros(len(sums) + 1, dtype=np.uint64)
    packed[:-1] = sums
    packed[1:] += spill
    return starts[::step], packed.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]


def decode_block(n: int, checkpoints: np.ndarray, packed: bytes, symbols: np.ndarray, widths: np.ndarray, step: int = CHECKPOINT) -> np.ndarray:
    """The ids of a block; symbols and widths are indexed by the next MAX_BITS bits."""
    raw = np.frombuffer(packed + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.array(checkpoints, dtype=np.int64)
    out = np.zeros((len(at), step), dtype=np.uint32)
    last = len(window) - 1
    for k in range(step):
        word = (window[np.minimum(at >> 3, last)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[:, k] = symbols[word]
        at = at + widths[word]
    return out.reshape(-1)[:n]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids as unsigned 16-bit, part, row) of every whole text, the end id appended."""
    small_batches(docs.sparkSession, 2000, "16m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, end = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            found = [raw + end for raw in encode(batch.column(1))]
            ids = np.frombuffer(b"".join(found), dtype="<u4")
            if len(ids) and ids.max() > 65535:
                raise ValueError("ids above 65535 need a wider token table")
            n, offsets = batch.num_rows, np.concatenate(([0], np.cumsum([len(x) // 2 for x in found]))).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())], names=["doc_id", "ids", "part", "row"])
            row += n

    return bare(docs, "doc_id", "text").mapInArrow(run, _TOKENS)


def _values(column: pa.Array) -> np.ndarray:
    """All ids of a binary column, one after another, as they lie in its buffer."""
    if not len(column):
        return np.zeros(0, dtype="<u2")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].view("<u2")


def _in_order(spark: SparkSession, path: str) -> str:
    """A token table whose parts ascend and do not overlap in doc_id: the same one if it is so already.

    Tables are mostly written in id order; one aggregate over (doc_id, part, row) shows whether this one is.  Otherwise rows are range-partitioned, which gives new parts.
    """
    keys = spark.read.schema(_TOKENS).parquet(path).select("doc_id", "part", "row")
    steps = keys.withColumn("before", F.lag("doc_id").over(Window.partitionBy("part").orderBy("row")))
    spans = steps.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.expr("bool_and(doc_id IS NOT NULL AND (before IS NULL OR before <= doc_id))").alias("rising"))
    spans = spans.withColumn("reached", F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)))
    if spans.agg(F.expr("coalesce(bool_and(rising AND (reached IS NULL OR reached < low)), true)")).first()[0]:
        return path

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())], names=["doc_id", "ids", "part", "row"])
            row += n

    ranged = spark.read.schema(_TOKENS).parquet(path).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "part", "row")
    new = write_shared(ranged.mapInArrow(renumber, _TOKENS), "tokens-in-order")
    delete(spark, path)
    return new


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the folder described above."""
    spark = docs.sparkSession
    tokens_path = _in_order(spark, write_shared(token_rows(docs, tokenizer, end_id), "tokens"))
    tokens = spark.read.schema(_TOKENS).parquet(tokens_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0)), minlength=65536)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = np.array(sorted(r.id for r in counts), dtype=np.int64)
    by_id = {r.id: r.n for r in counts}
    bits = code_lengths(np.array([by_id[i] for i in ids.tolist()], dtype=np.int64))
    spark.createDataFrame(list(zip(ids.tolist(), bits.tolist(), strict=True)), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    code_table, bit_table = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.int64)
    in_order, codes = canonical(ids, bits)
    code_table[in_order], bit_table[ids] = codes, bits

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(b[1] for b in block), dtype="<u2")
            marks, packed = encode_block(all_ids, code_table, bit_table)
            values = [[block[0][2]], [block[0][3]], [[b[0] for b in block]], [[len(b[1]) // 2 for b in block]], [len(all_ids)], [marks.tolist()], [packed]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "row", "doc_ids", "counts", "n_ids", "checkpoints", "bits"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and (size >= BLOCK_IDS or row[2] != block[-1][2] or row[3] != block[-1][3] + 1):
                    yield flush()
                    block, size = [], 0
                block.append(row)
                size += len(row[1]) // 2
        if block:
            yield flush()

    tokens.mapInArrow(encode, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    delete(spark, tokens_path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text, decoded from a written folder; with ids on request."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per distinct id of the vocabulary
    symbols, widths = np.zeros(1 << MAX_BITS, dtype=np.uint32), np.ones(1 << MAX_BITS, dtype=np.int64)
    ids, codes = canonical(np.array([r.id for r in book], dtype=np.int64), bits := np.array([r.bits for r in book], dtype=np.int64))
    for symbol, code, width in zip(ids.tolist(), codes.tolist(), np.sort(bits).tolist(), strict=True):
        first = code << (MAX_BITS - width)
        symbols[first : first + (1 << (MAX_BITS - width))] = symbol
        widths[first : first + (1 << (MAX_BITS - width))] = width

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, doc_ids, counts, n, marks, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = decode_block(n, np.array(marks), packed, symbols, widths).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = (ends - np.array(counts)).tolist()
                texts = [raw[4 * s : 4 * e] for s, e in zip(starts, ends.tolist(), strict=True)]
                k = len(doc_ids)
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([part] * k, pa.int64()), pa.array([row] * k, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())] if keep_ids else columns, names=["doc_id", "inside", "n_tokens", "ids_crc32", "part", "row"] + ["ids"] * keep_ids)

    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sizes = stored.select("part", "row", "n_ids", F.expr("doc_ids[0]").alias("first"))
    in_part = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("row", "first")).getField("first").alias("first")).withColumn("part_start", F.coalesce(F.sum("n").over(Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts.drop("first"), "part").select("part", "row", (F.col("part_start") + F.col("before")).alias("block_start"))
    schema = "doc_id long, inside long, n_tokens long, ids_crc32 long, part long, row long" + ", ids binary" * keep_ids
    rows = stored.mapInArrow(decode, schema).join(starts, ["part", "row"])
    return rows.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op5_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids of the byte vocabulary and id 2, written in code and read back."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_ids(spark, path)
