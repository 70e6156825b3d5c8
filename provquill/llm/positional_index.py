"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a shard holds the token postings of consecutive documents, one row per
term with all its positions in the shard, and one row with the shard's documents and word counts.  Positions of
a shard share one axis, with a gap between documents that no phrase or proximity window crosses.  Test windows
are sent to every shard, in blocks of items of bounded size; there the posting lists of a window's terms are
intersected at their offsets, from the rarest term on, so lists of common words are only probed, never walked.
The index stores the postings of a given vocabulary (the test terms) or, on request, of all terms.

Defined results: null texts and texts without words have no words and no hits; an item without words has no
window; windows of items with a null item_id count as hits, but such items are in no list of items; repeated
rows are judged each; repeated item_ids count once; very long texts are shards of their own;
an empty table gives an empty one, an empty benchmark no hits; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, forget_worker_state, materialize, release, small_batches, table, without

WINDOW = 13
#: Words of a shard, and the gap between its documents.
SHARD_WORDS, GAP = 1_000_000, 64
#: Words to either side of the rarest term in which a proximity match has all of a window's terms.
SLOP = 26
#: Distinct words of items up to which the index holds their postings only.
VOCABULARY = 2_000_000
#: Characters of items that are sent to the shards at a time.
BLOCK_CHARS = 8_000_000

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORDS = bytes(c if c >= 128 or c in _ALNUM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_POSTINGS = "shard long, term binary, n long, positions binary, doc_ids array<long>, n_words array<long>"
_FOUND = "shard long, place long, doc_id long, n_words long, hit_from array<long>, hit_to array<long>, items array<string>, near_items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of ASCII digits and letters (A-Z lowered) and of anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Postings per (shard, term), and one row per shard (term null) with its documents.  One pass, no shuffle.

    With a vocabulary only its terms have postings; word counts are always of all words.
    """
    small_batches(docs.sparkSession)
    known = None if vocabulary is None else {w: k for k, w in enumerate(sorted(vocabulary))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        part, number = TaskContext.get().partitionId(), 0
        terms: dict[bytes, int] = {} if known is None else known
        doc_ids: list[int | None] = []
        counts: list[int] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, doc_ids, counts, ids, terms
            base = np.cumsum([0, *(c + GAP for c in counts)])[:-1]
            at = np.concatenate([np.arange(len(x)) + b for x, b in zip(ids, base, strict=True)]) if ids else np.zeros(0, dtype=np.int64)
            term = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            at, term = at[term >= 0], term[term >= 0]
            order = np.argsort(term, kind="stable")
            at, term = at[order].astype("<i4"), term[order]
            cuts = np.flatnonzero(np.diff(term)) + 1
            lists = np.split(at, cuts) if len(term) else []
            names = list(terms)
            spelled = [names[k] for k in term[np.concatenate(([0], cuts))].tolist()] if len(term) else []
            shard, n = (part << 32) + number, len(lists)
            columns = [
                pa.array([shard] * (n + 1), pa.int64()), pa.array([*spelled, None], pa.binary()), pa.array([*map(len, lists), len(counts)], pa.int64()),
                pa.array([*(x.tobytes() for x in lists), None], pa.binary()), pa.array([None] * n + [doc_ids], pa.list_(pa.int64())), pa.array([None] * n + [counts], pa.list_(pa.int64())),
            ]
            number += 1
            doc_ids, counts, ids = [], [], []
            terms = {} if known is None else known
            return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "positions", "doc_ids", "n_words"])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if known is None:
                    found = np.fromiter((terms.setdefault(w, len(terms)) for w in words), dtype=np.int32, count=len(words))
                else:
                    found = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                doc_ids.append(doc_id)
                counts.append(len(words))
                ids.append(found)
                size += len(words) + GAP
                if size >= shard_words:
                    yield flush()
                    size = 0
        if counts:
            yield flush()

    return bare(docs, "doc_id", "text").mapInArrow(run, _POSTINGS)


class WindowSearch:
    """The distinct windows of a block of items, looked up in one shard's postings."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW, slop: int = SLOP) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows_of(words_of(text), size):
                owners[window].update(() if item is None else (item,))
        self.terms = {w: k for k, w in enumerate(sorted({w for window in owners for w in window}))}
        self.slop = slop
        self.groups = []
        for length in sorted({len(w) for w in owners}):
            mine = sorted(w for w in owners if len(w) == length)
            self.groups.append((length, np.array([[self.terms[t] for t in w] for w in mine]), [sorted(owners[w]) for w in mine]))

    def run(self, lists: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, list[str], np.ndarray]]:
        """(starts of exact occurrences, words of the window, its items, anchors of proximity matches)."""
        sizes = np.zeros(len(self.terms), dtype=np.int64)
        for k, positions in lists.items():
            sizes[k] = len(positions)
        for length, windows, owners in self.groups:
            counts = sizes[windows]
            for w in np.flatnonzero(counts.min(axis=1) > 0).tolist():
                order = np.argsort(counts[w], kind="stable").tolist()
                terms = windows[w].tolist()
                anchors = lists[terms[order[0]]].astype(np.int64)
                exact = anchors - order[0]
                near = anchors
                for offset in order[1:]:
                    positions = lists[terms[offset]]
                    if len(exact):
                        at = np.searchsorted(positions, exact + offset)
                        exact = exact[positions[np.minimum(at, len(positions) - 1)] == exact + offset]
                    at = np.searchsorted(positions, near - self.slop)
                    near = near[(at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] <= near + self.slop)]
                    if not len(near):
                        break
                if len(near):
                    yield (exact if len(near) else near), length, owners[w], near


def search(index: DataFrame, items: list[tuple[str | None, str | None]], size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document of the index: the merged ranges of words inside exact matches, and the items that match."""
    searched = WindowSearch(items, size, slop)
    if not searched.terms:
        searched.terms = {}

    def run(shard: pa.Table) -> pa.Table:
        lists: dict[int, np.ndarray] = {}
        doc_ids: list = []
        counts: list[int] = []
        number = shard.column("shard")[0].as_py()
        for term, positions, ids, words in zip(*(shard.column(c).to_pylist() for c in ("term", "positions", "doc_ids", "n_words")), strict=True):
            if term is None:
                doc_ids, counts = ids, words
            elif (k := searched.terms.get(term)) is not None:
                lists[k] = np.frombuffer(positions, dtype="<i4")
        base = np.cumsum([0, *(c + GAP for c in counts)])
        ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items_of: dict[int, set[str]] = defaultdict(set)
        near_of: dict[int, set[str]] = defaultdict(set)
        for exact, length, owners, near in searched.run(lists):
            for s, d in zip(exact.tolist(), (np.searchsorted(base, exact, "right") - 1).tolist(), strict=True):
                ranges[d].append((s - int(base[d]), s - int(base[d]) + length))
                items_of[d].update(owners)
            for d in np.unique(np.searchsorted(base, near, "right") - 1).tolist():
                near_of[d].update(owners)
        n = len(counts)
        merged = [merge(ranges.get(d, [])) for d in range(n)]
        columns = [
            pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()),
            pa.array([[a for a, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[b for _, b in m] for m in merged], pa.list_(pa.int64())),
            pa.array([sorted(items_of.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array([sorted(near_of.get(d, set()) - items_of.get(d, set())) for d in range(n)], pa.list_(pa.string())),
        ]
        return pa.Table.from_arrays(columns, names=["shard", "place", "doc_id", "n_words", "hit_from", "hit_to", "items", "near_items"])

    return index.groupBy("shard").applyInArrow(run, _FOUND)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document from the rows of several item blocks: ranges united, items distinct."""
    grouped = found.groupBy("shard", "place", "doc_id", "n_words").agg(
        F.expr("array_sort(flatten(collect_list(arrays_zip(hit_from, hit_to))))").alias("r"), F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items"), F.expr("array_sort(array_distinct(flatten(collect_list(near_items))))").alias("near_items")
    )
    fold = (
        "aggregate(r, named_struct('f', cast(array() AS array<bigint>), 't', cast(array() AS array<bigint>), 'e', -1L), (a, x) -> named_struct("
        "'f', CASE WHEN x.hit_from > a.e THEN concat(a.f, array(x.hit_from)) ELSE a.f END, "
        "'t', CASE WHEN x.hit_from > a.e THEN concat(a.t, array(x.hit_to)) WHEN x.hit_to > a.e THEN concat(slice(a.t, 1, size(a.t) - 1), array(x.hit_to)) ELSE a.t END, "
        "'e', greatest(a.e, x.hit_to)))"
    )
    return grouped.withColumn("m", F.expr(fold)).select("shard", "place", "doc_id", "n_words", F.col("m.f").alias("hit_from"), F.col("m.t").alias("hit_to"), "items", F.expr("array_except(near_items, items)").alias("near_items"))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, in the order of their ids; one block is on the driver at a time."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for r in bare(benchmark, "item_id", "text").selectExpr("cast(item_id AS string) AS item", "text").orderBy("item", "text").toLocalIterator():
        block.append((r.item, r.text))
        size += len(r.text or "") + 64
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def vocabulary_of(benchmark: DataFrame, most: int = VOCABULARY) -> set[bytes] | None:
    """The distinct words of the items; None, for an index of all terms, where they are more than the driver should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in words_of(t)}), pa.binary())], names=["word"])

    words = materialize(bare(benchmark, "text").mapInArrow(run, "word binary").distinct(), "vocabulary")
    found = None if words.count() > most else {bytes(r.word) for r in words.collect()}
    release(words)
    return found


def match(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document with its exact and proximity matches: see _FOUND; ranges are word numbers, end exclusive."""
    index = materialize(build_index(docs, vocabulary_of(benchmark)), "postings")
    parts = [materialize(search(index, block, size, slop), "matches") for block in item_blocks(benchmark, block_chars)]
    if not parts:
        parts = [materialize(search(index, [], size, slop), "matches")]
    release(index)
    return parts[0] if len(parts) == 1 else _merge_blocks(reduce(DataFrame.union, parts))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: a twentieth of the words or more inside exact matches."""
    hit = "aggregate(zip_with(hit_from, hit_to, (a, b) -> b - a), 0L, (s, x) -> s + x)"
    return found.withColumn("n_hit", F.expr(hit)).withColumn("n_items", F.expr("cast(size(items) AS bigint)")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows in every document."""
    found = with_verdict(match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.expr("cast(size(near_items) AS bigint)").alias("n_near_items"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; equal (doc_id, text) rows share their verdict, a null doc_id is a value."""
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    judged = with_verdict(match(keyed.select(F.col("_key").alias("doc_id"), "_row.text"), table(spark, sf_dir, "benchmark")))
    return without(keyed, judged.where("contaminated").select(F.col("doc_id").alias("_key")), "_key").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
