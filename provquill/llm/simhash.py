"""SimHash near-duplicates: deletion-variant signatures over two 32-bit halves.

Two fingerprints at two or fewer differing bits differ by at most one bit in one of their halves.  Each distinct
fingerprint is indexed under its halves as they are, and under every half with one bit made a wildcard; equal
keys meet in an equality join and the distance is verified there.  The wildcard key of bit i is probed by
fingerprints whose bit i is 0 and indexed by those whose bit i is 1, so a pair meets once, not 32 times.

Keys that very many fingerprints share (clouds of near copies) are not joined with themselves: their members
are indexed once more with the remaining distance's wildcards in the other half.  All members of such a refined
key are within the distance, so each is linked to the smallest of them: rows grow with the members, never with
their square, and no link between different fingerprints is lost to the components.

Defined results: null and empty texts have no words, fingerprint zero, and are linked like any other; repeated
rows and copies share a fingerprint and so a component; a row with a null doc_id links like any other and names
no component (its component_id is null if no row with an id is reached); an empty table gives an empty one;
columns beside doc_id and text are ignored, whatever their names.

The pipeline's stage links all that these links of fingerprints join, found in the same way, and beyond them texts
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Fingerprints of such texts differ in about
ten of 64 bits, too many for segments to select by, so these come by another way beside it, which takes nothing from
the first.  Equal sets are one from the start.  A union of at most nine shingles is similar only where one set lacks a single shingle
of the other, which deletion variants of the set find by equality, each variant one set at most.  Larger sets
(eight shingles or more) become candidates by min-hash bands (24 of 4: a pair at 0.8 is missed with a probability of
4e-6), and every link of theirs is verified on the whole shingle sets.  Each member of a band key is first held against the
smallest and the greatest one; only what these links leave in different components is compared further.  A text of
fewer than five words is one shingle; texts without words are one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bare, drop_shuffles, forget_worker_state, give_back, materialize, release, small_batches, table, without
from .graph import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: From so many members of one key on, the key is refined instead of joined with itself.
HOT_KEY = 512

#: The stage's shingle size, its bands of min-hashes, and the least similarity of a link as a fraction.
SHINGLE, BANDS, BAND_ROWS, SIMILAR = 5, 24, 4, (4, 5)
#: Sets of so few shingles have deletion variants, sets of so many have bands; a similar union of ten shingles or more shares eight.
SMALL, LARGE = 9, 8


def fingerprint_of(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprints of whole texts, as unsigned integers."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)

    def flush(first: int, last: int) -> None:
        n = counts[first:last]
        full = np.flatnonzero(n)
        if not len(full):
            return
        h = np.array(hashes, dtype=np.uint64)
        ends = np.cumsum(n[full])
        starts = ends - n[full]
        value = np.zeros(len(full), dtype=np.uint64)
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            value |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
        out[first + full] = value

    first = 0
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(digest(b" ".join(words), seed))
            counts[i] = 1
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-shingle] + 1))
            hashes += [digest(joined[s:e], seed) for s, e in zip(begins.tolist(), ends[shingle - 1 :].tolist())]
            counts[i] = len(words) - shingle + 1
        if len(hashes) > 200_000:
            flush(first, i + 1)
            hashes, first = [], i + 1
    flush(first, len(texts))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer.  One pass over the texts, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        for batch in batches:
            found = fingerprint_of(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return bare(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame, half: int) -> DataFrame:
    """(fp, key, side): the half as it is (side 2), and its one-wildcard variants (side: the bit left out).

    The key packs half number (1 bit), wildcard position + 1 (6 bits) and the half with that bit zeroed (32 bits).
    """
    mine = f"shiftrightunsigned(fp, {32 * half}) & 4294967295L"
    exact = f"struct({half << 38}L | ({mine}) AS key, 2 AS side)"
    wild = f"transform(sequence(0, 31), i -> struct({half << 38}L | shiftleft(cast(i + 1 AS bigint), 32) | (({mine}) & ~shiftleft(1L, i)) AS key, cast(shiftright({mine}, i) & 1 AS int) AS side))"
    return fps.select("fp", F.explode(F.expr(f"concat(array({exact}), {wild})")).alias("x")).select("fp", "x.key", "x.side")


def links(fps: DataFrame, distance: int = 2, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between distinct fingerprints that join everything within the distance (2 at most).

    Pairs under ordinary keys are all there; members of a hot key come as stars over refined keys.
    """
    if distance not in (1, 2):
        raise ValueError("two halves with one wildcard each find distances of 1 and 2")
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    # Counted where the keys meet, so all that follows reads one exchange of them.
    keys = _variants(dealt, 0).union(_variants(dealt, 1)).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    cold_keys, hot_keys = keys.where(f"n <= {hot_key}"), keys.where(f"n > {hot_key}").drop("n")
    left = cold_keys.where("side <> 1").select("key", F.col("fp").alias("a"), F.col("side").alias("s"))
    right = cold_keys.where("side <> 0").select("key", F.col("fp").alias("b"), F.col("side").alias("t"))
    pairs = left.join(right.hint("merge"), (left.key == right.key) & F.expr(f"bit_count(a ^ b) <= {distance} AND ((s = 2 AND t = 2 AND a < b) OR (s = 0 AND t = 1))")).select("a", "b")
    # What remains of the distance, as wildcards in the other half: both bits for an exact key, one for a wildcard key.
    other = "CASE WHEN shiftright(key, 38) = 0 THEN shiftrightunsigned(fp, 32) & 4294967295L ELSE fp & 4294967295L END"
    refined = hot_keys.withColumn("o", F.expr(other)).withColumn(
        "masks",
        F.expr("CASE WHEN side = 2 THEN flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j)))) ELSE transform(sequence(0, 31), i -> shiftleft(1L, i)) END" if distance == 2 else "CASE WHEN side = 2 THEN transform(sequence(0, 31), i -> shiftleft(1L, i)) ELSE array(0L) END"),
    )
    refined = refined.select("fp", "key", F.explode("masks").alias("mask"), "o").withColumn("rest", F.expr("o & ~mask")).drop("o")
    least = refined.groupBy("key", "mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    stars = refined.join(least, ["key", "mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return materialize(pairs.union(stars.distinct()), "fingerprint-links")


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a chain of links reaches.

    Tables with a row for every fingerprint are joined by sorting, whatever size a plan takes them for: a broadcast
    would pass through the driver, whose memory does not grow with the documents.
    """
    known = materialize(fingerprints(docs), "fingerprints")
    groups = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    reached = components(links(groups.select("fp"), distance))
    rooted = groups.join(reached.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return known.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words are those of the fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle]), seed) for k in range(max(1, len(words) - shingle + 1))], dtype=np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for every set; the sets have to be non-empty."""
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(sizes) - sizes
    r = np.random.default_rng(42)
    salts, factors = r.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            mixed = (flat ^ salts[k]) * (factors[k] | np.uint64(1))
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum.reduceat(mixed * np.uint64(0xD6E8FEB86659FD93), starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _hashes(sets: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 7) for x in sets], dtype=np.uint64).view(np.int64)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(key, doc_id, fp, set, n, keys, variants) of (key, doc_id, text).

    fp is the fingerprint, set is the hash of a text's shingle set, n its size; variants are the hashes of the set
    without one shingle each.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(2).to_pylist()
                sets = [shingle_set(t) for t in texts]
                full = [x for x in sets if len(x) >= LARGE]
                keys = iter(band_keys(full).view(np.int64).tolist() if full else [])
                raw = [x.tobytes() for x in sets]
                ids = _hashes(raw)
                less = [_hashes([x[: 8 * k] + x[8 * k + 8 :] for k in range(len(x) // 8)]) if 5 <= len(x) // 8 <= SMALL else [] for x in raw]
                columns = [part.column(0), part.column(1), pa.array(fingerprint_of(texts).view(np.int64)), pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array([next(keys) if len(x) >= LARGE else [] for x in sets], pa.list_(pa.int64())), pa.array(less, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "fp", "set", "n", "keys", "variants"])
        give_back()

    return rows.mapInArrow(run, "key long, doc_id long, fp long, set long, n long, keys array<long>, variants array<long>")


def shingles_of(wanted: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """(set, shingles) of the wanted sets: their sorted hashes, made again from one text of each, so that no table holds those of all."""
    chosen = materialize(known.select("key", "set").join(wanted.hint("merge"), "set", "left_semi").groupBy("set").agg(F.min("key").alias("key")), "chosen-rows")
    few = chosen.count() <= BROADCAST_KEYS // 2
    texts = rows.select("key", "text").join(F.broadcast(chosen) if few else chosen.hint("merge"), "key").select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["set", "shingles"])
        give_back()

    return texts.mapInArrow(run, "set long, shingles binary").groupBy("set").agg(F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is SIMILAR or more, counted on the whole sets."""
    over, under = SIMILAR
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "wanted-sets")
    texts = materialize(shingles_of(wanted, known, rows), "shingle-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                union = len(np.unique(both))
                ok.append(under * (len(both) - union) >= over * union)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in range(2)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    found = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar-sets")
    release(wanted, texts)
    return found


def fingerprint_links(known: DataFrame) -> DataFrame:
    """(a, b): links between distinct sets that join those whose texts have the same fingerprint or linked ones."""
    owners = materialize(known.groupBy("fp").agg(F.min("set").alias("first")), "fingerprint-owners")
    same = known.select("fp", "set").distinct().join(owners.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("set").alias("b"))
    near = linked = links(owners.select("fp"))
    for end in ("a", "b"):
        near = near.join(owners.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")).hint("merge"), end).drop(end).withColumnRenamed(f"_{end}", end)
    found = materialize(same.union(near.select("a", "b")).where("a <> b"), "fingerprint-set-links")
    release(owners, linked)
    drop_shuffles(known.sparkSession)
    return found


def similar_links(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links between distinct sets that join all which linked fingerprints or the similar pairs of a key join; those of band keys are verified."""
    over, under = SIMILAR
    first_links = fingerprint_links(known)
    fit = f"{under} * least(m, n) >= {over} * greatest(m, n)"
    distinct = materialize(known.groupBy("set").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("variants").alias("variants")), "distinct-sets")
    fuller = distinct.select(F.col("set").alias("b"), F.explode("variants").alias("a"))
    lacking = fuller.join(distinct.where(f"n < {SMALL}").select(F.col("set").alias("a")), "a").select("a", "b")
    entries = distinct.select("set", "n", F.explode("keys").alias("key"))
    pivots = entries.groupBy("key").agg(F.min(F.struct("set", "n")).alias("p"), F.max(F.struct("set", "n")).alias("z"), F.count("*").alias("c")).where("c > 1")
    members = materialize(entries.join(pivots, "key").select("key", "set", "n", "p", "z"), "band-members")
    first = members.select("set", "n", F.explode(F.array("p", "z")).alias("p")).select("set", "n", F.col("p.set").alias("pivot"), F.col("p.n").alias("m"))
    pairs = materialize(first.where(f"set <> pivot AND {fit}").select(F.least("pivot", "set").alias("a"), F.greatest("pivot", "set").alias("b")).distinct(), "star-pairs")
    stars = materialize(first_links.union(lacking).union(similar(pairs, known, rows)), "stars")
    reached = components(stars).select(F.col("node").alias("set"), "component")
    placed = materialize(members.join(reached, "set", "left").select("key", "set", "n", F.expr("set = p.set OR set = z.set").alias("met"), F.coalesce("component", "set").alias("component")), "placed-members")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    # The pivots have met all members; the others of different components have not met.
    rest = materialize(placed.where("NOT met").join(open_keys, "key", "left_semi"), "open-members")
    found = materialize(stars.union(joined_sets(rest, known, rows)), "set-links")
    release(first_links, distinct, members, pairs, stars, placed, rest)
    return found


def joined_sets(members: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links that join the components of a key's members wherever any links do.

    A task goes through the pairs of its keys in order and passes over those whose components it has joined already.
    """
    over, under = SIMILAR
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = members.select("set").distinct()
    sets = shingles_of(wanted, known, texts)
    rows = members.select("key", "set", "component").join(sets, "set").select(F.pmod(F.xxhash64("key"), F.lit(4 * partitions)).alias("bucket"), "key", "set", "component", "shingles")

    def run(table: pa.Table) -> pa.Table:
        key, ids, group = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "set", "component"))
        order = np.lexsort((ids, key))
        key, ids, group = key[order], ids[order], group[order]
        raw = table.column("shingles").combine_chunks().take(pa.array(order))
        shingles = [np.frombuffer(raw[k].as_py(), dtype=np.uint64) for k in range(len(raw))]
        sizes = np.fromiter(map(len, shingles), dtype=np.int64, count=len(shingles))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        seen: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for at, to in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            for i in range(at, to):
                fits = (group[i + 1 : to] != group[i]) & (under * np.minimum(sizes[i + 1 : to], sizes[i]) >= over * np.maximum(sizes[i + 1 : to], sizes[i]))
                for j in (np.flatnonzero(fits) + i + 1).tolist():
                    x, y, pair = find(int(group[i])), find(int(group[j])), (int(ids[i]), int(ids[j]))
                    if x != y and pair not in seen:
                        seen.add(pair)
                        both = int(sizes[i] + sizes[j])
                        common = both - len(np.unique(np.concatenate((shingles[i], shingles[j]))))
                        if under * common >= over * (both - common):
                            up[x] = y
                            out.append(pair)
        return pa.Table.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_copies(rows: DataFrame) -> DataFrame:
    """(key, first, n) of (key, doc_id, text), once for every key: the first key that a chain of texts with similar shingle sets reaches, and the key's rows.

    Keys are in the order of doc_id, those without one last, then of the key.
    """
    known = materialize(shingle_sets(rows), "shingle-sets")
    reached = components(similar_links(known, rows)).select(F.col("node").alias("set"), "component")
    # Copies are counted down to sets first, so a set that a third of the rows share is one row in what follows.
    firsts = known.groupBy("set").agg(F.min(F.struct(F.expr("doc_id IS NULL").alias("none"), "doc_id", "key")).alias("first"))
    rooted = materialize(firsts.join(reached, "set", "left").select("set", "first", F.coalesce("component", "set").alias("root")), "rooted-sets")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_set = rooted.join(least, "root").select("set", F.col("least.key").alias("first"))
    per_key = known.groupBy("key", "set").agg(F.count("*").alias("n"))
    out = materialize(per_key.join(by_set, "set").select("key", "first", "n"), "near-copies")
    release(known, rooted)
    return out


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (of different texts that share it or have none the one with the smallest hash, of equal rows any)."""
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("key"))
    found = near_copies(keyed.select("key", "_row.doc_id", "_row.text"))
    kept = without(keyed, found.where("key <> first").select("key"), "key")
    repeated = materialize(found.where("key = first AND n > 1").select("key"), "repeated-rows")
    rows = lambda df: df.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    if repeated.isEmpty():
        return rows(kept)
    single = kept.join(repeated, "key", "left_anti")
    return rows(single.union(kept.join(repeated, "key", "left_semi").dropDuplicates(["key"]).select(single.columns)))
