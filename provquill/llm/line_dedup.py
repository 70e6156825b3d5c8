"""Line dedup by a segment-partition edit join.

Equal lines of any length are copies.  Lines of ``WORDY`` words or more are also compared by edit distance on
words, with a threshold that grows with the shorter line (``BANDS``: one word from 10 words on, two from 20,
three from 40); a pair with a line of fewer words is compared on code points, with a threshold of ``DISTANCE``,
if both have ``MIN_CHARS`` code points.  White space divides words and does not count between them.

Two sequences within t edits share one of t + 1 even segments of the shorter one, at a place that the lengths
bound: every distinct line is indexed under its segments and probes, for each length it may match, the
substrings that the multi-match-aware bounds leave.  Keys are 64-bit hashes of (unit, length, segment number,
segment), all taken from one running hash per batch; a key's lowest bits hold the threshold and the role.  Index
and probe entries travel as packed arrays, so a shuffled entry is 24 bytes; a bucket of keys is sorted and
matched in numpy, pairs whose sketches differ too much go at once, and the rest is verified on its texts by
banded bit-parallel edit distance.

A crowd of near copies has links by the square of its size, of which a class needs few.  So lines of one length are
first held against one of those that share a segment in its place, the key's pivot; then one member of every class
(connected component) that a key still holds is held against its pivot; and what these links leave in different
classes is compared further, pair by pair in one task a key, which passes over the classes that it has joined.  Links
are therefore enough to join whatever is linked, not all there are.  Linked lines are in one class, so n_links, all
links of a line, is counted inside the classes afterwards, block against block, with no row for a link.

A key that leaves very many such pairs (lines that share a beginning, an end or a middle) is not matched with itself.
Its members keep what surrounds the shared segment as pieces: if segment i is the first at which a linked pair
is in step, the left piece has exactly i edits and the right one t - i at most.  Members are signed once more by
the segments of their most selective piece, under the key and that piece's own threshold, and so on while a key
stays hot.  Every round shortens the pieces, and only keys whose pieces are too short to be cut again, where
what is left differs within the threshold, are matched as they are; so no link between classes is lost.  A group in
which a piece that must hold edits is the same for all members holds no pair that an earlier segment has not.

A line goes if the same text, or one that a chain of links reaches, first occurs earlier (by doc_id, then row, then
line number).  Copies are one class from the start and never multiply entries.

Defined results: null, empty and blank texts have no lines; blank lines stay; a null doc_id comes before all
others; every row is judged by itself, rows that share a doc_id or have none in the order of a number that is
written once with the table, so of two identical rows the second loses its lines; an empty table gives an empty
one; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, give_back, materialize, release, routing_keys, small_batches, table, worker_state
from .graph import components

#: Threshold on code points, and the fewest code points of a line that is compared so.
DISTANCE, MIN_CHARS = 2, 16
#: Lines of so many words are compared on words; (fewest words of the shorter line, threshold), ascending.
WORDY, BANDS = 10, ((10, 1), (20, 2), (40, 3))
#: Pairs of different classes that one key may leave before it is refined.
HOT_PAIRS = 2_000_000
#: The table of bits that every task gets to find the texts of ids has so many rows of 64 bits at most.
BIT_ROWS = 1_000_000
_CHUNK = 1 << 20
_ENTRIES = 1_200_000
_PAIRS = 1 << 18

_U = np.uint64
_BASE, _K1, _K2, _K3 = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
#: (fewest elements of the shorter sequence, threshold), ascending.
Bands = tuple[tuple[int, int], ...]


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    return _long_powers(_CHUNK * 2 - 1)


def _long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


#: Bytes that are white space, as str.split() has it; those that begin longer white space, and its spellings in UTF-8.
_BLANK, _LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


class Words:
    """The words of lines that lie one after another in UTF-8 bytes, found and hashed together."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        blank = _BLANK[data]
        lead = np.flatnonzero(_LEAD[data])
        if len(lead):
            after = [np.where(lead + k < len(data), data[np.minimum(lead + k, len(data) - 1)], 0).astype(np.int64) for k in (1, 2)]
            two = data[lead].astype(np.int64) << 8 | after[0]
            for wide, size in ((lead[np.isin(two, _WIDE)], 2), (lead[np.isin(two << 8 | after[1], _WIDE)], 3)):
                for k in range(size):
                    blank[wide + k] = True
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        # A line may begin right behind the last word of another document.
        inner = starts[(starts > 0) & (starts < len(data))]
        first[inner] = ~blank[inner]
        last[inner - 1] = ~blank[inner - 1]
        self.data, self.starts = data, np.flatnonzero(first)
        self.bytes = np.flatnonzero(last) + 1 - self.starts
        self.at = np.searchsorted(self.starts, starts)
        self.counts = np.searchsorted(self.starts, ends) - self.at

    def codes(self, lines: np.ndarray) -> np.ndarray:
        """Hashes of the words of some of the lines."""
        counts = self.counts[lines]
        word = np.repeat(self.at[lines] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        start, size = self.starts[word], self.bytes[word]
        eight = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        for kind, k in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):  # the eight bytes from every place on
            eight = eight.astype(kind)
            eight[:-k] |= eight[k:] << kind(8 * k)
        out = size.astype(np.uint64) * _K3
        going = np.arange(len(out))
        for k in range(0, min(_LONG, int(size.max(initial=0))), 8):
            if k:
                going = going[size[going] > k]
            out[going] = _mix(out[going] ^ (eight[start[going] + k] & _MASKS[np.minimum(size[going] - k, 8)]))
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[start[i] : start[i] + size[i]], 3)
        return out


class Hashed:
    """Running hashes and sketches of sequences (code points, or words); sub() hashes any of their substrings at once."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        power, self.inverse = worker_state("line_dedup_powers", _powers) if len(codes) < 2 * _CHUNK else _long_powers(len(codes))
        self.prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(codes + _U(1)) * power[: len(codes)], dtype=np.uint64)))
        bins = np.repeat(np.arange(len(sizes)), sizes) * 16 + (codes % _U(16)).astype(np.int64)
        counts = np.bincount(bins, minlength=16 * len(sizes)).reshape(-1, 16).astype(np.uint64) & _U(15)
        self.sketch = (counts << (np.arange(16, dtype=np.uint64) * _U(4))).sum(axis=1, dtype=np.uint64)

    @classmethod
    def of_chars(cls, lines: list[str]) -> Hashed:
        raw = [x.encode("utf-32-le", "surrogatepass") for x in lines]
        return cls(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.uint64), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4)

    @classmethod
    def of_words(cls, lines: list[str]) -> Hashed:
        raw = [x.encode("utf-8", "surrogatepass") for x in lines]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))
        return cls(words.codes(np.arange(len(lines))), words.counts)

    def sub(self, line: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.starts[line] + start
        return (self.prefix[at + size] - self.prefix[at]) * self.inverse[at]

    def one(self, line: int, start: int, size: int) -> int:
        at = int(self.starts[line]) + start
        return (int(self.prefix[at + size]) - int(self.prefix[at])) * int(self.inverse[at]) & (1 << 64) - 1


class Relation:
    """Which lines are linked, and in which units each line is signed."""

    def __init__(self, distance: int = DISTANCE, min_chars: int = MIN_CHARS, wordy: int = WORDY, bands: Bands = BANDS) -> None:
        if not 1 <= distance <= 4 or any(not 1 <= t <= 4 for _, t in bands) or list(bands) != sorted(bands) or bands and bands[0][0] != wordy:
            raise ValueError("thresholds are 1 to 4, bands ascend from wordy on")
        self.distance, self.wordy, self.min_chars = distance, wordy, max(min_chars, distance + 1)
        self.bands: tuple[Bands, Bands] = (((self.min_chars, distance),), bands)

    def signed(self, line: str, words: list[str]) -> tuple[bool, bool]:
        """By code points, by words.  Edits of code points change the number of words by one each at most."""
        by_char, by_word = self.units(np.array([len(words)]))
        return len(line) >= self.min_chars and bool(by_char[0]), bool(by_word[0])

    def units(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """signed() for numbers of words, of lines that are long enough by code points."""
        return (words > 0) & (words < self.wordy + self.distance if self.bands[1] else True), (words >= self.wordy) & bool(self.bands[1])

    def linked(self, a: str, b: str) -> bool:
        return self.near(a, a.split(), b, b.split())

    def near(self, a: str, x: list[str], b: str, y: list[str]) -> bool:
        """linked() of lines whose words are known."""
        if self.bands[1]:
            shorter = min(len(x), len(y))
            if shorter >= self.wordy:
                return within(x, y, max(t for least, t in self.bands[1] if shorter >= least))
        return min(len(a), len(b)) >= self.min_chars and within(a, b, self.distance)


def cut(length: np.ndarray | int, parts: int, i: int) -> tuple:
    """(start, size) of the i-th of even segments, the longer ones last."""
    base, extra = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - extra)), base + (i >= parts - extra)


#: What entries() yields: lines, keys, starts and sizes of segments, their number, target lengths, threshold, role (0: index and probe, 1: probe).
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, int, int]


def entries(h: Hashed, unit: int, bands: Bands) -> Iterator[Entries]:
    """Every index and probe entry of sequences, in groups."""
    every = np.arange(len(h.sizes))
    leasts = np.array([least for least, _ in bands])
    for delta in range(max(t for _, t in bands) + 1):
        band = np.searchsorted(leasts, h.sizes - delta, "right") - 1
        for b, (_, t) in enumerate(bands):
            lines = every[band == b]
            if delta > t or not len(lines):
                continue
            length = h.sizes[lines] - delta
            for i in range(t + 1):
                start, size = cut(length, t + 1, i)
                salt = length.astype(np.uint64) * _K3 + _U(i + 1 + 16 * unit)
                for shift in range(-i, i + 1):
                    if abs(shift - delta) > t - i:
                        continue
                    at = start + shift
                    ok = (at >= 0) & (at + size <= h.sizes[lines])
                    role = int(delta != 0 or shift != 0)
                    key = _mix(h.sub(lines[ok], at[ok], size[ok]) ^ salt[ok])
                    yield lines[ok], (key & ~_U(7)) | _U(2 * (t - 1) + role), at[ok], size[ok], i, length[ok], t, role


def _pack(key: np.ndarray, more: list[np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
    """(bucket, payload): keys, then the other columns (ids, sketches, ...) of each bucket, one after another.

    buckets are the routing keys, of which every shuffle partition gets equally many.
    """
    bucket = ((key >> _U(20)) % _U(len(buckets))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in (key, *more)], bucket[order]
    names, firsts = np.unique(bucket, return_index=True)
    cuts = [*firsts.tolist(), len(key)]
    payload = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets[names], pa.int64()), pa.array(payload, pa.binary())], names=["bucket", "payload"])


def _line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def _bytes_and_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, and where their lines that are not empty start and end in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.sort(np.concatenate((bounds[:-1], breaks + 1))), np.sort(np.concatenate((breaks, bounds[1:])))
    return raw, starts[starts < ends], ends[starts < ends]


def signed_lines(docs: DataFrame, buckets: np.ndarray, relation: Relation) -> DataFrame:
    """Packed index and probe entries of the distinct lines of each task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        groups: list = []
        n = 0

        def sign(unit: int, h: Hashed, ids: np.ndarray) -> None:
            nonlocal n
            for line, key, *_ in entries(h, unit, relation.bands[unit]):
                groups.append((key, ids[line], h.sketch[line]))
                n += len(line)

        def sign_lines(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
            words = Words(raw, starts, ends)
            units = relation.units(words.counts)
            view, ids, new = memoryview(raw), np.zeros(len(starts), dtype=np.uint64), []
            short: list[tuple[int, str]] = []
            for k in np.flatnonzero(units[0] | units[1]).tolist():
                line = view[starts[k] : ends[k]]
                known = xxhash.xxh64_intdigest(line, 42)
                if known not in seen:
                    seen.add(known)
                    ids[k] = known
                    new.append(k)
                    if units[0][k] and len(text := str(line, "utf-8")) >= relation.min_chars:
                        short.append((k, text))
            if short:
                sign(0, Hashed.of_chars([text for _, text in short]), ids[[k for k, _ in short]])
            wordy = np.array(new, dtype=np.int64)
            wordy = wordy[units[1][wordy]]
            if len(wordy):
                sign(1, Hashed(words.codes(wordy), words.counts[wordy]), ids[wordy])

        def packed() -> pa.RecordBatch:
            nonlocal groups, n
            key, *more = (np.concatenate([g[k] for g in groups]) for k in range(3))
            groups, n = [], 0
            return _pack(key, more, buckets)

        for batch in batches:
            raw, starts, ends = _bytes_and_lines(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(starts // _CHUNK)) + 1).tolist(), len(starts)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    at = starts[i]
                    sign_lines(raw[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
                    if n >= _ENTRIES:
                        yield packed()
        if groups:
            yield packed()
        seen.clear()
        give_back()

    return bare(docs, "text").mapInArrow(run, "bucket long, payload binary")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the 16 counts, modulo 16, of their circular differences: at most twice the edit distance."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(16):
        d = ((a >> _U(4 * k)) - (b >> _U(4 * k))) & _U(15)
        out += np.minimum(d, _U(16) - d).astype(np.int64)
    return out


_FOUND = "kind int, key long, a long, b long, sketch long"


def _close(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches are within what the key's threshold allows."""
    return sketch_distance(a, b) <= 2 * ((key & _U(3)).astype(np.int64) + 1)


def starred(packed: DataFrame) -> DataFrame:
    """(0, key, pivot, member) for index entries that may be linked to their key's pivot, and (1, key, id, role, sketch) for the members of keys that may join more."""

    def run(rows: pa.Table) -> pa.Table:
        key, ids, sketch = np.concatenate([np.frombuffer(p, dtype=np.uint64).reshape(3, -1) for p in rows.column("payload").to_pylist()], axis=1)
        order = np.lexsort((ids.view(np.int64), key))
        key, ids, sketch = key[order], ids[order].view(np.int64), sketch[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        probe, key, ids, sketch = (key[new] & _U(1)).astype(bool), key[new] >> _U(1), ids[new], sketch[new]
        ik, ii, isk = key[~probe], ids[~probe], sketch[~probe]
        low = np.searchsorted(ik, key, "left")  # the pivot: the key's index entry of the smallest id
        has = low < len(ik)
        has[has] = ik[low[has]] == key[has]
        key, ids, sketch, probe, low = key[has], ids[has], sketch[has], probe[has], low[has]
        near = ids != ii[low]
        near[near] = _close(key[near], sketch[near], isk[low[near]])
        pair = near & ~probe
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(key)))
        # Two members join no more than a probe that is near; of three or more some other pair may.
        more = (size > 2) | ((size == 2) & (np.add.reduceat(near & probe, first) > 0)) if len(key) else size > 2
        many = np.repeat(more, size)
        n, m = int(pair.sum()), int(many.sum())
        columns = [
            np.concatenate((np.zeros(n, dtype=np.int32), np.ones(m, dtype=np.int32))), np.concatenate((key[pair], key[many])).astype(np.int64), np.concatenate((ii[low[pair]], ids[many])),
            np.concatenate((ids[pair], probe[many].astype(np.int64))), np.concatenate((sketch[pair], sketch[many])).view(np.int64),
        ]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "a", "b", "sketch"])

    return packed.groupBy("bucket").applyInArrow(run, _FOUND)


_MEMBER_ROW = ("key", "h1", "h2", "role", "sketch", "class", "line")


def crossed(members: DataFrame, texts: DataFrame, relation: Relation, buckets: int) -> DataFrame:
    """(a1, a2, b1, b2): verified links that join the classes of a key's members wherever any links do.

    A task goes through the pairs of an index member with any other one of its keys, in order, and passes over those
    whose classes it has joined already, so it verifies what may join classes and gives one link for each that does.
    """
    rows = members.select("key", "h1", "role", "sketch", "class").distinct().join(texts, "h1").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), *_MEMBER_ROW)

    def run(table: pa.Table) -> pa.Table:
        key, ids, second, role, sketch, group = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in _MEMBER_ROW[:-1])
        order = np.lexsort((ids, key))
        key, ids, second, role, group, sketch = key[order], ids[order], second[order], role[order], group[order], sketch[order].view(np.uint64)
        lines = table.column("line").combine_chunks().take(pa.array(order))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        known: set[tuple[int, int]] = set()
        out: list[tuple[int, int, int, int]] = []
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        members = np.flatnonzero(role == 0)
        at, n = np.repeat(first, size)[members], np.repeat(size, size)[members]
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(n) - n) // _PAIRS)) + 1).tolist(), len(members)]
        for f, t in zip(cuts[:-1], cuts[1:], strict=True):  # all pairs of some index members at once
            i = np.repeat(members[f:t], n[f:t])
            j = np.repeat(at[f:t] - (np.cumsum(n[f:t]) - n[f:t]), n[f:t]) + np.arange(len(i))
            ok = (group[i] != group[j]) & ((role[j] == 1) | (j > i)) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = _close(key[i].view(np.uint64), sketch[i], sketch[j])
            for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                x, y = find(int(group[a])), find(int(group[b]))
                pair = (min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b])))
                if x != y and pair not in known:
                    known.add(pair)
                    if relation.linked(lines[a].as_py(), lines[b].as_py()):
                        up[x] = y
                        ends = [(int(ids[k]), int(second[k])) for k in (a, b)]
                        out.append((*min(ends), *max(ends)))
        return pa.Table.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=["a1", "a2", "b1", "b2"])

    return rows.groupBy("bucket").applyInArrow(run, "a1 long, a2 long, b1 long, b2 long")


#: Members of hot keys: pieces are what is left of the sequence around the shared segments (first element, end, length of the index member's, threshold, edits it must hold, hash).
_PIECE = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("target", pa.int32()), ("limit", pa.int32()), ("must", pa.int32()), ("hash", pa.int64())])
_MEMBER = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("role", pa.int64()), ("unit", pa.int32()), ("sketch", pa.int64()), ("final", pa.bool_()), ("pieces", pa.list_(_PIECE))])
_MEMBERS = "key long, h1 long, role long, unit int, sketch long, final boolean, pieces array<struct<s:int,e:int,target:int,limit:int,must:int,hash:long>>"


def best_piece(pieces: list[dict]) -> int | None:
    """The piece whose segments are longest; None if no piece can be cut into non-empty segments."""
    sizes = [p["target"] // (p["limit"] + 1) for p in pieces]
    most = max(sizes, default=0)
    return sizes.index(most) if most else None


def _around(h: Hashed, line: int, s: int, e: int, target: int, i: int, limit: int, at: int, start: int, size: int) -> list[dict] | None:
    """The pieces left and right of a segment that the index member has at start, this one at at; None if they are too unlike in length."""
    out = []
    for first, end, want, t, must in ((s, at, start, i, i), (at + size, e, target - start - size, limit - i, 0)):
        if abs(end - first - want) > t:
            return None
        if want:
            out.append({"s": first, "e": end, "target": want, "limit": t, "must": must, "hash": h.one(line, first, end - first) - (1 << 63)})
    return out


def _sequences(lines: list[str], unit: int) -> Hashed:
    return Hashed.of_words(lines) if unit else Hashed.of_chars(lines)


def _opened(members: DataFrame, relation: Relation) -> DataFrame:
    """(key, h1, role, line) of hot first keys with the pieces around the segment that the key stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: dict[str, set[int]] = {}
            for key, role, line in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                wanted.setdefault(line, set()).add(2 * (key & (1 << 63) - 1) + role)
            out = []
            for unit in (0, 1):
                lines = [x for x in wanted if relation.signed(x, x.split())[unit]]
                if not lines:
                    continue
                h = _sequences(lines, unit)
                own = np.array([_line_id(x) for x in lines], dtype=np.uint64).view(np.int64)
                any_key = np.array(sorted({k for x in lines for k in wanted[x]}), dtype=np.uint64)
                for line, key, at, size, i, target, t, role in entries(h, unit, relation.bands[unit]):
                    ok = np.isin(key, any_key)
                    for n, k, a, z, length in zip(line[ok].tolist(), key[ok].tolist(), at[ok].tolist(), size[ok].tolist(), target[ok].tolist(), strict=True):
                        if k in wanted[lines[n]] and (pieces := _around(h, n, 0, int(h.sizes[n]), length, i, t, a, int(cut(length, t + 1, i)[0]), z)) is not None:
                            out.append({"key": k >> 1, "h1": int(own[n]), "role": role, "unit": unit, "sketch": int(h.sketch[n : n + 1].view(np.int64)[0]), "final": best_piece(pieces) is None, "pieces": pieces})
            yield pa.RecordBatch.from_pylist(out, _MEMBER)

    return members.mapInArrow(run, _MEMBERS)


def _refined(members: DataFrame) -> DataFrame:
    """Members of hot keys, with their lines, signed once more by the segments of their best piece."""
    names = ("key", "h1", "role", "unit", "sketch", "pieces", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            out: list[dict] = []
            for unit in (0, 1):
                own = [r for r in rows if r[3] == unit]
                if not own:
                    continue
                places: dict[str, int] = {}
                for r in own:
                    places.setdefault(r[6], len(places))
                h = _sequences(list(places), unit)
                for key, h1, role, _, sketch, pieces, line in own:
                    n, best = places[line], best_piece(pieces)
                    p = pieces[best]
                    rest = pieces[:best] + pieces[best + 1 :]
                    delta, t = p["e"] - p["s"] - p["target"], p["limit"]
                    for i in range(t + 1):
                        start, size = (int(x) for x in cut(p["target"], t + 1, i))
                        for shift in range(-i, i + 1):
                            at = p["s"] + start + shift
                            if abs(shift - delta) > t - i or at < p["s"] or at + size > p["e"]:
                                continue
                            around = _around(h, n, p["s"], p["e"], p["target"], i, t, at, start, size)
                            if around is None:
                                continue
                            left = [*rest, *around]
                            fine = xxhash.xxh64_intdigest(struct.pack("<QqHH", h.one(n, at, size), key, best, i)) >> 1 & ~3 | key & 3
                            out.append({"key": fine, "h1": h1, "role": int(role or shift != 0), "unit": unit, "sketch": sketch, "final": best_piece(left) is None, "pieces": left})
                            if len(out) >= 5000:
                                yield pa.RecordBatch.from_pylist(out, _MEMBER)
                                out = []
            yield pa.RecordBatch.from_pylist(out, _MEMBER)

    return members.select(*names).mapInArrow(run, _MEMBERS)


def _placed(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their class, and per key and class the number of members and index members, the smallest of both."""
    reached = components(links.selectExpr("a1 AS a", "b1 AS b")).selectExpr("node AS h1", "component")
    placed = materialize(members.join(reached, "h1", "left").withColumn("class", F.coalesce("component", "h1")).drop("component"), "placed-members")
    per = placed.groupBy("key", "class").agg(F.count("*").alias("n"), F.count_if(F.expr("role = 0")).alias("i"), F.min("h1").alias("m"), F.min(F.expr("CASE WHEN role = 0 THEN h1 END")).alias("p"))
    return placed, materialize(per, "key-classes")


def _class_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): a key's pivot with one member of every other class of the key."""
    _, per = _placed(members, links)
    pivots = per.where("p IS NOT NULL").groupBy("key").agg(F.min(F.struct("p", "class")).alias("x")).select("key", F.col("x.p").alias("a"), F.col("x.class").alias("own"))
    return per.join(pivots, "key").where("class <> own").select("a", F.col("m").alias("b"))


def _open_members(members: DataFrame, links: DataFrame, hot_pairs: int) -> DataFrame:
    """Members of keys that join different classes, with their class; hot where such pairs are very many."""
    placed, per = _placed(members, links)
    keys = per.groupBy("key").agg(F.expr("sum(n) * sum(i) - sum(n * i)").alias("pairs")).where("pairs > 0")
    found = materialize(placed.join(keys.select("key", F.expr(f"pairs >= {hot_pairs}").alias("hot")), "key"), "open-members")
    release(placed, per)
    return found


def _finer(hot: DataFrame, texts: DataFrame, relation: Relation) -> DataFrame:
    """Members of hot keys, signed by the segments of what surrounds those that they share."""
    texts = texts.select("h1", "line")
    members = hot if "pieces" in hot.columns else materialize(_opened(hot.join(texts, "h1").select("key", "h1", "role", "line"), relation), "hot-members")
    pieces = members.where("NOT final").select("key", F.posexplode("pieces").alias("k", "p")).where("p.must > 0")
    alike = pieces.groupBy("key", "k").agg(F.min("p.hash").alias("low"), F.max("p.hash").alias("high")).where("low = high").select("key").distinct()
    going = members.where("NOT final").join(alike, "key", "left_anti")
    finer = _refined(going.join(texts, "h1"))
    ends = members.where("final").select(finer.columns)  # of a first key whose line is its segment
    return materialize(finer.union(ends), "finer-members")


def within(a: str | list[str], b: str | list[str], distance: int) -> bool:
    """Whether two texts, or two lists of words, are within an edit distance, by a bit vector that holds one band of the matrix."""
    if abs(len(a) - len(b)) > distance:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # common suffix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m == 0:
        return n <= distance
    width = 2 * distance + 1
    full, low_bit = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    # Bit k of the band at column j is row j - distance + k; its lowest row is followed down, then to the right.
    up, down, score = full & ~((1 << distance) - 1), 0, min(m, distance)
    for j, c in enumerate(b):
        p = places.get(c, 0)
        match = (p >> (j - distance) if j >= distance else p << (distance - j)) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(zero | up)) & full
        right_down = zero & up
        last = m - 1 - j + distance  # the band's bit that is the last row, while it is inside
        if last >= width:
            score += not zero & low_bit
            if score > 2 * distance + n - m:  # at most distance + n - m steps to the right remain
                return False
        elif last == width - 1:
            score += not zero & low_bit
        else:
            score += bool(right_up >> last & 1) - bool(right_down >> last & 1)
        up, down = (right_down | ~((zero >> 1) | right_up)) & full, (zero >> 1) & right_up
    return score <= distance


#: A character that is no white space, as str.split() has it.
_FULL = r"[^\x20\x09-\x0D\x1c-\x1f\x85\p{Z}]"


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(h1, h2, line) once for every line with one of the ids.

    Most lines have none.  A table of bits, 16 for an id where ``BIT_ROWS`` allows, goes to every task and drops nearly all of these
    where they are read, so their texts are not shuffled; the ids decide on the rest.
    """
    rows = max(1, min(BIT_ROWS, ids.count() // 4))
    word, bit = F.pmod("h1", F.lit(rows)).alias("word"), "cast(shiftrightunsigned(h1, 58) AS int)"
    bits = ids.select(word, F.expr(f"shiftleft(1L, {bit})").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    lines = bare(docs, "text").select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("h1"), "line")
    some = lines.select("*", word).join(F.broadcast(bits), "word").where(f"shiftrightunsigned(bits, {bit}) & 1 = 1").select("h1", "line").distinct()
    return some.join(ids, "h1", "left_semi").select("h1", F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def verified(pairs: DataFrame, texts: DataFrame, relation: Relation) -> DataFrame:
    """(a1, a2, b1, b2): the pairs (a, b) of line ids that are linked, as hashes of their texts."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [relation.linked(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in range(4)], names=["a1", "a2", "b1", "b2"])

    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("a_line"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("b_line"))
    both = pairs.join(left, "a").join(right, "b").select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", "a_line", "b_line")
    return materialize(both.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long"), "line-links")


def linked_lines(docs: DataFrame, relation: Relation, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(a1, a2, b1, b2): hashes of distinct line texts that are linked; these links join whatever any links join."""
    return _links_and_texts(docs, relation, hot_pairs)[0]


def _links_and_texts(docs: DataFrame, relation: Relation, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """linked_lines(), and (h1, h2, line) of every line that a candidate names; documents are read for them once."""
    buckets = np.array(routing_keys(docs.sparkSession, 4), dtype=np.int64)
    found = materialize(starred(signed_lines(docs, buckets, relation)), "line-candidates")
    ids = materialize(found.select(F.explode(F.expr("CASE WHEN kind = 0 THEN array(a, b) ELSE array(a) END")).alias("h1")).distinct(), "candidate-ids")
    texts = materialize(_texts(docs, ids), "candidate-lines")
    release(ids)
    links = verified(found.where("kind = 0").select("a", "b"), texts, relation)
    members = found.where("kind = 1").selectExpr("key", "a AS h1", "b AS role", "sketch")
    while not members.isEmpty():
        links = materialize(links.union(verified(_class_pairs(members, links), texts, relation)).distinct(), "line-links")
        rest = _open_members(members, links, hot_pairs)
        cold = rest.where("NOT hot OR final") if "final" in rest.columns else rest.where("NOT hot")
        links = materialize(links.union(crossed(cold, texts, relation, len(buckets))).distinct(), "line-links")
        hot = rest.where("hot AND NOT final") if "final" in rest.columns else rest.where("hot")
        if hot.isEmpty():
            break
        members = _finer(hot, texts, relation)
    release(found)
    return links, texts


#: A class is dealt in blocks of about so many lines, of which every two meet in one task.
BLOCK = 256


def link_counts(reached: DataFrame, texts: DataFrame, relation: Relation, block: int) -> DataFrame:
    """(h1, h2, component, n_links) of (h1, component): with how many other texts each line is linked.

    Linked lines are in one class, so all pairs of a class are held against each other: their sizes and sketches
    together in numpy, what passes on the texts.  A task counts the links of two blocks, and no row is made for a
    link; the two lines of a class of two are linked already.
    """
    partitions = int(reached.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = reached.groupBy("component").agg(F.count("*").alias("n"))
    known = reached.join(sizes, "component").join(texts, "h1")
    dealt = known.where("n > 2").withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}")).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "h1"), "blocks"))
    pairs = dealt.select("component", "h1", "h2", "line", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")).select(F.col("component").alias("class"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "h1", "h2", "line")
    rows = pairs.select(F.pmod(F.xxhash64("class", "x", "y"), F.lit(4 * partitions)).alias("bucket"), "class", "x", "y", "own", "h1", "h2", "line")

    def run(table: pa.Table) -> pa.Table:
        group, x, y, own = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("class", "x", "y", "own"))
        order = np.lexsort((own, y, x, group))
        group, x, y, own = group[order], x[order], y[order], own[order]
        lines = table.column("line").combine_chunks().take(pa.array(order)).to_pylist()
        words = [line.split() for line in lines]
        counts = np.zeros(len(lines), dtype=np.int64)
        first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        for at, to in zip(first.tolist(), [*first[1:].tolist(), len(lines)], strict=True):
            middle = at + int((own[at:to] == x[at]).sum())
            whole = x[at] == y[at]  # one block with itself
            if not whole and middle in (at, to):
                continue
            near = _near(lines[at:to], relation) if to - at > 8 else None
            for i in range(at, to if whole else middle):
                others = range(max(i + 1, at if whole else middle), to)
                for j in others if near is None else (np.flatnonzero(near(i - at, others.start - at)) + others.start).tolist():
                    if relation.near(lines[i], words[i], lines[j], words[j]):
                        counts[i] += 1
                        counts[j] += 1
        return pa.Table.from_arrays([*(table.column(c).combine_chunks().take(pa.array(order)) for c in ("h1", "h2", "class")), pa.array(counts)], names=["h1", "h2", "component", "n"])

    counted = rows.groupBy("bucket").applyInArrow(run, "h1 long, h2 long, component long, n long").groupBy("h1", "h2", "component").agg(F.sum("n").alias("n_links"))
    return counted.union(known.where("n = 2").select("h1", "h2", "component", F.lit(1).cast("long").alias("n_links")))


def _near(lines: list[str], relation: Relation) -> Callable[[int, int], np.ndarray]:
    """A function of (i, start): which lines from start on may be linked to line i by their sizes and sketches."""
    by_char, by_word = Hashed.of_chars(lines), Hashed.of_words(lines)
    leasts, most = np.array([least for least, _ in relation.bands[1]], dtype=np.int64), np.maximum.accumulate([0, *(t for _, t in relation.bands[1])])

    def near(i: int, start: int) -> np.ndarray:
        chars, count = by_char.sizes[start:], by_word.sizes[start:]
        limit = most[np.searchsorted(leasts, np.minimum(count, count.dtype.type(by_word.sizes[i])), "right")]
        wordy = limit > 0
        ok = np.where(wordy, np.abs(count - by_word.sizes[i]) <= limit, np.abs(chars - by_char.sizes[i]) <= relation.distance)
        for h, of, t in ((by_word, ok & wordy, limit), (by_char, ok & ~wordy, np.full(len(ok), relation.distance))):
            if of.any():
                at = np.flatnonzero(of)
                ok[at] = sketch_distance(h.sketch[start:][at], np.full(len(at), h.sketch[i])) <= 2 * t[at]
        return ok

    return near


def numbered_lines(rows: DataFrame) -> DataFrame:
    """(row_no, doc_id, line_no, h1, h2) of (row_no, doc_id, text): the lines that are not blank, and one without hashes for each row."""
    lines = rows.select("row_no", "doc_id", F.posexplode(F.expr("concat(split(coalesce(text, ''), '\\n'), array(cast(null AS string)))")).alias("line_no", "line"))
    return lines.where(F.col("line").isNull() | F.col("line").rlike(_FULL)).select("row_no", "doc_id", "line_no", F.expr("CASE WHEN line IS NOT NULL THEN xxhash64(line) END").alias("h1"), F.expr("CASE WHEN line IS NOT NULL THEN xxhash64(1, line) END").alias("h2"))


def judged_lines(docs: DataFrame, lines: DataFrame, relation: Relation | None = None, hot_pairs: int = HOT_PAIRS, counted: bool = True) -> DataFrame:
    """(row_no, line_no, class_id, class_line, n_links, kept) of every line of docs that is not blank.

    lines are those of numbered_lines, stored.  The class is where the line's text, or one that links reach, first
    occurs: that row's doc_id, and the line's number there; n_links counts all lines of other texts that are linked to
    this one, or, if they need not be counted, the links that join its class.
    """
    lines = lines.where("h1 IS NOT NULL").select(F.expr("coalesce(doc_id, -9223372036854775808L)").alias("id"), "row_no", "line_no", "h1", "h2")
    links, texts = _links_and_texts(docs, relation or Relation(), hot_pairs)
    reached = components(links.selectExpr("a1 AS a", "b1 AS b")).selectExpr("node AS h1", "component")
    if counted:
        ends = link_counts(reached, texts, relation or Relation(), BLOCK)
    else:
        ends = links.select(F.explode(F.expr("array(struct(a1 AS h1, a2 AS h2), struct(b1 AS h1, b2 AS h2))")).alias("x")).groupBy("x.h1", "x.h2").agg(F.count("*").alias("n_links")).join(reached, "h1").select("h1", "h2", "component", "n_links")
    # A text that occurs once and has no link is its own class; only the others are written and joined.
    first, none = F.struct("id", "row_no", "line_no"), F.lit(None).cast("long")
    both = lines.select("h1", "h2", first.alias("first"), none.alias("component"), none.alias("n_links")).union(ends.select("h1", "h2", F.lit(None).cast("struct<id:long,row_no:long,line_no:int>"), "component", "n_links"))
    firsts = both.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("first").alias("n"), F.max("component").alias("component"), F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))
    rooted = materialize(firsts.where("n > 1 OR n > 0 AND component IS NOT NULL"), "rooted-lines")
    linked = rooted.where("component IS NOT NULL")
    by_class = linked.join(linked.groupBy("component").agg(F.min("first").alias("class")), "component").select("h1", "h2", "n_links", "class")
    classes = materialize(by_class.union(rooted.where("component IS NULL").selectExpr("h1", "h2", "n_links", "first AS class")), "line-classes")
    release(links, texts, rooted)
    placed = lines.join(classes, ["h1", "h2"], "left").withColumn("class", F.coalesce("class", first)).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return placed.select("row_no", "line_no", F.expr("nullif(class.id, -9223372036854775808L)").alias("class_id"), F.col("class.line_no").alias("class_line"), "n_links", F.expr("class.row_no = row_no AND class.line_no = line_no").alias("kept"))


def dedup_lines(docs: DataFrame, relation: Relation | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, lines): every row with its judged lines in their order."""
    known = materialize(numbered_lines(bare(docs, "doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())), "lines")
    judged = judged_lines(docs, known, relation, hot_pairs)
    by_row = judged.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "class_line", "n_links", "kept"))).alias("lines"))
    none = F.expr("cast(array() AS array<struct<line_no:int,class_id:bigint,class_line:int,n_links:bigint,kept:boolean>>)")
    return known.where("h1 IS NULL").select("row_no", "doc_id").join(by_row, "row_no", "left").select("doc_id", F.coalesce("lines", none).alias("lines"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with its lines' classes, links and fates, and the counts of them."""
    count = lambda where: F.expr(f"cast(size(filter(lines, l -> {where})) AS bigint)")
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), count("NOT l.kept").alias("n_removed"), F.expr("aggregate(lines, 0L, (s, l) -> s + l.n_links)").alias("n_links"), "lines")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that go; n_chars, where it is a column, follows the text.

    No document is dropped: one whose lines all go has an empty text.
    """
    keyed = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("row_no")), "numbered-rows")
    rows = keyed.select("_row.doc_id", "_row.text", "row_no")
    lines = materialize(numbered_lines(rows), "lines")
    gone = judged_lines(rows, lines, counted=False).where("NOT kept").groupBy("row_no").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    keyed = keyed.join(gone, "row_no", "left")
    kept = keyed.withColumn("_lines", F.split("_row.text", "\n")).withColumn("_text", F.expr("CASE WHEN gone IS NULL THEN _row.text ELSE array_join(transform(array_except(sequence(0, size(_lines) - 1), gone), k -> _lines[k]), '\n') END"))
    columns = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return kept.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
