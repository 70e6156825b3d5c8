"""SimHash and line dedup against plain versions, hot keys included."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from provquill import llm
from provquill.llm import line_dedup, simhash
from provquill.llm.common import table
from provquill.llm.graph import components


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[max(self.find(a), self.find(b))] = min(self.find(a), self.find(b))


def test_fingerprints(spark, awkward, sf_dir):
    rows = awkward.collect() + table(spark, sf_dir, "documents").limit(60).collect()
    got = simhash.fingerprint_of([r.text for r in rows])
    assert got.tolist() == [plain_fingerprint(r.text) for r in rows]


@pytest.mark.parametrize("hot_key", [3, 512])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_reach_what_all_pairs_reach(spark, hot_key, distance):
    r = random.Random(hot_key)
    centers = [r.getrandbits(64) for _ in range(6)] + [0]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centers for _ in range(40)} | {r.getrandbits(64) for _ in range(50)})
    want = Sets()
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    for i, a in enumerate(fps):
        want.find(signed[i])
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                want.join(signed[i], signed[j])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = simhash.links(df, distance, hot_key)
    got = {x.node: x.component for x in components(pairs).collect()}
    assert {x: got.get(x, x) for x in signed} == {x: want.find(x) for x in signed}
    for x in pairs.collect():
        assert ((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= distance


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(1000, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in range(1000, 1100)) and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_table_of_all_fingerprints_is_broadcast(spark, sf_dir, monkeypatch):
    """A broadcast passes through the driver; of the joins only those with hot keys may be planned as one."""
    from provquill.llm import graph

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], graph.write_shared
    monkeypatch.setattr(graph, "write_shared", lambda df, *rest: plans.append(plan(df)) or write(df, *rest))
    plans.append(plan(simhash.near_duplicates(table(spark, sf_dir, "documents"))))
    assert len(plans) > 2 and not any("BroadcastHashJoin" in x for x in plans)


def test_near_duplicate_rows(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == awkward.count() and got[2] == got[1] == 1 and got[3] == got[4] == got[5] == 3 and got[None] is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.simhash_stage(spark, awkward, "")
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c} and kept.count() == len({i for i, c in got.items() if i == c})
    twice = awkward.union(awkward.selectExpr("cast(null AS long) AS doc_id", *[f"`{c}`" for c in awkward.columns[1:]]))
    assert simhash.simhash_stage(spark, twice, "").collect() == kept.collect() or {tuple(r) for r in simhash.simhash_stage(spark, twice, "").collect()} == {tuple(r) for r in kept.collect()}


def test_simhash_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = {r.doc_id: r for r in llm.queries()["op3_simhash"](spark, sf_dir).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = Sets()
    for a in sorted(fps):
        for b in sorted(fps):
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 2:
                want.join(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{fps[i]:016x}", want.find(i)) for i in fps}


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(r, a, k, alphabet="abcd"):
    a = list(a)
    for _ in range(k):
        at = r.randint(0, len(a))
        way = r.randint(0, 2)
        if way == 0:
            a.insert(at, r.choice(alphabet))
        elif a:
            a[min(at, len(a) - 1) : min(at, len(a) - 1) + 1] = [] if way == 1 else [r.choice(alphabet)]
    return "".join(a)


def test_banded_distance():
    r = random.Random(5)
    for _ in range(15_000):
        a = "".join(r.choices("abc", k=r.randint(0, 12)))
        b = edited(r, a, r.randint(0, 5), "abc") if r.random() < 0.8 else "".join(r.choices("abc", k=r.randint(0, 12)))
        for d in (1, 2, 3):
            assert line_dedup.within(a, b, d) == (edits(a, b) <= d)


def plain_lines(rows, relation):
    """By place in rows: [(line_no, class_id, class_line, n_links, kept)]; ids are ascending, or the rows in the order of their numbers."""
    first, seen = {}, []
    for place, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if line.split():
                first[line] = min(first.get(line, (place, k, i)), (place, k, i))
                seen.append((place, k, line))
    near = collections.defaultdict(list)
    lines = sorted(first)
    words = {x: len(x.split()) for x in lines}
    most = max([relation.distance, *(t for _, t in relation.bands[1])])
    for x, a in enumerate(lines):
        for b in lines[:x]:
            if (abs(words[a] - words[b]) <= most or abs(len(a) - len(b)) <= most) and relation.linked(a, b):
                near[a].append(b)
                near[b].append(a)
    sets = Sets()
    for a in lines:
        for b in near[a]:
            sets.join(a, b)
    least = {}
    for a in lines:
        least[sets.find(a)] = min(least.get(sets.find(a), first[a]), first[a])
    out = {k: [] for k in range(len(rows))}
    for place, k, line in seen:
        c = least[sets.find(line)]
        out[place].append((k, c[2], c[1], len(near[line]), c[:2] == (place, k)))
    return out


def agree(got, want):
    """Classes and fates are equal; a line has a verified link if it has any, and no more than it has."""
    strip = lambda x: {i: [v[:3] + v[4:] for v in lines] for i, lines in x.items()}
    assert strip(got) == strip(want)
    for i, lines in want.items():
        assert all(0 < g[3] <= w[3] or g[3] == w[3] == 0 for g, w in zip(got[i], lines, strict=True))


def judged(df, relation, hot_pairs=line_dedup.HOT_PAIRS):
    return {r.doc_id: [tuple(v) for v in r.lines] for r in line_dedup.dedup_lines(df, relation, hot_pairs).collect()}


@pytest.mark.parametrize("hot_pairs, distance", [(20, 3), (2_000_000, 1), (2_000_000, 2)])
def test_line_dedup_finds_all_near_lines(spark, hot_pairs, distance):
    """Edits of code points: stems with many near copies, lines that share a beginning, an end, or both."""
    r = random.Random(11)
    stems = ["".join(r.choices("abcdefgh é中", k=r.randint(16, 60))).strip() + "xxxxxxxxxxxxxxxx" for _ in range(12)]
    shared = "a boilerplate beginning that very many lines share, number "
    rows = [(d, "\n".join([edited(r, r.choice(stems), r.randint(0, 2)) for _ in range(4)] + [shared + str(r.randint(0, 400)), f"{r.randint(0, 90)} <- {shared}", "short", "   ", shared[:20] + str(r.randint(0, 90)) + shared[20:]])) for d in range(40)]
    relation = line_dedup.Relation(distance, 16, 99, ())
    agree(judged(spark.createDataFrame(rows, "doc_id long, text string"), relation, hot_pairs), plain_lines(rows, relation))


@pytest.mark.parametrize("hot_pairs", [20, 2_000_000])
def test_line_dedup_compares_long_lines_by_words(spark, hot_pairs):
    """Edits of words, more of them in longer lines, lines about the bounds of the bands, and short ones beside them."""
    r = random.Random(12)
    stems = [[r.choice(["lo", "rem", "ipsum", "dolor", "sit"]) + str(r.randint(0, 30)) for _ in range(r.choice([7, 9, 10, 11, 19, 20, 21, 39, 40, 41, 70]))] for _ in range(14)]

    def changed(stem):
        words = list(stem)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], [words[at], "new"], [str(r.randint(0, 3))], [words[at] + "s"]])
        return r.choice([" ", " ", "  "]).join(words)

    rows = [(d, "\n".join(changed(r.choice(stems)) for _ in range(6))) for d in range(40)]
    relation = line_dedup.Relation(2, 16, 10, ((10, 1), (20, 2), (40, 4)))
    want = plain_lines(rows, relation)
    agree(judged(spark.createDataFrame(rows, "doc_id long, text string"), relation, hot_pairs), want)
    assert sum(v[3] for x in want.values() for v in x) > 150


def test_lines_that_share_a_beginning_or_an_end(spark, monkeypatch):
    """No pair of them is enumerated but those that the rest of the lines joins."""
    r = random.Random(13)
    tail = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=40))
    begin = "https://example.org/a/shared/path/of/40?"
    lines = [begin + tail() for _ in range(4000)] + [tail() + begin[::-1] for _ in range(4000)]
    lines += [lines[5][:-1] + "#", lines[5000][:3] + lines[5000][4:]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").repartition(4)
    relation = line_dedup.Relation()
    asked = []
    plain = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: asked.append(pairs.distinct().count()) or plain(pairs, *rest))
    assert line_dedup.linked_lines(df, relation, 100_000).count() == 2
    assert len(asked) > 2 and sum(asked) < 2 * len(lines)


def test_a_crowd_of_near_lines_makes_few_links(spark):
    """A thousand lines that are all linked: about as many links as lines, not their square."""
    words = [f"w{k}" for k in range(50)]
    lines = [" ".join([*words[:10], f"x{n}", *words[11:]]) for n in range(1000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    assert 999 <= line_dedup.linked_lines(df, line_dedup.Relation()).count() <= 4000


@pytest.mark.parametrize("block", [7, 256])
def test_every_link_of_a_line_is_counted(spark, monkeypatch, block):
    """Crowds of near lines by words and by code points, whose members share several keys, and chains beside them."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(14)
    words = [f"w{k}" for k in range(24)]
    lines = [" ".join([*words[:k], f"x{r.randint(0, 9)}", *words[k + 1 :]]) for k in (3, 11, 20) for _ in range(25)]
    lines += [f"a line of code points, number {k}" for k in range(90, 130)] + ["b" * k + "a chain of short ones" for k in range(20)] + ["only a pair of lines 1", "only a pair of lines 2", "and one that is alone here"]
    rows = [(d, "\n".join(r.sample(lines, 6))) for d in range(60)]
    want = plain_lines(rows, line_dedup.Relation())
    assert max(v[3] for x in want.values() for v in x) > 20
    assert judged(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.Relation()) == want


def test_words_of_bytes_are_those_of_str_split():
    """Words, their numbers and one hash for each, over white space of all kinds and long words; documents lie end to end."""
    r = random.Random(15)
    parts = ["a", "bc", "é", "中", "🙂", " ", " ", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\n", "â", "ã", "\u200b", "x" * 300, "y" * 9]
    codes = {}
    for _ in range(200):
        texts = [None if r.random() < 0.1 else "".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(12)]
        raw, starts, ends = line_dedup._bytes_and_lines(pa.array(texts, pa.string())[3:])
        lines = [x for t in texts[3:] for x in (t or "").split("\n") if x]
        assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == lines
        words = line_dedup.Words(raw, starts, ends)
        assert words.counts.tolist() == [len(x.split()) for x in lines]
        for code, word in zip(words.codes(np.arange(len(lines))).tolist(), [w for x in lines for w in x.split()], strict=True):
            assert codes.setdefault(word, code) == code
        assert line_dedup.Hashed.of_words(lines).sizes.tolist() == words.counts.tolist()
    assert len(set(codes.values())) == len(codes) > 500


def test_texts_that_no_candidate_names_are_not_shuffled(spark):
    """However many ids there are: what is shuffled follows the lines that have one, not all lines."""
    docs = spark.range(200, numPartitions=4).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 500), k -> concat('line ', k, ' of ', id)), '\n') AS text")
    named = spark.range(200).selectExpr("xxhash64(concat('line 7 of ', id)) AS h1")
    ids = named.union(spark.range(110_000).selectExpr("xxhash64(id, id) AS h1"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    before, limit = stages().size(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = line_dedup._texts(docs, ids).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(x.line for x in got) == sorted(f"line 7 of {k}" for k in range(200))
    found = stages()
    written = [found.apply(k).shuffleWriteRecords() for k in range(found.size() - before) if found.apply(k).inputRecords() == 200]  # the latest come first
    assert len(written) == 1 and 200 <= written[0] < 20_000


def test_line_dedup_query_and_stage(spark, awkward, nothing):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[k][0]: v for k, v in plain_lines(rows, line_dedup.Relation()).items()}
    got = {r.doc_id: r for r in llm.queries()["op1_line_dedup"](spark, sf).collect()}
    agree({i: [tuple(v) for v in r.lines] for i, r in got.items()}, want)
    assert all(r.n_removed == sum(not v.kept for v in r.lines) and r.n_links == sum(v.n_links for v in r.lines) for r in got.values())
    gone = {i: {v[0] for v in x if not v[4]} for i, x in want.items()}
    stage = line_dedup.line_dedup_stage(spark, docs, sf)
    assert stage.columns == docs.columns
    assert {r.doc_id: r.text for r in stage.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
    out = line_dedup.line_dedup_stage(spark, awkward, sf)
    assert out.columns == awkward.columns and out.count() == awkward.count() and line_dedup.line_dedup_stage(spark, nothing, sf).count() == 0
    assert out.where("doc_id = 10").first().text == ""  # one edit from the first line of document 1
    assert out.where(F.col("doc_id") == 3).first().text is None
    every = line_dedup.dedup_lines(awkward).collect()
    assert len(every) == awkward.count() and line_dedup.dedup_lines(nothing).count() == 0
    assert sorted([v.kept for v in r.lines] for r in every if r.doc_id == 2) == [[False, False], [False, False]]
    assert [[v.kept for v in r.lines] for r in every if r.doc_id is None] == [[True]]


def test_line_dedup_stage_judges_each_row_by_itself(spark):
    """Rows without an id, and rows that share one, lose their own repeated lines and no others."""
    x, u, v, w = (f"line {c * 20} of the test" for c in "xuvw")
    fill = [f"{k}: {c * 30}" for k, c in enumerate("abcdefghijklmnop")]
    rows = [
        (None, "\n".join([x, *fill[:4], u])), (None, "\n".join([*fill[4:9], x])), (None, "\n".join([*fill[9:13], v, x])),
        (7, "\n".join([x, w])), (7, "\n".join([fill[13], x])), (8, "\n".join([fill[14], w])), (9, fill[15]), (9, fill[15]),
    ]
    out = line_dedup.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    got = collections.Counter(line for r in out for line in r.text.split("\n") if line)
    assert len(out) == len(rows) and got == collections.Counter({line: 1 for line in [x, u, v, w, *fill]})


def test_stage_links_what_all_pairs_of_five_word_sets_link(spark):
    """Near copies at 0.8 or more go, those below stay; a crowd of copies, chains and short texts among them."""
    r = random.Random(5)
    prose = lambda n: [f"w{r.randint(0, 9999)}" for _ in range(n)]
    texts = ["", "One two", "one TWO", "one two three four five", "one two three four six"]
    for base in (prose(60), prose(150), prose(400)):
        for edits_made in (0, 1, 2, 4, 6, 9, 12, 20):
            words = list(base)
            for k in r.sample(range(len(words)), edits_made):
                words[k] = "changed"
            texts.append(" ".join(words))
    crowd = prose(200)
    texts += [" ".join(crowd[:k] + ["x" + str(k)] + crowd[k:]) for k in range(0, 200, 3)] + [" ".join(prose(80)) for _ in range(20)]
    small = prose(40)
    texts += [" ".join(small[a:b]) for a in range(0, 24, 3) for b in range(a + 5, a + 16)]  # 1 to 11 shingles
    r.shuffle(texts)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    want = Sets()
    linked = 0
    for i, a in enumerate(sets):
        want.find(i)
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                want.join(i, j)
                linked += a != sets[j]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.simhash_stage(spark, docs, "").collect()}
    assert linked > 1000 and kept == {i for i in range(len(texts)) if want.find(i) == i}


def test_stage_links_what_fingerprints_link(spark):
    """Texts at two differing bits or fewer are linked as op3 links them, also below the similarity of the sets."""
    r = random.Random(6)
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    while True:
        base = [f"w{r.randint(0, 9999)}" for _ in range(300)]
        texts = [" ".join(base)] + [" ".join("changed" if k in at else w for k, w in enumerate(base)) for at in (set(range(n, 300, 38)) for n in range(38))]
        fps = [plain_fingerprint(t) for t in texts]
        near = [t for t, f in zip(texts[1:], fps[1:], strict=True) if (f ^ fps[0]).bit_count() <= 2]
        if near:
            break
    a, b = sets(texts[0]), sets(near[0])
    assert 5 * len(a & b) < 4 * len(a | b)
    docs = spark.createDataFrame([(1, texts[0]), (2, near[0]), (3, " ".join(f"v{k}" for k in range(50)))], "doc_id long, text string")
    assert {x.doc_id for x in simhash.simhash_stage(spark, docs, "").collect()} == {1, 3}
