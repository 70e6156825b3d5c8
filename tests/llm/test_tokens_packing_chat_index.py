"""Token operators, chat examples, the positional index, the pipeline: exact round trips and plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from provquill import llm
from provquill.llm import chat, huffman, packing, positional_index
from provquill.llm.common import shared_dir, table
from provquill.llm.tokens import Encoder
from tests.oracle import connect, same

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cut_texts_encode_like_whole_ones(path):
    r, e = random.Random(1), Encoder(path, 50)
    bits = ["a", " ", "\n", "  ", "B'", "s", "'s", "1", "é", "\t", "\r", "​", "é", "Σ", "ΑΣ", "中", "?", "!", ".", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", " ", "x", "́", "\0", "🙂", "don't "]
    texts = ["".join(r.choices(bits, k=r.randint(0, 9))) for _ in range(8000)]
    for k in range(0, len(texts), 100):
        assert e.encode(texts[k : k + 100]) == e.whole(texts[k : k + 100])
    assert e.encode([None, ""]) == [b"", b""] and e.encode([]) == []


def ids_of(path, texts, end):
    from tokenizers import Tokenizer

    return [x.ids + [end] for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_code_lengths():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        counts = r.integers(1, 10, n) ** 8
        bits = huffman.code_lengths(counts, 12 if n <= 4096 else 16)
        assert bits.max() <= 12 and (2.0**-bits).sum() <= 1
        if n > 1:
            assert (2.0**-bits).sum() == 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert huffman.code_lengths(fib, 16).max() == 9 and huffman.code_lengths(fib, 5).max() == 5
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, dtype=int), 3)


def check_huffman(rows, texts_in_order):
    start = 0
    want = []
    for i, ids in texts_in_order:
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda x: (x[1],)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=key) == want


def test_huffman_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    check_huffman(llm.queries()["op5_huffman"](spark, sf_dir).collect(), zip([d.doc_id for d in docs], ids_of(BYTE, [d.text for d in docs], 2), strict=True))


def test_huffman_of_unordered_rows_and_ids_back(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 1000)
    docs = table(spark, sf_dir, "documents").repartition(5, "lang")
    path = f"{shared_dir(spark)}/unordered"
    huffman.write_ids(docs, path, BYTE, 2)
    rows = huffman.read_ids(spark, path, keep_ids=True).collect()
    plain = docs.orderBy("doc_id").collect()
    all_ids = ids_of(BYTE, [d.text for d in plain], 2)
    check_huffman(rows, zip([d.doc_id for d in plain], all_ids, strict=True))
    back = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in rows}
    assert [back[d.doc_id] for d in plain] == all_ids


def test_huffman_of_awkward_rows(spark, awkward, nothing):
    for k, docs in enumerate((awkward, nothing)):
        path = f"{shared_dir(spark)}/awkward{k}"
        huffman.write_ids(docs, path, BYTE, 2)
        rows = huffman.read_ids(spark, path).collect()
        assert len(rows) == docs.count() and sum(r.n_tokens for r in rows) == max([r.start + r.n_tokens for r in rows], default=0)
        ids = {d.doc_id: x for d, x in zip(docs.collect(), ids_of(BYTE, [d.text for d in docs.collect()], 2), strict=True)} if k == 0 else {}
        assert all(r.ids_crc32 == crc(ids[r.doc_id]) for r in rows)
        starts = [(r.doc_id is not None, r.doc_id or 0, r.start) for r in rows]
        assert [s[2] for s in sorted(starts)] == sorted(s[2] for s in starts)


def check_packing(rows, ids, most_padding):
    at, cover = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == crc(piece) and r.doc_tokens == len(ids[r.doc_id]) and r.length == len(piece) > 0
        at[r.sequence_id].append((r.offset, r.length))
        cover[r.doc_id].append((r.start, r.length))
    for spans in (*at.values(), *cover.values()):
        end = 0
        for s, n in sorted(spans):
            assert s == end
            end += n
    assert all(sum(n for _, n in v) <= 4096 for v in at.values())
    assert {i: sum(n for _, n in v) for i, v in cover.items()} == {i: len(x) for i, x in ids.items()}
    total = sum(map(len, ids.values()))
    assert len(at) * 4096 - total <= most_padding * total + 4096


def test_cut_and_layout():
    for n in range(0, 20_000, 37):
        lengths = packing.cut(n)
        assert sum(lengths) == n and all(x < packing.TAIL or x in {4096 // j for j in range(1, 17)} for x in lengths)
    assert packing.layout({}) == []


def test_packing_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    check_packing(llm.queries()["op2_packing"](spark, sf).collect(), dict(zip([d.doc_id for d in docs], ids_of(WORD, [d.text for d in docs], 2), strict=True)), 0.01)


def test_packing_awkward_rows(spark, awkward, nothing):
    docs = awkward.dropDuplicates(["doc_id"])
    rows = docs.collect()
    check_packing(packing.pack(docs, WORD, 2).collect(), dict(zip([d.doc_id for d in rows], ids_of(WORD, [d.text for d in rows], 2), strict=True)), 0.05)
    assert packing.pack(nothing, WORD, 2).count() == 0
    assert sum(r.length for r in packing.pack(awkward, WORD, 2).collect()) == sum(map(len, ids_of(WORD, [d.text for d in awkward.collect()], 2)))


def test_chat_query(spark, sf_dir):
    same(llm.queries()["op4_chat"](spark, sf_dir), connect(sf_dir), llm.oracle_sql()["op4_chat"])


def test_chat_examples(spark):
    rows = [(1, 0, "user", "<|end|> \\l > \\\\"), (1, 1, "assistant", None), (1, 2, "assistant", "b<"), (1, 3, "user", "tail"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "a|>b", "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", chat.F.lit("clash"))
    out = chat.format_examples(df)
    read = out.select("conv_id", "example", "is_last", chat.read_turns(chat.F.col("text")).alias("turns"), chat.read_loss(chat.F.col("text"), chat.F.col("loss_from"), chat.F.col("loss_to")).alias("loss")).collect()
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in read if r.is_last}
    assert turns == {1: [("user", "<|end|> \\l > \\\\"), ("assistant", ""), ("assistant", "b<"), ("user", "tail")], 2: [("", "x"), ("", "x")], 3: [("a|>b", "y")], None: [("assistant", "z")]}
    assert sorted((r.conv_id or 0, r.example, r.loss) for r in read) == [(0, 1, "z"), (1, 2, ""), (1, 3, "b<"), (1, 4, ""), (2, 2, ""), (3, 1, "")]
    assert chat.format_examples(df.limit(0)).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items):
    words = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_query(spark, sf_dir):
    rows = llm.queries()["op8_decontamination"](spark, sf_dir).drop("n_near_items").collect()
    want = plain_hits([tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()], [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in rows), key=str) == want


@pytest.mark.parametrize("block_chars", [10, 1_000_000])
def test_short_items_repeats_and_blocks(spark, block_chars):
    r = random.Random(2)
    text = lambda n: " ".join(r.choices(["a", "b", "É", "9", "C-d"], k=n))
    items = [(k, text(r.choice([1, 2, 3, 13, 14, 20]))) for k in range(12)] + [(50, None), (51, "--"), (3, "a b"), (None, "a")]
    docs = [(k, text(r.choice([0, 1, 5, 40, 200])) + (" " + items[k % 12][1] if k % 3 == 0 else "")) for k in range(40)] + [(98, None), (None, "a b a"), (7, "a b")]
    found = positional_index.with_verdict(positional_index.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars))
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.contaminated) for x in found.collect()), key=str)
    assert got == plain_hits(docs, [x for x in items if x[0] is not None])


def test_proximity_and_full_index(spark):
    item = "alpha beta gamma delta"
    docs = spark.createDataFrame([(0, "x alpha beta gamma delta x"), (1, "delta y gamma y beta y alpha"), (2, "alpha " + "y " * 80 + "beta gamma delta")], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in positional_index.match(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {0: (["5"], []), 1: ([], ["5"]), 2: ([], [])}
    index = positional_index.build_index(docs)
    assert index.where("term IS NOT NULL").agg(positional_index.F.sum("n")).first()[0] == 6 + 7 + 84


def test_empty_tables(spark, awkward, nothing, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    assert positional_index.match(nothing, b).count() == 0
    assert positional_index.match(awkward, b.limit(0)).where("size(items) > 0").count() == 0
    out = positional_index.decontamination_stage(spark, awkward, sf_dir)
    assert out.columns == awkward.columns and out.count() == awkward.count()


def test_pipeline_stages_take_effect(spark, sf_dir):
    """Every stage against its own input, then the packed rows against the last kept texts."""
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == columns
        sizes.append((kept.count(), kept.agg({"n_chars": "sum"}).first()[0]))
    assert sizes[0][0] < docs.count() and sizes[1][0] == sizes[0][0] and sizes[1][1] < sizes[0][1] and sizes[2][0] <= sizes[1][0] and sizes[3][0] < sizes[2][0]
    rows = kept.collect()
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), dict(zip([d.doc_id for d in rows], ids_of(WORD, [d.text for d in rows], 2), strict=True)), 0.05)


def test_items_without_an_id_count_as_hits(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), ("a", "quite other words")], "item_id string, text string")
    for block_chars in (1, 8_000_000):
        got = {r.doc_id: r for r in positional_index.with_verdict(positional_index.match(docs, items, block_chars=block_chars)).collect()}
        assert (got[1].n_hit, got[1].contaminated, got[1].n_items, got[1]["items"]) == (13, True, 0, []) and got[2].n_hit == 0
