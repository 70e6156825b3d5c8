"""The whole pipeline against plain versions of its stages, one after another."""

from __future__ import annotations

import re

import corpus_pipeline
from provquill.llm import line_dedup
from provquill.llm.common import table

from .test_near_duplicates import Sets, plain_lines
from .test_text_rules import base_stats, plain_rules
from .test_tokens_packing_chat_index import WORD, check_packing, ids_of, plain_hits

NAMES = ("dup_line_share", "exclaim_share", "log_words", "mean_word_chars", "repeat_share", "symbol_share", "upper_share")


def plain_quality(docs, labels):
    import math

    rows = []
    for i, t in docs:
        n, c, s, d, p, failed = base_stats(t)
        if not failed:
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            rows.append((i, n, c, s, d, len(lines), p, len(re.findall("[A-Z]", t)), t.count("!")))
    rules, kept = plain_rules(rows, labels), set()
    for i, w, c, s, d, n, p, u, e in rows:
        f = dict(zip(NAMES, (d / max(n, 1), e / max(w, 1), math.log2(max(w, 1)), c / max(w, 1), p / max(w, 1), s / max(c, 1), u / max(c, 1)), strict=True))
        if not any(all((f[name] >= cut) if above else (f[name] < cut) for name, above, cut in rule) for rule in rules):
            kept.add(i)
    return [(i, t) for i, t in docs if i in kept]


def plain_near(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    classes = Sets()
    for a in range(len(docs)):
        classes.find(a)
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                classes.join(a, b)
    return [d for k, d in enumerate(docs) if classes.find(k) == k]


def test_run_gives_what_plain_stages_give(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").collect())
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect() if r.quality is not None}
    good = plain_quality(docs, labels)
    judged = plain_lines(good, line_dedup.Relation())
    gone = {k: {v[0] for v in lines if not v[4]} for k, lines in judged.items()}
    unique = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[place])) for place, (i, t) in enumerate(good)]
    single = plain_near(unique)
    bad = {x[0] for x in plain_hits(single, [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]) if x[-1]}
    left = [(i, t) for i, t in single if i not in bad]
    assert len(docs) > len(good) > len(single) > len(left)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, dict(zip([i for i, _ in left], ids_of(WORD, [t for _, t in left], 2), strict=True)), 0.05)
