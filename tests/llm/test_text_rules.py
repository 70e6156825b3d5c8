"""Quality rules, secrets, personal data, toxicity: against plain versions of their contracts."""

from __future__ import annotations

import collections
import hashlib
import importlib
import random
import re
import string
import time
import zlib

import numpy as np
import pytest

from provquill import llm
from provquill.llm import pii, quality_rules, secrets, toxicity
from provquill.llm.common import materialize, table
from provquill.llm.spans import Taken


def base_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_statistics(spark, awkward, sf_dir):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in (awkward, table(spark, sf_dir, "documents")):
        for r in quality_rules.document_statistics(docs.select("doc_id", "text")).collect():
            assert tuple(r[c] for c in columns) == base_stats(r.text)


def test_quality_rules_separate_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in llm.queries()["op7_quality_rules"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    clean = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert len(got) == 1000 and all(got[i].kept for i in clean)
    assert sum(not got[i].kept for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())


def test_quality_without_labels_and_rows(spark, awkward, nothing, sf_dir):
    none = table(spark, sf_dir, "labels").limit(0)
    stats = quality_rules.document_statistics(awkward.select("doc_id", "text"))
    assert quality_rules.learn(stats, none).rules == []
    assert quality_rules.quality_stage(spark, nothing, sf_dir).count() == 0
    assert quality_rules.quality_stage(spark, awkward, sf_dir).columns == awkward.columns


def test_rules_are_ordered_conditions(spark):
    rules = quality_rules.DecisionList([quality_rules.Rule((quality_rules.Condition("symbol_share", True, 0.5),)), quality_rules.Rule((quality_rules.Condition("upper_share", True, 0.5), quality_rules.Condition("log_words", False, 9.0)))])
    docs = spark.createDataFrame([(0, "## " * 60), (1, "AB " * 20 + "CD " * 20 + "EF GH IJ KL MN OP QR ST UV WX YZ"), (2, " ".join(f"w{k}" for k in range(80)))], "doc_id long, text string")
    stats = quality_rules.document_statistics(docs).withColumn("base_failed", quality_rules.F.lit(False))
    assert [r.rule for r in quality_rules.apply_rules(stats, rules).orderBy("doc_id").collect()] == [1, 2, 0]


def plain_secrets(t):
    out = []
    fold = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join([*map(fold, ("password", "passwd", "secret", "token")), fold("api") + "_?" + fold("key")])
    for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, "assign", m.end())] if len(m.group(2)) >= 12 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def plain_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m.group())
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))]
        out += [(m.start(), 2, "card", m.end())] if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0 else []
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


@pytest.mark.parametrize("which", ["pii", "secrets"])
def test_spans_on_random_texts(which):
    r = random.Random(3)
    letters = {"pii": [*"0123456789", "@", ".", "-", "+", "a", " ", "(", ")", "a.b@c.d", "1.2.3.4", "256", "4111 1111 1111 1111", "+1 (555) 555-5555", "\n", "é"], "secrets": ["token", "ToKen", "api_key", "APIKEY", "passwd", "secret", "=", ":", " ", '"', "'", "a" * 12, "0123456789ab", "deadbeef", "AKIA", "ABCDEFGHIJKLMNOP", "ſecret", "toKen", "-", "\n", "x", "9"]}[which]
    find, kinds, plain = (pii.make_finder(), pii.KINDS, plain_pii) if which == "pii" else (secrets.make_finder(None)(), secrets.KINDS, plain_secrets)
    for _ in range(20_000):
        t = "".join(r.choices(letters, k=r.randint(1, 30)))
        assert ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, kinds.index(k), k, e) for k, s, e in find(t))) == plain(t)


@pytest.mark.parametrize("name, plain", [("op9_secrets", plain_secrets), ("op10_pii", plain_pii)])
def test_span_queries(spark, sf_dir, name, plain):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = llm.queries()[name](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_method_spans():
    find = pii.make_finder()
    assert ("account", 6, 28) in find("IBAN: GB82WEST12345698765432")
    assert not [s for s in find("IBAN: GB82WEST12345698765433") if s[0] == "account"]
    assert ("account", 5, 16) in find("SSN: 123-45-6789 x")
    assert [s[0] for s in find("see https://host.example/~someone now")] == ["address"]
    assert not find("plain https://host.example/page here")
    models = secrets.MarkovPair(secrets.random_samples(), secrets.library_identifiers())
    spans = secrets.make_finder(models)()("x q7Zk9LmP2vX8rT4wYb6N3cJd5 x get_running_loop_exception_handler x")
    assert [(k, s) for k, s, _ in spans] == [("random", 2)]


def test_markov_models_on_strings_that_they_have_not_seen():
    """Random strings of other seeds and lengths are found, identifiers of other libraries are not."""
    models = secrets.MarkovPair(secrets.random_samples(), known := secrets.library_identifiers())
    find = secrets.make_finder(models)()
    names: set[str] = set()
    for module in ("asyncio", "ssl", "decimal", "ctypes", "multiprocessing", "typing", "inspect", "ast", "tarfile", "datetime", "locale", "numpy", "pandas", "pyarrow", "pyspark"):
        for name, value in vars(importlib.import_module(module)).items():
            names |= {name, *(dir(value) if isinstance(value, type) else ())}
    names = {n for n in names - set(known) if re.fullmatch(secrets.CANDIDATE, n)}
    r = random.Random(99)
    strings = ["".join(r.choices(a, k=k)) for a in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/") for k in (20, 24, 32, 40, 64) for _ in range(200)]
    found = lambda x: any(s[0] in ("random", "hex", "access") for s in find(f"as {x} is"))
    assert len(names) > 300 and sum(map(found, names)) <= 0.005 * len(names)
    assert sum(map(found, strings)) >= 0.98 * len(strings)


def test_hostile_texts_cost_one_pass():
    """Long runs of digits, and 200,000 spans in one text."""
    start = time.monotonic()
    assert pii.make_finder()("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert pii.make_finder()("9" * 100_000 + ".1.2.3 " + "1" * 100_000) == []
    found = pii.make_finder()("joe@a.b https://u@h.c/ " * 100_000)
    assert len(found) == 200_000
    models = secrets.MarkovPair(secrets.random_samples(), secrets.library_identifiers())
    assert len(secrets.make_finder(models)()('token = "abcdefghijkl" q7Zk9LmP2vX8rT4wYb6N3cJd5 ' * 100_000)) == 200_000
    assert time.monotonic() - start < 60


def test_taken_ranges():
    r = random.Random(1)
    for _ in range(2000):
        spans = [("x", s, s + r.randint(1, 6)) for s in r.choices(range(40), k=r.randint(0, 6))]
        s = r.randint(0, 40)
        e = s + r.randint(1, 5)
        assert Taken(spans).clear(s, e) == all(e <= a or b <= s for _, a, b in spans)


def test_spans_of_awkward_rows(awkward, nothing):
    for docs, n in ((awkward, awkward.count()), (nothing, 0)):
        assert pii.find_personal_data(docs).count() == n
        assert secrets.find_secrets(docs, None).count() == n


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in llm.queries()["op6_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    hit = [i for i in held if rows[i].predicted]
    assert sum(labels[i] for i in hit) >= 0.97 * len(hit)
    assert sum(labels[i] for i in hit) >= 0.9 * sum(labels[i] for i in held)


def plain_marks(t):
    """Marks of a text, from their description: words and stems, at least counts and least shares."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    n = collections.Counter()
    for x in w:
        n[x + "$"] += 1
        for k in (4, 5, 6, 7, 8):
            if len(x) >= k:
                n["^" + x[:k]] += 1
    return {m for s, c in n.items() for m in [s, *(f"{s} n{k}" for k in (2, 4, 8) if c >= k), *(f"{s} s{k}" for k in (1, 2, 4, 8) if 100 * c >= k * len(w))]}


def test_toxicity_scores_equal_a_plain_learner(spark):
    """All of a small table fits the bounds of the sample, so the whole learner can be written plainly."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    learns = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    known = [y for i, y in labels.items() if learns(i)]
    prior = min(0.9, max(sum(known) / len(known), 1e-3))
    marks = {i: plain_marks(t) for i, t in texts.items()}
    u = [i for i in texts if learns(i)]
    p = [i for i in u if labels.get(i) == 1]
    in_p, in_u = collections.Counter(m for i in p for m in marks[i]), collections.Counter(m for i in u for m in marks[i])
    worth = {m: np.log((in_p[m] + 0.1) / len(p)) - np.log((in_u[m] + 0.5) / len(u)) for m in in_p if in_p[m] >= max(2, 0.02 * len(p))}
    chosen = sorted((m for m, r in worth.items() if r > 0.4 * -np.log(prior)), key=lambda m: (-in_p[m] * worth[m], m))[:400]
    xp, xu = (np.array([[m in marks[i] for m in chosen] + [True] for i in ids], dtype=float) for ids in (p, u))
    theta = np.zeros(len(chosen) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, 601):
        sp, su = 1 / (1 + np.exp(-xp @ theta)), 1 / (1 + np.exp(-xu @ theta))
        bracket = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        g = (su[:, None] * xu).mean(0) - prior * (sp[:, None] * xp).mean(0)
        g = prior * ((sp - 1)[:, None] * xp).mean(0) + g if bracket >= 0 else -g
        g[:-1] += 2e-4 * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    got = {r.doc_id: r.score for r in llm.queries()["op6_toxicity"](spark, sf).collect()}
    want = {i: 1 / (1 + np.exp(-(theta[-1] + sum(theta[k] for k, m in enumerate(chosen) if m in marks[i])))) for i in texts}
    assert len(chosen) > 50 and max(abs(got[i] - want[i]) for i in texts) < 1e-4


def plain_rules(rows, labels, bins=24):
    """The decision list by its description; rows: (doc_id, words, chars, symbols, dup lines, lines, repeats, upper, exclaim)."""
    import struct

    import xxhash

    names = ("dup_line_share", "exclaim_share", "log_words", "mean_word_chars", "repeat_share", "symbol_share", "upper_share")
    one = lambda x: max(x, 1)
    data = []
    for i, w, c, s, d, n, p, u, e in rows:
        if i in labels:
            f = dict(zip(names, (d / one(n), e / one(w), np.log2(one(w)), c / one(w), p / one(w), s / one(c), u / one(c)), strict=True))
            data.append((f, labels[i] == 0, xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    data = [(f, bad, signed(h) % 3 == 0) for f, bad, h in data]
    cuts = {}
    for name in names:
        found = set()
        for side in (True, False):
            v = sorted(f[name] for f, bad, _ in data if bad == side)
            found |= {v[max(0, int(np.ceil(k / bins * len(v))) - 1)] for k in range(bins + 1)} if v else set()
        cuts[name] = sorted(found)
    fires = lambda rule, f: all((f[n] >= t) if above else (f[n] < t) for n, above, t in rule)
    total, rules, left = sum(bad for _, bad, _ in data), [], data
    while total and len(rules) < 8:
        rule = []
        grown = [x for x in left if not x[2]]
        while len(rule) < 3:
            bad, good = sum(x[1] for x in grown), sum(not x[1] for x in grown)
            best = (0.0, None, 0)
            for name in sorted(names) if bad and good else ():
                for cut in cuts[name]:
                    for above in (False, True):
                        inside = [x[1] for x in grown if (x[0][name] >= cut) == above]
                        b, g = sum(inside), len(inside) - sum(inside)
                        if b and (gain := b * (np.log2(b / (b + g)) - np.log2(bad / (bad + good)))) > best[0] + 1e-9:
                            best = (gain, (name, above, cut), g)
            if best[1] is None:
                break
            rule.append(best[1])
            grown = [x for x in grown if fires([best[1]], x[0])]
            if not best[2]:
                break
        worth, kept = -2.0, None
        for n in range(1, len(rule) + 1):
            inside = [x[1] for x in left if x[2] and fires(rule[:n], x[0])]
            b, g = sum(inside), len(inside) - sum(inside)
            if inside and (b - g) / (b + g) > worth:
                worth, kept = (b - g) / (b + g), (rule[:n], b, g)
        if kept is None or kept[1] / max(1, kept[1] + kept[2]) < 0.97 or kept[1] < 0.01 * total / 3:
            break
        rules.append(kept[0])
        left = [x for x in left if not fires(kept[0], x[0])]
    return rules


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_verdicts_equal_a_plain_learner(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs = table(spark, sf, "documents").collect()
    rows = []
    for r in docs:
        n, c, s, d, p, failed = base_stats(r.text)
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rows.append((failed, (r.doc_id, n, c, s, d, len(lines), p, len(re.findall("[A-Z]", r.text or "")), (r.text or "").count("!"))))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.quality is not None}
    stats = materialize(quality_rules.document_statistics(table(spark, sf, "documents").select("doc_id", "text")).drop("text"), "statistics")
    learnt = [[(c.feature, c.above, c.threshold) for c in rule.conditions] for rule in quality_rules.learn(stats, table(spark, sf, "labels")).rules]
    want = plain_rules([x for failed, x in rows if not failed], labels)
    assert [[(n, a, round(t, 9)) for n, a, t in rule] for rule in learnt] == [[(n, a, round(float(t), 9)) for n, a, t in rule] for rule in want] and want


def test_toxicity_never_reads_held_out_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 200) if zlib.crc32(str(i).encode()) % 3 == 1], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    assert model.weights == {} and toxicity.score(awkward, model).count() == awkward.count() and toxicity.score(nothing, model).count() == 0


def test_nnpu_finds_the_separating_mark():
    r = np.random.default_rng(0)
    p = np.hstack([np.ones((200, 1)), r.random((200, 3)) < 0.3]).astype(float)
    u = np.hstack([(r.random((2000, 1)) < 0.1), r.random((2000, 3)) < 0.3]).astype(float)
    w, b = toxicity.nnpu(p, u, 0.1)
    assert b + w[0] > 1 > 0 > b and abs(w[1:]).max() < w[0] / 2
