"""Sequences against plain loops, verdict rules, pixels, files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provquill.functions import pixels
from provquill.operators import marks, sequences, verdict
from provquill.plans.spelled import tiny_png
from provquill.sources import files
from provquill.streaming.runs import overlap

ROWS = "sequence long, frame_index long, confidence double, region struct<x:int,y:int,w:int,h:int>"


def frames(seed: int, n: int = 120):
    r = random.Random(seed)
    return [(s, k, r.choice([0.1, 0.3, 0.6, 0.95]), None if r.random() < 0.25 else (r.choice([0, 2, 12]), 0, 20, 20)) for s in range(3) for k in range(n)]


def plain_runs(rows, weak, anchor=None):
    out, run, number = {}, [], 0
    for s, k, c, region in sorted(rows):
        if run and run[-1][0] != s:
            run = []
            number = 0
        if region is None or c < weak:
            continue
        if not run or k - run[-1][1] > 3 or overlap(run[-1][2], region) < 0.55 or (anchor is not None and overlap(run[0][2], region) < anchor):
            number += 1
            run = []
        run.append((s, k, region))
        out[s, k] = number
    return out


@pytest.mark.parametrize("anchor", [None, 0.7])
def test_runs(spark, anchor):
    rows = frames(2)
    df = spark.createDataFrame(rows, ROWS)
    got = sequences.runs(df, 0.3) if anchor is None else sequences.anchored_runs(df, 0.3, anchor)
    assert {(r.sequence, r.frame_index): r.run for r in got.collect()} == plain_runs(rows, 0.3, anchor)


def plain_stable(rows, p):
    out = []
    numbers = plain_runs(rows, p.weak)
    for s in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == s)
        accepted = [None] * len(mine)
        groups = {}
        for k, r in enumerate(mine):
            if (s, r[1]) in numbers:
                groups.setdefault(numbers[s, r[1]], []).append(k)
        for g in groups.values():
            if len(g) < p.min_frames or max(mine[k][2] for k in g) < p.strong:
                continue
            for k in g:
                accepted[k] = mine[k][3]
            for a, b in zip(g[:-1], g[1:], strict=True):
                if b - a > 1 and overlap(mine[a][3], mine[b][3]) >= 0.55:
                    for k in range(a + 1, b):
                        accepted[k] = mine[a][3] if k - a <= b - k else mine[b][3]
        known = [x for x in accepted if x]
        if p.cover and known:
            last = known[0]
            for k, r in enumerate(mine):
                if accepted[k] is not None:
                    last = accepted[k]
                elif r[3] and r[2] >= p.transition and any(overlap(r[3], x) >= 0.55 for x in known):
                    accepted[k] = r[3]
                else:
                    accepted[k] = last
        out += [(s, r[1], x) for r, x in zip(mine, accepted, strict=True)]
    return out


@pytest.mark.parametrize("cover", [False, True])
def test_stabilize(spark, cover):
    rows, policy = frames(5), sequences.Policy(0.3, 0.9, 0.2, 4, cover=cover)
    got = sequences.stabilize(spark.createDataFrame(rows, ROWS), policy).orderBy("sequence", "frame_index").collect()
    assert [(r.sequence, r.frame_index, tuple(r.accepted) if r.accepted else None) for r in got] == plain_stable(rows, policy)


def test_verdict_rules(spark):
    rows = [("none", b"nothing"), ("iptc", b"compositeWithTrainedAlgorithmicMedia"), ("camera", b"jumb c2pa NIKON"), ("bare", b"algorithmicMedia"), ("null", None), ("cloud", b"dcterms:provenance https://cai-manifests.adobe.com/x")]
    out = {r.path: r for r in verdict.verdicts(spark.createDataFrame([(a, bytearray(b) if b is not None else None) for a, b in rows], "path string, scan binary")).collect()}
    assert {k: v.is_ai_generated for k, v in out.items()} == {"none": None, "iptc": True, "camera": None, "bare": None, "null": None, "cloud": None}
    assert out["iptc"].ai_source_kind == "enhanced"
    assert out["camera"].platform == "Nikon (camera, C2PA capture)"
    assert out["cloud"].platform == "C2PA signer: Adobe Content Authenticity (cloud manifest)"


def test_invalid_credentials_drop_platform(spark):
    df = spark.createDataFrame([("a", bytearray(b"jumb c2pa OpenAI trainedAlgorithmicMedia"))], "path string, scan binary").withColumn("c2pa", F.from_json(F.lit('{"integrity":"invalid","codes":["assertion.dataHash.mismatch"]}'), verdict.C2PA_TYPE))
    r = verdict.verdicts(df).first()
    assert r.platform is None and r.is_ai_generated is None
    assert r.integrity_clashes[0] == "C2PA credentials failed integrity validation: assertion.dataHash.mismatch"


def test_trust(spark):
    rows = [("f", "doubao", "p1", True, True, []), ("f", "jimeng", "p1", False, True, []), ("g", "kling", "p2", False, True, ["kling"]), ("h", "qwen", "p3", True, True, [])]
    got = marks.trust(spark.createDataFrame(rows, "path string, mark string, product string, strict boolean, vouches boolean, provenance array<string>")).collect()
    assert {(r.path, r.mark): r.trust for r in got} == {("f", "doubao"): "strict", ("f", "jimeng"): "confirmed", ("g", "kling"): "confirmed", ("h", "qwen"): "strict"}


def test_pixels():
    g = np.arange(64 * 64, dtype=float).reshape(64, 64) % 251
    assert len(pixels.perceptual_hash(g)) == 16
    d = pixels.dct_matrix(8)
    assert np.allclose(d @ d.T, np.eye(8))
    assert pixels.residual(np.full((5, 5), 7.0)).max() == 0
    assert pixels.noise(np.full((5, 5), 7.0))["std"] == 0
    assert pixels.vote(np.array([1, 0, 1, 0]), 2).tolist() == [True, False]


def test_haar_bits_against_a_loop():
    plane = np.random.default_rng(3).integers(0, 256, (27, 41)).astype(float)
    want = []
    for r in range(0, 24, 8):
        for c in range(0, 40, 8):
            low = [plane[r + 2 * i : r + 2 * i + 2, c + 2 * j : c + 2 * j + 2].sum() / 2 for i in range(4) for j in range(4)]
            want.append(int(max(low[1:]) % 36 > 18))
    assert pixels.haar_bits(plane).tolist() == want
    assert pixels.haar_bits(np.zeros((1, 9))).size == 0


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(tiny_png(("parameters", "a cat")))
    (tmp_path / "b.png").write_bytes(tiny_png())
    (tmp_path / "c.jpg").write_bytes(b"\xff")  # an empty file gives no row: Spark plans no split for it
    (tmp_path / "d.txt").write_bytes(b"parameters")
    got = {r.path.rsplit("/", 1)[1]: r.is_ai_generated for r in files.identify(spark, str(tmp_path)).collect()}
    assert got == {"a.png": True, "b.png": None, "c.jpg": None}


def test_records_of_other_versions_raise(spark):
    df = spark.createDataFrame([("a", '{"schema_version": 2, "status": "complete"}')], "path string, record string")
    with pytest.raises(Exception, match="unsupported or incomplete"):
        files.evidence_from_records(df).collect()


def test_greedy_pairs(spark):
    from provquill.operators.matching import greedy_pairs

    r = random.Random(4)
    rows = [(g, a, b, r.randint(1, 9) / 10) for g in range(3) for a in range(6) for b in range(5)]
    want = set()
    for g in range(3):
        left, right = set(), set()
        for _, a, b, s in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1], x[2])):
            if s >= 0.3 and a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((g, a, b, s))
    got = greedy_pairs(spark.createDataFrame(rows, "g int, a int, b int, s double"), "g", "a", "b", "s", 0.3)
    assert {tuple(x) for x in got.collect()} == want


def test_nearest_pairs_are_greedy_pairs(spark):
    from provquill.operators.matching import greedy_pairs, nearest_pairs

    r = random.Random(8)
    items = [(g, k, r.randint(0, 12) / 2, r.random() < 0.5) for g in ("a", "b", None) for k in range(60)] + [("a", 3, 1.5, True), ("a", 4, 4.0, False), ("c", 1, 1.0, True)]
    df = spark.createDataFrame(items, "g string, k int, v double, is_left boolean")
    a, b = df.where("is_left").alias("a"), df.where("NOT is_left").alias("b")
    c = a.join(b, F.col("a.g") == F.col("b.g")).select("a.g", F.col("a.k").alias("l"), F.col("b.k").alias("r"), (-F.abs(F.col("a.v") - F.col("b.v"))).alias("s"))
    want = {(x.g, x.l, x.r, -x.s) for x in greedy_pairs(c, "g", "l", "r", "s", -2.5).collect()}
    got = [tuple(x) for x in nearest_pairs(df, ["g"], "k", "v", "is_left", 2.5).collect()]
    assert len(got) == len(set(got)) > 40 and set(got) == want


def test_matching_of_crowded_groups_makes_no_pairs(spark, tmp_path):
    """Equal sizes by the thousand: all pairs of a product would be 16 million, and each round takes one of them."""
    import time

    from provquill.plans import queries

    spark.range(8000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "cast(1 + id % 2 + 4 * (id % 3) AS int) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    began = time.monotonic()
    rows = queries()["j14_greedy_matching"](spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 30
    assert len(rows) == len({x.l for x in rows}) == len({x.r for x in rows}) == 4000 and {x.score for x in rows} <= {0.5, 0.25, 0.166667, 0.125, 0.1}


def test_overlapping_pairs_are_those_of_all_pairs(spark):
    """Regions shared by many items, areas about the bins' bounds, empty regions, repeated and missing keys."""
    from provquill.operators.matching import overlapping_pairs

    r = random.Random(9)
    spots = [(r.randint(0, 3), r.randint(0, 3), r.choice([0, 4, 5, 8, 10, 16, 20]), r.choice([1, 5, 8, 10])) for _ in range(25)]
    items = [(r.choice("gh"), k % 190, r.choice(spots)) for k in range(200)] + [(None, 900, spots[0]), (None, 901, spots[0]), ("g", 902, None)]
    df = spark.createDataFrame(items, "g string, k long, region struct<x:int,y:int,w:int,h:int>")

    def overlap(a, b):
        w, h = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        union = a[2] * a[3] + b[2] * b[3] - w * h
        return w * h / union if union else 0.0

    for least in (0.3, 0.8, 1.0):
        want = sorted((a[1], b[1]) for a in items for b in items if a[0] and a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and overlap(a[2], b[2]) >= least)
        assert len(want) > 100 and sorted(tuple(x) for x in overlapping_pairs(df, ["g"], "k", "region", least).collect()) == want


def test_sinks(spark, tmp_path):
    from provquill.sources import sinks

    v = verdict.verdicts(spark.createDataFrame([("a", bytearray(b"compositeSynthetic"))], "path string, scan binary"))
    sinks.write_report_json(v, str(tmp_path / "j"))
    sinks.write_report_csv(v, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).first().path == "a"
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().signals == "iptc"
    row = spark.createDataFrame([("a\0b" + "x" * 5000, bytearray(b"ab"))], "t string, b binary").select(sinks.safe_text(F.col("t")).alias("t"), sinks.capped_base64(F.col("b"), 1).alias("b")).first()
    assert row.t.startswith("a�b") and row.t.endswith("…") and row.b == "YQ==…"


def test_random_baseline(spark):
    from provquill.functions.vectors import random_baseline

    a = [r.embedding for r in random_baseline(spark, 50, 64, 1).orderBy("vec_id").collect()]
    assert a == [r.embedding for r in random_baseline(spark, 50, 64, 1).orderBy("vec_id").collect()]
    assert abs(np.mean(a)) < 0.1 and abs(np.std(a) - 1) < 0.1


def test_sparkle_gate(spark):
    rows = [(0.2, 0.9, 0.9, 9.0, 0.1), (0.8, 0.9, 0.5, 9.0, 0.1), (0.6, 0.5, 0.6, 9.0, 0.1), (0.6, 0.5, 0.6, 2.0, 0.1), (0.5, 0.4, 0.4, 9.0, 0.1), (0.6, 0.5, 0.6, 9.0, 0.9)]
    df = spark.createDataFrame(rows, "spatial double, gradient double, variance double, margin double, saturation double")
    c = [F.col(x) for x in ("spatial", "gradient", "variance", "margin", "saturation")]
    got = [(round(r.a, 4), round(r.b, 4)) for r in df.select(marks.sparkle_confidence(*c).alias("a"), marks.sparkle_confidence(*c, F.lit(True)).alias("b")).collect()]
    assert got == [(0.1, 0.1), (0.77, 0.77), (0.57, 0.57), (0.3, 0.57), (0.3, 0.45), (0.3, 0.57)]


def test_decide(spark):
    rows = [("f", "doubao", "d", True, True, False), ("f", "jimeng_pill", "j", True, True, True), ("g", "jimeng", "j", True, True, False), ("g", "jimeng_pill", "j", False, True, False), ("h", "jimeng_pill", "j", True, True, True), ("i", "kling", "k", False, True, False)]
    df = spark.createDataFrame(rows, "path string, mark string, product string, strict boolean, relaxed boolean, flat boolean").withColumn("provenance", F.when(F.col("path").isin("h", "i"), F.array(F.lit("jimeng"), F.lit("kling"))).otherwise(F.array().cast("array<string>")))
    assert sorted((r.path, r.mark, r.trust) for r in marks.decide(df).collect()) == [("f", "doubao", "strict"), ("g", "jimeng", "strict"), ("g", "jimeng_pill", "confirmed"), ("h", "jimeng_pill", "strict"), ("i", "kling", "confirmed")]


def test_visible_keys(spark):
    rows = [("Google (Gemini / Imagen)", [], None), (None, ["aigc"], "0011" + "91110108335469089C"), (None, ["aigc"], None), (None, ["samsung_genai"], None)]
    df = spark.createDataFrame(rows, "platform string, names array<string>, producer string")
    got = [sorted(r.k) for r in df.select(marks.visible_keys(F.col("platform"), F.col("names"), F.col("producer")).alias("k")).collect()]
    assert got == [["gemini"], ["kling"], ["doubao", "jimeng"], ["samsung"]]


def test_images_to_pixel_evidence(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(tiny_png())
    r = pixels.pixel_evidence(files.read_images(spark, str(tmp_path))).first()
    assert r.path.endswith("a.png") and r.status == "complete" and r.phash is not None


def test_ssim_and_coarse_maps():
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (23, 31)).astype(float)
    b = np.clip(a + r.normal(0, 20, a.shape), 0, 255)
    total = []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            total.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert abs(pixels.ssim(a, b) - np.mean(total)) < 1e-9 and pixels.ssim(a, a) == pytest.approx(1)
    assert pixels.coarse_map(np.arange(16.0).reshape(4, 4), 2) == [2.5, 4.5, 10.5, 12.5] and len(pixels.coarse_map(a)) == 64
