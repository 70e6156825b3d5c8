"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that ``labels.toxic`` confirms; everything else is unlabelled text.  A linear classifier
over word marks minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the bracket turns negative its gradient is reversed,
so that the classifier cannot fit the unlabelled part below zero risk.  A mark is a whole word, or
the first letters of one (languages build words from stems), at a least count or a least share of the text's
words.  Marks are chosen by how much more often positives have them than unlabelled texts; they are compared by
their whole spelling, never by a bucket.

Training rows are bounded: ``max_positive`` positives and ``max_unlabelled`` other documents (smallest hashes of
their ids), ``max_marks`` marks.  Scoring reads every whole text in one pass, without a shuffle.

Defined results: null and empty texts get the score of a text without any mark; ties in the choice of
marks go by spelling; repeated rows are scored each; an empty table gives an empty one; without a confirmed
example every score is sigmoid(-30), less than 1e-12; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, materialize, small_batches, table
from .positional_index import words_of

#: Part of the rows that never train: this remainder of crc32(doc_id as text) mod 3.
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"
DECIDE_AT = 0.7


#: Letters of a stem; least counts; least shares in hundredths of the words.
STEMS, COUNTS, SHARES = (4, 5, 6, 7, 8), (2, 4, 8), (1, 2, 4, 8)


class StemTable(dict):
    """Word -> its own mark (word$) and those of its stems (^letters); with wanted ones only these.  Each word is spelled once."""

    def __init__(self, wanted: set[str] | None = None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        w = word.decode("utf-8", "surrogatepass")
        found = (f"{w}$", *(f"^{w[:k]}" for k in STEMS if len(w) >= k))
        out = self[word] = found if self.wanted is None else tuple(s for s in found if s in self.wanted)
        return out


def stem_counts(text: str | None, stems: StemTable) -> tuple[int, dict[str, int]]:
    """(words, counts of the table's marks) of a whole text."""
    words = words_of(text)
    out: dict[str, int] = {}
    for w, n in Counter(words).items():
        for s in stems[w]:
            out[s] = out.get(s, 0) + n
    return len(words), out


def marks_of(stem: str, n: int, words: int) -> list[str]:
    return [stem, *(f"{stem} n{k}" for k in COUNTS if n >= k), *(f"{stem} s{k}" for k in SHARES if 100 * n >= k * words)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.stems = StemTable({m.split(" ")[0] for m in self.weights})

    def score(self, text: str | None) -> float:
        words, counts = stem_counts(text, self.stems)
        z = self.bias + math.fsum(self.weights.get(m, 0.0) for s, n in counts.items() for m in marks_of(s, n, words))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 600, rate: float = 0.05, decay: float = 2e-4, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic classifier with the least non-negative risk, by Adam on whole matrices."""
    n = positive.shape[1]
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    xp, xu = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, epochs + 1):
        sp, su = sigmoid(xp @ theta), sigmoid(xu @ theta)
        # Logistic losses: -log s for label 1, -log(1 - s) for label 0; their gradients are (s - 1) x and s x.
        negative_part = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        part = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        gradient = prior * (xp.T @ (sp - 1)) / len(xp) + part if negative_part >= floor else -part
        gradient[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = 2000, max_unlabelled: int = 4000, max_marks: int = 400, least_share: float = 0.02) -> Model:
    """Fit on the rows that are not held out; labels of held-out rows are never read."""
    usable = bare(labels, "doc_id", label).where(f"doc_id IS NOT NULL AND {label} IS NOT NULL AND NOT ({HELD_OUT})").groupBy("doc_id").agg(F.max(label).alias("y"))
    share = usable.agg(F.avg(F.col("y").cast("double")).alias("p"), F.sum("y").alias("n")).first()
    if not share.n:
        return Model({}, -30.0)
    prior = min(0.9, max(share.p, 1e-3))
    ids = bare(docs, "doc_id").where(f"doc_id IS NOT NULL AND NOT ({HELD_OUT})").distinct()
    confirmed = usable.where("y = 1").select("doc_id")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    positives = ids.join(confirmed, "doc_id", "left_semi").orderBy(*by_hash).limit(max_positive).withColumn("pos", F.lit(1))
    others = ids.orderBy(*by_hash).limit(max_unlabelled).withColumn("pos", F.lit(0))
    chosen = F.broadcast(positives.union(others))  # max_positive + max_unlabelled ids at most
    small_batches(docs.sparkSession)

    def all_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = StemTable()
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                words, counts = stem_counts(text, stems)
                found.append([m for s, n in counts.items() for m in marks_of(s, n, words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "pos", "marks"])

    sample = bare(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", "pos", "text")
    sample = materialize(sample.mapInArrow(all_marks, "doc_id long, pos int, marks array<string>"), "toxicity-sample")
    sizes = sample.agg(F.expr("count_if(pos = 1)").alias("p"), F.expr("count_if(pos = 0)").alias("u")).first()
    if not sizes.p or not sizes.u:
        return Model({}, -30.0)
    counts = sample.select("pos", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("u"))
    least = max(2, least_share * sizes.p)
    ratio = f"ln((p + 0.1D) / {sizes.p}D) - ln((u + 0.5D) / {sizes.u}D)"
    marks = [r.mark for r in counts.where(f"p >= {least} AND {ratio} > {0.4 * -np.log(prior)}D").orderBy(F.expr(f"p * ({ratio})").desc(), "mark").limit(max_marks).collect()]
    if not marks:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {m: k for k, m in enumerate(marks)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[m] for m in ms if m in place] for ms in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["pos", "places"])

    matrix = {0: [], 1: []}
    for r in sample.select("pos", "marks").mapInArrow(rows, "pos int, places array<int>").collect():  # the bounded sample
        x = np.zeros(len(marks))
        x[r.places] = 1
        matrix[r.pos].append(x)
    weights, bias = nnpu(np.array(sorted(map(tuple, matrix[1]))), np.array(sorted(map(tuple, matrix[0]))), prior)
    return Model({m: float(weights[k]) for m, k in place.items()}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return bare(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"cast(score >= {DECIDE_AT} AS int)").alias("predicted"))
