"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

The base kinds (assign, access, hex) are regular patterns.  The method adds kind ``random``: runs of token
characters that no base span touches and that a bigram model of random strings explains better than a bigram
model of identifiers and words, by a margin per character.  The identifier model learns from labelled samples:
the words of a bounded number of documents that ``labels.quality`` marks as good, whose base spans are taken
out, and identifiers of the Python library; the random model from fixed-seed random strings over the alphabets
that keys use (hexadecimal, base 32, base 62, base 64).

Defined results: null and empty texts have no spans; ties start in the order of the kinds; repeated rows are
scanned each; texts of any length are scanned whole; an empty table gives an empty one; without labelled rows
the identifier model rests on the library's identifiers; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import builtins
import keyword
import random
import re
import string
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, table
from .spans import Span, Taken, count_of, find_spans, joined

KINDS = ("assign", "access", "hex", "random")

# The base patterns and the least lengths that they need.
ASSIGN = r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Nats per character by which a run has to look more random than an identifier: on strings that the models have not seen it keeps 0.99 of the random ones and none of the identifiers.
MARGIN = 0.3
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CLASS = {c: i for i, c in enumerate(_ALPHABET)}


class MarkovPair:
    """Log-likelihood ratio per character, random strings over identifiers, from two bigram tables."""

    def __init__(self, random_strings: list[str], identifiers: list[str], smoothing: float = 0.5) -> None:
        def table_of(samples: list[str]) -> np.ndarray:
            n = len(_ALPHABET)
            counts = np.full((n + 1, n), smoothing)
            for s in samples:
                before = n
                for c in s:
                    if (k := _CLASS.get(c)) is not None:
                        counts[before, k] += 1
                        before = k
            return np.log(counts / counts.sum(axis=1, keepdims=True))

        self.ratio = (table_of(random_strings) - table_of(identifiers)).tolist()

    def score(self, token: str) -> float:
        ratio, before, total = self.ratio, len(_ALPHABET), 0.0
        for c in token:
            k = _CLASS[c]
            total += ratio[before][k]
            before = k
        return total / max(1, len(token))


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
    return ["".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(16, 64))) for i in range(n)]


def library_identifiers() -> list[str]:
    found = {*keyword.kwlist, *sys.stdlib_module_names, *dir(builtins)}
    for module in ("argparse", "collections", "email", "http", "json", "logging", "os", "pathlib", "re", "socket", "string", "subprocess", "threading", "unittest", "urllib"):
        for name in dir(__import__(module)):
            found |= {name, *dir(getattr(__import__(module), name))}
    return sorted(found)


def labelled_words(docs: DataFrame, labels: DataFrame, max_docs: int = 500, max_words: int = 50_000) -> list[str]:
    """Words of at most max_docs documents labelled good (smallest hashes of their ids), base spans taken out."""
    chosen = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = bare(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_docs ids at most
    words = texts.select(F.explode(F.expr(r"array_distinct(split(text, '[^A-Za-z0-9+/_=-]+'))")).alias("w")).where("length(w) >= 6").distinct().orderBy(F.xxhash64("w"), "w").limit(max_words)
    drop = re.compile(rf"{ACCESS}|(?=.*[0-9])[0-9a-f]{{{HEX_LEAST},}}")
    return sorted(r.w for r in words.collect() if not drop.fullmatch(r.w))


def base_spans(text: str, assign: re.Pattern, access: re.Pattern, hexadecimal: re.Pattern) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", m.start(), m.end()) for m in hexadecimal.finditer(text)]


def make_finder(models: MarkovPair | None, margin: float = MARGIN) -> Callable[[], Callable[[str], list[Span]]]:
    """A builder of the search function.  Runs of 16 or more hex digits are maximal runs, as the base pattern has them."""

    def build() -> Callable[[str], list[Span]]:
        assign, access, hexadecimal, candidate = re.compile(ASSIGN), re.compile(ACCESS), re.compile(rf"{HEX[:-1]}{{{HEX_LEAST},}}"), re.compile(CANDIDATE)

        def find(text: str) -> list[Span]:
            found = base_spans(text, assign, access, hexadecimal)
            if models is not None:
                base = Taken(found)
                for m in candidate.finditer(text):
                    if base.clear(*m.span()) and models.score(m.group()) >= margin:
                        found.append(("random", m.start(), m.end()))
            return found

        return find

    return build


def find_secrets(docs: DataFrame, models: MarkovPair | None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans) with the base kinds and, given models, kind random."""
    return find_spans(docs, make_finder(models, margin))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; the identifier model learns from good documents of the folder."""
    docs = table(spark, sf_dir, "documents")
    models = MarkovPair(random_samples(), [*library_identifiers(), *labelled_words(docs, table(spark, sf_dir, "labels"))])
    base = joined("spans", KINDS[:3])
    return find_secrets(docs, models).select("doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), joined("spans", KINDS).alias("spans"))
