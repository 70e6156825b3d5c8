"""All tokens that a verdict looks for, found in one pass over a buffer.

A verdict asks for some hundred and fifty tokens; looked up one by one, each costs a pass over a head of up to a
megabyte.  An Aho-Corasick automaton finds them together, and the verdict then reads a small array of names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import Iterator  # the UDF reads its kind from this very hint

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import dims

cloudpickle.register_pickle_by_value(sys.modules["provquill"])

#: The UUID of the provenance box, as the latin-1 text of its bytes.
UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481").decode("latin-1")
TRAINED = ("trainedAlgorithmicMedia", "TrainedAlgorithmicMedia")
COMPOSITES = ("compositeWithTrainedAlgorithmicMedia", "compositeSynthetic")
# Names of what is found by more than a token's presence.
NAMED, BARE, APP = "<c2pa in any case beside jumb>", "<trained marker outside composites>", "<app export>"


def tokens() -> list[str]:
    """Every token, as the latin-1 text of its UTF-8 bytes (the UUID is bytes already)."""
    plain = [
        *(v.token for v in dims.VENDORS), *(t for t, _ in (*dims.AI_TOOLS, *dims.SOFT_BINDINGS, *dims.DEVICES, *dims.SIGNERS, *dims.MANIFEST_HOSTS)), *dims.IPTC_MARKERS, *dims.IPTC_FIELDS, *dims.AIGC_MARKERS,
        *TRAINED, *COMPOSITES, "jumb", "c2pa.watermarked", "dcterms:provenance", "Apple Photos Clean Up", "CreatorTool", dims.SAMSUNG_MARKER,
    ]
    return list(dict.fromkeys([*(t.encode().decode("latin-1") for t in plain), UUID]))


class Finder:
    """Finds the tokens of a buffer; built once per task."""

    def __init__(self) -> None:
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
        else:
            self.automaton = ahocorasick.Automaton()
            for t in tokens():
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()

    def __call__(self, data: bytes | None) -> list[str] | None:
        if data is None:
            return None
        text = data.decode("latin-1")
        found = {t for t in tokens() if t in text} if self.automaton is None else {t for _, t in self.automaton.iter(text)}
        low = data.lower()
        if "jumb" in found and b"c2pa" in low:
            found.add(NAMED)
        if b"dreamina" in low or b'aigc_info' in low:
            found.add(APP)
        if found & set(TRAINED):
            bare = text
            for c in COMPOSITES:
                bare = bare.replace(c, "")
            if any(t in bare for t in TRAINED):
                found.add(BARE)
        return sorted(found)

    def both(self, scan: bytes | None, region: bytes | None) -> dict:
        head = self(scan)
        return {"head": head, "region": head if region == scan else self(region)}


#: The type of what Finder.both gives, in Arrow and in a frame.
ARROW = pa.struct([("head", pa.list_(pa.string())), ("region", pa.list_(pa.string()))])
SEEN = "struct<head:array<string>,region:array<string>>"


def _seen(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    find = Finder()
    for scan, region in parts:
        yield pa.array([find.both(s.as_py(), r.as_py()) for s, r in zip(scan, region, strict=True)], ARROW)


def seen(scan: Column, region: Column) -> Column:
    """The tokens of two binary columns: STRUCT of head and region."""
    return F.arrow_udf(_seen, SEEN)(scan, region)


class Tokens:
    """Found tokens in the place of a buffer: the probes take either."""

    def __init__(self, names: Column) -> None:
        self.names = names

    def has(self, token: str) -> Column:
        return F.coalesce(F.array_contains(self.names, token.encode().decode("latin-1")), F.lit(False))

    def has_named(self, name: str) -> Column:
        return F.coalesce(F.array_contains(self.names, name), F.lit(False))

    def has_any(self, names: Iterable[str]) -> Column:
        return F.coalesce(F.arrays_overlap(self.names, F.array(*[F.lit(n.encode().decode("latin-1")) for n in names])), F.lit(False))
