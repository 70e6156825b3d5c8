"""Spans in texts: the digest columns that the span-finding queries share."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, small_batches

#: One found span: kind, first code point, end (exclusive).
Span = tuple[str, int, int]
_SCHEMA = "doc_id long, spans array<struct<kind string, start int, end int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], list[Span]]]) -> DataFrame:
    """(doc_id, spans) of every whole text; finder builds the worker's search function once per task.  No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return bare(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def joined(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the named kinds by start, then in the order named, comma-joined."""
    order = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(
        f"array_join(transform(array_sort(transform(filter({spans}, s -> array_contains(array({order}), s.kind)), "
        f"s -> struct(s.start AS start, array_position(array({order}), s.kind) AS place, s.end AS end, s.kind AS kind))), "
        f"s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    )


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) AS bigint)")


class Taken:
    """What spans cover, as disjoint ranges in order; clear() looks a range up by bisection."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def clear(self, start: int, end: int) -> bool:
        after = bisect_right(self.ends, start)  # the first range that ends behind the start
        return after == len(self.starts) or end <= self.starts[after]
