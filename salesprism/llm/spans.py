"""Shared shape of span detectors: rows of (kind, start, end) in code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[str, int, int]

SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("start", T.LongType(), False),
    T.StructField("end", T.LongType(), False),
    T.StructField("base", T.BooleanType(), False),
]), False)

_ARROW = pa.list_(pa.struct([
    pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False),
    pa.field("end", pa.int64(), False), pa.field("base", pa.bool_(), False),
]))


def span_column(text: Column, detect: Callable[[Sequence[str]], Iterable[list[tuple[Span, bool]]]]) -> Column:
    """A column of spans, sorted by start and then by the detector's order of kinds; a null text has none."""

    def run(texts: pa.Array) -> pa.Array:
        found = detect([t or "" for t in texts.to_pylist()])
        rows = [[{"kind": k, "start": s, "end": e, "base": b} for (k, s, e), b in spans] for spans in found]
        return pa.array(rows, _ARROW)

    return F.arrow_udf(run, SPAN_TYPE)(text)


def count_kind(spans: Column, kind: str) -> Column:
    """Number of base spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])
