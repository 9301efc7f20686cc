"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must contain. A segment (a block of texts inside one task)
is indexed by the trigrams the queries ask for: posting lists of row
numbers. Each query intersects and unites posting lists, and only the rows
left are verified with the expression. A rule without mandatory trigrams
(``hex``) is verified on every row. Segments are independent, so there is
no shuffle, no shared state and nothing to rebuild when an executor goes.

Null and empty texts have no spans; repeated rows are scanned each for
itself; texts of any length are scanned whole, in linear memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache
from re import _constants as tok
from re import _parser as regex_tree

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.spans import Span, span_column

EXACT_LIMIT = 64  # strings a literal part may stand for before it is closed
CLASS_LIMIT = 8  # members of a character class that is spelled out
SEGMENT_BYTES = 4 << 20  # text of one segment


@dataclass(frozen=True)
class Rule:
    """``accept`` drops a match that fails; a dropped match still uses up its characters."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False


# The base rules and their order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18, True),
    # a maximal run of 16 or more is the same as a run that passes the length test
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", base=True),
)
# Public key formats of well-known issuers.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is None (no mandatory trigram), or alternatives, each a set of trigrams that must all occur.
Query = frozenset[frozenset[bytes]] | None


def _trigrams(text: str) -> frozenset[bytes]:
    raw = text.encode()
    return frozenset(raw[i:i + 3] for i in range(len(raw) - 2))


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _minimal(a | b)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joined = [x | y for x in a for y in b]
    return _minimal(frozenset(joined)) if len(joined) <= EXACT_LIMIT else min(a, b, key=len)


def _minimal(q: frozenset) -> frozenset:
    """Drop alternatives implied by a weaker one."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    sets = frozenset(_trigrams(s) for s in strings)
    return None if not all(sets) else _minimal(sets)


def _fold(char: int) -> str:
    text = chr(char)
    return text.lower() if text.isascii() else text


def _analyse(items: Sequence) -> tuple[set[str] | None, Query]:
    """All strings a part can stand for (None: too many), and its trigram query."""
    exact: set[str] = {""}
    query: Query = None
    whole = True

    def close() -> None:
        nonlocal exact, query, whole
        query, exact, whole = _both(query, _of_strings(exact)), {""}, False

    def extend(options: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(options) > EXACT_LIMIT:
            close()
        exact = {a + b for a in exact for b in options}

    for op, value in items:
        if op is tok.LITERAL:
            extend({_fold(value)})
        elif op is tok.IN and all(o is tok.LITERAL for o, _ in value) and len(value) <= CLASS_LIMIT:
            extend({_fold(v) for _, v in value})
        elif op is tok.SUBPATTERN or op is tok.BRANCH:
            parts = [_analyse(p) for p in (value[1] if op is tok.BRANCH else [value[-1]])]
            if all(e is not None for e, _ in parts):
                extend(set().union(*(e for e, _ in parts)))
            else:
                close()
                joint = parts[0][1]
                for _, q in parts[1:]:
                    joint = _either(joint, q)
                query = _both(query, joint)
        elif op is tok.MAX_REPEAT or op is tok.MIN_REPEAT:
            low, high, body = value
            inner, inner_query = _analyse(body)
            if inner is not None and (low, high) == (0, 1):
                extend(inner | {""})
            elif inner is not None and low == high and len(inner) == 1 and low <= EXACT_LIMIT:
                extend({next(iter(inner)) * low})
            else:
                close()
                query = _both(query, inner_query) if low else query
        elif op not in (tok.AT, tok.ASSERT, tok.ASSERT_NOT):
            close()
    if whole:
        return exact, _of_strings(exact)
    return None, _both(query, _of_strings(exact))


def trigram_query(pattern: str) -> Query:
    """Trigrams (ASCII letters folded) that every match of ``pattern`` contains.

    An over-approximation: a text that fails the query has no match. Only
    ASCII case folding is assumed, so patterns are compiled with ``re.A``.
    """
    return _analyse(regex_tree.parse(pattern, re.A))[1]


class SegmentIndex:
    """Posting lists of one segment, for the trigrams that the queries name."""

    def __init__(self, texts: Sequence[bytes], wanted: Sequence[bytes], table: np.ndarray):
        # 0xFF never occurs in UTF-8, so no trigram crosses two texts unnoticed
        blob = np.frombuffer(b"\xff\xff".join(texts).lower() + b"\xff\xff\xff", np.uint8).astype(np.uint32)
        codes = (blob[:-2] << 16) | (blob[1:-1] << 8) | blob[2:]
        number = table[codes]
        at = np.flatnonzero(number)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        row = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(number[at].astype(np.int64) * len(texts) + row)
        edge = np.searchsorted(pairs, np.arange(1, len(wanted) + 2, dtype=np.int64) * len(texts))
        self.postings = {w: pairs[edge[i]:edge[i + 1]] % len(texts) for i, w in enumerate(wanted)}
        self.all_rows = np.arange(len(texts))

    def search(self, query: Query) -> np.ndarray:
        """Rows that satisfy the query, in order."""
        if query is None:
            return self.all_rows
        out = np.empty(0, np.int64)
        for clause in query:
            lists = sorted((self.postings[t] for t in clause), key=len)
            rows = lists[0]
            for other in lists[1:]:
                rows = np.intersect1d(rows, other, assume_unique=True)
            out = np.union1d(out, rows)
        return out


@cache
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries if q for clause in q for t in clause})
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(wanted, 1):
        table[int.from_bytes(t, "big")] = i
    return [re.compile(r.pattern, re.A) for r in rules], queries, wanted, table


def scan_texts(texts: Sequence[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[Span, bool]]]:
    """Spans of each text. Added kinds are kept where they overlap base kinds."""
    expressions, queries, wanted, table = _compiled(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin = 0
    while begin < len(texts):
        end, load, block = begin, 0, []
        while end < len(texts) and (not block or load < SEGMENT_BYTES):
            block.append(texts[end].encode("utf-8", "surrogatepass"))
            load += len(block[-1])
            end += 1
        index = SegmentIndex(block, wanted, table)
        for number, (rule, expression, query) in enumerate(zip(rules, expressions, queries, strict=True)):
            for row in index.search(query).tolist():
                spans = found[begin + row]
                for m in expression.finditer(texts[begin + row]):
                    if rule.accept(m):
                        spans.append((m.start(), number, m.end()))
        begin = end
    return [[((rules[n].kind, s, e), rules[n].base) for s, n, e in sorted(spans)] for spans in found]


def secret_spans(text: Column) -> Column:
    """Array of (kind, start, end, base) for a text column."""
    return span_column(text, scan_texts)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and ``spans``. Other columns are not carried."""
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("spans"))
