"""Personal data, also when disguised, with spans in the original text.

Base detectors run on the text as it is. Then three transducers rewrite
disguises: look-alike letters and digits to ASCII, spelled digits to
digits, and spelled or bracketed "at" and "dot" to their signs. Each
rewriting remembers which source characters it stands for, so a hit in the
normalised text maps back to a span of the original. Hits that need a
rewriting and overlap no base span are added.

Everything runs row by row inside a task: no shuffle, nothing to lose.
Null and empty texts have no spans. The detectors take linear time, since
no expression can start twice inside one run of its characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.spans import Span, span_column

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: from a later one the rest would fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, found from each @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


DETECTORS = (emails, ips, cards, phones)

# Letters of other scripts that look like ASCII, as (look-alike, plain) strings.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТХаеѕіјорсхуԁԛԝһ", "ABESIJKMHOPCTXaesijopcxydqwh"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp"),
)
ZERO_WIDTH = "­​‌‍⁠﻿"
# Spelled digits.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
LEAST_SPELLED = 4  # shorter runs of spelled digits and numbers are ordinary prose


@cache
def look_alikes() -> dict[str, str]:
    """Single characters with an ASCII reading: the lists above, other decimal digits and full-width forms."""
    table = {c: "" for c in ZERO_WIDTH}
    for strange, plain in LOOK_ALIKES:
        table |= dict(zip(strange, plain, strict=True))
    for code in range(0x80, 0x20000):
        char = chr(code)
        if unicodedata.category(char) == "Nd":
            table[char] = str(unicodedata.digit(char))
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or char in "﹫．｡․":
            plain = unicodedata.normalize("NFKC", char)
            table[char] = "." if char in "｡․" else plain if len(plain) == 1 and plain.isascii() else char
    return {k: v for k, v in table.items() if k != v}


_WORD = "|".join(DIGIT_WORDS)
# These run on text whose ASCII letters are folded.
_DIGITS = rf"(?:{_WORD}|[0-9]+)"
SPELLED = re.compile(
    rf"(?<![a-z0-9])(?:plus[\x20-]+)?{_DIGITS}(?:[\x20-]+{_DIGITS}){{{LEAST_SPELLED - 1},}}(?![a-z0-9])")
SPELLED_PART = re.compile(rf"(plus[\x20-]+)|({_WORD})|[\x20-]+")
ANY_WORD = re.compile(_WORD)
_OPEN, _SHUT = r"\x20{0,3}[(\[{<]\x20?", r"\x20?[)\]}>]\x20{0,3}"
# Words after a plain "at" that open a noun phrase, as in "look at the dot on the map".
DETERMINERS = "the|a|an|this|that|these|those|my|your|his|her|its|our|their|each|every|any|some|no|one"
_SPELLED_HOST = rf"(?!(?:{DETERMINERS})\x20)(?=[a-z0-9-]+(?:\x20dot\x20[a-z0-9-]+)+)"
# Endings of a dotted host after a plain "at", and words before it that are no mailbox.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu"
NO_MAILBOX = frozenset(
    "us me him her them it is are be was were look looking see seen here there online live available hosted found "
    "visit out only page site website shop store work works working read more".split())
_DOTTED_HOST = rf"(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{ENDINGS})(?![a-z0-9-]))"
DISGUISE = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_SHUT}|(?<=[a-z0-9])\x20at\x20{_SPELLED_HOST})|(?P<plain>(?<=[a-z0-9])\x20at\x20{_DOTTED_HOST})"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_SHUT}|(?<=[a-z0-9])\x20dot\x20(?=[a-z0-9]))")
BRACKETED = re.compile(rf"[(\[{{<]\x20?(?:at|dot|@|\.)\x20?[)\]}}>]|\x20at\x20{_DOTTED_HOST}")
LAST_WORD = re.compile(r"[a-z0-9._%+-]{1,16}\Z")


def fold(text: str) -> str:
    """ASCII letters in lower case; every other character, and so every position, stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hinted(low: str) -> tuple[bool, bool]:
    """Whether folded text can hold spelled digits, and disguised signs."""
    digits = any(w in low for w in DIGIT_WORDS) and any(ANY_WORD.search(m[0]) for m in SPELLED.finditer(low))
    return digits, " dot " in low or BRACKETED.search(low) is not None


class Rewriting:
    """A text and, for each of its characters, the span of the original it stands for."""

    def __init__(self, text: str):
        self.text, self.source, self.marks = text, text, [(0, 0, 1)]  # (position, original, step)

    def apply(self, edits: Sequence[tuple[int, int, str]]) -> "Rewriting":
        """Replace sorted, disjoint pieces of the present text; an edit's characters stand for its whole piece."""
        if not edits:
            return self
        out, at, size, pieces = [], 0, 0, []
        for start, end, new in edits:
            if start > at:
                out.append(self.text[at:start])
                pieces.append((size, at, start))
                size += start - at
            if new:
                out.append(new)
                pieces.append((size, start, end, len(new)))
                size += len(new)
            at = end
        out.append(self.text[at:])
        pieces.append((size, at, len(self.text)))
        follow = Rewriting.__new__(Rewriting)
        follow.text, follow.source, follow.marks = "".join(out), self.source, pieces
        follow.keys = [p[0] for p in pieces]
        follow.before = self
        return follow

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """Span of the original, and whether any rewriting lies inside."""
        if not hasattr(self, "before"):
            return start, end, False
        i, j = bisect_right(self.keys, start) - 1, bisect_right(self.keys, end - 1) - 1
        first, last = self.marks[i], self.marks[j]
        low = first[1] if len(first) == 4 else first[1] + start - first[0]
        high = last[2] if len(last) == 4 else last[1] + end - last[0]
        low, high, changed = self.before.origin(low, high)
        return low, high, changed or i != j or len(first) == 4


def normalise(text: str) -> Rewriting | None:
    """The text without disguises, or None if it has none."""
    table, state = look_alikes(), Rewriting(text)
    if not text.isascii() and (strange := table.keys() & set(text)):
        any_strange = re.compile("[" + "".join(map(re.escape, strange)) + "]")
        state = state.apply([(m.start(), m.end(), table[m[0]]) for m in any_strange.finditer(text)])
    low = fold(state.text)
    digits, signs = hinted(low)
    if digits:
        edits = []
        for m in SPELLED.finditer(low):
            if not ANY_WORD.search(m[0]):
                continue
            for part in SPELLED_PART.finditer(low, *m.span()):
                edits.append((*part.span(), "+" if part[1] else DIGIT_WORDS[part[2]] if part[2] else ""))
        state = state.apply(edits)
        low = fold(state.text)
    if signs:
        state = state.apply([
            (*m.span(), "." if m["dot"] else "@") for m in DISGUISE.finditer(low)
            if not m["plain"] or LAST_WORD.search(low[max(0, m.start() - 16):m.start()])[0] not in NO_MAILBOX])
    return state if state.text != text else None


def pii_in(text: str) -> list[tuple[Span, bool]]:
    """Spans by start, then in the order of ``KINDS``; True marks base spans."""
    base = [[*detect(text)] for detect in DETECTORS]
    found = [(s, k, e, True) for k, spans in enumerate(base) for s, e in spans]
    plain = normalise(text)
    if plain is not None:
        taken = sorted(x for spans in base for x in spans)
        starts = [s for s, _ in taken]
        for k, detect in enumerate(DETECTORS):
            for hit in detect(plain.text):
                s, e, changed = plain.origin(*hit)
                i = bisect_right(starts, e - 1)
                if changed and not any(end > s for _, end in taken[max(0, i - 4):i]):
                    found.append((s, k, e, False))
    return [((KINDS[k], s, e), b) for s, k, e, b in sorted(found)]


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end, base) for a text column."""
    return span_column(text, lambda texts: map(pii_in, texts))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and ``spans``. Other columns are not carried."""
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans make one replacement.

    A null text stays null. The result is put together from the pieces between
    spans, in one pass over the spans.
    """
    length = F.char_length(text).cast("long")
    end = F.struct(F.lit("").alias("kind"), length.alias("start"), length.alias("end"), F.lit(True).alias("base"))
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - state["at"], F.lit(0)).cast("int")
        piece = F.substring(text, (state["at"] + 1).cast("int"), gap)
        label = F.when((s["kind"] == "") | (s["start"] < state["at"]), F.lit("")).otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(
            F.concat(state["parts"], F.array(piece, label)).alias("parts"),
            F.greatest(state["at"], s["end"]).alias("at"))

    parts = F.aggregate(F.concat(spans, F.array(end)), empty, step, lambda state: state["parts"])
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))
