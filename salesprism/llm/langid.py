"""Language identification with bit-sliced Bloom filters over letter n-grams.

Learning counts the letter trigrams of all labelled rows by language and
keeps, for each language, those that are frequent in it and not far more
frequent in another one. All languages share one filter whose slots hold a
bit mask over languages: one lookup (the AND of a few slots) returns every
language that contains the n-gram. A text's n-grams are looked up, the bits
of each language are counted, and the counts are corrected for the share
that its false positives would give by chance.

A language keeps at most 1 / ``LEAST_SHARE`` n-grams, so the filter that is
broadcast is bounded by the number of languages, not by the corpus.

``und`` with score 0 is given to null texts and texts without a letter (and
to all if no row is labelled). A text none of whose n-grams is known gets the
first language with score 0. Texts are read whole, in blocks of bounded
memory; repeated rows are predicted each for itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism.llm.words import blocks as byte_blocks
from salesprism.session import stage

UNKNOWN = "und"
N = 3
LEAST_SHARE = 1e-4  # of a language's n-grams
RIVAL = 0.25  # of the n-gram's largest share in any language
HASHES = 3
SLOTS_PER_GRAM = 12
BLOCK = 1 << 18  # characters, or bytes, of texts handled at once
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter or mark."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        if unicodedata.category(char := chr(code))[0] in "LM":
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


@cache
def _is_letter() -> np.ndarray:
    """Whether a code point is a letter: a mark may join a word but does not make one."""
    return np.array([unicodedata.category(chr(code))[0] == "L" for code in range(0x110000)])


def has_letter(texts: Sequence[str | None]) -> list[bool]:
    return [bool(_is_letter()[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters; a longer text is a range of its own."""
    begin, load = 0, 0
    for i, t in enumerate(texts):
        load += len(t or "") + 2
        if load >= BLOCK:
            yield begin, i + 1
            begin, load = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All letter trigrams as 63-bit numbers, and the text each belongs to. Words are framed by spaces."""
    raw = np.frombuffer("  ".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") + 2 for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    row = np.concatenate([row, np.full(len(raw) - len(row), len(texts) - 1)])
    text = _letters()[raw]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != SPACE) | (text[:-1] != SPACE)
    text, row = text[keep].astype(np.uint64), row[keep]
    if len(text) < N:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = (text[:-2] << np.uint64(42)) | (text[1:-1] << np.uint64(21)) | text[2:]
    # a trigram with the frame in its middle joins two words or texts
    inner = text[1:-1] != SPACE
    return found[inner], row[1:-1][inner]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    slots: np.ndarray  # (words of the mask, slots)
    chance: np.ndarray  # false positives by language

    def lookup(self, found: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each n-gram, as (words, n-grams)."""
        mask = None
        for at in _places(found, self.slots.shape[1]):
            mask = self.slots[:, at] if mask is None else mask & self.slots[:, at]
        return mask

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for begin, end in blocks(texts):
            found, row = grams(texts[begin:end])
            total = np.bincount(row, minlength=end - begin)
            lettered = has_letter(texts[begin:end])
            share = np.zeros((len(self.languages), end - begin))
            if self.languages:
                mask = self.lookup(found)
                for i in range(len(self.languages)):
                    bit = (mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits = np.bincount(row, weights=bit.astype(np.float64), minlength=end - begin)
                    share[i] = (hits / np.maximum(total, 1) - self.chance[i]) / (1 - self.chance[i])
                best = share.argmax(axis=0)
            for i in range(end - begin):
                known = bool(self.languages) and lettered[i] and total[i] > 0
                names.append(self.languages[best[i]] if known else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, share[best[i], i]))) if known else 0.0)
        return names, scores


def _places(found: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """Slots of each n-gram: double hashing of a mixed 64-bit value; ``slots`` is a power of two."""
    x = found * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(33)) | np.uint64(1)
    for _ in range(HASHES):
        yield (x & np.uint64(slots - 1)).astype(np.int64)
        x = x + step


def build_model(kept: Sequence[tuple[str, int]]) -> Model:
    """The filter of (language, n-gram) pairs."""
    languages = tuple(sorted({lang for lang, _ in kept}))
    words = max(1, -(-len(languages) // 64))
    distinct = len({g for _, g in kept})
    size = 1 << max(10, int(np.ceil(np.log2(max(1, distinct) * SLOTS_PER_GRAM))))
    slots = np.zeros((words, size), np.uint64)
    chance = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        own = np.array([g for name, g in kept if name == lang], np.int64).astype(np.uint64)
        word, bit = slots[i // 64], np.uint64(1) << np.uint64(i % 64)
        for at in _places(own, size):
            word[at] |= bit
        chance[i] = (np.count_nonzero(word & bit) / size) ** HASHES
    return Model(languages, slots, chance)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with a text and a language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            langs, texts = [langs[i] for i in order], batch.column("text").take(pa.array(order, pa.int64()))
            code = np.unique(langs, return_inverse=True)[1] if langs else np.empty(0, np.int64)
            for begin, end in byte_blocks(texts, BLOCK) if langs else ():
                found, row = grams(texts.slice(begin, end - begin).to_pylist())
                own = code[begin:end][row]
                for c in np.unique(own):
                    values, counts = np.unique(found[own == c], return_counts=True)
                    name = langs[int(np.searchsorted(code, c))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)),
                        pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counts = stage(
        rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "langid-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    frequent = frequent.where(F.col("share") >= LEAST_SHARE)
    top = frequent.groupBy("gram").agg(F.max("share").alias("top"))
    kept = frequent.join(top, "gram").where(F.col("share") >= RIVAL * F.col("top")).select("lang", "gram").collect()
    return build_model([tuple(r) for r in kept])


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predictions(model: Model, texts: pa.Array) -> pa.Array:
    """Struct (lang, score) of each text; texts become Python's a block at a time."""
    names: list[str] = []
    scores: list[float] = []
    for begin, end in byte_blocks(texts, BLOCK) if len(texts) else ():
        lang, score = model.predict(texts.slice(begin, end - begin).to_pylist())
        names += lang
        scores += score
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])


def language(text: Column, model: Model, session) -> Column:
    """Struct (lang, score) for a text column; a filter on it does not predict a second time."""
    shared = session.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return predictions(shared.value, texts)

    # else Spark copies the call into the filter: two predictions and two Python workers a task
    return F.arrow_udf(run, PREDICTION).asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    found = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        language(F.col(text_col), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
