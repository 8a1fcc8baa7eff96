"""Language identification with a bit-sliced Bloom filter over byte n-grams.

Each language's frequent n-grams enter one Bloom filter; its slots hold one bit per language,
so reading an n-gram's slots and AND-ing them gives every language that contains it. A
document's n-grams are looked up, bits are counted per language, the counts are freed of the
filter's expected false positives, and the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an n-gram, slots of the filter (a power of two), hash functions.
NGRAM, SLOTS, HASHES = 4, 1 << 20, 3

#: An n-gram enters a language's filter if it is at least this share of the language's n-grams;
#: so a language has at most 1 / MIN_SHARE of them, however large the corpus.
MIN_SHARE = 1 / 50_000

_letter = regex.compile(r"\p{L}").search

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _grams(data: bytes) -> np.ndarray:
    """The packed byte n-grams of lower-cased text between blanks."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    if len(b) < NGRAM:
        b = np.concatenate([b, np.full(NGRAM - len(b), 32, np.uint8)])
    packed = np.zeros(len(b) - NGRAM + 1, np.uint32)
    for k in range(NGRAM):
        packed = packed << np.uint32(8) | b[k : len(b) - NGRAM + 1 + k]
    return packed


def _slots(grams: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[k]) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) per batch."""
    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            total = pd.Series(dtype=np.int64)
            for part in _portions(texts):
                counted = pd.Series(_grams(part)).value_counts(sort=False)
                total = counted if total.empty else total.add(counted, fill_value=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total), pa.string()), pa.array(total.index.to_numpy(), pa.int64()), pa.array(total.to_numpy(), pa.int64())],
                names=["lang", "gram", "n"],
            )


def _portions(texts: list[str], chars: int = 1 << 22) -> Iterator[bytes]:
    """Lower-cased texts joined by blanks, some millions of characters at a time."""
    held, size = [], 0
    for t in texts:
        for at in range(0, max(1, len(t)), chars):
            part = t[at : at + chars].lower()
            held.append(part)
            size += len(part)
            if size >= chars:
                yield " ".join(held).encode()
                held, size = [], 0
    if held:
        yield " ".join(held).encode()


class LanguageFilter:
    """The bit-sliced filter: per slot one bit per language (in words of 64)."""

    def __init__(self, languages: list[str], slots: np.ndarray, language: np.ndarray):
        self.languages = languages
        self.planes = [np.zeros(SLOTS, np.uint64) for _ in range((len(languages) + 63) // 64)]
        for i in range(len(languages)):
            plane = self.planes[i // 64]
            plane[slots[language == i]] |= np.uint64(1 << i % 64)
        fill = [np.count_nonzero(self.planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def votes(self, grams: np.ndarray) -> np.ndarray:
        """Per language the number of n-grams found, less the expected false ones."""
        where = [_slots(grams, k) for k in range(HASHES)]
        found = np.zeros(len(self.languages))
        for p, plane in enumerate(self.planes):
            mask = plane[where[0]]
            for w in where[1:]:
                mask = mask & plane[w]
            here = self.languages[64 * p : 64 * p + 64]
            if len(here) <= 8:
                found[64 * p : 64 * p + len(here)] = np.bincount(mask.astype(np.uint8), minlength=256) @ _BITS[:, : len(here)]
            else:
                for i in range(len(here)):
                    found[64 * p + i] = np.count_nonzero(mask & np.uint64(1 << i))
        # those missed, freed of the false ones that hide others: whole counts stay whole where nothing was missed
        return np.maximum(len(grams) - (len(grams) - found) / (1 - self.false_rate), 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of the text's n-grams that it contains."""
        if text is None or not _letter(text) or not self.languages:
            return "und", 0.0
        total, n = np.zeros(len(self.languages)), 0
        for part in _portions([text]):
            grams = _grams(part)
            total += self.votes(grams)
            n += len(grams)
        best = int(np.argmax(total))  # ties: the first in the alphabet
        return self.languages[best], float(min(1.0, total[best] / n))


_BITS = np.array([[v >> i & 1 for i in range(8)] for v in range(256)], np.float64)


def train(docs: DataFrame) -> LanguageFilter:
    """Learn from rows with a language and a text; counts cover all of them.

    Only the chosen n-grams come to the driver: at most 1 / MIN_SHARE per language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    chosen = counts.join(sums, "lang").where(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram").toPandas()
    languages = sorted(chosen["lang"].unique())
    grams, codes = chosen["gram"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), chosen["lang"].to_numpy(object)) if languages else np.zeros(0, np.int64)
    slots = np.concatenate([_slots(grams, k) for k in range(HASHES)])
    return LanguageFilter(languages, slots, np.tile(codes, HASHES))


def predict(docs: DataFrame, languages: LanguageFilter, **columns: Column) -> DataFrame:
    """doc_id, the given columns, lang_pred and score per document.

    A null text, or one without a letter, is `und` with score 0; a text whose n-grams no
    language knows gets the first language with score 0. The filter is broadcast; its size is
    SLOTS words per 64 languages. Other columns, lang and source among them, are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(languages)
    names = ["doc_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(t.as_py()) for t in b.column("text")]
            arrays = [b.column(c) for c in names] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(k) for k, c in columns.items()], F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The third of the documents that is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
