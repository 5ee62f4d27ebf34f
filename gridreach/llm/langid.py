"""Language identification with bit-sliced Bloom filters of character n-grams.

A slot of the filter is a bit mask over languages, so one look-up (the AND of a gram's slots) names every language
whose n-gram set holds the gram.  A text's hits are summed per language, corrected for the filter's false positives of
that language, and the language with the most explained n-grams wins.

A language's set holds the grams that make up at least 1 / `rarest` of its learned grams, so it has `rarest` members at
most and the filter's size does not depend on the corpus; the counts behind it cover every learned row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.llm.text import keyed, mix
from gridreach.session import cut

#: Characters of a gram; smallest share of a gram in its language is 1 / RAREST; hashes and slots (a power of two) of the filter.
GRAM, RAREST, HASHES, SLOTS = 3, 20_000, 4, 1 << 19
#: Languages in one word of a mask; more languages take more words.
WORD = 64
#: Grams counted by a task before it adds them up.
HELD = 1 << 21

_U = np.uint64
_SPACE = 32
_LETTERS: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code point of each letter or mark, the code of a space for everything else; and which are letters."""
    if "t" not in _LETTERS:
        t, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(ch := chr(c))[0]
            if kind in "LM":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
                letter[c] = kind == "L"
        _LETTERS["t"], _LETTERS["letter"] = t, letter
    return _LETTERS["t"], _LETTERS["letter"]


def grams(text: str | None) -> np.ndarray:
    """Every GRAM-character window of the letters and their marks, runs of anything else read as one space; each packed into 63 bits.

    A text without a letter has none, marks alone are not enough.
    """
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    lowered, letter = _letters()
    if not letter[code].any():
        return np.zeros(0, np.uint64)
    c = lowered[code]
    gap = c == _SPACE
    keep = ~(gap & np.concatenate(([True], gap[:-1])))
    c = c[keep]
    c = np.concatenate(([_SPACE], c, [_SPACE] if c[-1] != _SPACE else [])).astype(np.uint64)
    return c[:-2] | (c[1:-1] << _U(21)) | (c[2:] << _U(42))


def learned(folds: int = 4, fold: int = 2) -> Column:
    """Rows to learn from: outside the held-out fold; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != fold, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (text, lang): added up inside each task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                g = grams(text)
                held.setdefault(lang, []).append(g)
                size += len(g)
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots(g: np.ndarray) -> np.ndarray:
    """(HASHES, grams) slot numbers."""
    h = mix(g)
    step = mix(g ^ _U(0x6A09E667F3BCC909)) | _U(1)
    return ((h + step * np.arange(HASHES, dtype=np.uint64)[:, None]) & _U(SLOTS - 1)).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filter over languages: WORD of them in each word of a slot."""

    def __init__(self, langs: list[str], members: list[tuple[int, np.ndarray]]):
        self.langs = langs
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.tables = [np.zeros(SLOTS, kind) for _ in range(max(1, -(-len(langs) // WORD)))]
        for i, g in members:
            for s in slots(g):
                np.bitwise_or.at(self.tables[i // WORD], s, kind(1 << i % WORD))
        fill = np.array([((self.tables[i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(langs))])
        self.false = fill**HASHES

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        """Words of the bit mask of the languages whose set holds each gram."""
        s = slots(g)
        return [np.bitwise_and.reduce(t[s], 0) for t in self.tables]

    def shares(self, g: np.ndarray) -> np.ndarray:
        """Share of the grams that each language explains, less the false positives to expect."""
        hits = []
        for w, m in enumerate(self.masks(g)):
            distinct, times = np.unique(m, return_counts=True)
            bit = distinct.dtype.type
            hits += [times[(distinct >> bit(i)) & bit(1) == 1].sum() for i in range(min(WORD, len(self.langs) - w * WORD))]
        return np.clip((np.array(hits) / len(g) - self.false) / (1 - self.false), 0, 1)


def fit(docs: DataFrame, rarest: int = RAREST) -> Filter:
    """Filter of the languages of rows (text, lang); languages in the order of their grams, most first, then by name."""
    counts = cut(gram_counts(docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()  # one row a language
    langs = [r["lang"] for r in totals]
    members = []
    for i, r in enumerate(totals):  # at most `rarest` grams for each language
        g = counts.where((F.col("lang") == r["lang"]) & (F.col("n") * rarest >= r["total"])).select("gram").toPandas()["gram"]
        members.append((i, np.sort(g.to_numpy(np.int64)).view(np.uint64)))
    return Filter(langs, members)


def predict(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows outside the held-out fold with a language, applied to every row.

    score is the winner's corrected share of explained grams.  Ties go to the language with more learned grams.  A null text,
    one without a letter, or any text where no language was learned is `und` with score 0.  Repeated rows weigh and return as
    often as they come; extra columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, "doc_id", "text").withColumn("held_out", ~learned())
    model = fit(docs.where(learned()).select("text", "lang"), rarest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for text in b.column("text").to_pylist():
                g = grams(text)
                if not len(g) or not model.langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                s = model.shares(g)
                at = int(np.argmax(s))
                lang.append(model.langs[at])
                score.append(float(s[at]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
