"""Benchmark decontamination with spaced seeds.

A mask such as 11101011 reads the tokens at its 1s and ignores those at its 0s, so a seed still hits when an
ignored token was substituted.  Seeds of benchmark items and of documents are joined by hash; around each hit the
two token sequences are laid over each other and the best overlap (+1 for an equal token, -2 for another one) is
verified.  Tokens are runs of letters, digits and multi-byte characters, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.llm.text import keyed, mix, over_batches, raw, token_streams, tokens
from gridreach.session import cut, small_side

#: Token positions read (1) and ignored (0).
MASKS = ("11101011", "110110111", "1110010111", "11011001011")
#: Items below LONG tokens have masks of their own: every overlap that `enough` accepts with window 13 and share 80 has a seed of
#: one.  Items of 1 to 4 tokens have no tolerance and are looked for as a whole.
SHORT = {
    5: ("1111", "11011"),
    6: ("11111", "111011", "110111"),
    7: ("111011", "110111"),
    8: ("1111011", "1101111"),
    9: ("11101011", "111111"),
    10: ("11011011", "110101011", "1101001011"),
    11: ("110101011", "1101001011", "1111101"),
    12: ("11101011", "101100111"),
    13: ("111001011", "1111011"),
    14: ("111001011", "11001000111", "11101011"),
    15: ("11001010011", "111010011", "11010001011", "11101101"),
}
LONG = 16
#: Benchmark seeds held by a task at once; more are worked off in further blocks.
BLOCK_SEEDS = 1 << 21
#: Equal seeds expanded at a time.
HITS = 1 << 20

_U = np.uint64


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked tokens at each position where the mask fits."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            h *= _U(0xD6E8FEB86659FD93)
            h += t[j : j + n]
    return mix(h)


def masks_for(n: int) -> Sequence[str]:
    return MASKS if n >= LONG else SHORT.get(n, ("1" * n,) if n else ())


def best_overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal tokens) of the stretch of two aligned sequences with the highest +1 / -2 score; of several the last to end, as long as can be."""
    same = a == b
    run = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(run)
    gain = run - low
    end = int(np.flatnonzero(gain == gain.max())[-1])
    start = int(np.argmax(run == low[end]))
    return start, end - start, int(same[start:end].sum())


def enough(equal: int, item_tokens: int, window: int, share: int) -> bool:
    return 100 * equal >= share * min(window, item_tokens)


class _Index:
    """Seeds of one block of items, sorted by hash, behind a bitmap."""

    def __init__(self, items: Sequence[tuple[int, int | None, bytes]]):
        self.ids = [i for _, i, _ in items]
        self.tokens = [np.frombuffer(t, np.uint64) for *_, t in items]
        self.masks = sorted({m for t in self.tokens for m in masks_for(len(t))}, key=lambda m: (len(m), m))
        h, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(self.tokens):
            for m in masks_for(len(t)):
                s = seeds(t, m)
                h.append(s)
                item.append(np.full(len(s), i))
                at.append(np.arange(len(s)))
        h, item, at = np.concatenate(h), np.concatenate(item), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        self.bits = max(16, int(4 * len(h)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash & _U((1 << self.bits) - 1)] = True

    def diagonals(self, t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, item, shift of the row against the item) that share a seed, and how many; `bounds` are the rows' ends in the token stream t.

        Equal seeds are expanded HITS at a time, so a repetitive text against a repetitive item holds no more than that and its diagonals.
        """
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, 3), np.int64), np.zeros(0, np.int64))]
        for m in self.masks:
            s = seeds(t, m)
            p = np.flatnonzero(self.seen[s & _U((1 << self.bits) - 1)])
            row = np.searchsorted(bounds, p, "right") - 1
            whole = p + len(m) <= bounds[row + 1]
            p, row = p[whole], row[whole]
            lo, hi = np.searchsorted(self.hash, s[p]), np.searchsorted(self.hash, s[p], "right")
            p, row, lo, hi = (x[hi > lo] for x in (p, row, lo, hi))
            block = np.cumsum(hi - lo) // HITS
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(block)) + 1) if len(p) else ():
                n = (hi - lo)[part]
                g = np.repeat(hi[part] - np.cumsum(n), n) + np.arange(n.sum())
                r, at = np.repeat(row[part], n), np.repeat(p[part] - bounds[row[part]], n)
                parts.append(np.unique(np.stack([r, self.item[g], at - self.at[g]], 1), axis=0, return_counts=True))
                if len(parts) > 16:
                    parts = [_added(parts)]
        return _added(parts)

    def overlaps(self, t: np.ndarray, bounds: np.ndarray, window: int, share: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(row, item) -> (equal tokens, overlap length, first token in the row, hits) of the best verified overlap."""
        lines, count = self.diagonals(t, bounds)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for (r, i, shift), n in zip(lines.tolist(), count.tolist(), strict=True):
            item, text = self.tokens[i], t[bounds[r] : bounds[r + 1]]
            a, z = max(0, -shift), min(len(item), len(text) - shift)
            start, length, equal = best_overlap(item[a:z], text[a + shift : z + shift])
            if enough(equal, len(item), window, share):
                now, was = (equal, length, a + shift + start, n), best.get((r, i))
                if was is None or (-now[0], now[2]) < (-was[0], was[2]):
                    best[r, i] = now
        return best


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lines of all parts with their counts added up."""
    lines, at = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
    return lines, np.bincount(at.ravel(), np.concatenate([p[1] for p in parts]), len(lines)).astype(np.int64)


def overlaps(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 80, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, n_equal, n_tokens, first_token, n_hits.

    An overlap counts when its equal tokens reach `share` per cent of min(window, tokens of the item).  Items are worked off
    in blocks of a bounded number of seeds, each against all documents.  Null and empty texts have no token and never overlap;
    items of fewer than LONG tokens lose no overlap (at the given window and share), longer ones those without a seed of MASKS;
    items of 1 to 4 tokens count where they stand verbatim; items with equal texts are both named; a null id is carried along;
    repeated rows give repeated results; extra columns are ignored; empty tables give an empty result.
    """

    def tokenise(batch: pa.RecordBatch) -> pa.RecordBatch:
        ts = [tokens(t) for t in raw(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(map(len, ts), pa.int64()), pa.array([t.tobytes() for t in ts], pa.binary())], ["item_id", "n", "tokens"])

    test = cut(over_batches(items.select(F.col("item_id").cast("long"), "text"), tokenise, "item_id long, n long, tokens binary").where(F.col("n") > 0))
    total = test.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total * max(map(len, (MASKS, *SHORT.values()))) // block_seeds)
    schema = "doc_id long, item_id long, n_equal long, n_tokens long, first_token long, n_hits long"
    out = docs.sparkSession.range(0).select(*[F.lit(None).cast("long").alias(c.split()[0]) for c in schema.split(", ")])  # no Python rows, which would take workers of their own
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == k
        block = [(r["n"], r["item_id"], bytes(r["tokens"])) for r in test.where(mine).collect()]  # bounded by block_seeds
        if block:
            out = out.unionByName(keyed(docs, "doc_id", "text").mapInArrow(_scan(block, window, share), schema))
    return out


def _scan(block: list, window: int, share: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or _Index(block)
            ids, rows = batch.column("doc_id"), []
            for first, t, bounds in token_streams(raw(batch, "text")):
                rows += [(ids[first + r].as_py(), index.ids[i], *x) for (r, i), x in sorted(index.overlaps(t, bounds, window, share).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_equal", "n_tokens", "first_token", "n_hits"])

    return scan


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 80) -> DataFrame:
    """The documents without any overlap, all columns kept, whatever their names.

    Rows with a null id are never dropped, all rows of an id go if one of them overlaps; an empty table gives an empty result.
    """
    hit = small_side(overlaps(docs, items, window, share).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
