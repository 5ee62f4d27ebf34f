"""Variable-capacity best-fit packing of documents into training sequences.

Pieces of the same length are interchangeable, so the plan is made on the histogram of lengths (at most one row for
each length up to the largest capacity, whatever the corpus): the longest piece left opens a bin, each permitted
capacity is filled best-fit with the longest pieces that still fit, the capacity with the least cost for each token
is opened, and the bin is repeated for as long as the histogram can feed it.  Last, each bin is downsized to the
smallest capacity that holds its contents.  Documents then find their bin by their rank among pieces of their length;
ranks are spread over tasks, so a length that a third of all documents share is no hot spot.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.operators.ordered import prefix_sums
from gridreach.session import cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin beyond its tokens, in tokens.
OVERHEAD = 64


@dataclass(frozen=True)
class Bins:
    """`times` bins of the same contents: (length, uses) from the longest on."""

    first: int
    times: int
    capacity: int
    contents: tuple[tuple[int, int], ...]


def _fill(lengths: Sequence[int], counts: Mapping[int, int], capacity: int) -> list[tuple[int, int]]:
    """Best-fit contents of one bin: again and again the longest piece that still fits."""
    room, top, out = capacity, len(lengths), []
    while top and (top := bisect_right(lengths, room, 0, top)):
        n = lengths[top - 1]
        uses = min(counts[n], room // n)
        out.append((n, uses))
        room -= n * uses
        top -= 1
    return out


def plan(histogram: Mapping[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> list[Bins]:
    """Bins for a histogram of lengths (each between 1 and the largest capacity)."""
    sizes = sorted(set(capacities))
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, out, first = sorted(counts), [], 0
    while lengths:
        tried = []
        for c in sizes[bisect_left(sizes, lengths[-1]) :]:
            contents = _fill(lengths, counts, c)
            tried.append(((c + overhead) / sum(n * u for n, u in contents), c, contents))
        _, capacity, contents = min(tried)
        times = min(counts[n] // u for n, u in contents)
        capacity = sizes[bisect_left(sizes, sum(n * u for n, u in contents))]
        out.append(Bins(first, times, capacity, tuple(contents)))
        first += times
        for n, u in contents:
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
                lengths.pop(bisect_left(lengths, n))
    return out


def _places(bins: Sequence[Bins]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, uses, first bin, capacity, offset of the first use), by rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    for b in bins:
        at = 0
        for n, u in b.contents:
            rows.setdefault(n, []).append((used.get(n, 0), u, b.first, b.capacity, at))
            used[n] = used.get(n, 0) + u * b.times
            at += n * u
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, capacity, bin_offset for rows (doc_id, n_tokens).

    A document longer than the largest capacity is cut into pieces of that size and a rest.  Null, zero or negative lengths
    have nothing to pack and give one row with piece 0, n_tokens 0 and no bin.  Repeated rows and null ids are packed as
    often as they come; ties are ranked by id; extra columns are ignored; an empty table gives an empty result.
    """
    most = max(capacities)
    d = lengths.select(F.col("doc_id").cast("long"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    piece = d.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / most) - 1, F.lit(0)).cast("long"))).alias("piece"))
    piece = piece.select("doc_id", "piece", F.least(F.lit(most).cast("long"), F.col("_n") - F.col("piece") * most).alias("n_tokens"), F.lit(1).cast("long").alias("_one"))
    piece = cut(piece)
    ranked = prefix_sums(piece, ["n_tokens"], ["doc_id", "piece"], {"rank": "_one"})
    hist = {r["n_tokens"]: r["count"] for r in piece.groupBy("n_tokens").count().collect() if r["n_tokens"]}  # at most one row a length
    places = _places(plan(hist, capacities, overhead))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            rank = batch.column("rank_cum").to_numpy() - 1
            out = np.full((3, len(n)), -1, np.int64)
            order = np.argsort(n, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else ():
                if (size := int(n[group[0]])) == 0:
                    continue
                rows = places[size]
                r = rank[group]
                start, uses, first, capacity, at = rows[np.searchsorted(rows[:, 0], r, "right") - 1].T
                out[:, group] = first + (r - start) // uses, capacity, at + (r - start) % uses * size
            cols = [pa.array(c, pa.int64(), mask=c < 0) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("n_tokens"), *cols], ["doc_id", "piece", "n_tokens", "bin_id", "capacity", "bin_offset"])

    return ranked.select("doc_id", "piece", "n_tokens", "rank_cum").mapInArrow(place, "doc_id long, piece long, n_tokens long, bin_id long, capacity long, bin_offset long")


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): white-space words of the whole text and one end mark; null counts as empty."""
    return docs.select("doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"))
