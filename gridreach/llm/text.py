"""Byte-level text helpers for Arrow batches: words, 64-bit hashes, shingle sets, sums by group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of white space: x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a multi-byte character; the rest separates tokens.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray = _powers(int(_BASE), 1 << 12)
_DOWN: np.ndarray = _powers(pow(int(_BASE), -1, 1 << 64), 1 << 12)


def _need(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(int(_BASE), size), _powers(pow(int(_BASE), -1, 1 << 64), size)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs where `inside` holds."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def _segment_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _need(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _UP[: len(b)], out=run[1:])
    return mix((run[ends] - run[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def hash_runs(b: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """One 64-bit hash per run of `inside`, in order; memory beyond the text is bounded by a segment or the longest run."""
    starts, ends = spans(inside)
    if len(b) <= _SEGMENT:
        return _segment_hashes(b, starts, ends)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        a, z = int(starts[i]), int(ends[j - 1])
        out.append(_segment_hashes(b[a:z], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def as_bytes(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)


def words(text: bytes | None) -> np.ndarray:
    """Hash of each white-space word, A-Z lower-cased."""
    b = LOWER[as_bytes(text)]
    return hash_runs(b, ~SPACE[b])


def tokens(text: bytes | None) -> np.ndarray:
    """Hash of each run of letters, digits and multi-byte characters, A-Z lower-cased."""
    b = LOWER[as_bytes(text)]
    return hash_runs(b, WORDLIKE[b])


def token_streams(texts: Iterable[bytes | None], size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, token bounds of each row) of runs of texts of about `size` bytes: short texts share array operations."""
    first, rows, held = 0, [], 0

    def stream() -> tuple[int, np.ndarray, np.ndarray]:
        b = LOWER[as_bytes(b" ".join(rows))]
        inside = WORDLIKE[b]
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in rows])))
        return first, hash_runs(b, inside), np.searchsorted(spans(inside)[0], begin)

    for t in texts:
        rows.append(t or b"")
        held += len(rows[-1])
        if held >= size:
            yield stream()
            first, rows, held = first + len(rows), [], 0
    if rows:
        yield stream()


def windows(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word window; a shorter text is one window, an empty one none."""
    if len(w) == 0:
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + w[j : j + n]
    return mix(h)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct k-word window hashes of a text."""
    return np.unique(windows(words(text), k))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a per-batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def raw(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes, a few rows at a time."""
    texts = batch.column(column)
    for i in range(0, len(texts), 64):
        yield from texts.slice(i, 64).cast(pa.binary()).to_pylist()


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (extra ones, whatever their names, go), with the id as long."""
    return docs.select(*[F.col(c).cast("long") if c == "doc_id" else F.col(c) for c in columns])
