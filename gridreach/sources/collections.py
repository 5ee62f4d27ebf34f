"""Features of a FeatureCollection file of any size, read by many tasks.

The text is read in byte ranges that Spark deals out itself, as pieces that end at a closing brace.  Whether a piece lies inside a
string, and how deep, depends on all that stands before it; so a first scan finds for each range how it changes both, for either
start, two running sums over the ranges of a file give each range's start, and a second scan cuts the features out.  A feature that
reaches over a border is put together from its fragments.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridreach.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(r'\\.|["{\[\]]', re.S)
#: Brackets open around a feature: the collection and its list.
AROUND = 2


def _turns(piece: str) -> tuple[int, int, int]:
    """(quotes mod 2, depth change if the piece begins outside a string, and if inside); its closing brace counts."""
    inside, change = 0, [0, 0]
    for m in TOKEN.finditer(piece):
        c = m[0]
        if c == '"':
            inside ^= 1
        elif len(c) == 1:
            change[inside] += -1 if c == "]" else 1
    change[inside] -= 1
    return inside, change[0], change[1]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a byte range: whether it flips being inside a string, and its depth change for either start."""
    names, now, rows = ["file", "start", "flips", "outside", "inside"], None, []
    for batch in batches:
        for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
            if now is None or now[:2] != [file, start]:
                now = [file, start, 0, 0, 0]
                rows.append(now)
            flip, a, b = _turns(value)
            if now[2]:
                a, b = b, a
            now[2] ^= flip
            now[3] += a
            now[4] += b
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)], names)


class _Cutter:
    """Cuts features out of one byte range's pieces, from a known start."""

    def __init__(self, inside: int, depth: int) -> None:
        self.inside, self.depth = inside, depth
        self.open = self.continued = depth > AROUND  # inside a feature that began before this range
        self.held: list[str] = []

    def take(self, piece: str) -> Iterator[tuple[bool, bool, str]]:
        """(begins here, ends here, text) of the features that the piece ends."""
        begin = 0
        for m in TOKEN.finditer(piece):
            c = m[0]
            if c == '"':
                self.inside ^= 1
            elif len(c) == 1 and not self.inside:
                if c == "{" and self.depth == AROUND and not self.open:
                    self.open, begin = True, m.start()
                self.depth += -1 if c == "]" else 1
        if self.open:
            self.held.append(piece[begin:] + "}")
        if not self.inside:
            self.depth -= 1
            if self.open and self.depth == AROUND:
                yield not self.continued, True, "".join(self.held)
                self.held, self.open, self.continued = [], False, False

    def rest(self) -> Iterator[tuple[bool, bool, str]]:
        if self.open and self.held:
            yield not self.continued, False, "".join(self.held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, begins, ends, text): features, and fragments of those that reach over a range's border."""
    now, cutter = None, None

    def row(found: list[tuple[bool, bool, str]]) -> pa.RecordBatch:
        a, z, t = zip(*found, strict=True)
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(a), pa.array(z), pa.array(t, pa.string())], ["file", "start", "begins", "ends", "text"])

    for batch in batches:
        found: list[tuple[bool, bool, str]] = []
        for value, file, start, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start", "in_string", "depth")), strict=True):
            if now != (file, start):
                if cutter is not None:
                    found += cutter.rest()
                if found:
                    yield row(found)
                now, cutter, found = (file, start), _Cutter(inside, depth), []
            found += cutter.take(value)
        if found:
            yield row(found)
    if cutter is not None and (left := list(cutter.rest())):
        yield row(left)


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON text of every object in the list of a collection: (text).

    Files of several collections are read one by one.  Braces inside strings, nested objects and any white space are fine.
    """
    pieces = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ranges = cut(pieces.mapInArrow(_summaries, "file string, start long, flips long, outside long, inside long"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = ranges.withColumn("in_string", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    state = state.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    known = F.broadcast(cut(state.select("file", "start", "in_string", "depth")))  # one row a byte range; order of pieces stays
    parts = pieces.join(known, ["file", "start"]).select("value", "file", "start", "in_string", "depth").mapInArrow(_cut_out, "file string, start long, begins boolean, ends boolean, text string")
    parts = cut(parts)
    whole = parts.where("begins and ends").select("text")
    edge = parts.where("not (begins and ends)")
    runs = Window.partitionBy("file").orderBy("start", F.col("begins").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    torn = edge.withColumn("run", F.sum(F.col("begins").cast("int")).over(runs))  # two fragments a byte range at most
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.col("begins").cast("int").alias("b"), "text"))), lambda x: x.text), "")
    return whole.unionByName(torn.groupBy("file", "run").agg(text.alias("text")).select("text"))
