"""Random permutations of a column over neighbouring cells, without a row for each (cell, permutation).

Cells are numbered 0, 1, ... and cut into blocks of BLOCK numbers.  A permutation
is a keyed shuffle of the numbers that any task can compute forwards and
backwards, so a block sends each other block just its values, in an order that
both sides know.  A block receives its own cells and those up to its farthest
neighbours, and adds up its part of the statistic for all permutations.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.operators import ordered as o
from gridreach.session import cut, shuffle_width

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Numbers in a block; rounds of the keyed shuffle.
BLOCK, ROUNDS = 2048, 6


def shuffled(at: np.ndarray, n: int, perm: int, seed: int, back: bool = False) -> np.ndarray:
    """Images of the numbers `at` under a permutation of 0 .. n-1; `back` gives the originals.

    A Feistel network with random tables: number = left * b + right, each round moves one half by a random
    function of the other.  Images beyond n-1 go through again.
    """
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    rng = np.random.default_rng([seed, perm])
    tables = [rng.integers(0, a, b) if i % 2 == 0 else rng.integers(0, b, a) for i in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            step = -tables[i] if back else tables[i]
            if i % 2 == 0:
                left = (left + step[right]) % a
            else:
                right = (right + step[left]) % b
        return left * b + right

    out = once(at)
    beyond = np.flatnonzero(out >= n)
    while beyond.size:
        out[beyond] = once(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out


def neighbour_products(values: DataFrame, adj: DataFrame, value: str, perms: int, seed: int) -> DataFrame:
    """(perm, num): sum over cells of their value times the mean of their neighbours' values, both less the overall mean, for each permutation.

    values has (grid_id, value) without nulls, adj (src, dst).
    """
    spark = values.sparkSession
    home = cut(o.row_index(values.select("grid_id", F.col(value).cast("double").alias("v")), ["grid_id"], name="k").select("grid_id", "k", "v"))
    seen = home.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("v") == F.rint("v")).alias("whole")).first()
    n, mean = seen["n"], seen["mean"]
    if not n:
        return spark.createDataFrame([], "perm int, num double")
    fits = [t for t in (np.int8, np.int16, np.int32) if seen["whole"] and np.iinfo(t).min <= seen["lo"] and seen["hi"] <= np.iinfo(t).max]
    kind = np.dtype(fits[0] if fits else np.float64)  # values travel in the narrowest type that holds them all
    ends = adj.join(home.select(F.col("grid_id").alias("src"), F.col("k").alias("a")), "src").join(home.select(F.col("grid_id").alias("dst"), F.col("k").alias("b")), "dst")
    ends = cut(ends.select(F.floor(F.col("a") / BLOCK).alias("block"), "a", "b"))
    first = np.arange(0, n, BLOCK)
    last = np.minimum(first + BLOCK, n) - 1
    for r in ends.groupBy("block").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).collect():  # one row for each BLOCK cells
        first[r["block"]], last[r["block"]] = min(first[r["block"]], r["lo"]), max(last[r["block"]], r["hi"])
    first, last = np.minimum.accumulate(first[::-1])[::-1], np.maximum.accumulate(last)  # blocks that need a number are neighbours

    def send(t: pa.Table) -> pa.Table:
        k, v = t["k"].to_numpy(), t["v"].to_numpy().astype(kind)
        by = np.argsort(k)
        k, v = k[by], v[by]
        to = np.concatenate([shuffled(k, n, p, seed) for p in range(1, perms + 1)])
        low = np.searchsorted(last, to)
        copies = np.searchsorted(first, to, "right") - low
        each = np.repeat(np.arange(to.size), copies)
        block = low[each] + np.arange(each.size) - np.repeat(np.cumsum(copies) - copies, copies)
        order = np.argsort((block * perms + each // k.size) * n + to[each])
        goes, block = v[each[order] % k.size], block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        starts = np.concatenate([[0], cuts])
        return pa.table({
            "block": pa.array(block[starts], pa.int64()), "sender": pa.array(np.full(starts.size, k[0] // BLOCK), pa.int64()),
            "sent": pa.array([part.tobytes() for part in np.split(goes, cuts)], pa.binary()),
        })

    def receive(sent: pa.Table, near: pa.Table) -> pa.Table:
        if not (sent.num_rows and near.num_rows):
            return pa.table({"perm": pa.array([], pa.int32()), "num": pa.array([], pa.float64())})
        mine = sent["block"][0].as_py()
        at = np.arange(first[mine], last[mine] + 1)
        source = np.concatenate([shuffled(at, n, p, seed, back=True) for p in range(1, perms + 1)]) // BLOCK
        order = np.argsort((source * perms + np.repeat(np.arange(perms), at.size)) * n + np.tile(at, perms))
        senders = np.argsort(sent["sender"].to_numpy())
        z = np.empty(order.size)
        z[order] = np.concatenate([np.frombuffer(sent["sent"][int(i)].as_py(), kind) for i in senders])
        z = z.reshape(perms, at.size) - mean
        a, b = near["a"].to_numpy() - at[0], near["b"].to_numpy() - at[0]
        weight = 1.0 / np.bincount(a, minlength=at.size)[a]
        num = [float(np.dot(row[a] * row[b], weight)) for row in z]
        return pa.table({"perm": pa.array(np.arange(1, perms + 1), pa.int32()), "num": pa.array(num, pa.float64())})

    # so many parts, as the tables are small for the work they make and would be merged into a few tasks
    width = min(first.size, shuffle_width(spark))
    blocks = home.select(F.floor(F.col("k") / BLOCK).alias("home"), "k", "v").repartition(width, "home")
    sent = blocks.groupBy("home").applyInArrow(send, "block long, sender long, sent binary").repartition(width, "block")
    parts = sent.groupBy("block").cogroup(ends.repartition(width, "block").groupBy("block")).applyInArrow(receive, "perm int, num double")
    return parts.groupBy("perm").agg(F.sum("num").alias("num"))
