"""Shortest paths inside one block of a street graph or in the blocks around it, for all sources or pairs at once.

Spark deals blocks to tasks (`graph.reach`, `graph.route_report`); here each block's states are a flat array
(row, node) that is relaxed along the edges until no state gets better.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: States held at once; more sources or pairs are taken in turn.
STATES = 1 << 22
#: Rows handed back at once.
ROWS = 1 << 18


def _values(table: pa.Table, col: str) -> np.ndarray:
    return table[col].to_numpy()


class _Streets:
    """Edges of a block sorted by their start, nodes numbered 0, 1, ... in the order of `names`."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, *more: np.ndarray):
        self.names, ids = np.unique(np.concatenate([src, dst, *more]), return_inverse=True)
        self.n = len(self.names)
        src, self.dst = ids[: len(src)], ids[len(src) : len(src) + len(dst)]
        self.order = np.argsort(src, kind="stable")
        self.src, self.dst = src[self.order], self.dst[self.order]
        self.first = np.searchsorted(self.src, np.arange(self.n + 1))
        self.more, at = [], len(src) + len(dst)
        for m in more:
            self.more.append(ids[at : at + len(m)])
            at += len(m)

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `nodes`, edge) for every edge that leaves one of the nodes."""
        n_out = self.first[nodes + 1] - self.first[nodes]
        each = np.repeat(np.arange(len(nodes)), n_out)
        return each, self.first[nodes][each] + np.arange(len(each)) - np.repeat(np.cumsum(n_out) - n_out, n_out)


def _once(at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One position for each distinct value of `at`; `mark` has a place for every value, whatever it holds."""
    each = np.arange(len(at), dtype=mark.dtype)
    mark[at] = each
    return np.flatnonzero(mark[at] == each)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def packed(edges: pa.Table, entries: pa.Table) -> pa.Table:
    """One row (block, edges, entries, n) for a block: its edges (home, goes, src, dst, w) by start and the nodes that edges of other blocks lead to, compressed, and the number of its edges."""
    home = (edges if edges.num_rows else entries)["home"][:1].cast(pa.int64())
    row = {"block": home, "edges": pa.array([_pack(edges.sort_by("src"))], pa.binary()), "entries": pa.array([_pack(entries.select(["node"]))], pa.binary())}
    return pa.table(row | {"n": pa.array([edges.num_rows], pa.int64())})


def packed_ends(ends: pa.Table) -> pa.Table:
    """One row (block, ends) for a block: its rows (node, ...) at which states are wanted, compressed."""
    return pa.table({"block": ends["block"][:1], "ends": pa.array([_pack(ends.drop_columns(["block"]))], pa.binary())})


def _unpacked(column: pa.ChunkedArray | pa.Array) -> list[pa.Table]:
    return [pa.ipc.open_stream(x.as_buffer()).read_all() for x in column if x.is_valid]


def task(sources: pa.Table, streets: pa.Table) -> pa.Table:
    """One row (block, sources, edges, ends) with the sources (source, node, block, ...) of one search and all edges and ends around them, compressed."""
    if not sources.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("sources", "edges", "ends")}})
    row = {"block": sources["block"][:1], "sources": pa.array([_pack(sources.select(["source", "node"]))], pa.binary())}
    for c in ("edges", "ends"):
        parts = _unpacked(streets[c])
        whole = pa.concat_tables(parts) if parts else None
        if whole is not None and c == "edges":
            whole = whole.select(["src", "dst", "w"])
        row[c] = pa.array([None if whole is None else _pack(whole)], pa.binary())
    return pa.table(row)


def _least(g: _Streets, w: np.ndarray, row: np.ndarray, v: np.ndarray, t: np.ndarray, rows: int, cutoff: float) -> np.ndarray:
    """Least values within `cutoff` of a flat array (row, node), from states (row, v, t) along the streets."""
    best = np.full(rows * g.n, np.inf)
    mark = np.empty(len(best), np.int64)
    while len(v):
        to = row * g.n + v
        np.minimum.at(best, to, t)
        pick = _once(to, mark)
        row, v, t = row[pick], v[pick], best[to[pick]]
        each, edge = g.out(v)
        row, v, t = row[each], g.dst[edge], t[each] + w[edge]
        ok = (t <= cutoff) & (t < best[row * g.n + v])
        row, v, t = row[ok], v[ok], t[ok]
    return best


def search(tasks: Iterator[pa.RecordBatch], cutoff: float, out: pa.Schema, at_ends: bool) -> Iterator[pa.RecordBatch]:
    """(source, node, t) of all nodes within `cutoff` of the sources of rows of `task`, with `at_ends` once for each end at a node, with its columns."""
    for batch in tasks:
        for i in range(batch.num_rows):
            sources, edges, ends = (_unpacked(batch.column(c).slice(i, 1)) for c in ("sources", "edges", "ends"))
            if not at_ends or ends:
                yield from _searched(sources[0], edges[0] if edges else None, ends[0] if at_ends else None, cutoff, out)


def _searched(sources: pa.Table, edges: pa.Table | None, ends: pa.Table | None, cutoff: float, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    names, at = _values(sources, "source"), _values(sources, "node")
    src, dst, w = (at[:0], at[:0], np.zeros(0)) if edges is None else (_values(edges, c) for c in ("src", "dst", "w"))
    g = _Streets(src, dst, at)
    at, w = g.more[0], w[g.order]
    if ends is not None:
        place = np.minimum(np.searchsorted(g.names, _values(ends, "node")), g.n - 1)
        here = np.flatnonzero(g.names[place] == _values(ends, "node"))
        here = here[np.argsort(place[here], kind="stable")]
        first = np.searchsorted(place[here], np.arange(g.n + 1))
    step = max(1, STATES // g.n)
    for lo in range(0, len(at), step):
        n = min(step, len(at) - lo)
        best = _least(g, w, np.arange(n), at[lo : lo + n], np.zeros(n), n, cutoff)
        known = np.flatnonzero(best < np.inf)
        s, v = np.divmod(known, g.n)
        t, more = best[known], []
        if ends is not None:
            n_ends = first[v + 1] - first[v]
            each = np.repeat(np.arange(len(v)), n_ends)
            row = pa.array(here[first[v][each] + np.arange(len(each)) - np.repeat(np.cumsum(n_ends) - n_ends, n_ends)])
            s, v, t = s[each], v[each], t[each]
            more = [ends[c].take(row) for c in out.names[3:]]
        found = pa.table([pa.array(names[lo + s], out.types[0]), pa.array(g.names[v], out.types[1]), pa.array(t), *more], schema=out)
        yield from found.to_batches(max_chunksize=ROWS)


def spread(arrived: pa.Table, streets: pa.Table, cutoff: float) -> pa.Table:
    """States within `cutoff` that arrivals (source, node, t) reach inside their block, whose streets are one row of `packed`.

    Gives (source, node, block, t, kind): kind 0 a state, 1 a state at a node that edges from other blocks lead to,
    2 a state that another block has to go on from.
    """
    if not arrived.num_rows or not streets.num_rows:
        return arrived.select(["source", "node", "block", "t"]).append_column("kind", pa.array(np.zeros(arrived.num_rows, np.int32)))
    edges, entries = (pa.ipc.open_stream(streets[c][0].as_buffer()).read_all() for c in ("edges", "entries"))
    inside = _values(edges, "home") == _values(edges, "goes")
    src, dst, w = _values(edges, "src"), _values(edges, "dst"), _values(edges, "w")
    at_node = _values(arrived, "node")
    g = _Streets(src[inside], dst[inside], at_node, src[~inside], _values(entries, "node"))
    node_at, leaves, entered = g.more
    w_in = w[inside][g.order]
    entry = np.zeros(g.n, bool)
    entry[node_at] = entry[entered] = True
    # the crossing edges, sorted by start
    turn = np.argsort(leaves, kind="stable")
    cross = np.searchsorted(leaves[turn], np.arange(g.n + 1))
    out_dst, out_w, out_home = dst[~inside][turn], w[~inside][turn], _values(edges, "goes")[~inside][turn]
    sources, source_at = np.unique(_values(arrived, "source"), return_inverse=True)
    t_at = _values(arrived, "t")
    home = _values(arrived, "block")[0]
    ids = arrived.schema.field("source").type, arrived.schema.field("node").type
    pieces = []
    step = max(1, STATES // g.n)
    for lo in range(0, len(sources), step):
        mine = np.flatnonzero((source_at >= lo) & (source_at < lo + step))
        best = _least(g, w_in, source_at[mine] - lo, node_at[mine], t_at[mine], min(step, len(sources) - lo), cutoff)
        known = np.flatnonzero(best < np.inf)
        s, v = np.divmod(known, g.n)
        pieces.append(pa.record_batch({
            "source": pa.array(sources[lo + s], ids[0]), "node": pa.array(g.names[v], ids[1]), "block": pa.array(np.full(len(v), home), pa.int64()),
            "t": pa.array(best[known]), "kind": pa.array(entry[v].astype(np.int32)),
        }))
        n_out = cross[v + 1] - cross[v]
        each = np.repeat(np.arange(len(v)), n_out)
        edge = cross[v][each] + np.arange(len(each)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        t = best[known][each] + out_w[edge]
        ok = t <= cutoff
        each, edge, t = each[ok], edge[ok], t[ok]
        pieces.append(pa.record_batch({
            "source": pa.array(sources[lo + s[each]], ids[0]), "node": pa.array(out_dst[edge], ids[1]), "block": pa.array(out_home[edge], pa.int64()),
            "t": pa.array(t), "kind": pa.array(np.full(len(t), 2, np.int32)),
        }))
    return pa.Table.from_batches(pieces)


def routes(pairs: pa.Table, edges: pa.Table, floor: float) -> pa.Table:
    """(pair_id, cost, hops) of the cheapest route, fewest hops on a tie, of each pair whose cost stays within its `r`.

    pairs has (pair_id, source, target, tx, ty, r), edges (src, dst, w, dx, dy) with the place of dst; `floor` is the least cost of
    a metre of straight line.
    """
    g = _Streets(_values(edges, "src"), _values(edges, "dst"), _values(pairs, "source"), _values(pairs, "target"))
    source, target = g.more
    w, x, y = (_values(edges, c)[g.order] for c in ("w", "dx", "dy"))
    tx, ty, r = (_values(pairs, c) for c in ("tx", "ty", "r"))
    costs, hops = np.full(len(source), np.inf), np.zeros(len(source), np.int32)
    step = max(1, STATES // g.n)
    for lo in range(0, len(source), step):
        mine = np.arange(lo, min(lo + step, len(source)))
        best, steps = np.full(len(mine) * g.n, np.inf), np.zeros(len(mine) * g.n, np.int32)
        mark = np.empty(len(best), np.int64)
        row, v = np.arange(len(mine)), target[mine]
        goal, v = row * g.n + v, source[mine]
        c, h = np.zeros(len(mine)), np.ones(len(mine), np.int32)
        while len(v):
            to = row * g.n + v
            np.minimum.at(best, to, c)
            least = c == best[to]
            row, v, to, c, h = row[least], v[least], to[least], c[least], h[least]
            steps[to] = np.iinfo(np.int32).max
            np.minimum.at(steps, to, h)
            pick = _once(to, mark)
            row, v, c, h = row[pick], v[pick], c[pick], steps[to[pick]]
            each, edge = g.out(v)
            row, v, c, h = row[each], g.dst[edge], c[each] + w[edge], h[each] + np.int32(1)
            line = np.sqrt((x[edge] - tx[mine[row]]) ** 2 + (y[edge] - ty[mine[row]]) ** 2)
            to = row * g.n + v
            # a hair of slack keeps equal-cost routes in spite of rounding
            ok = c + line * floor <= np.minimum(best[goal], r[mine])[row] * (1 + 1e-12)
            ok &= (c < best[to]) | ((c == best[to]) & (h < steps[to]))
            row, v, c, h = row[ok], v[ok], c[ok], h[ok]
        costs[mine], hops[mine] = best[goal], steps[goal]
    met = np.flatnonzero((costs < np.inf) & (costs <= r))
    return pa.table({"pair_id": pairs["pair_id"].take(pa.array(met)), "cost": pa.array(costs[met]), "hops": pa.array(hops[met], pa.int32())})
