"""N-gram Jaccard join: size-banded tiles, parity bitmaps, exact sorted-array intersection.

Sets of word shingles link when 100 * |A & B| >= threshold * |A | B|.  The join is exact (up to 64-bit hashes):

1. `fingerprints`: per document the set size, a 64-bit key of the set and a parity bitmap (bit = number of
   elements that hash to it, mod 2).  Equal sets share a key, so copies cost one node whatever their number.
2. Size bands.  Two linked sets, the smaller one in a band, differ in at most H elements, H fixed by the band.
   A set is cut into m > H parts by hash range; linked sets agree on a part, so each part's content hash is a
   signature.  A part holds about ten shingles, so a passage that many documents share does not pair them up.
   A set also signs for a lower band when a set of that band can still link with it.
3. Tiles.  Signatures travel as packed arrays to (band, hash slice) tiles of a bounded size.  Each batch of the
   scan first settles the signatures it holds twice, sending one member on, so a hot signature reaches its tile
   once per batch.  A tile returns the signatures with two or more different sets.
4. Candidates: each member of a signature against its first member, then, where that left a signature's members
   in several components, against its member with the most links.  Popcount of the xor of two parity bitmaps bounds the
   difference from below and so the overlap from above; pairs over the bound are intersected exactly from their whole texts.
5. Signatures still in several components meet in chunked tiles with wider bitmaps, four times finer, which all but decide a pair.
   Each tile hands on the likeliest pairs that would join its components, fewer than it has members however many pairs it
   looked at; these are intersected exactly.  Members for which a pair over the bound is left after that, near the threshold,
   meet once more with their sorted arrays.
6. Components of the verified links; component_id is the smallest doc_id.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.llm.text import keyed, mix, over_batches, raw, shingle_set
from gridreach.operators.graph import components
from gridreach.session import cut, shuffle_width, small_side

_U = np.uint64
#: First set size of each band: whole numbers, then steps of a half.
BANDS = [1, 2, 3]
while BANDS[-1] < 1 << 40:
    BANDS.append(math.ceil(BANDS[-1] * 1.5))
_BANDS = np.array(BANDS)
#: Signatures held by a scan task before it sends them on; members and shingles of one chunk, two of which meet in a tile.
FLUSH, CHUNK, WEIGHT = 1 << 18, 512, 1 << 20


def parts_of(band: int, threshold: int) -> tuple[int, int]:
    """(parts, empty parts a set may have without signing them) of a band."""
    top = BANDS[band + 1] - 1
    differ = top * (100 - threshold) // threshold
    spare = 0
    for _ in range(4 if differ >= 4 else 0):
        m = differ + 1 + spare
        spare = min(differ, math.ceil(2 * m * math.exp(-BANDS[band] / m)))
    return differ + 1 + spare, spare


def bands_of(n: int, threshold: int) -> list[int]:
    """The bands a set of n shingles signs for: its own, and lower ones with sets that can link with it."""
    own = int(np.searchsorted(_BANDS, n, "right")) - 1
    out = [own]
    while out[-1] and n * threshold <= (BANDS[out[-1]] - 1) * 100:
        out.append(out[-1] - 1)
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set; 0 only for the empty one."""
    if not len(s):
        return 0
    k = mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64) + _U(len(s)))[0]
    return int(k.view(np.int64)) or 1


def parity(s: np.ndarray, each: int = 2) -> bytes:
    """Parity bitmap with about `each` bits an element (64 to 65,536 bits)."""
    bits = min(1 << 16, max(64, 1 << (max(1, each * len(s)) - 1).bit_length()))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(na: int, pa_: bytes, nb: int, pb: bytes) -> int:
    """No overlap of the two sets can be larger: (sizes - odd bits) / 2."""
    a, b = np.frombuffer(pa_, np.uint8), np.frombuffer(pb, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return min(na, nb, (na + nb - int(np.bitwise_count(a ^ b).sum())) // 2)


def linked(overlap: int, na: int, nb: int, threshold: int) -> bool:
    return 100 * overlap >= threshold * (na + nb - overlap)


def signatures(s: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(band, signature) arrays of a sorted set."""
    bands, sigs = [], []
    for band in bands_of(len(s), threshold) if len(s) else ():
        m, spare = parts_of(band, threshold)
        part = ((s >> _U(32)) * _U(m)) >> _U(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        label = part[starts] + _U(band << 48)
        body = np.add.reduceat(mix(s ^ _U(0x2545F4914F6CDD1D)), starts)
        sig = mix(body + mix(label))
        if m - len(starts) > spare:
            void = np.setdiff1d(np.arange(m, dtype=np.uint64), part[starts]) + _U(band << 48)
            sig = np.concatenate((sig, mix(mix(void) ^ _U(0x1D8E4E27C47D124F))))
        bands.append(np.full(len(sig), band, np.int64))
        sigs.append(sig)
    return (np.concatenate(bands), np.concatenate(sigs)) if bands else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key, parity of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(s), set_key(s), parity(s)) for s in (shingle_set(t, k) for t in raw(batch, "text"))]
        n, key, bits = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "key", "parity"])

    return over_batches(keyed(docs, "doc_id", "text"), one, "doc_id long, n_shingles long, key long, parity binary")


def _by_first(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, key) sorted by both, and the first key of each one's signature."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[fresh], key[fresh]
    start = np.ones(len(sig), bool)
    start[1:] = sig[1:] != sig[:-1]
    return sig, key, key[np.flatnonzero(start)][np.cumsum(start) - 1] if len(sig) else key


def _tile_plan(prints: DataFrame, threshold: int) -> np.ndarray:
    """First tile number of each band and, last, their count; tiles are sized by the number of signatures."""
    bounds = F.array(*[F.lit(b) for b in BANDS])
    per_band = prints.where("n_shingles > 0").groupBy(F.size(F.filter(bounds, lambda b: b <= F.col("n_shingles"))).alias("b")).agg(F.countDistinct("key").alias("n")).collect()
    load = np.zeros(len(BANDS), np.int64)
    for r in per_band:  # at most one row a band
        for band in (r["b"] - 1, max(0, r["b"] - 2)):
            load[band] += r["n"] * parts_of(band, threshold)[0]
    size = int(np.clip(load.sum() // (4 * shuffle_width(prints.sparkSession)), 1 << 12, 1 << 18))
    return np.concatenate(([0], np.cumsum(np.maximum(1, -(-load // size)))))


def shared_signatures(docs: DataFrame, prints: DataFrame, k: int, threshold: int) -> DataFrame:
    """(sig, key, lead) of every signature that two or more different sets have: each member but the first, with the first.

    Where a batch settled a signature among its own members, `lead` is their first, which met the other batches' in the tile.
    """
    first = _tile_plan(prints, threshold)
    tiles = int(first[-1])
    per_band = np.diff(first)

    def pack(bands: list, sigs: list, keys: list, turn: int) -> pa.RecordBatch | None:
        if not sigs:
            return None
        band, sig = np.concatenate(bands), np.concatenate(sigs)
        key = np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
        tile = first[band] + ((sig >> _U(32)) % per_band[band].astype(np.uint64)).astype(np.int64)
        whole = (tile.astype(np.uint64) << _U(32)) | (sig & _U(0xFFFFFFFF))
        whole, key, lead = _by_first(whole, key)
        rows: dict[str, list] = {"tile": [], "sig": [], "key": [], "lead": []}
        settled = key != lead
        if settled.any():  # already shared signatures: spread over the tiles, not by signature
            rows["tile"].append(int(mix(np.array([key[0] + turn], np.int64).view(np.uint64))[0] % _U(tiles)))
            for name, values in (("sig", whole), ("key", key), ("lead", lead)):
                rows[name].append(values[settled].tobytes())
        whole, key = whole[~settled], key[~settled]
        t = (whole >> _U(32)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
        low = (whole & _U(0xFFFFFFFF)).astype(np.uint32)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            rows["tile"].append(int(t[a]))
            rows["sig"].append(low[a:z].tobytes())
            rows["key"].append(key[a:z].tobytes())
            rows["lead"].append(None)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == "tile" else pa.binary()) for c, v in rows.items()], list(rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, keys, held, turn = [], [], [], 0, 0
        for batch in batches:
            for text in raw(batch, "text"):
                s = shingle_set(text, k)
                b, g = signatures(s, threshold)
                if len(g):
                    bands.append(b)
                    sigs.append(g)
                    keys.append(set_key(s))
                    held += len(g)
                if held >= FLUSH:
                    yield pack(bands, sigs, keys, turn)
                    bands, sigs, keys, held, turn = [], [], [], 0, turn + 1
        if held:
            yield pack(bands, sigs, keys, turn)

    def settle(group: pa.Table) -> pa.Table:
        sig, key, lead = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        loose_s, loose_k = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s, x, first_ in zip(*(group.column(c).to_pylist() for c in ("sig", "key", "lead")), strict=True):
            if first_ is None:
                loose_s.append(np.frombuffer(s, np.uint32))
                loose_k.append(np.frombuffer(x, np.int64))
            else:
                for out, kind, values in ((sig, np.uint64, s), (key, np.int64, x), (lead, np.int64, first_)):
                    out.append(np.frombuffer(values, kind))
        s, x, f = _by_first(np.concatenate(loose_s), np.concatenate(loose_k))
        more = x != f
        sig.append((_U(group.column("tile")[0].as_py()) << _U(32)) | s[more].astype(np.uint64))
        key.append(x[more])
        lead.append(f[more])
        return pa.table({"sig": np.concatenate(sig).view(np.int64), "key": np.concatenate(key), "lead": np.concatenate(lead)})

    packed = keyed(docs, "text").mapInArrow(scan, "tile long, sig binary, key binary, lead binary")
    return packed.groupBy("tile").applyInArrow(settle, "sig long, key long, lead long")


def _over_bound(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of keys that the parity bitmaps do not refute."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        na, nb, p, q = (batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb"))
        keep = [linked(overlap_bound(*x), x[0], x[2], threshold) for x in zip(na, p, nb, q, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    return over_batches(pairs.join(side("a"), "a").join(side("b"), "b"), one, "a long, b long")


def _texts_of(keys: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(key, text) of the named sets."""
    wanted = small_side(sets.join(keys.distinct(), "key").select(F.col("doc_id").alias("_id"), "key"))  # else every text would be shuffled
    d = keyed(docs, "doc_id", "text")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:  # a repeated id may stand for another text
        keep = [set_key(shingle_set(t, k)) == x for t, x in zip(raw(batch, "text"), batch.column("key").to_pylist(), strict=True)]
        return batch.filter(pa.array(keep, pa.bool_()))

    texts = over_batches(d.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text"), own, "key long, text string")
    return texts.dropDuplicates(["key"])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs whose exact intersection reaches the threshold, as (src, dst)."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    texts = cut(_texts_of(ends, docs, sets, k))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, text: bytes) -> np.ndarray:
            if key not in seen:
                seen[key] = shingle_set(text, k)
                if len(seen) > 64:
                    seen.popitem(last=False)
            return seen[key]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), raw(batch, "ta"), raw(batch, "tb"), strict=True):
                x, y = of(a, ta), of(b, tb)
                keep.append(linked(overlap(x, y), len(x), len(y), threshold))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out.rename_columns(["src", "dst"])

    t = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(t("a"), "a").join(t("b"), "b").mapInArrow(check, "src long, dst long")


def _open_members(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(sig, key, comp) of signatures with three or more members that lie in several components; equal member sets count once.

    Of two members the pair was tested already.
    """
    label = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    pairs = shared.select("key", "lead").distinct().join(label("key"), "key", "left").join(label("lead"), "lead", "left")
    apart = pairs.where(F.coalesce("c_key", "key") != F.coalesce("c_lead", "lead")).select("key", "lead")
    unsettled = shared.join(apart, ["key", "lead"], "left_semi").select("sig").distinct()
    members = shared.join(unsettled, "sig", "left_semi").select("sig", F.explode(F.array("key", "lead")).alias("key")).distinct()
    at = cut(members.join(label("key"), "key", "left").select("sig", "key", F.coalesce("c_key", "key").alias("comp")))
    same = at.groupBy("sig").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key))").alias("h1"), F.expr("bit_xor(xxhash64(key, 1))").alias("h2"))
    once = same.where("n > 2").groupBy("h1", "h2", "n").agg(F.min("sig").alias("sig")).select("sig")
    return at.join(once, "sig", "left_semi")


def _to_best(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member outside the component of its signature's member with the most links, and that member."""
    degree = links.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    best = members.join(degree, "key", "left").groupBy("sig").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "key", "comp")).alias("best"))
    far = members.join(best, "sig").where(F.col("comp") != F.col("best.comp"))
    return far.select(F.greatest("key", "best.key").alias("a"), F.least("key", "best.key").alias("b")).distinct()


#: Bits an element of the wider bitmaps.
FINE = 8


def _made(texts: DataFrame, column: str, make) -> DataFrame:
    """(key, column) with make(set) of each text's set."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array([make(t) for t in raw(batch, "text")], pa.binary())], ["key", column])

    return over_batches(texts, one, f"key long, {column} binary")


def _across(members: DataFrame, sets: DataFrame, threshold: int, bodies: DataFrame | None = None, keys_only: bool = False) -> DataFrame:
    """Pairs (a, b) over the bound that would join all components of members of one signature that can join, the likeliest first.

    sets has key, n_shingles, parity.  With `bodies` (key, body: sorted arrays) only pairs that link count.  With `keys_only` (key): the members
    that are in any pair over the bound.  All pairs across components are looked at, except those that earlier ones joined.  Chunks of a
    signature, of CHUNK members, and with bodies of WEIGHT shingles, on average, meet two by two.
    """
    full = sets.select("key", "n_shingles", "parity") if bodies is None else sets.select("key", "n_shingles", "parity").join(bodies, "key")
    size = members.join(sets.select("key", "n_shingles"), "key").groupBy("sig").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("long") if bodies is None else F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("w") / WEIGHT)).cast("long")
    rows = members.join(size, "sig").withColumn("c", F.pmod(F.xxhash64("key"), chunks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rows = rows.select("sig", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "key", "comp").join(full, "key")
    exact = bodies is not None

    def tile(group: pa.Table) -> pa.Table:
        c, key, root, n = (group.column(x).to_numpy().copy() for x in ("c", "key", "comp", "n_shingles"))
        one_chunk = group.column("i")[0] == group.column("j")[0]
        bits = _same_width(group.column("parity").to_pylist())
        body = [np.frombuffer(x, np.uint64) for x in group.column("body").to_pylist()] if exact else []
        a, b, seen = [], [], np.zeros(len(key), bool)
        for q in range(1, len(key)):
            fits = (root[:q] != root[q]) & (100 * np.minimum(n[:q], n[q]) >= threshold * np.maximum(n[:q], n[q]))
            p = np.flatnonzero(fits if one_chunk else fits & (c[:q] != c[q]))
            odd = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(n[p], n[q]), (n[p] + n[q] - odd) // 2)
            over = 100 * most >= threshold * (n[p] + n[q] - most)
            p, most = p[over], most[over]
            if keys_only:
                seen[p], seen[q] = True, seen[q] or len(p) > 0
                continue
            p = p[np.lexsort((key[p], -most / (n[p] + n[q] - most)))]
            while len(p):
                x, p = p[0], p[1:]
                if exact and not linked(overlap(body[x], body[q]), len(body[x]), len(body[q]), threshold):
                    continue
                root[root == root[x]] = root[q]
                a.append(max(key[x], key[q]))
                b.append(min(key[x], key[q]))
                p = p[root[p] != root[q]]
        return pa.table({"key": key[seen]}) if keys_only else pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("sig", "i", "j").applyInArrow(tile, "key long" if keys_only else "a long, b long").distinct()


def _same_width(bitmaps: list[bytes]) -> np.ndarray:
    """Parity bitmaps as rows of one width: wider ones are folded, which keeps them parity bitmaps."""
    width = min(map(len, bitmaps))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), 0) for x in bitmaps])


def join_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: sets of k-word shingles that link at `threshold` per cent Jaccard similarity.

    Words are white-space words with A-Z lower-cased; a text of fewer than k words is one shingle.  Null and empty texts have
    no shingle, link with nothing and are their own component.  Rows that repeat an id and its text are returned
    as often as they come; an id with different texts keeps one row per text.  A null id never is a component's
    name unless the component has no other.  Extra columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, k))
    sets = cut(prints.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("parity").alias("parity")))
    shared = cut(shared_signatures(docs, prints, k, threshold))
    pairs = shared.select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct()
    tested = cut(_over_bound(pairs, sets, threshold))
    links = cut(_verified(tested, docs, sets, k, threshold))
    comp = cut(components(links))
    members = cut(_open_members(shared, comp))
    if not members.isEmpty():

        def also(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            """Links, components and open members with those of `pairs` that link."""
            every = cut(links.unionByName(_verified(pairs, docs, sets, k, threshold)))
            grown = cut(components(every))
            return every, grown, cut(_open_members(shared, grown))

        best = cut(_over_bound(_to_best(members, links).join(tested, ["a", "b"], "left_anti"), sets, threshold))
        if not best.isEmpty():
            links, comp, members = also(best)
        fine = _made(_texts_of(members.select("key"), docs, sets, k), "parity", lambda t: parity(shingle_set(t, k), FINE))
        fine = cut(sets.select("key", "n_shingles").join(fine, "key"))
        likely = cut(_across(members, fine, threshold).join(tested.unionByName(best), ["a", "b"], "left_anti"))
        if not likely.isEmpty():
            links, comp, members = also(likely)
        left = cut(_across(members, fine, threshold, keys_only=True))
        if not left.isEmpty():
            bodies = cut(_made(_texts_of(left, docs, sets, k), "body", lambda t: shingle_set(t, k).tobytes()))
            joined = _across(members.join(left, "key", "left_semi"), fine, threshold, bodies).select(F.col("a").alias("src"), F.col("b").alias("dst"))
            comp = cut(components(links.unionByName(joined)))
    named = sets.join(comp, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "key").alias("comp"))
    low = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_key = named.join(low, "comp").select("key", "component_id")
    out = prints.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates: the one with the smallest id.

    All columns stay, whatever their names.  A row that repeats a kept id goes.  A row without an id goes if its group has one with an id;
    of a group without any id one row stays.  Rows without a word link with nothing and stay.
    """
    far = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 60))  # behind every id: a text's stand-in for a missing one
    own = F.coalesce(F.col("doc_id").cast("long"), far)
    found = cut(join_components(docs.select(own.alias("doc_id"), "text"), k, threshold))
    gone = small_side(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    stay = docs.join(gone, own == gone["_gone"], "left_anti")
    named, bare = stay.where("doc_id is not null"), stay.where("doc_id is null")
    if not found.where(F.col("doc_id") < (1 << 62)).groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    if found.where(F.col("doc_id") >= (1 << 62)).isEmpty():
        return named
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return named.unionByName(bare.where(worded).dropDuplicates(["text"])).unionByName(bare.where(~worded))
