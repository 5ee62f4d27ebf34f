"""Source divergence audit: terms found by iceberg refinement of byte prefixes, then exact distances of sources.

Kept terms are those in at least `least` documents of their language.  They are found level by level: prefixes of LEVELS[0] bytes whose
distinct-document count falls below the threshold go, the others are extended to the next length, until only complete terms
remain (a term ends with END, so a complete one is a prefix too).  No extension is in more documents than its prefix, so
nothing is lost.  What survives a level reaches the next scan as a bitmap of fixed size, hashed by (language, prefix): a
collision lets a prefix be counted in vain, and its own exact count then drops it.  Scans count per task and send
(language, prefix, documents) sums, at most HELD at a time.

Distances of two sources run over all kept terms.  Counts of a language are dealt to tiles of (block of sources, block of sources, share of
terms); terms that a tile's sources lack all have the same distance and are added by their number.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.llm.text import raw
from gridreach.session import cut

#: Bytes of letters: A-Z lower-cased, a-z and every byte of a multi-byte character; the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
END = b"\0"
GAP = END + b" "
#: First prefix length in bytes and what each level multiplies it by; bits of the survivors' bitmap.
FIRST, GROWTH, BITS = 8, 4, 1 << 23
#: Sums (or distinct terms) a scan task holds, verdicts it remembers of a language, occurrences it adds up at a time.
HELD, KNOWN, LOT = 1 << 18, 1 << 16, 1 << 21
#: Sources of one side of a tile, counts of one tile (on average).
BLOCK, TILE = 64, 1 << 16
SCALE = 1_000_000_000


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a text in order, END behind each; bare ENDs, which stand for gaps, are among them."""
    return ((text or b"").translate(FOLD) + b" ").replace(b" ", GAP).split()


class Alive:
    """Whether the bitmap holds a prefix of a language; verdicts are remembered up to a bound."""

    def __init__(self, bits: bytes, lang: str) -> None:
        self.bits, self.seed, self.known = bits, zlib.crc32(lang.encode() + END), {END: False}

    def among(self, prefixes: set[bytes]) -> set[bytes]:
        known = self.known
        fresh = prefixes.difference(known)
        if len(known) + len(fresh) > KNOWN:
            self.known = known = {END: False}
            fresh = prefixes - {END}
        for p in fresh:
            at = zlib.crc32(p, self.seed) % BITS
            known[p] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return {p for p in prefixes if known[p]}


def _texts(docs: DataFrame) -> DataFrame:
    """lang, source, text without nulls."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def bitmap(survivors: DataFrame) -> bytes:
    """BITS bits, one set at the hash of every (lang, prefix); built as 64-bit words on the executors."""
    at = survivors.select(F.pmod(F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(END), "prefix")), F.lit(BITS)).alias("at"))
    words = at.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    got = words.toArrow()  # BITS / 64 rows at most, whatever survives
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64).astype("<u8").tobytes()


def _level(texts: DataFrame, size: int, before: int, alive: bytes | None) -> DataFrame:
    """(lang, prefix, n) sums of documents that hold a term with the prefix; prefixes have `size` bytes, shorter ones end with END."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter[bytes]] = defaultdict(Counter)
        filters: dict[str, Alive] = {}
        n = 0

        def out() -> pa.RecordBatch:
            langs = [x for x, c in sums.items() for _ in range(len(c))]
            prefixes = [p for c in sums.values() for p in c]
            counts = [n for c in sums.values() for n in c.values()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(prefixes, pa.binary()), pa.array(counts, pa.int64())], ["lang", "prefix", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), raw(batch, "text"), strict=True):
                held = set(terms(text))
                held.discard(END)
                if alive is not None:
                    held = {t for t in held if len(t) > before}
                    heads = filters.setdefault(lang, Alive(alive, lang)).among({t[:before] for t in held})
                    held = {t for t in held if t[:before] in heads}
                had = len(sums[lang])
                sums[lang].update({t[:size] for t in held})
                n += len(sums[lang]) - had
                if n >= HELD:
                    yield out()
                    n = 0
        if sums:
            yield out()

    return texts.select("lang", "text").mapInArrow(scan, "lang string, prefix binary, n long")


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term, n_docs) of the terms that at least `least` documents of their language hold."""
    texts, size, before, alive, done = _texts(docs), FIRST, 0, None, []
    while True:
        counted = _level(texts, size, before, alive).groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        counted = cut(counted.withColumn("whole", F.substring("prefix", -1, 1) == F.lit(END)))
        done.append(counted.where("whole"))
        open_ = counted.where("not whole")
        if open_.isEmpty():
            break
        size, before, alive = size * GROWTH, size, bitmap(open_)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("lang", F.expr("decode(substring(prefix, 1, length(prefix) - 1), 'UTF-8')").alias("term"), F.col("n").alias("n_docs"))


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) occurrences of kept terms, without zeros.

    A task numbers its terms, adds occurrences up as (term, group) numbers and sends one row a term with its groups' counts.
    Groups travel as 64-bit hashes of (lang, source), with a seed that keeps all groups apart.
    """
    texts = _texts(docs)
    named = cut(texts.select("lang", "source").distinct())
    seed, n = 0, named.count()
    group = lambda: F.xxhash64("lang", "source", F.lit(seed))
    while named.select(group().alias("g")).distinct().count() < n:
        seed += 1
    alive = bitmap(kept.select("lang", F.concat(F.col("term").cast("binary"), F.lit(END)).alias("prefix")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[str, Alive] = {}
        ids: dict[str, dict[bytes, int]] = {}
        names: list[tuple[str, bytes]] = []
        groups: dict[int, int] = {}
        parts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(parts), return_counts=True)
            term, g = code // len(groups), np.array(list(groups), np.int64)[code % len(groups)]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate((first, [len(term)])).astype(np.int32))
            rows = [names[i] for i in term[first].tolist()]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][:-1].decode() for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (g, times.astype(np.int64))]], ["lang", "term", "g", "n"])

        pending: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            parts.extend(t * len(groups) + groups[g] for g, t in pending)  # the number of groups is known now
            batch = out()
            parts.clear()
            pending.clear()
            groups.clear()
            return batch

        for batch in batches:
            for lang, g, text in zip(batch.column("lang").to_pylist(), batch.column("g").to_pylist(), raw(batch, "text"), strict=True):
                found = terms(text)
                mine = ids.setdefault(lang, {END: -1})
                fresh = set(found).difference(mine)
                good = filters.setdefault(lang, Alive(alive, lang)).among(fresh)
                for t in fresh:
                    mine[t] = len(names) if t in good else -1
                    if t in good:
                        names.append((lang, t))
                at = np.fromiter(map(mine.__getitem__, found), np.int64, len(found))
                groups.setdefault(g, len(groups))
                pending.append((g, at[at >= 0]))
                held += len(pending[-1][1])
                if held >= LOT or sum(map(len, ids.values())) > HELD or len(pending) >= HELD:
                    yield flush()
                    held = 0
                    if sum(map(len, ids.values())) > HELD:
                        ids.clear()
                        names.clear()
        if pending:
            yield flush()

    rows = texts.select("lang", group().alias("g"), "text").mapInArrow(scan, "lang string, term string, g array<long>, n array<long>")
    each = rows.select("lang", "term", F.inline(F.arrays_zip("g", "n")))
    counted = each.groupBy("lang", "g", "term").agg(F.sum("n").alias("n")).join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    return counted.join(named.select("source", group().alias("g")), "g").select("lang", "source", "term", "n")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)) in exact whole numbers."""
    up = (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + 2 * v).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(SCALE * n / total), n <= total < 9e15, in 64 bits, three digits at a time."""
    out, rest = np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64), n
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out


def _pairs(counts: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions."""
    seat = Window.partitionBy("lang").orderBy("source")
    seated = cut(groups.join(sizes, "lang").withColumn("seat", F.row_number().over(seat) - 1))  # sources of a language, whose pairs are all returned
    blocks = F.floor((F.max("seat").over(Window.partitionBy("lang"))) / BLOCK)
    seated = seated.withColumn("last", blocks).withColumn("block", F.floor(F.col("seat") / BLOCK))
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), "last"))
    dealt = seated.select("lang", "source", "seat", "total", "v", "shares", "block", tiles.alias("other"))
    dealt = dealt.select("lang", "source", "seat", "total", "v", "shares", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = counts.join(dealt, ["lang", "source"]).select("lang", "i", "j", F.pmod(F.xxhash64("term"), "shares").alias("share"), "seat", "term", "n", "total", "v")
    empty = dealt.select("lang", "i", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "seat", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "v")

    def tile(group: pa.Table) -> pa.Table:
        i, j, v = (group.column(c)[0].as_py() for c in ("i", "j", "v"))
        seat, n, total = (group.column(c).to_numpy() for c in ("seat", "n", "total"))
        seats, col = np.unique(seat, return_inverse=True)
        totals = np.zeros(len(seats), np.int64)
        totals[col] = total
        code = group.column("term").combine_chunks().dictionary_encode()
        real = ~np.asarray(code.is_null())
        at = code.indices.fill_null(0).to_numpy()
        width = len(code.dictionary)
        a, b = np.flatnonzero(seats // BLOCK == i), np.flatnonzero(seats // BLOCK == j)
        value = np.zeros((len(seats), len(seats)), np.int64)
        both = totals + 2 * v
        zero = 1 + _scaled(np.full(len(seats), 2), np.maximum(both, 1))
        for first in range(0, width, 1024):
            inside = real & (at >= first) & (at < first + 1024)
            c = np.zeros((min(1024, width - first), len(seats)), np.int64)
            c[at[inside] - first, col[inside]] = n[inside]
            p = 1 + _scaled(c + 2, both)
            for s in a:
                q = p[:, b]
                d = p[:, s, None] - q
                value[s, b] += (d * d // (p[:, s, None] + q)).sum(0)
        s, t = np.meshgrid(a, b, indexing="ij")
        ok = seats[s] < seats[t]
        s, t = s[ok], t[ok]
        d = zero[s] - zero[t]
        rest = d * d // (zero[s] + zero[t])
        lang = pa.array([group.column("lang")[0].as_py()] * len(s), pa.string())
        return pa.table({"lang": lang, "x": seats[s].astype(np.int64), "y": seats[t].astype(np.int64), "value": value[s, t], "seen": np.full(len(s), width, np.int64), "rest": rest})

    parts = rows.unionByName(empty).groupBy("lang", "i", "j", "share").applyInArrow(tile, "lang string, x long, y long, value long, seen long, rest long")
    found = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))
    side = lambda c, name: seated.select("lang", F.col("seat").cast("long").alias(c), F.col("source").alias(name), "v")
    named = found.join(side("x", "a"), ["lang", "x"]).join(side("y", "b").drop("v"), ["lang", "y"])
    value = F.when(F.col("v") == 0, 0).otherwise(F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest"))
    ends = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return named.select("lang", value.alias("value"), ends).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: distances of a source to the others of its language, and the terms it prefers.

    Part `pair` has every other source of the language with the summed distance over all kept terms, part `term` the `top` terms that
    the source uses more than its language does.  Null text, lang and source count as empty strings.  Every row is one document,
    repeated ids and rows included; a null id is a document too.  Ties are broken by the item's bytes.  A language without kept terms has
    pairs of value 0 and no term; a source alone in its language has no pair.  Very long texts and terms cost one more scan for each
    GROWTH-fold of the longest kept term.  Extra columns are ignored, an empty table gives an empty result.
    """
    kept = cut(kept_terms(docs, least))
    counts = cut(term_counts(docs, kept))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("rows"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(_texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"]))
    per_lang = cut(groups.select("lang").distinct().join(sizes, "lang", "left").join(langs, "lang", "left").fillna(0, ["v", "all", "rows"]))
    shared = per_lang.select("lang", "v", (F.floor(F.col("rows") / TILE) + 1).alias("shares"))
    pairs = _pairs(counts, groups, shared).withColumn("part", F.lit("pair"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    seen = counts.join(whole, ["lang", "term"]).join(groups, ["lang", "source"]).join(per_lang, "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_lang"), F.col("all"), F.col("v"))
    liked = seen.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = liked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def audit_sql() -> str:
    """The same for DuckDB, without prefixes: all terms counted at once."""
    share_ = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    dist = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total,
             (SELECT count(*) FROM k WHERE k.lang = s.lang) AS v FROM (SELECT DISTINCT lang, source FROM d) s),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share_("coalesce(c.n, 0)", "g.total")} AS p
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
t AS (SELECT f.lang, f.source, f.term AS item, f.p, {share_("l.n", "l.total")} AS q FROM f JOIN l USING (lang, term) JOIN (SELECT DISTINCT lang, v FROM g) USING (lang) WHERE f.n > 0),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, {dist} FROM t WHERE p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
"""
