import random
import re
from collections import Counter

from gridreach.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, least, top=10):
    """rows: (lang, source, text); the contract's rows by plain counting."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n = Counter(), {}
    for g, s, t in rows:
        found = TERM.findall(lowered(t))
        docs.update({(g, w) for w in found})
        n.setdefault((g, s), Counter()).update(found)
    out = []
    for g in {r[0] for r in rows}:
        kept = [w for (x, w), c in docs.items() if x == g and c >= least]
        v, sources = len(kept), sorted(s for x, s in n if x == g)

        def share(c, v=v, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * v) for w in kept}

        p, q = {s: share(n[g, s]) for s in sources}, share(sum((n[g, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][w], p[r][w]) for w in kept), r) for r in sources if r != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if n[g, s][w] and p[s][w] > q[w]]
            for part, items, limit in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(g, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 0) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")


def test_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK", 3)
    monkeypatch.setattr(dv, "TILE", 40)
    monkeypatch.setattr(dv, "HELD", 30)
    monkeypatch.setattr(dv, "KNOWN", 4)
    monkeypatch.setattr(dv, "LOT", 50)
    rng = random.Random(4)
    vocab = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "ABCD", "É", "é", "straße", "日本語", "x" * 40, "x" * 41, "zeta", "omega"]
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(8)}", " ".join(rng.choices(vocab, weights=[1 + (i % 5) ** 2 for i in range(16)], k=rng.randrange(9)))) for _ in range(150)]
    rows += [("fr", "only", "mot rare"), ("es", "p", "una"), ("es", "q", None), ("en", "empty", ""), ("en", None, "omega zeta1zeta"), (None, None, "zeta")]
    for bits in (1 << 23, 64):  # a bitmap full of collisions gives the same rows
        monkeypatch.setattr(dv, "BITS", bits)
        got = [tuple(r) for r in dv.audit(frame(spark, rows), least=4).collect()]
        assert sorted(got) == sorted(brute(rows, 4))


def test_odd_rows(spark):
    rows = [("a", "s", "same Words here")] * 6 + [("a", "t", "same")] * 5 + [("a", "t", "w " * 300_000), ("a", "t", "y" * 100_000)]
    got = [tuple(r) for r in dv.audit(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows, 10))
    assert dv.audit(frame(spark, rows[:0])).collect() == []


def test_large_counts_stay_exact():
    import numpy as np

    n, total = np.array([3, 10**15, 7 * 10**14]), np.array([7, 10**15, 9 * 10**14 + 1])
    assert dv._scaled(n, total).tolist() == [10**9 * int(a) // int(b) for a, b in zip(n, total)]
