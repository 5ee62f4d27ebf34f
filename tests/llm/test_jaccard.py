import random

import numpy as np
import pytest

from gridreach.llm import jaccard as j
from gridreach.llm.text import shingle_set


def brute(rows, k, threshold):
    """{(id, text): component} by comparing every pair."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= threshold * len(sets[a] | sets[b]):
                comp[top(a)] = top(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    return sorted(((r[0], len(s), min((x for x in groups[top(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, n_words, copies, edits, start):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: len(w) - rng.randrange(max(1, len(w) // 8))]
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "threshold"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, threshold):
    rng = random.Random(k)
    rows = [(9000, None), (9001, ""), (9002, "  \n "), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "one"), (None, "lonely text without an id at all"), (9006, "Einß größer"), (9006, "Einß größer")]
    rows += [r for f in range(14) for r in family(rng, 6 + 14 * f, 9, 1 + f // 2, 100 * f)]
    rows += [(8000, "long " * 20_000 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 AS key", "'x' AS sig")
    got = sorted((tuple(r) for r in j.join_components(df, k, threshold).collect()), key=str)
    assert got == brute(rows, k, threshold)


def test_members_that_link_with_each_other_but_not_with_the_first(spark):
    """Chains: neighbours link, ends do not; copies of a common half never link."""
    base = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 9 : 300 + i * 9])) for i in range(11)]
    rows += [(100 + i, " ".join(base[:150] + [f"own{i}_{x}" for x in range(100)])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in j.join_components(df, 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("threshold", [80, 90])
def test_linked_sets_share_a_signature_and_the_bound_holds(threshold):
    rng = random.Random(threshold)
    for n in [1, 2, 3, 4, 5, 9, 10, 17, 18, 27, 40, 90, 200, 700, 3000]:
        for _ in range(25):
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(a)
            while True:  # change elements as long as they link
                c = set(b)
                c.discard(rng.choice(sorted(c)))
                if rng.random() < 0.5:
                    c.add(rng.getrandbits(64))
                if not c or 100 * len(a & c) < threshold * len(a | c):
                    break
                b = c
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert set(j.signatures(x, threshold)[1].tolist()) & set(j.signatures(y, threshold)[1].tolist())
            bound = j.overlap_bound(len(a), j.parity(x), len(b), j.parity(y))
            assert len(a & b) <= bound


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert j.join_components(empty).count() == 0
    assert j.keep_one(empty).count() == 0
    t = "a b c d e f g h i j"
    rows = [(3, t, "x"), (1, t, "y"), (1, t, "y"), (2, "", "z"), (4, None, "z"), (5, "other words here", "q"), (None, "no id", "q")]
    kept = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=str) == sorted([(1, "y"), (2, "z"), (4, "z"), (5, "q"), (None, "q")], key=str)
    assert kept.columns == ["doc_id", "text", "lang"]


def test_words_are_split_at_ascii_white_space_only():
    assert len(shingle_set("a b c d".encode(), 1)) == 2
    assert (shingle_set(b"AbC dE", 2) == shingle_set(b"abc\x0bde", 2)).all()
    assert (shingle_set("Ä b".encode(), 2) != shingle_set("ä b".encode(), 2)).all()
    long = b"w" * (1 << 21) + b" " + b"tail words " * 200_000
    assert len(shingle_set(long, 3)) == 3


def test_a_large_group_hands_on_few_pairs(spark, monkeypatch):
    """2,000 near copies of one text, many of them too far apart to link with each other: rows stay below a few for each member."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made = []
    seen = lambda name, f=None: monkeypatch.setattr(j, name, lambda *a, f=getattr(j, name), **b: made.append((name, d := j.cut(f(*a, **b)))) or d)
    for name in ("_over_bound", "_verified", "_to_best", "_across"):
        seen(name)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in j.join_components(df, 3, 90).collect()}
    for name, d in made:
        assert d.count() <= 4 * len(rows), name
    assert any(name == "_across" for name, _ in made)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for _, t in rows[:150]]
    for a in range(150):
        for b in range(a):
            both = len(sets[a] & sets[b])
            assert 100 * both < 90 * len(sets[a] | sets[b]) or comp[a] == comp[b]


def test_keep_one_decides_rows_without_id_by_their_group(spark):
    t = "a b c d e f g h i j k l m n"
    rows = [(None, t, "x"), (5, t, "y"), (None, "lone words that nobody else has", "p"), (None, "lone words that nobody else has", "q"), (None, "", "r"), (None, "", "s"), (None, None, "t"), (7, None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string").selectExpr("*", "1 AS _own", "2 AS _id")
    kept = j.keep_one(df)
    got = sorted((str(r.doc_id), str(r.text)[:4], r._gone) for r in kept.collect())
    assert kept.columns == df.columns and [g[0] for g in got].count("5") == 1
    assert sorted(g[2] for g in got if g[1] != "lone") == ["r", "s", "t", "u", "y"] and sum(g[1] == "lone" for g in got) == 1
