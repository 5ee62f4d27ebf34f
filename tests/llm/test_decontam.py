import itertools
import random
import re

import numpy as np

from gridreach.llm import decontam as d


def toks(t):
    return [x.lower() for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]


def brute(docs, items, window=13, share=80):
    """Every shift of every item over every document that has a seed in common."""
    out = set()
    for i, (doc, text) in enumerate(docs):
        t = toks(text)
        for item, body in items:
            q = toks(body)
            for shift in range(1 - len(q), len(t)):
                a, z = max(0, -shift), min(len(q), len(t) - shift)
                same = [q[x] == t[x + shift] for x in range(a, z)]
                masks = d.masks_for(len(q))
                if not any(all(same[p + x] for x, on in enumerate(m) if on == "1") for m in masks for p in range(len(same) - len(m) + 1)):
                    continue
                run = best = equal = most = 0
                for s in same:
                    run, equal = (run + 1, equal + 1) if s else (run - 2, equal)
                    if run < 0:
                        run = equal = 0
                    if run >= best:
                        best, most = run, equal
                if 100 * most >= share * min(window, len(q)):
                    out.add((i, doc, item))
    return sorted(((x, y) for _, x, y in out), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([5, 7, 9, 14, 30, 60])))) for k in range(25)]
    items += [(100, items[8][1]), (101, None), (102, ""), (103, "too short"), (None, "an item without an id has eight words here")]
    docs = [(None, "an item without an id has eight words here!"), (900, None), (901, ""), (902, "  ,. ")]
    for k in range(140):
        t = [f"d{rng.randrange(3000)}" for _ in range(rng.randrange(80))]
        if k % 2:
            q = toks(items[rng.randrange(25)][1])
            q = [x if rng.random() > 0.12 else "zz" for x in q][: rng.randrange(4, 70)]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + q + t[at:]
        docs.append((k, ", ".join(t).title() if k % 3 else " ".join(t)))
    docs += [docs[5], docs[5]]
    want = brute(docs, items)
    assert len(want) > 15
    dd = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id AS item_id", "doc_id", "text", "1 AS n")
    ii = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "2 AS n", "'q' AS tokens0")
    for block in (d.BLOCK_SEEDS, 400):
        got = d.overlaps(dd, ii, block_seeds=block).select("doc_id", "item_id").collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_substitutions_and_drop(spark):
    item = "the quick brown fox jumps over the lazy dog while five boxing wizards watch from a hill"
    broken = item.replace("brown", "red").replace("wizards", "witches").replace("over", "under")
    rows = [(1, f"before {item.upper()} after"), (2, f"x {broken}"), (3, "the quick brown fox sleeps"), (4, None), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_equal, r.n_tokens, r.first_token) for r in d.overlaps(docs, items).collect()}
    assert got == {1: (17, 17, 1), 2: (14, 17, 1), None: (17, 17, 0)}
    assert sorted((r.doc_id for r in d.drop_contaminated(docs, items).collect()), key=str) == [3, 4, None]
    assert d.overlaps(docs, items.limit(0)).count() == 0
    assert d.overlaps(docs.limit(0), items).count() == 0


def accepted(q, t, window=13, share=80):
    """Whether any shift of item q over text t is enough by the acceptance rule alone."""
    for shift in range(1 - len(q), len(t)):
        a, z = max(0, -shift), min(len(q), len(t) - shift)
        run = best = equal = most = 0
        for x in range(a, z):
            run, equal = (run + 1, equal + 1) if q[x] == t[x + shift] else (run - 2, equal)
            if run < 0:
                run = equal = 0
            if run >= best:
                best, most = run, equal
        if 100 * most >= share * min(window, len(q)):
            return True
    return False


def test_short_items_keep_the_whole_tolerance():
    for n in range(1, d.LONG):
        for k in range(5 if n > 4 else 1):
            for out in itertools.combinations(range(n), k):
                same = [x not in out for x in range(n)]
                if accepted(range(n), [x if s else -1 for x, s in enumerate(same)]):
                    assert any(all(same[p + x] for x, on in enumerate(m) if on == "1") for m in d.masks_for(n) for p in range(n - len(m) + 1)), (n, out)


def test_short_items_by_the_acceptance_rule_alone(spark):
    rng = random.Random(8)
    items = [(n * 10 + k, " ".join(f"i{n}x{k}x{x}" for x in range(n))) for n in range(1, d.LONG) for k in range(2)]
    docs = []
    for item, body in items:
        q = body.split()
        for _ in range(12):
            out = rng.sample(range(len(q)), rng.randrange(min(4, len(q) + 1)))
            docs.append((len(docs), " ".join(["a"] * rng.randrange(3) + ["zz" if x in out else w for x, w in enumerate(q)][: rng.choice([len(q), len(q), len(q) - 1])] + ["b"] * rng.randrange(3))))
    want = sorted((doc, item) for doc, t in docs for item, body in items if accepted(body.split(), t.split()))
    assert {item // 10 for _, item in want} == set(range(1, d.LONG))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.overlaps(dd, ii).collect()) == want


def test_repetitive_texts_are_expanded_in_blocks(spark, monkeypatch):
    """A text and an item of one repeated token: all their diagonals, no more than HITS seeds at a time, the counts as in one go."""
    item, text = "na " * 60, "na " * 1500 + "other " + "na " * 40
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    whole = [tuple(r) for r in d.overlaps(docs, bench).collect()]
    assert [r[:3] for r in whole] == [(1, 7, 60)]
    idx = d._Index([(60, 7, d.tokens(item.encode()).tobytes())])
    t = d.tokens(text.encode())
    one = idx.diagonals(t, np.array([0, len(t)]))
    monkeypatch.setattr(d, "HITS", 500)
    many = idx.diagonals(t, np.array([0, len(t)]))
    assert (one[0] == many[0]).all() and (one[1] == many[1]).all() and one[1].sum() > 50_000


def test_recall_of_the_masks_on_long_items():
    """Random substitutions of 10 to 30 per cent: at least 96 in 100 of the overlaps that the rule accepts share a seed."""
    rng = np.random.default_rng(9)
    for size in (16, 20, 30):
        hit = accepted = 0
        for _ in range(1500):
            item = rng.integers(1, 1 << 60, size).astype(np.uint64)
            text = item.copy()
            change = rng.random(size) < rng.uniform(0.1, 0.3)
            text[change] = rng.integers(1 << 61, 1 << 62, int(change.sum())).astype(np.uint64)
            _, _, equal = d.best_overlap(item, text)
            if d.enough(equal, size, 13, 80):
                accepted += 1
                hit += len(d._Index([(size, 1, item.tobytes())]).diagonals(text, np.array([0, size]))[0]) > 0
        assert accepted > 300 and hit >= 0.96 * accepted, (size, hit, accepted)
