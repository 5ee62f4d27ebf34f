import random
from collections import Counter, defaultdict

from gridreach.llm import packing as p


def check(rows, got, capacities):
    most = max(capacities)
    want = Counter()
    for doc, n in rows:
        n = max(0, n or 0)
        for k in range(max(1, -(-n // most))):
            want[doc, k, min(most, n - k * most)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        if r.n_tokens == 0:
            assert r.bin_id is None and r.capacity is None
        else:
            bins[r.bin_id].append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):  # no gap, no overlap
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.capacity for r in rs} == {min(c for c in capacities if c >= at)}
    assert sorted(bins) == list(range(len(bins)))
    return sum(r[0].capacity for r in bins.values()), sum(max(0, n or 0) for _, n in rows)


def one_bin_at_a_time(sizes, capacities, overhead):
    """The same rule, piece by piece."""
    left, used = sorted(sizes), []
    while left:
        tried = []
        for c in sorted(capacities):
            if c < left[-1]:
                continue
            room, rest, mine = c, list(left), []
            for n in reversed(left):
                if n <= room:
                    mine.append(n)
                    rest.remove(n)
                    room -= n
            tried.append(((c + overhead) / sum(mine), c, mine, rest))
        _, c, mine, left = min(tried, key=lambda x: x[:2])
        used.append(tuple(mine))
    return used


def test_plan_is_best_fit_and_downsized():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 60))]
        bins = p.plan(Counter(sizes), (16, 32, 64), 4)
        mine = [tuple(n for n, u in b.contents for _ in range(u)) for b in bins for _ in range(b.times)]
        assert Counter(x for m in mine for x in m) == Counter(sizes)
        assert sum(map(sum, mine)) == sum(sizes) and all(sum(m) <= b.capacity for b in bins for m in [tuple(n * u for n, u in b.contents)])
        assert mine == one_bin_at_a_time(sizes, (16, 32, 64), 4)  # the whole plan
    assert len(p.plan({7: 10**12, 9: 10**11, 60: 3}, (16, 64))) < 12


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 3, 7, 30, 30, 30, 30, 61, 64, 65, 200])) for i in range(900)]
    rows += [(5, 30)] * 3 + [(None, 12), (None, None), (7000, 0), (7001, -4), (7002, None), (7003, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS piece", "2 AS rank_cum", "3 AS _one")
    room, tokens = check(rows, p.pack(df, (16, 32, 64), 4).collect(), (16, 32, 64))
    assert room <= 1.05 * tokens
    assert p.pack(df.limit(0)).count() == 0


def test_word_lengths(spark):
    df = spark.createDataFrame([(1, "a b\tc d \n e"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in p.word_lengths(df).collect()] == [(1, 5), (2, 1), (3, 1)]
