import hashlib
import zlib

import pytest

from gridreach.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n = n_chars + more if n_chars is not None else None
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def climb(hashes):
    """(root, per leaf the list of (sibling or '', sibling is left))."""
    ways, seats, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for way, at in zip(ways, seats):
            way.append((level[at ^ 1] if at ^ 1 < len(level) else "", at % 2 == 1))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        seats = [s // 2 for s in seats]
    return level[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    low = {g: climb([leaf(r) for r in trees[g]]) for g in names}
    root, high = climb([low[g][0] for g in names])
    out = []
    for g, above in zip(names, high):
        for r, way in zip(trees[g], low[g][1]):
            f = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for sib, left in way + above:
                f = H(sib, f) if left else H(f, sib)
            out.append((r[0], leaf(r), low[g][0], root, H(*[s for s, _ in way + above]), f, f == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, w int")


@pytest.mark.parametrize("step", [2, 8])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 1, "": 3, "ä": 33, "=": 2}, {f"l{i}": 1 + i % 5 for i in range(19)}])
def test_equals_the_plain_trees(spark, sizes, step, monkeypatch):
    monkeypatch.setattr(manifest, "STEP", step)
    monkeypatch.setattr(manifest, "SPREAD", 3)  # copies of upper nodes also on small trees
    rows = [(100 * j + i, f"s{i}", g, None if i % 5 == 1 else i, "é" * i if i % 4 else None) for j, (g, n) in enumerate(sizes.items()) for i in range(n)]
    got = [tuple(r) for r in manifest.prove(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 2 + [(7, "s", "a", 1, "")] * 3 + [(7, "s", "a", 2, "other"), (-3, "s", "a", 2**63 - 1, "long " * 100_000)]
    got = [tuple(r) for r in manifest.prove(frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert manifest.prove(frame(spark, rows[:0])).collect() == []
