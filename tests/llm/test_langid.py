import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

from gridreach.llm import langid as g


def plain_grams(text):
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    w = " ".join(x for x in out.split(" ") if x)
    w = f" {w} " if w else ""
    return [w[i : i + 3] for i in range(len(w) - 2)]


def packed(s):
    return ord(s[0]) | ord(s[1]) << 21 | ord(s[2]) << 42


def test_grams():
    for t in ["", None, "12 ..", "a", "Ab c", "  Ünïcode—日本語 x1y ", "İstanbul ß", "\ud83d\ude00ok".encode("utf-16", "surrogatepass").decode("utf-16")]:
        assert g.grams(t).tolist() == [packed(x) for x in plain_grams(t)]


def test_filter_names_every_language_and_corrects_false_positives():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 60, 15_000, dtype=np.uint64) for _ in range(3)]
    sets[1][:500] = sets[0][:500]
    f = g.Filter(["x", "y", "z"], list(enumerate(sets)))
    for i, s in enumerate(sets):
        assert ((f.masks(s)[0] >> np.uint8(i)) & 1).all()  # no false negative
    assert (f.masks(sets[0][:500])[0] & 3 == 3).all()
    other = rng.integers(1 << 60, 1 << 61, 200_000, dtype=np.uint64)
    assert np.allclose([((f.masks(other)[0] >> np.uint8(i)) & 1).mean() for i in range(3)], f.false, atol=1e-3)
    assert (f.shares(other) < 1e-3).all()


def test_equals_exact_sets_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in g.predict(docs.selectExpr("*", "1 AS gram", "'x' AS held_out0")).collect()}
    rows = docs.collect()
    counts, out = defaultdict(Counter), []
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(plain_grams(r.text))
    sets = {k: {x for x, n in c.items() if n * g.RAREST >= c.total()} for k, c in counts.items()}
    for r in rows:
        p = plain_grams(r.text)
        share = {k: sum(x in s for x in p) / len(p) for k, s in sets.items()}
        assert abs(got[r.doc_id].score - max(share.values())) < 0.01
        assert share[got[r.doc_id].lang_pred] >= max(share.values()) - 0.01
        if got[r.doc_id].held_out:
            out.append(got[r.doc_id].lang_pred == r.lang)
    assert len(got) == len(rows) and np.mean(out) >= 0.97 and len(out) > 150


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (4, None, "en"), (5, "123 !?", "de"), (None, "the dog", "fr"), (6, "the cat " * 100_000, None), (6, "und die", "de"), (6, "und die", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(g.predict(df).collect(), key=str)
    assert len(got) == 8 and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.lang_pred for r in g.predict(df.selectExpr("doc_id", "text", "CAST(null AS string) AS lang")).collect()} == {"und"}
    assert g.predict(df.limit(0)).count() == 0


def test_marks_alone_are_no_letters(spark):
    assert len(g.grams("\u0301\u0308 1")) == 0 and len(g.grams("e\u0301 1")) > 0
    rows = [(1, "\u0301\u0308", "xx"), (2, "some words of a text", "xx"), (3, "some words of a text", "xx")]
    got = {r.doc_id: r.lang_pred for r in g.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == "und" and got[2] == "xx"


def test_more_languages_than_bits_in_a_word():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 300)).astype(np.uint64) for _ in range(150)]
    f = g.Filter([f"l{i}" for i in range(150)], list(enumerate(sets)))
    assert len(f.masks(sets[0])) == 3
    for i in (0, 63, 64, 127, 128, 149):
        s = f.shares(sets[i])
        assert len(s) == 150 and s.argmax() == i and s[i] == 1
