import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from gridreach.llm import rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    cover = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


@given(st.lists(st.sampled_from(["a", "B", "a ", "b", " ", "\n", "\n\n", "#", "é", "\u2003", "\x0b", "\x1c", "|", "a b a b a b", "日本"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_counts_equal_brute_force(parts):
    text = "".join(parts)
    assert q.base_counts(text.encode())[0] == brute(text)


def test_long_text():
    text = ("word other " * 150_000 + "\n") * 2
    assert q.base_counts(text.encode())[0] == brute(text)


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.judge(docs, labels.where("doc_id % 3 <> 0")).toPandas()
    assert len(got) == docs.count()
    assert (got.kept == (~got.base_failed & (got.probability >= 0.3))).all()
    out = got.merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert ((out.probability >= 0.3) == (out.quality == 1)).mean() >= 0.93
    assert ((out.probability - out.quality) ** 2).mean() < 0.07


def test_sample_bound_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x " * 60), (3, " ".join(f"w{i}" for i in range(90))), (3, " ".join(f"w{i}" for i in range(90))), (4, "same thing again " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS k")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(docs, none).collect()}
    assert got[1].base_failed and got[2].base_failed and got[4].base_failed and got[None].base_failed
    assert got[3].kept and not got[3].base_failed and got[3].probability is None
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] * 2 + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = q.judge(docs, labels, fit_rows=3).collect()
    assert len(got) == 6 and all(r.probability is None or 0 <= r.probability <= 1 for r in got)
    assert q.judge(docs.limit(0), labels).count() == 0
