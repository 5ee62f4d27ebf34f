import random
import re

import pytest

from gridreach.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "\n", "\t", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "é", "日本語", "🎉", "the", "The", " the", "ing", "\u0000", "　", "#", "://", "1234", " " * 20, "é", "​", "ſ", "aaaa", "\r\n", "한국", "zq"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def draws(n):
    rng = random.Random(3)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_whole_tokens_are_proven(library):
    proof = tc.prove(PATH)
    plain = sentencepiece.SentencePieceProcessor(model_proto=proof.model)
    assert len(proof.whole) > 20_000
    for s in random.Random(1).sample(sorted(proof.whole), 500):
        assert plain.encode(s, out_type=str) == [s] and re.fullmatch(proof.pattern, s)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_counts_equal_the_library(library, monkeypatch, piece):
    monkeypatch.setattr(tc, "PIECE", piece)
    monkeypatch.setattr(tc, "HELD", 50)  # merged pre-tokens are let go and merged again
    proof = tc.prove(PATH)
    costs, pattern = tc.Costs(proof), re.compile(proof.pattern)
    for t in draws(3000):
        lists = list(tc.pre_tokens(t, pattern))
        assert "".join(x for pre in lists for x in pre) == ("▁" + t.replace(" ", "▁") if t else "")
        assert sum(costs.sums(lists)) == len(library.encode(t)), t


def test_documents(spark, library):
    texts = [*draws(300), None, "", "the " * 2000, "the " * 2048, "x" * 200_000, "ab " * 300_000, "the same", "the same"]
    rows = [(i if i % 50 else None, t, 5, "a") for i, t in enumerate(texts)]
    got = tc.count(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, size string"), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows]
    assert sorted([tuple(r)[:3] for r in got], key=lambda r: (r[0] or -1, *r[1:])) == sorted(want, key=lambda r: (r[0] or -1, *r[1:]))
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert tc.count(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
