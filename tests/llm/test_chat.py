import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from gridreach.llm import chat as c
from tests.check import compare


def test_round_trip_with_control_strings(spark):
    rng = random.Random(7)
    bits = [*c.CONTROL, "\\", "\\e", "\\b", "<", ">", "|", "[", "]", "/", " ", "\n", "<<", "</", "s>", "INST]", "end", "ok", "é", "\n<</SYS>>\n\n", " [/INST]", "<|end|>", "[INST] "]
    rows, want = [], {}
    for conv in range(300):
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant"] * 3, ["user", "tool", "assistant"], ["assistant"], ["<|x|>", "", None, "a|b"]])
        turns = [(r, None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for r in roles]
        want[conv] = [(r or "", t or "") for r, t in turns]
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "'x' AS formatted")
    chats = c.format_chats(df)
    got = {r.conv_id: r for r in c.read_back(chats).collect()}
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for r, t in turns if r == "assistant")
    for r in chats.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        if r.conv_id in want:
            order = [x for x, _ in want[r.conv_id]]
            state = "start"
            for x in order:
                state = c.TURNS.get((state, x), "broken")
            assert r.valid == (state in c.LAST)


def test_ties_nulls_long_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, "user", "q"), (2, 0, None, None), (3, 0, "user", "x<s>" * 100_000), (3, 1, "assistant", "y\\" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in c.read_back(c.format_chats(df)).collect()}
    assert got[1] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None] == [("user", "q")] and got[2] == [("", "")]
    assert got[3] == [("user", "x<s>" * 100_000), ("assistant", "y\\" * 100_000)]
    assert c.format_chats(df.limit(0)).count() == 0


def test_probe(spark):
    from gridreach.llm.queries import PROBE, op4_chat_format

    df = op4_chat_format(spark, "/root/testdata/sf0.001")
    r = df.where("conv_id = -1").first()
    text = f"user\n{PROBE}\nassistant\n{PROBE}\n"
    assert (r.n_turns, r.loss_chars, r.valid) == (2, len(PROBE), True)
    assert r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest()
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert df.select(F.count("*")).first()[0] == df.select("conv_id").distinct().count()


def test_query_keeps_turns_without_a_conversation_id(spark, tmp_path):
    from gridreach.llm.queries import SQL, op4_chat_format

    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a<s>"), (7, 0, "user", "x"), (7, 1, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    df = op4_chat_format(spark, str(tmp_path))
    assert compare(df, con, SQL["op4_chat_format"]) is None
    r = df.where("conv_id is null").first()
    assert (r.n_turns, r.loss_chars, r.valid) == (2, 4, True) and df.count() == 3
