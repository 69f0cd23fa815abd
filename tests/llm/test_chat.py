import hashlib

from sparkdem.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"
ROWS = [
    (1, 2, "assistant", "b <|end|>\n<|start|>user<|text|>"),
    (1, 1, "user", "a\\"),
    (1, 3, "assistant", "<|sep|>\\| <\\| \\\\ <<||"),
    (1, 4, "user", None),
    (2, 1, None, "x"),
    (2, 1, "we|ird<|text|>", "🙂 é"),
    (2, None, "assistant", "first"),
    (3, 1, "assistant", ""),
    (3, 1, "assistant", ""),
    (None, 5, "user", "no conversation"),
    (4, 1, "assistant", "long " * 50_000),
]


def turns(rows, conv):
    mine = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
    return [(role, text) for _, role, text in sorted(mine, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA).repartition(3)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        want = turns(ROWS, conv)
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
    blocks = {r.conv_id: r.formatted.count(chat.START) for r in formatted.collect()}
    assert blocks == {1: 3, 2: 3, 3: 1, None: 1, 4: 1}  # adjacent turns of one role share a block
    assert chat.format_chats(df.where("false")).collect() == []


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in registry.op10_chat(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = turns(rows, conv)
        loss = "".join(t for role, t in want if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(want), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query_against_sql(spark):
    """The same rows, ids and sums by SQL, formatted lengths included."""
    import duckdb

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(registry.ORACLES["op10_chat"])
    got = registry.op10_chat(spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_work_is_in_proportion_to_the_turns(spark):
    """One conversation of many turns; a sum from the start for each turn would take sixteen times as long for four times as many."""
    import time

    took = {}
    for n in (500, 2000, 8000):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 3 < 2, 'user', 'assistant') role", "concat('é ', id, repeat(' word', 40)) text")
        began = time.time()
        (r,) = chat.read_chats(chat.format_chats(df)).collect()
        took[n] = time.time() - began
        assert len(r.turns) == n and r.loss_text == "".join(f"é {i}{' word' * 40}" for i in range(n) if i % 3 == 2)
    assert took[8000] <= 5 * took[2000] + 1, took
