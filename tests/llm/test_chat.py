from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from lacuna.llm import chat


def test_equals_sql(spark, sf):
    assert rows_of(chat.op10_chat_formatting(spark, sf)) == rows_of_sql(chat.OP10_SQL, sf)


NASTY = ["", "\\", "\\\\", "### ", "#### ", "</turn>", "<\\/turn>", "</turn>\n### user: x</turn>\n", "a: b", "é \U0001f600", "\\### Assistant: </turn> ok", "x\r\ny", "$1 \\$2", "#\\## ", "</turn", "\n"]


def test_round_trip(spark):
    rows = [(i, t, role, NASTY[(i + t) % len(NASTY)]) for i in range(len(NASTY)) for t, role in enumerate(("system", "user", "assistant", "odd: role ### \\", "r:"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("t", chat.parse_turns(F.col("formatted"))).collect()
    for r in out:
        want = [(role, text) for i, _, role, text in rows if i == r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["t"]] == want
        assert [x["loss"] for x in r["t"]] == [role == "assistant" for role, _ in want]


def test_edges(spark):
    rows = [(1, 2, "assistant", None, 5), (1, 1, "user", "hi", 5), (1, 1, "user", "hi", 5), (None, None, None, None, 5), (2, 0, "human", "x" * 300000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r["t"] for r in chat.format_conversations(df).select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]] == [("user", "hi"), ("user", "hi"), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in out[None]] == [("", "")]
    assert out[2][0]["role"] == "human" and len(out[2][0]["text"]) == 300000
    assert chat.format_conversations(df.limit(0)).count() == 0


LAYOUTS = [
    ('{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
    ('{"completion": "b", "prompt": "a"}', "prompt_completion", [("user", "a"), ("assistant", "b")]),
    ('{"question": "a", "answer": null}', "question_answer", [("user", "a"), ("assistant", "")]),
    ('{"instruction": "a", "input": "i", "output": "b"}', "instruction_input_output", [("user", "a\n\ni"), ("assistant", "b")]),
    ('{"instruction": "a", "input": "", "output": "b"}', "instruction_input_output", [("user", "a"), ("assistant", "b")]),
    ('{"system": "", "prompt": "a", "response": "b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
    ('{"role": "user", "text": "a"}', "turn_row", [("user", "a")]),
    ('{"odd": {"deep": [1, 2]}}', None, None),
    ('{"messages": [{"role": "human", "content": "a", "name": "n"}, {"role": "gpt", "content": null}], "id": 3}', "messages", [("human", "a"), ("gpt", "")]),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b"]}, {"role": "assistant", "content": "c"}]}', "messages", [("user", "ab"), ("assistant", "c")]),
    ('{"id": 1, "prompt": "a", "response": "b", "meta": {"k": [1]}}', "prompt_response", [("user", "a"), ("assistant", "b")]),
    ('{"system": "s", "prompt": "a", "completion": "b"}', "prompt_completion", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ('{"messages": []}', "messages_empty", []),
    ('{"messages": [1, 2]}', None, None),
    ('{"conversations": [{"from": "tool", "value": 5}]}', "conversations", [("tool", "5")]),
    ("null", None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LAYOUTS)], "i int, j string").select("i", F.parse_json("j").alias("rec"))
    for r in chat.canonical_turns(df, "rec").orderBy("i").collect():
        _, name, turns = LAYOUTS[r["i"]]
        assert r["layout"] == name
        assert turns is None and r["turns"] is None or [(t["role"], t["text"]) for t in r["turns"]] == turns


def test_field_paths(spark):
    df = spark.createDataFrame([('{"b": {"c": 1, "a b": [[{"x": null}]]}, "a": [1, "s"]}',)], "j string")
    assert df.select(chat.field_paths(F.parse_json("j"))).first()[0] == ["a", "a[]", "b", "b.a b", "b.a b[]", "b.a b[][]", "b.a b[][].x", "b.c"]


def test_roles_stay_and_several_layouts_serve(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "r"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "r"), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("t", chat.parse_turns(F.col("formatted"))).collect()
    assert {r["conv_id"]: r["layout"] for r in out} == {1: "messages", 2: "prompt_response", 3: "prompt_response", 4: "messages"}
    for r in out:
        assert [(x["role"], x["text"]) for x in r["t"]] == [(role, text) for i, _, role, text in rows if i == r["conv_id"]]
    assert not any(x["loss"] for r in out if r["conv_id"] == 1 for x in r["t"])
