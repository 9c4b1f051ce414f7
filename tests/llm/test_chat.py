import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.llm import chat


def test_escapes_are_reversible(spark):
    pieces = st.sampled_from(["<", "|", "\\", "[", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "</SYS>>", "a", " ", "\n", "é", "$1", chat.END, chat.START])
    texts = []

    @settings(max_examples=400, database=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(pieces, max_size=12))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", chat.escaped(F.col("t")).alias("e")).select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(begin + rest in r.e for begin, rests in chat.RESERVED.items() for rest in rests)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r", "extra": 3}, [("user", "p"), ("assistant", "r")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": None}, [("user", "p"), ("assistant", "")]),
    ({"question": "p", "answer": "r"}, [("user", "p"), ("assistant", "r")]),
]


def test_json_records_of_all_layouts(spark):
    rows = [(i, json.dumps(record)) for i, (record, _) in enumerate(LAYOUTS)] + [(90, None), (91, "{"), (92, '{"unknown": 1}')]
    found = chat.canonical_turns_of_json(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()
    for i, (_, expected) in enumerate(LAYOUTS):
        assert [(r.role, r.text) for r in sorted(found, key=lambda r: r.turn) if r.conv_id == i] == expected
    assert {r.conv_id for r in found} == set(range(len(LAYOUTS)))


def test_tables_of_all_layouts(spark):
    for record, expected in LAYOUTS[:5]:
        frame = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 5, **record})]))
        found = chat.canonical_turns(frame).orderBy("turn").collect()
        assert [(r.conv_id, r.role, r.text) for r in found] == [(5, *e) for e in expected]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


def test_conversations_come_back(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] x [/INST]\\"), (1, 0, "user", "a<|end|>b"), (1, 0, "user", "a<|end|>b"), (1, None, "system", None),
        (2, 0, None, ""), (None, 3, "assistant", "null id"), (3, 0, "assistant", "long " * 50_000),
    ] + [(4, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    found = chat.formatted(chat.canonical_turns(turns)).select(
        "conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"),
    ).collect()
    by_id = {r.conv_id: r for r in found}
    assert [tuple(t) for t in by_id[1].turns] == [
        ("system", ""), ("user", "a<|end|>b"), ("user", "a<|end|>b"), ("assistant", "</s>[INST] x [/INST]\\"),
    ]
    assert by_id[1].trained == "</s>[INST] x [/INST]\\"
    assert [tuple(t) for t in by_id[2].turns] == [("", "")] and by_id[2].trained == ""
    assert by_id[None].trained == "null id" and by_id[3].trained == "long " * 50_000
    assert [t.text for t in by_id[4].turns] == [f"turn {t}" for t in range(300)]
    for r in found:
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.formatted(chat.canonical_turns(turns.limit(0))).count() == 0
