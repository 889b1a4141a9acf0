import hashlib
import json

from pyspark.sql import functions as F

from gleanery.llm import chats
from gleanery.llm.queries import op13_chat_formatting

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def digests(rows):
    """conv: list of (role, text) in order."""
    out = {}
    for conv, turns in rows.items():
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        said = [t for r, t in turns if r == "assistant"]
        out[conv] = (len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, said)), sha(said))
    return out


TEXTS = ["", "plain", CONTROL_TEXT, r"<\/s> and <\\/s>[\INST]", "[[INST]]", "a < b </", "[", "[ROLE]x[/ROLE]y[/TURN]", "é日\n\n", "\\", "[/", "s>", "</s></s>"]


def test_round_trip_of_awkward_texts_and_roles(spark):
    roles = ["user", "assistant", "system", "tool", "", None, "[ROLE]", "a\nb", "User"]
    rows, want = [], {}
    for conv in range(40):
        for turn in range(conv % 11):
            role, text = roles[(conv + turn * 5) % len(roles)], TEXTS[(conv * 3 + turn) % len(TEXTS)] + TEXTS[(conv + turn * 7) % len(TEXTS)]
            rows.append((conv, turn, role, text))
            want.setdefault(conv, []).append((role or "", text))
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", None), (100, None, "user", "first"), (100, 0, "user", "second"), (101, 0, "user", "same"), (101, 0, "user", "same")]
    want |= {None: [("assistant", ""), ("user", "x")], 100: [("user", "first"), ("user", "second")], 101: [("user", "same")] * 2}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    pieces = chats.format_chats(chats.canonical_turns(frame), 40).persist()
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chats.read_back(pieces).collect()}
    assert got == digests(want)
    held = pieces.collect()
    assert any(x.piece > 0 for x in held)
    for x in held:
        marked = "".join(x.text[s.start : s.start + s.length] for s in x.loss)
        assert not any(c in marked for c in chats.CONTROLS)
        assert sum(x.text.count(c) for c in ("[/INST]", "[/SYS]", "</s>", "[/TURN]")) == len(list(chats.read_turns(x.text)))


def test_very_long_conversation_and_text(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(3000)] + [(8, 0, "assistant", "[INST] " * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chats.format_chats(chats.canonical_turns(frame))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chats.read_back(pieces).collect()}
    assert got == digests({7: [(r, t) for _, _, r, t in rows[:3000]], 8: [("assistant", rows[-1][3])]})


RECORDS = [
    ("m", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5}, "messages", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ("e", {"messages": []}, "messages", []),
    ("f", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "meta": {"x": [1]}}, "from and value", [("user", "q"), ("assistant", "")]),
    ("p", {"prompt": "q", "completion": "a"}, "prompt and completion", [("user", "q"), ("assistant", "a")]),
    ("ps", {"system": "s", "prompt": "q", "response": "a"}, "prompt and response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ("i", {"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ("i0", {"instruction": "do", "input": "", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
    ("q", {"question": "q", "answer": "a", "context": "c"}, "question and answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ("?", {"headline": "x"}, None, []),
    ("2", {"prompt": "q", "completion": "a", "messages": []}, None, []),
    ("[]", [1, 2], None, []),
    ("w", {"messages": ["hello"]}, None, []),
]


def test_fingerprints_select_layouts(spark):
    rows = [(k, json.dumps(r)) for k, r, *_ in RECORDS] + [("bad", "{nope"), ("null", None)]
    frame = spark.createDataFrame(rows, "key string, record string").withColumn("_r", F.lit(1))
    turns = chats.canonical_turns(frame, "key", "record").orderBy("conv_id", "turn").collect()
    for k, _, layout, want in RECORDS:
        own = [x for x in turns if x.conv_id == k]
        assert [(x.role, x.text) for x in own] == want and {x.layout for x in own} <= {layout}
    assert {x.key for x in chats.unmapped(frame, "record").collect()} == {"?", "2", "[]", "w", "bad", "null"}


def test_typed_tables(spark):
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5), (2, None, 6)], "conv_id long, messages array<struct<role: string, content: string>>, other int")
    assert [(x.turn, x.role, x.text) for x in chats.canonical_turns(nested).collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    pair = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string")
    assert [(x.role, x.text) for x in chats.canonical_turns(pair).collect()] == [("user", "q"), ("assistant", "a")]
    words = spark.createDataFrame([(1, ["q"])], "conv_id long, messages array<string>")
    assert chats.canonical_turns(words).collect() == [] and chats.unmapped(words).count() == 1
    neither = pair.withColumn("messages", F.array(F.lit("x")))
    assert chats.canonical_turns(neither).collect() == [] and chats.unmapped(neither).count() == 1


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi"), (2, 0, "assistant", CONTROL_TEXT)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(1)).withColumn("messages", F.lit("x")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.conv_id: x for x in op13_chat_formatting(spark, str(tmp_path)).collect()}
    want = digests({1: [("user", ""), ("assistant", "hi")], 2: [("assistant", CONTROL_TEXT)], -1: [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]})
    assert {k: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for k, x in got.items()} == want
    assert got[1].formatted_chars == len("[INST][/INST]hi</s>") and got[-1].formatted_chars == 2 * (len(CONTROL_TEXT) + 3) + len("[INST][/INST]</s>")


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.read_back(chats.format_chats(chats.canonical_turns(none))).collect() == []
