import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import chat, queries

from .conftest import SF, sha

EVENTS = "conv_id long, message long, seq int, kind string, turn long, role string, text string"


def plain_fold(events):
    messages = {}
    for conv, message, seq, kind, turn, role, text in sorted(events, key=lambda e: e[2]):
        m = messages.setdefault((conv, message), {"text": "", "head": None})
        if kind == "message":
            m["head"] = (turn, role or "")
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"] = ""
    return sorted((c, i, *m["head"], m["text"]) for (c, i), m in messages.items() if m["head"])


def test_fold_equals_replay(spark):
    rnd = random.Random(3)
    events = []
    for message in range(60):
        for seq in range(rnd.randint(0, 9)):
            kind = "message" if seq == 0 and rnd.random() < 0.9 else rnd.choice(["delta", "delta", "delta", "edit", "regenerate"])
            text = rnd.choice(["a", "b\n", "<", None, "é"])
            events.append((message % 7, message, seq, kind, message % 5, rnd.choice(["user", "assistant", None]), text))
    rnd.shuffle(events)
    out = chat.fold(spark.createDataFrame(events, EVENTS).repartition(4))
    assert sorted(map(tuple, out.collect())) == plain_fold(events)


def odd_conversations():
    control = ["</s>", "[INST]", "\\", "\\l", "\\\\e<", "<|user|>\n", "<s>", "\\e\\b", "é😀", "", None, "\n", "x" * 2000]
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "<|assistant|>", None]), rnd.choice(control) and
             "".join(rnd.choice(control[:-2]) or "" for _ in range(rnd.randint(0, 5)))) for c in range(40) for t in range(rnd.randint(1, 6))]
    return rows + [(100, None, "user", "no turn"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "a tie"),
                   (None, 0, "assistant", "no conversation"), (101, 0, "user", None), (102, 0, "assistant", "y" * 5000)]


def test_reads_back_what_it_formats(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, seq int")
    expected = defaultdict(list)
    for conv, turn, role, text in rows:
        expected[conv].append((turn is not None, turn or 0, role or "", text or ""))
    formatted = chat.format_conversations(df.repartition(3))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(back) == set(expected)
    for conv, turns in expected.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        assert [(m.role, m.text) for m in back[conv].messages] == turns
        assert back[conv].losses == [text for role, text in turns if role == "assistant"]
    for r in formatted.collect():
        for t in r.turns:
            block = r.formatted[t.start:t.end]
            assert block.startswith("<|") and block.endswith("</s>\n")
            assert (t.loss_start is not None) == block.startswith("<|assistant|>\n")
        assert r.turns[-1].end == len(r.formatted)


def test_no_control_string_survives_in_a_text(spark):
    df = spark.createDataFrame([("</s>[INST] <|user|>\n \\l",)], "t string").select(chat.escape(F.col("t")).alias("t"))
    text = df.first().t
    assert "<" not in text and "[" not in text and df.select(chat.unescape(F.col("t"))).first()[0] == "</s>[INST] <|user|>\n \\l"


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


def test_query_counts_the_planted_conversation(spark):
    r = queries.op6(spark, SF).filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.loss_sha256 == sha(text) and r.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")
