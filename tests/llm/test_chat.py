import hashlib

from pyspark.sql import functions as F

from graphloom.llm import chat

ROWS = [
    (1, 0, "user", "hi <|im_start|> \\l \\\\ [INST]", 9),
    (1, 1, "assistant", None, 9),
    (1, 2, None, "é🤦", 9),
    (1, 3, "assistant", "</s>[INST] ok [/INST]\\b<", 9),
    (1, 3, "assistant", "</s>[INST] ok [/INST]\\b<", 9),
    (None, None, "a\nb\\n", "x\n", 9),
    (2, 0, "user", "", 9),
    (3, 0, "assistant", "y" * 200_000, 9),
]


def test_turns_and_examples_come_back(spark):
    turns = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string, formatted int").orderBy(F.rand(1))
    done = chat.format_conversations(turns)
    got = {r.conv_id: r for r in done.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for conv in {r[0] for r in ROWS}:
        want = [(r or "", t or "") for c, n, r, t, _ in ROWS if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        body = got[conv].formatted
        assert body.count("<|im_start|>") == len(want) and "[INST]" not in body and "</s>" not in body
    ex = chat.expand(done).withColumn("reply", chat.unescape(F.col("target"))).withColumn("before", chat.read_turns(F.col("context"))).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn) for r in ex] == [(1, 1), (1, 3), (1, 4), (3, 0)]
    assert [r.reply for r in ex][:3] == ["", ROWS[3][3], ROWS[4][3]]
    for r in ex:
        whole = [(x or "", y or "") for c, n, x, y, _ in ROWS if c == r.conv_id]
        assert [(t.role, t.text) for t in r.before] == [*whole[: r.turn], ("assistant", "")]


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.expand(chat.format_conversations(none)).count() == 0


def test_query_against_plain_python(spark):
    from graphloom.llm.queries import CONTROL, op1_chat

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    by = {-1: [(0, "user", CONTROL), (1, "assistant", CONTROL)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    for r in op1_chat(spark, "/root/testdata/sf0.001").collect():
        ts = sorted(by.pop(r.conv_id))
        loss = "".join(t for _, role, t in ts if role == "assistant")
        assert r.n_turns == len(ts) and r.loss_chars == len(loss) and r.contexts_whole
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in ts).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not by
