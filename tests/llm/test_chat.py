import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n int"


def test_turns_come_back_and_the_mask_holds_assistant_texts(spark):
    nasty = ["<|turn|>", "<|end|>\n", "<\\|text|>", "<", "<\\", "|>", "a<", None, "", "é<\\\\|x|>漢", "\\### Assistant: </turn> ok", "x" * 50_000]
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t, "clash", 1) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "same", "", 1), (2, 0, "assistant", "same", "", 1), (2, None, "system", "first", "", 1), (None, 0, None, "no id", None, None), (3, 5, "<|role|>", "t", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = chat.read_back(chat.format_chats(df)).collect()
    for r in found:
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert cut == [e for (e,) in spark.createDataFrame([(i, r["turns"][s["turn"] - 1]["text"]) for i, s in enumerate(r["loss"])], "i int, t string").orderBy("i").select(chat.escaped(F.col("t"))).collect()]
    by = {r["conv_id"]: r for r in found}
    assert [(t["role"], t["text"]) for t in by[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert by[1]["under"] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in by[2]["turns"]] == [("system", "first"), ("assistant", "same"), ("assistant", "same")]
    assert by[2]["formatted"].count("<|turn|>") == 2  # the equal roles are one block
    assert [(t["role"], t["text"]) for t in by[None]["turns"]] == [("", "no id")]
    assert [(t["role"], t["text"]) for t in by[3]["turns"]] == [("<|role|>", "t")]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_adds_its_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["conv_id"]: r for r in chat.op7_chat(spark, str(tmp_path)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and rows[-7]["loss_chars"] == len(said)
    assert rows[1]["n_turns"] == 2 and rows[1]["loss_chars"] == 0


def test_escapes_on_many_texts(spark):
    texts: list[str] = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="<|\\>a\n", max_size=12))
    def gather(t):
        texts.append(t)

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e")))
    assert df.where("t <> u or contains(e, '<|')").count() == 0


def test_a_conversation_of_very_many_turns_is_read_back_in_linear_time(spark):
    df = spark.range(40_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 60) as text")
    row = chat.read_back(chat.format_chats(df)).selectExpr("size(turns) n", "length(under) m").first()
    assert (row["n"], row["m"]) == (40_000, 20_000 * 300)


@pytest.mark.parametrize("start, end, turn", [(1, 1, 0), (-1, -1, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1)])
def test_spans_that_are_elsewhere_raise(spark, start, end, turn):
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t) for i, t in enumerate(["hi", "<|end|>\n", "é漢", "", "same", "same"])]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(chats).first()["under"] == "<|end|>\né漢samesame"
    for at in range(4):  # one span of the mask at a time
        moved = F.transform("loss", lambda s, i: F.when(i == at, F.struct((s["start"] + start).alias("start"), (s["end"] + end).alias("end"), (s["turn"] + turn).alias("turn"))).otherwise(s))
        with pytest.raises(Exception, match="a span is not its turn's text|out of bounds|INVALID_ARRAY_INDEX"):
            chat.read_back(chats.withColumn("loss", moved)).collect()
