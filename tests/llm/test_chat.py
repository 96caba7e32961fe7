import hashlib
import re

from pyspark.sql import functions as F

from karst.llm import chat

TEXTS = ["hi", "", None, "a <|im_end|> b", "<\\|x", "<\\\\|", "<|<|", "</s>[INST] ok [/INST]", "<", "|", "é😀\n<|im_start|>user<|im_sep|>"]


def escaped(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text or "")


def test_round_trip_and_loss(spark):
    rows = [(c, t, ["user", "assistant", "<|im_sep|>", None][t % 4], x) for c in (1, 2) for t, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("segments")).alias("loss")).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.formatted.count(chat.START) == len(mine) == r.n_turns
        assert [r.formatted[s.start : s.stop] for s in r.segments] == [escaped(x[3]) for x in mine]
        assert [s.loss for s in r.segments] == [x[2] == "assistant" for x in mine]


def test_parts(spark):
    parts = "array(named_struct('type','text','text','see ','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('type','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null), named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.5,'pages',null), named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3), named_struct('type','odd','text',null,'ref','d','width',null,'height',null,'seconds',null,'pages',null))"
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast({parts} as array<{chat.PART}>) parts union all select 1L, 1L, 'assistant', null")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user<|im_sep|>see <|image|><|audio|><|document|><|unknown|><|im_end|>\n<|im_start|>assistant<|im_sep|><|im_end|>\n"
    assert [(a.part, a.ref, a.n_tokens) for a in r.attachments] == [(1, "a.png", 3), (2, "b.wav", 63), (3, "c.pdf", 768), (4, "d", 0)]
    assert r.n_attachment_tokens == 834


def test_order_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 2, "b", "x"), (None, None, "a", "y"), (None, 2, "b", "x"), (None, 2, "a", "z")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), F.lit(1).alias("n"))).select(chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert [[x.text for x in y.t] for y in r] == [["y", "z", "x", "x"]]


def test_nothing(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chats(df).collect() == []


def test_registered_query_has_the_extra_conversation(spark):
    from karst.llm.queries import QUERIES

    r = QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_turns == 2 and r.loss_chars == len(text)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
