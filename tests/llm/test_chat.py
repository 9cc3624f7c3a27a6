import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ethoflow.llm.chat import PART, digests, formatted, masked, parsed, text_parts
from ethoflow.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a]<~", ""]), st.one_of(st.none(), st.text(alphabet="ab~0123<>[]/s\n é😀", max_size=12), st.sampled_from(["</s>", "<s>[user]", "[/user]</s>", "~3]~"]))), max_size=5)


@settings(max_examples=15, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=6))
def test_round_trip(spark, convs):
    rows = [(c, k, role, text) for c, turns in enumerate(convs) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", text_parts(F.col("text"))).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in formatted(df).withColumn("t", parsed(F.col("formatted"))).withColumn("m", masked(F.col("t"))).collect()}
    got = {r.conv_id: r for r in digests(formatted(df)).collect()}
    for c, turns in enumerate(convs):
        if not turns:
            assert c not in out
            continue
        assert [(t.role, t.text) for t in out[c].t] == [(r, x or "") for r, x in turns]
        loss = "".join(x or "" for r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert len(out[c].m) == sum(r == "assistant" for r, _ in turns)


def test_parts(spark):
    parts = [("text", "see <image:9> ", None, None), ("image", None, "a.png", 576), ("text", " and ", None, None), ("audio", None, "b.wav", None), None, ("video", "x", "y", 1), ("document", "", "c.pdf", 1200)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", None, None, None)]), (1, None, None, None), (None, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r.conv_id: r for r in formatted(df).collect()}
    assert got[1].formatted == "<s>[][/]</s><s>[user]see ~1image:9> <image:0> and <audio:1><document:2>[/user]</s><s>[assistant][/assistant]</s>"
    assert [tuple(a) for a in got[1].attachments] == [(1, "image", "a.png", 576, 0), (1, "audio", "b.wav", 0, 1), (1, "document", "c.pdf", 1200, 2)]
    assert got[1].attachment_tokens == 1776 and got[None].formatted == "<s>[user][/user]</s>"
    assert formatted(df.limit(0)).collect() == []


def test_sql(spark):
    compare(spark, QUERIES["op9_chat_formatting"], ORACLES["op9_chat_formatting"], "/root/testdata/sf0.01")


def test_one_long_conversation(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<é~"), F.col("id").cast("string")).alias("text"))
    start = time.monotonic()
    chats = formatted(rows.withColumn("parts", text_parts(F.col("text"))))
    got = digests(chats).first()
    spans = chats.select(F.size(masked(parsed(F.col("formatted")))).alias("n")).first().n
    took = time.monotonic() - start
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n<é~{i}\n" for i in range(n))
    loss = "".join(f"<é~{i}" for i in range(1, n, 2))
    assert (got.n_turns, got.turns_sha256) == (n, hashlib.sha256(said.encode()).hexdigest())
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and spans == n // 2
    assert took < 60


def test_mask_lies_on_the_formatted_text(spark):
    df = spark.createDataFrame([(1, t, "assistant" if t % 3 else "user", f"[{t}]~é") for t in range(700)], "conv_id long, turn long, role string, text string")
    r = formatted(df.withColumn("parts", text_parts(F.col("text")))).withColumn("m", masked(parsed(F.col("formatted")))).first()
    back = lambda x: x.replace("~3", "]").replace("~2", "[").replace("~1", "<").replace("~0", "~")
    assert [back(r.formatted[m.start : m.stop]) for m in r.m] == [f"[{t}]~é" for t in range(700) if t % 3]


def test_many_parts(spark):
    parts = [("image" if i % 2 else "text", f"t{i}", f"r{i}", i) for i in range(900)]
    r = formatted(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{PART}>")).first()
    assert r.formatted == "<s>[user]" + "".join(f"<image:{i // 2}>" if i % 2 else f"t{i}" for i in range(900)) + "[/user]</s>"
