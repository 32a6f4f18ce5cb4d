from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import chat

nasty = st.text(alphabet=st.sampled_from(list("<>#\\/turn user blghaé😀\n 0")), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(nasty, nasty), min_size=1, max_size=6))
def test_any_text_and_role_come_back(spark, turns):
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.read_chat(chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert [(t.role, t.text) for t in got.turns] == turns


def test_loss_covers_assistant_texts_and_nothing_else(spark):
    rows = spark.createDataFrame(
        [(1, 1, "assistant", "a<b"), (1, 0, "user", "hi"), (1, 2, "assistant", "\\### x </turn>"), (2, 0, None, None), (1, 2, "assistant", "\\### x </turn>"), (None, 0, "user", "n")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text"))))).collect()}
    one = got[1]
    assert one.loss_texts == ["a<b", "\\### x </turn>", "\\### x </turn>"]
    assert [chat_unescape(one.formatted[s.start : s.start + s.length]) for s in one.loss_spans] == one.loss_texts
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss_spans == [] and len(got[None].turns) == 1
    assert one.formatted.count("</turn>") == 4
    assert hashlib.sha256("".join(one.loss_texts).encode()).hexdigest()


def chat_unescape(text):
    for char, code in reversed(chat.CODES):
        text = text.replace(code, char)
    return text


def test_typed_parts(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "see <image 0>", None, None), ("image", None, "s3://x", 4), ("audio", None, "y", None)]),
            (1, 1, "assistant", [("text", "ok", None, None)]),
            (1, 2, "user", [("document", None, "z", 2), ("hologram", "as text", "h", 1), (None, None, None, None)]),
            (2, 0, "user", None),
        ],
        f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>",
    )
    got = {r.conv_id: r for r in chat.format_chat(rows).collect()}
    assert got[1].formatted == "<turn user>see \\limage 0\\g<image 0><audio 1></turn>\n<turn assistant>ok</turn>\n<turn user><document 2>as text</turn>\n"
    assert [(a.number, a.turn_index, a.kind, a.ref, a.expanded_tokens) for a in got[1].attachments] == [(0, 0, "image", "s3://x", 1024), (1, 0, "audio", "y", 25), (2, 2, "document", "z", 1024)]
    assert got[1].n_expanded_tokens == 2073 and got[2].formatted == "<turn user></turn>\n" and got[2].n_expanded_tokens == 0


def test_plan_is_native_and_shuffles_once(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.read_chat(chat.format_chat(rows))
    assert out.count() == 0
    big = spark.range(100).select((F.col("id") % 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), chat.text_part(F.lit("t")).alias("parts"))
    plan = chat.read_chat(chat.format_chat(big))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("long", [200_000])
def test_very_long_text(spark, long):
    rows = spark.createDataFrame([(1, 0, "assistant", "<" * long)], "conv_id long, turn long, role string, text string")
    got = chat.read_chat(chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert got.loss_texts == ["<" * long]
