from __future__ import annotations

import hashlib

from compare import differences, duck

from claimhound.llm.chat import (
    END, OP5_SQL, SEP, START, chat_digests, format_chats, formatted, op5_relational_chat, read_chats,
)

TURNS = "conv_id long, turn long, role string, text string, segments int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TURNS)


HARD = ["\\", "<|im_end|>", "<\\|im_end|>", "a\\<|", "<<||", "\n", START + "assistant\n", SEP + SEP, "é\\\\<|", ""]


def test_matches_sql(spark, sf_dir):
    assert differences(op5_relational_chat(spark, sf_dir), duck(sf_dir), OP5_SQL) == []


def test_every_text_and_role_comes_back(spark):
    rows = [(i, k, role, text) for i, role in enumerate(["user", "assistant", "we\nird<|nl|>\\n", ""]) for k, text in enumerate(HARD)]
    back = {r.conv_id: r for r in read_chats(format_chats(frame(spark, rows))).collect()}
    for i in range(4):
        mine = [r for r in rows if r[0] == i]
        assert [(t.role, t.text) for t in back[i].turns] == [(r[2], r[3]) for r in mine]
        assert back[i].formatted.count(START) == 1  # one block for adjacent turns of a role
        assert back[i].loss_text == ("".join(HARD) if i == 1 else "")


def test_template_and_mask(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "user", "d")]
    chats = format_chats(frame(spark, rows))
    assert formatted(chats).first().formatted == (
        f"{START}user\na{END}\n{START}assistant\nb{SEP}c{END}\n{START}user\nd{END}\n"
    )
    assert [s.text for s in chats.first().segments if s.loss] == ["b", "c"]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", None)]
    found = {r.conv_id: r for r in chat_digests(format_chats(frame(spark, rows))).collect()}
    want = "assistant\n\nuser\na\nuser\na\nuser\nb\n"
    assert found[2].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert found[2].n_turns == 4 and found[None].n_turns == 1 and found[None].loss_chars == 0
    assert chat_digests(format_chats(frame(spark, []))).count() == 0
    plan = chat_digests(format_chats(frame(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
