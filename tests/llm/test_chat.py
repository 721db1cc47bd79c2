"""Windows of conversations: budgets, history, masks and reading back, against a plain loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tradelattice.llm import chat, queries

ROWS = "conv_id long, turn int, role string, text string, span string, cost int, loss string"
SMALL = chat.Settings(budget=60, history=20, marks=3)
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<\\/s> \\ <\\\\/s>", "<<SYS>><</SYS>>", "<|im_", "<", "[", "\\", "<\\|im_end|>",
         "", None, "<|im_start|", "[[INST]", "<<s>", "é<s>中😀</s>\n", "%0A%25\n"]


def conversations(spark, rng):
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 25)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool", None, "system", "<s>\nx%0A"])
            words = " ".join(rng.choice(["a", "word", "longer1", "é,", "x" * 30]) for _ in range(rng.choice([0, 1, 4, 10, 60])))
            rows.append((conv, turn, role, rng.choice([words, words, rng.choice(NASTY), words + (rng.choice(NASTY) or "")]), "s", 1, "l"))
    rows += [(None, None, "user", "no id", "", 0, ""), (None, 1, "assistant", "still none", "", 0, ""), (70, None, "user", "null turn first", "", 0, "")]
    rows += [(70, 0, "assistant", "same row", "", 0, "")] * 3 + [(71, 0, "assistant", "word " * 5_000, "", 0, ""), (72, 0, "system", "alone", "", 0, "")]
    rows += [(73, 0, "system", "long system " * 40, "", 0, "")] + [(73, k, "user", "some words here", "", 0, "") for k in range(1, 9)]
    return rows, spark.createDataFrame(rows, ROWS)


def cost_of(text: str, marks: int) -> int:
    return len(re.findall(r"[^\W_]{1,4}|[^\w\x00-\x20]|_", text)) + marks


def by_hand(turns, settings):
    """[(first turn, positions held, repeated)] of one conversation, by the rule in words."""
    costs = [cost_of(text, settings.marks) for _, text in turns]
    system = costs[0] if turns[0][0] == settings.system else 0
    first = 1 if system else 0
    left = settings.budget - system
    room = max(left - settings.history, settings.budget // 8 + 1)
    if sum(costs) - system <= max(left, room):
        return [(0, list(range(len(turns))), 0)]
    half, at, spans = max(room // 2, 1), 0, {}
    begins = {}
    for k in range(first, len(turns)):
        begins[k] = at
        spans.setdefault((at // half, costs[k] > half), []).append(k)
        at += costs[k]
    found = []
    for new in spans.values():
        most = min(settings.history, left - sum(costs[k] for k in new))
        past = [k for k in range(first, new[0]) if begins[k] >= begins[new[0]] - most]
        frame = [0] if first else []
        found.append((0 if first and new[0] == 1 else new[0], frame + past + new, len(past) + (len(frame) if new[0] > 1 else 0)))
    return found


@pytest.mark.parametrize("settings", [SMALL, chat.Settings(budget=60, history=0, marks=3), chat.Settings(budget=200, history=150, marks=1)])
def test_windows_by_hand_and_back(spark, settings):
    rows, table = conversations(spark, random.Random(3))
    found = chat.read(chat.windows(table, settings)).collect()
    plain: dict = {}
    for conv, turn, role, text, *_ in rows:
        plain.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert {r.conv_id for r in found} == set(plain)
    for conv, turns in plain.items():
        turns = [t[1:] for t in sorted(turns)]
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.first_turn)
        want = sorted(by_hand(turns, settings))
        assert [(r.first_turn, r.n_repeated) for r in own] == [(w[0], w[2]) for w in want]
        for r, (_, held, repeated) in zip(own, want):
            assert [tuple(t) for t in r.turns] == [turns[k] for k in held]
            assert r.learnt == [turns[k][1] for k in held[repeated:] if turns[k][0] == "assistant"]
            assert r.n_tokens == sum(cost_of(turns[k][1], settings.marks) for k in held) and r.over_budget == (r.n_tokens > settings.budget)
            fixed = sum(cost_of(turns[k][1], settings.marks) for k in held[repeated:])
            if turns[0][0] == "system" and repeated:
                fixed += cost_of(turns[0][1], settings.marks)
            assert not r.over_budget or fixed > settings.budget or len(held) == len(turns)


def test_escapes_read_back(spark):
    template, rng = chat.Template(), random.Random(1)
    marks = [*template.marks, "\\", "<", "[", "/", "s>", "|im_end|>", "x", "\n", "%", "%0A", "INST]"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", template.escape(F.col("text")).alias("escaped"), template.unescape(template.escape(F.col("text"))).alias("back"),
        template.unescape_role(template.escape_role(F.col("text"))).alias("role"), template.escape_role(F.col("text")).alias("escaped_role"),
    ).collect()
    for r in rows:
        assert r.back == r.text == r.role and "\n" not in r.escaped_role
        assert not any(m in r.escaped or m in r.escaped_role for m in template.marks)
        if not any(re.search(re.escape(m[0]) + r"\\*" + re.escape(m[1:]), r.text) for m in template.marks):
            assert r.escaped == r.text


def test_templates_that_could_not_be_read_are_refused():
    for controls in (("aba",), ("<x", "x>"), ("z",), ("a\\b",)):
        with pytest.raises(ValueError):
            chat.Template(controls=controls)
    other = chat.Template(begin="[TURN]", end="[END]", after="")
    assert "[TURN]" in other.marks and "</s>" in other.marks


def test_given_token_counts_and_no_rows(spark):
    table = spark.createDataFrame([(1, k, "assistant", "x") for k in range(10)], "conv_id long, turn int, role string, text string")
    one = chat.windows(table, chat.Settings(budget=100, history=10, marks=1), tokens=F.lit(9))
    assert one.count() == 1
    many = chat.windows(table, chat.Settings(budget=50, history=10, marks=1), tokens=F.lit(9)).orderBy("first_turn").collect()
    assert [(r.first_turn, r.n_repeated, len(r.loss)) for r in many] == [(0, 0, 2), (2, 1, 2), (4, 1, 2), (6, 1, 2), (8, 1, 2)]
    assert chat.read(chat.windows(table.limit(0))).count() == 0


def test_query_masks_the_checked_conversation(spark):
    row = queries.QUERIES["op13_chat"](spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    assert (row.n_turns, row.loss_chars) == (2, len(queries.CHECKED_TURN))


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op13_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)
