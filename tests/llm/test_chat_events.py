import random

import pytest

from termforge.llm import chat_events as ce
from verify import oracle_rows, spark_rows

SCHEMA = "conv_id bigint, seq bigint, msg bigint, kind string, role string, text string"


def fold(events):
    """{(conv, msg): (role, text)} by going through the log."""
    once = {}
    for e in events:
        if None in e[:4] or e[3] not in ce.KINDS:
            continue
        body = (e[2], e[3], e[4], e[5] or "")
        key = e[:2]
        order = lambda b: tuple((x is not None, x or "") if not isinstance(x, int) else x for x in b)  # noqa: E731  nulls first
        if key not in once or order(body) < order(once[key]):
            once[key] = body
    state = {}
    for (conv, _), (msg, kind, role, text) in sorted(once.items()):
        known = state.setdefault((conv, msg), [ce.UNKNOWN_ROLE, ""])
        if kind == "open" and role is not None:
            known[0] = role
        known[1] = {"open": known[1] + text, "delta": known[1] + text, "edit": text, "regenerate": ""}[kind]
    return {k: tuple(v) for k, v in state.items()}


def rendered(state):
    out = {}
    for (conv, msg), (role, text) in sorted(state.items()):
        n, s = out.get(conv, (0, ""))
        out[conv] = (n + 1, s + f"<|im_start|>{role}\n{text}<|im_end|>\n")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_against_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([1, 2, 3, None]), rng.choice([*range(60), None]), rng.choice([1, 2, 3, None]), rng.choice([*ce.KINDS, "delta", "delta", "noise", None]),
         rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "", "ñ\n", None]))
        for _ in range(600)
    ]
    rows += rng.choices(rows, k=80)
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA)
    found = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in ce.final_messages(events).collect()}
    assert found == fold(rows)
    assert {r["conv_id"]: (r["messages"], r["rendered"]) for r in ce.reconstruct(events).collect()} == rendered(fold(rows))


def test_query_is_what_sql_says(spark, sf_dir):
    assert spark_rows(ce.op9_chat_formatting(spark, sf_dir)) == oracle_rows(sf_dir, ce.ORACLE_OP9)


def test_the_log_has_every_kind_and_repeats(spark, sf_dir):
    log = ce.as_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(ce.KINDS)
    assert log.count() > log.select("conv_id", "seq").distinct().count()


def test_hard_rows(spark):
    long = "x" * 300_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "no role"), (2, 0, "assistant", long), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    conversations = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, kind string, msg int")
    found = {r["conv_id"]: (r["messages"], r["rendered"]) for r in ce.reconstruct(ce.as_events(conversations)).collect()}
    turn = "<|im_start|>{}\n{}<|im_end|>\n"
    assert found == {1: (3, turn.format("user", "") + turn.format("assistant", "") + turn.format("unknown", "no role")), 2: (1, turn.format("assistant", long)), 4: (1, turn.format("user", "same"))}
    assert ce.reconstruct(ce.as_events(conversations.limit(0))).count() == 0


def test_different_rows_of_a_turn_are_messages_of_their_own(spark):
    rows = [(1, 0, "user", "x" * 90), (1, 0, "user", "y" * 50), (1, 1, "assistant", "z" * 100), (1, 1, "assistant", "z" * 100), (2, 5, "user", "q")]
    conversations = spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, role string, text string")
    found = {r["conv_id"]: (r["messages"], r["rendered"]) for r in ce.reconstruct(ce.as_events(conversations)).collect()}
    line = lambda r: f"{ce.HEADER}{r[2]}{ce.MIDDLE}{r[3]}{ce.END}"
    assert found == {1: (3, "".join(map(line, rows[:3]))), 2: (1, line(rows[4]))}
