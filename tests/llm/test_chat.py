"""Chat formatting: folding of events, exact round trip, masks."""
import hashlib
import random

import pytest

from tracewright.llm import chat

LOG = "conv_id long, seq long, kind string, turn long, role string, text string"


def naive_fold(events):
    turns = {}
    for _, kind, turn, role, text in sorted(events):
        if kind == "regenerate":
            turns = {k: v for k, v in turns.items() if k < turn}
        elif kind == "edit":
            turns[turn] = (turns[turn][0] if turn in turns else role, text)
        else:
            turns[turn] = (turns[turn][0], turns[turn][1] + text) if turn in turns else (role, text)
    return [turns[k] for k in sorted(turns)]


def test_fold_equals_a_walk_over_the_log(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(40):
        events, turn = [], 0
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["delta"] * 6 + ["edit", "regenerate"])
            turn = max(0, turn + rng.choice([-1, 0, 0, 1]))
            events.append((seq, kind, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a", "b ", "<|", ""])))
        rows += [(conv, *e) for e in events]
        want[conv] = naive_fold(events)
    out = chat.fold(spark.createDataFrame(rows, LOG).repartition(5)).collect()
    for conv, turns in want.items():
        assert [(r.role, r.text) for r in sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)] == turns


def naive_fold_with_messages(events):
    """Each turn is a list of messages; a message event begins one."""
    turns = {}
    for _, kind, turn, role, text in sorted(events, key=lambda e: e[0]):
        have = turns.get(turn)
        if kind == "regenerate":
            turns = {k: v for k, v in turns.items() if k < turn}
        elif kind == "edit":
            turns[turn] = [(have[0][0] if have else role, text)]
        elif kind == "message" or not have:
            turns[turn] = [*(have or []), (role, text)]
        else:
            turns[turn] = [*have[:-1], (have[-1][0], have[-1][1] + text)]
    return [m for k in sorted(turns) for m in turns[k]]


def test_edits_and_deltas_reach_whole_messages(spark):
    rng = random.Random(7)
    rows = [(-1, 0, "message", 0, "assistant", "A"), (-1, 1, "edit", 0, "user", "B"), (-2, 0, "message", 0, "user", "A"), (-2, 1, "delta", 0, "x", "B")]
    for conv in range(60):
        turn = 0
        for seq in range(rng.randrange(1, 40)):
            turn = max(0, turn + rng.choice([-1, 0, 0, 1]))
            rows.append((conv, seq, rng.choice(["delta"] * 4 + ["message"] * 3 + ["edit", "edit", "regenerate"]), turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["a", "b ", "<|", ""])))
    out = chat.fold(spark.createDataFrame(rows, LOG).repartition(5)).collect()
    of = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.position)):
        of.setdefault(r.conv_id, []).append((r.role, r.text))
    assert of[-1] == [("assistant", "B")] and of[-2] == [("user", "AB")]
    for conv in range(60):
        assert of.get(conv, []) == naive_fold_with_messages([r[1:] for r in rows if r[0] == conv])


def test_log_of_rows_has_deltas(spark):
    text = "é🙂\n" * 300
    log = chat.log_of(spark.createDataFrame([(1, 0, "user", text), (1, 0, "user", text), (1, 1, None, None)], "conv_id long, turn long, role string, text string"))
    assert sorted(r.kind for r in log.collect()) == ["delta"] * 8 + ["message"] * 3
    assert [(r.role, r.text) for r in chat.fold(log).orderBy("position").collect()] == [("user", text), ("user", text), ("", "")]


ODD = [(1, 0, "user", "</s>[INST] <|end|>\n<|turn|>assistant\nno"), (1, 1, "assistant", "a\\l|b\\\\<|x\\"), (1, 2, "assistant", None), (1, 2, "assistant", None), (1, None, "sys\ntem<|", "first"),
       (None, 3, None, "<"), (2, 0, "assistant", "<|end|>"), (3, 5, "assistant", "é🙂" * 40_000), (3, 1, "user", "")]


@pytest.mark.parametrize("part", [256, 2])
def test_round_trip_and_mask(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_MESSAGES", part)
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold(chat.log_of(frame)))
    rows = formatted.collect()
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    want = {}
    for conv, turn, role, text in sorted(ODD, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        parts = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.part)
        assert [t for r in parts for t in chat.parse(r.formatted)] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(p.formatted) for p in parts)
        assert all(p.formatted.count(chat.TURN) == p.formatted.count(chat.END) for p in parts)


def test_nothing_and_unknown_kinds(spark):
    none = spark.createDataFrame([], LOG)
    assert chat.digests(chat.render(chat.fold(none))).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 1, "shout", 0, "user", "x")], LOG)).collect()
    only = spark.createDataFrame([(1, 1, "delta", 0, "user", "x"), (1, 2, "regenerate", 0, "user", None)], LOG)
    assert chat.fold(only).count() == 0


def test_query(spark):
    from tracewright.llm.queries import QUERIES
    got = {r.conv_id: r for r in QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(text) and got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[-7].n_turns == 2
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id] = turns.get(r.conv_id, "") + f"{r.role}\n{r.text or ''}\n"
    assert all(got[k].turns_sha256 == hashlib.sha256(v.encode()).hexdigest() for k, v in turns.items())
