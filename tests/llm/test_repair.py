"""Conversation repair against a plain search over whole conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from verdictflow.llm import repair

SPACE = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults_of(turns):
    seen, found = set(), []
    for _, role, text in turns:
        if not text.strip(SPACE):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if text.strip(SPACE)[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def cheapest(turns, faults):
    """Least (cost, audit, written) over all edits, state by state: the last role written is all that matters."""
    states = {"": (0, "", ())}

    def offer(to, state, path):
        if state not in to or path[:2] < to[state][:2]:
            to[state] = path

    def added(states):
        to = dict(states)
        for _ in range(2):
            for state, (cost, audit, written) in list(to.items()):
                role = "assistant" if state == "u" else "user"
                offer(to, role[0], (cost + 2, audit + "I", (*written, (role, ""))))
        return to

    states = added(states)
    for (_, role, text), fault in zip(turns, faults, strict=True):
        to = {}
        for state, (cost, audit, written) in states.items():
            offer(to, state, (cost + 3, audit + "D", written))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if (state, role[:1]) in NEXT:
                offer(to, NEXT[state, role[:1]], (cost + late, audit + "K", (*written, (role, text))))
            other = "assistant" if state == "u" else "user"
            offer(to, other[0], (cost + 2 + late, audit + "R", (*written, (other, text))))
        states = added(to)
    return min(states[s] for s in ("", "a") if s in states)


def plain(rows, wanted):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    found = {}
    for conv in wanted:
        turns = sorted(by.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = faults_of(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, written = cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, written)
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, more=(), chunk=repair.CHUNK):
    conversations = spark.createDataFrame([*rows, *[(c, 0, "user", "x") for c in more]], SCHEMA)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = repair.repair(turns, conversations, chunk).collect()
    expected = plain(rows, {r[0] for r in rows} | set(more))
    assert len(found) == len(expected)
    for r in found:
        got = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert got == expected[r.conv_id][:-1], r.conv_id
    return turns, expected


def random_turns(rng, n, long=False):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "usher", "Assistant"]
    texts = ["Fine.", "cut off", "", " \t", "Really?", "half!  ", "é ", "no"] + [f"t{i}." for i in range(40 if long else 4)]
    return [(rng.choice([None, *range(n)]) if not long else i, rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_random_conversations(spark):
    rng = random.Random(17)
    rows = [(c if c else None, *t) for c in range(250) for t in random_turns(rng, rng.randrange(1, 10))]
    check(spark, rows, more=[900, 901])


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_chunks_join_to_the_same_edits(spark, chunk):
    rng = random.Random(chunk)
    rows = [(c, i, role, f"{text}{i}." if rng.random() < 0.7 and text.strip() else text) for c in range(4) for i, role, text in random_turns(rng, 40, long=True)]
    turns, expected = check(spark, rows, chunk=chunk)
    back = defaultdict(list)
    for r in repair.repaired_turns(turns, chunk).collect():
        back[r.conv_id].append((r.n, r.role, r.text))
    for conv, (*_, written) in expected.items():
        assert [(r, t) for _, r, t in sorted(back[conv])] == list(written)
        assert [n for n, _, _ in sorted(back[conv])] == list(range(len(written)))


def test_one_long_conversation_and_runs_of_one_kind(spark):
    rng = random.Random(2)
    runs = {
        1: [("user", f"u{i}") for i in range(120)],  # all truncated
        2: [("system", f"s{i}.") for i in range(90)],
        3: [("user", "same.")] * 150 + [("assistant", "end.")],
        4: [("assistant" if i % 2 else "user", f"ok {i}.") for i in range(200)],
        5: [("", "") for _ in range(60)] + [("system", "late.")],
        6: [(rng.choice(["user", "assistant"]), f"{i}{rng.choice(['.', ''])}") for i in range(300)],
    }
    check(spark, [(c, i, *t) for c, turns in runs.items() for i, t in enumerate(turns)], chunk=16)


def test_numbers_ties_and_gaps(spark):
    rows = [(1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 5, "assistant", "b."), (1, 9, "user", "B."), (2, None, "user", "x."), (None, 3, "user", "n.")]
    check(spark, [*rows, (3, 4, "user", "z."), (3, 4, "assistant", "a."), (4, -(2**63), "user", "a."), (4, -(2**63) + 1, "assistant", "b.")])


def test_damage_follows_the_hash_of_the_place(spark):
    rows = [(c, t, role, text) for c in (1, None, -4) for t in [None, *range(40)] for role, text in [("system", "A. b! c?"), (None, None)]]
    expected = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(draw, text)
        expected += [(c, t, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    key = lambda r: tuple(str(x) for x in r)
    found = repair.damaged(spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, copy int"))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_no_conversations(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(nothing), nothing).collect() == []
    assert repair.repaired_turns(nothing).collect() == []


def test_a_chunk_stops_where_vectors_run_parallel():
    codes = repair.codes_of(["ua" * 200])
    end, other = np.array([repair.END]), np.array([[0, 0, 9, 0]])
    start = repair.levelled(repair.whole_run(codes, other)[0])
    found, turns = repair.fix_up(codes, end, other, start)
    assert (found == repair.levelled(repair.whole_run(codes, end)[0])).all() and turns < 10


def test_fixed_vectors_equal_whole_runs():
    rng = random.Random(9)
    codes = repair.codes_of(["".join(rng.choice("suaxSUAX") for _ in range(rng.randrange(30))) for _ in range(300)])
    ends = [repair.levelled(repair.whole_run(repair.codes_of([rng.choice(["u", "ua", "x", "", "S"]) for _ in range(300)]), np.tile(repair.END, (300, 1)))[0]) for _ in range(2)]
    old = repair.levelled(repair.whole_run(codes, ends[0])[0])
    found, _ = repair.fix_up(codes, ends[1], ends[0], old)
    assert (found == repair.levelled(repair.whole_run(codes, ends[1])[0])).all()
