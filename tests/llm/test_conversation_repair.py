"""Repaired conversations against a cheapest-path search in plain Python, which shares no code with the operator."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from wickflow.llm import conversation_repair as repair

GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows, faults):
    """Dijkstra over (rows used, grammar state) by (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(f"{r}:{x}" for r, x in made)
        roles = [(x, name) for x, name in (("u", "user"), ("a", "assistant")) if (state, x) in GRAMMAR]
        for x, name in roles:
            heapq.heappush(heap, (cost + 2, audit + "I", i, GRAMMAR[state, x], (*made, (name, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if faults[i] in ("", "truncated"):
                role, text = rows[i][1:]
                more = cost + (faults[i] == "truncated")
                if (state, role[:1]) in GRAMMAR:
                    heapq.heappush(heap, (more, audit + "K", i + 1, GRAMMAR[state, role[:1]], (*made, (role, text))))
                for x, name in roles:
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, GRAMMAR[state, x], (*made, (name, text))))


def brute(table):
    convs, out = {}, {}
    for c, t, role, text in table:
        own = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, rows in convs.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            tail = text.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else "")
            seen.add((role, text))
        at = {t for t, *_ in rows if t is not None}
        starts = [r[:1] for _, r, _ in rows]
        cost, audit, text = cheapest(rows, faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        out[c] = (max(at) - min(at) + 1 - len(at) if at else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(spark, folder):
    found = repair.op11_conversation_repair(spark, folder).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(spark, sf) == brute(rows)


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(None, 1, 2, 3, 4, 5, 6), pick(None, *range(30)), pick("user", "assistant", "system", None, "tool", "", "agent", "U"), pick("a b.", "hi", "hello!", " ", None, "", "ok?", "x\ny")) for _ in range(400)]
    return [*rows, (99, 0, None, None), (None, None, None, None), *((7, i, "user" if i % 3 else "assistant", f"t{i % 40}.") for i in range(300)), (8, 1, "user", "word " * 200_000)]


@pytest.mark.parametrize(("most", "chunk"), [(2000, 256), (20, 16), (0, 4), (0, 1)])
def test_odd_turns_in_one_piece_and_in_chunks(spark, tmp_path, monkeypatch, odd_turns, most, chunk):
    spark.createDataFrame(odd_turns, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(repair, "MOST_ROWS", most)
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "BATCH_ROWS", 50)
    assert result(spark, str(tmp_path)) == brute(odd_turns)


def test_turns_of_a_repair(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (2, 0, "user", "Well?")]
    other = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, _conv int")
    got = {r.conv_id: (r.audit, [tuple(t) for t in r.turns]) for r in repair.repair(other).collect()}
    assert got == {1: ("RKD", [("R", "user", "Hi."), ("K", "assistant", "Yes.")]), 2: ("KI", [("K", "user", "Well?"), ("I", "assistant", "")])}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(spark, str(tmp_path)) == {}
