import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.llm import conversations as cv
from tests.llm.helpers import CLASHING

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fate:
            row = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [row] * (2 if fate == 3 else 1)
    return out


def cheapest(turns):
    """Best-first search over whole edit sequences: (cost, audit) in order, so the first end is the answer."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        state = (at, initials[-1:])
        if state in done:
            continue
        done.add(state)
        legal = lambda x: re.fullmatch("s?(ua)*u?", initials + x) is not None  # noqa: E731, B023
        steps = [(2, "I", at, (role, "")) for role in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            steps.append((3, "D", at + 1, None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                steps += [(extra, "K", at + 1, (role, text)), *[(2 + extra, "R", at + 1, (r, text)) for r in ("user", "assistant")]]
        for price, letter, to, turn in steps:
            x = turn[0][:1] if turn else ""
            if turn is None or (x and legal(x)):
                heapq.heappush(heap, (cost + price, audit + letter, to, initials + x, out if turn is None else (*out, turn)))


def brute(rows, search=cheapest):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=order)
        turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role, text, fault))
        known = {r[1] for r in own} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = search(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def write(folder, rows, **extra):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
    made = pa.table(dict(zip(("conv_id", "turn", "role", "text"), columns)))
    for name, value in extra.items():
        made = made.append_column(name, pa.array([value] * len(rows)))
    pq.write_table(made, f"{folder}/conversations.parquet")
    return str(folder)


def found(spark, folder):
    rows = cv.op12_structure_repair(spark, folder)
    assert rows.columns == list(COLUMNS)
    return sorted((tuple(r) for r in rows.collect()), key=repr)


TEXTS = ["Yes.", "No!", "and then", "why?", "", "  \n", None, "é.", "so", "x" * 3000 + ".", "Fine. \t", "ends here. ", "a\nb."]
ROLES = ["user", "assistant", "system", "tool", "", None, "unit", "User"]


def random_rows(rng, conversations, most):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(most + 1)):
            if rng.random() < 0.9:
                role = ROLES[turn % 2] if rng.random() < 0.6 else rng.choice(ROLES)
                text = f"turn {turn}." if rng.random() < 0.6 else rng.choice(TEXTS)
                rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    return rows


def test_equals_a_search_over_edit_sequences(spark, tmp_path):
    rng = random.Random(1)
    rows = random_rows(rng, 250, 7) + [(None, 1, "user", "Who?"), (None, None, None, None), (None, 2, "assistant", "I.")]
    rows += rows[:30]
    assert found(spark, write(tmp_path, rows, **CLASHING)) == brute(rows)


def test_long_conversations_in_segments(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = random_rows(rng, 60, 7) + [(None, t, ROLES[t % 2], rng.choice(TEXTS)) for t in range(9)]
    folder = write(tmp_path, rows)
    whole = found(spark, folder)
    assert whole == brute(rows)
    monkeypatch.setattr(cv, "SHORT", 3)
    assert found(spark, folder) == whole


def test_one_very_long_conversation_equals_itself_repaired_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(TEXTS + [f"t{t}."] * 20)) for t in range(3000)]
    rows += [(5, 7, "user", "the same row.")] * 3000 + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Hi!")]
    folder = write(tmp_path, rows)
    monkeypatch.setattr(cv, "SHORT", 10_000)
    whole = found(spark, folder)
    monkeypatch.setattr(cv, "SHORT", 100)
    assert found(spark, folder) == whole
    docs = cv.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    turns = {}
    for r in sorted(cv.repaired_turns(docs).collect(), key=lambda r: (r.conv_id, r.segment)):
        turns.setdefault(r.conv_id, []).extend(f"{t.role}:{t.text}" for t in r.turns)
    digests = {r[0]: r[-1] for r in whole}
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in turns.items()} == digests


def test_dropped_whole_and_empty_tables(spark, tmp_path, monkeypatch):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")] * 9
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, write(tmp_path, rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    monkeypatch.setattr(cv, "SHORT", 4)
    assert found(spark, str(tmp_path)) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert found(spark, write(tmp_path, [])) == []


def test_walk_takes_the_least_of_equal_costs():
    make = lambda *roles: [cv.Turn(r[:1], False, 0, 1, r, "x.") for r in roles]
    for roles, audit in ((["user"], "KI"), (["assistant"], "IK"), (["user", "user"], "KIKI"), (["system"], "D"), (["user", "tool"], "KR")):
        turns = make(*roles)
        cost, best, _ = cheapest([(t.role, t.text, None) for t in turns])
        values = cv.cost_to_go(turns, cv.END)
        assert (values[0][0], cv.walk(turns, values, 0, True)[0]) == (cost, best)
        if len(roles) == 1:
            assert best == audit
