"""Conversation repair against a plain forward recursion and, for few rows, all edits."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from chronoweave.llm import conversation_repair as repair

GOAL = re.compile(r"(s?(ua)+)?")


def forward(codes):
    """(cost, audit) by keeping the best edits for each place and ending of the roles."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for roles, (cost, audit) in list(best.items()):
                new = "a" if roles[-1:] == "u" else "u"
                best[new] = min(best.get(new, (10**9, "")), (cost + 2, audit + "I"))
        return best

    for initial, must_go, truncated in codes:
        after = {}
        for roles, (cost, audit) in inserted(best).items():
            options = [(roles, cost + 3, audit + "D")]
            if not must_go:
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
                options += [(initial, cost + truncated, audit + "K")] if initial and initial in legal else []
                options += [(legal[-1], cost + 2 + truncated, audit + "R")]
            for to, *value in options:
                after[to] = min(after.get(to, (10**9, "")), tuple(value))
        best = after
    best = inserted(best)
    return min(best[x] for x in ("", "a") if x in best)


def every(codes):
    """(cost, audit) of all edits with at most two insertions in a row."""
    found = []
    for edits in product("DKR", repeat=len(codes)):
        for gaps in product(range(3), repeat=len(codes) + 1):
            cost, audit, roles, good = 2 * sum(gaps), "", "", True
            for k in range(len(codes) + 1):
                for _ in range(gaps[k]):
                    roles += "a" if roles[-1:] == "u" else "u"
                    audit += "I"
                if k < len(codes):
                    initial, must_go, truncated = codes[k]
                    audit += edits[k]
                    cost += {"D": 3, "K": truncated, "R": 2 + truncated}[edits[k]]
                    good = good and (edits[k] == "D" or not must_go)
                    roles += {"D": "", "K": initial or "?", "R": "a" if roles[-1:] == "u" else "u"}[edits[k]]
            if good and GOAL.fullmatch(roles):
                found.append((cost, audit))
    return min(found)


def test_search_is_optimal():
    rng = np.random.default_rng(1)
    codes = [("suax"[k % 4], k % 12 >= 10, k % 3 == 0) for k in range(24)]
    for _ in range(60):
        own = [codes[k] for k in rng.integers(0, 24, rng.integers(0, 5))]
        assert repair.search(own) == every(own) == forward(own)
    for n in (8, 40, 400):
        for share in (0.05, 0.5):
            for _ in range(40 if n < 400 else 6):
                own = [("ua"[k % 2] if rng.random() > share else "suax"[rng.integers(0, 4)], rng.random() < 0.1, rng.random() < share) for k in range(n)]
                assert repair.search(own) == forward(own)
    for own in ([("u", False, True)] * 1500, [("a", False, False), ("u", False, False)] * 700, [("s", False, False)] * 900, [("x", True, False)] * 2000):
        assert repair.search(own) == forward(own)


def test_bounds_never_exceed_the_cost():
    rng = np.random.default_rng(2)
    for _ in range(300):
        own = [("suax"[rng.integers(0, 4)], rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.integers(1, 7))]
        for ends in repair.STATES:
            bounds = repair.Bounds(own, ends)
            for place in range(len(own)):
                for entry in repair.STATES:
                    found = repair.search(own[place:], entry, ends, False)
                    assert found is None or bounds.of(place, entry) <= found[0]


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        out += [(conv_id, turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    return out


def brute(rows):
    hurt, found = damaged(rows), []
    for conv_id in {x[0] for x in rows}:
        own = sorted((x for x in hurt if x[0] == conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))
        codes, seen, faults = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            held = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else None
            if fault:
                faults[fault] += 1
            seen.add((role, text))
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = forward(codes)
        lines, row, last = [], 0, ""
        for edit in audit:
            role = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
            elif edit != "D":
                role = own[row][2] if edit == "K" else role
                lines.append(f"{role}:{own[row][3]}")
            last = role[0] if edit != "D" else last
            row += edit != "I"
        turns = [x[1] for x in own if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(codes, codes[1:]))
        found.append((conv_id, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df):
    rows = [tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()]
    found = repair.repair(repair.damage(df)).select(*COLUMNS).collect()
    assert sorted((tuple(x) for x in found), key=str) == brute(rows)


def odd(spark):
    data = [(None, None, None, None), (None, 3, "user", "Hi."), (None, None, "", "x"), (7, None, "user", "a."), (7, None, "user", "a."), (7, 1, "assistant", "b")]
    data += [(8, 2, "système", "é. \t\n"), (8, 9, "user", "\n"), (9, 5, "User", "Q?"), (-1, -4, "assistant", "z!"), (-1, 2**40, "user", "y" * 300_000)]
    data += [(100 + k, 1, "user", "only.") for k in range(40)] + [(60, k, "assistant", "same.") for k in range(30)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_conversations(spark):
    compare(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").repartition(3))
    compare(odd(spark))
    assert repair.repair(repair.damage(odd(spark).limit(0))).count() == 0


@pytest.mark.parametrize("chunk", [3, 50])
def test_long_conversations_in_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(repair, "LONG_ROWS", 20)
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(chunk)
    role = lambda: ["system", "user", "assistant", "tool", "user", "assistant"][rng.integers(0, 6)]
    data = [(None if c == 3 else c, int(k) if k % 9 else None, role(), f"t{rng.integers(0, 60)}" + ".?! x"[rng.integers(0, 5)]) for c in range(5) for k in range(rng.integers(100, 300))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").unionByName(odd(spark))
    compare(df.repartition(4))
