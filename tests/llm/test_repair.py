"""Conversation repair against a dynamic program over (cost, audit) pairs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from framescope.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, cost double, mid string, rel int"
SF = "/root/testdata/sf0.01"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, repaired lines): states are what the next row must be."""
    seen, kinds, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            counts[kind] += 1
    # best[q]: from row i on, q: 0 nothing yet, 1 after system, 2 user is open, 3 answered
    best = {0: (0, "", ()), 3: (0, "", ())}
    best[2] = (5, "I", ("assistant:",))
    best[1] = (10, "II", ("user:", "assistant:"))
    for (role, text), kind in zip(reversed(rows), reversed(kinds)):
        more, now = 5 * (kind == "truncated"), {}
        for q in range(4):
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if kind not in ("blank", "duplicate"):
                due, name = (3, "assistant") if q == 2 else (2, "user")
                for to, ok, c, op, r in ((1, role[:1] == "s" and q == 0, 0, "K", role), (due, role[:1] == name[0], 0, "K", role),
                                         (due, True, 1, "R", name)):
                    if ok:
                        ways.append((best[to][0] + c + more, op + best[to][1], (f"{r}:{text}",) + best[to][2]))
            now[q] = ways
        for _ in range(4):  # insertions before this row: states lead to one another
            for q in range(4):
                due, name = (3, "assistant:") if q == 2 else (2, "user:")
                c, a, lines = min(now[due])
                now[q].append((c + 5, "I" + a, (name,) + lines))
        best = {q: min(now[q]) for q in range(4)}
    return counts, best[0]


def brute(rows):
    out = {}
    damaged = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marks = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        counts, (cost, audit, lines) = cheapest([(r[2], r[3]) for r in mine])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def answers(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                           r["repaired_sha256"]) for r in df.collect()}


def random_rows(seed, conversations, longest):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "s", "a"]
    texts = ["Fine.", "And so on", "What?", "", " \n", None, "Yes! ", "no end \t", "é日本。", "x."]
    return [(c if c else None, rnd.choice([t, t, t, rnd.randrange(5), None]), rnd.choice(roles[:2] * 4 + roles),
             rnd.choice(texts[:4] * 2 + texts + [f"Line {t}.", f"line {t}"]))
            for c in range(conversations) for t in range(rnd.randrange(1, longest))]


@pytest.mark.parametrize("segment, seed, conversations, longest", [(64, 1, 60, 9), (2, 2, 25, 12), (4, 3, 4, 90), (2, 4, 2, 40)])
def test_repair_equals_brute_force(spark, monkeypatch, segment, seed, conversations, longest):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    rows = random_rows(seed, conversations, longest)
    df = spark.createDataFrame([r + (1.0, "m", 2) for r in rows], SCHEMA).repartition(5)
    assert answers(dialogue.audited(df)) == brute(rows)


def test_given_conversations_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert answers(dialogue.audited(df)) == brute(rows)


def test_one_repeated_row_and_one_dropped_conversation(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 > 4)
    rows = [(9, gone, "user", "Hi.")] + [(3, kept, "user", "Hello.")] * 500
    got = answers(dialogue.audited(spark.createDataFrame([r + (1.0, "m", 2) for r in rows], SCHEMA)))
    assert got == brute(rows)
    assert got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[3][6] in ("K" + "D" * 499 + "I", "D" * 500)


def test_repair_of_an_empty_table(spark):
    assert dialogue.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_auction_prices_are_dual_feasible_and_exact():
    rnd = random.Random(7)
    for _ in range(200):
        symbols = "".join(rnd.choice("suaoSUAO") for _ in range(rnd.randrange(0, 12)))
        arcs = dialogue.closed(dialogue.row_lattice(symbols), dialogue.END)
        prices = [0] * len(arcs)
        for origin in range(4):
            cost = dialogue.auction(arcs, prices, origin)
            far = [10 ** 9] * len(arcs)
            far[-1] = 0
            for _ in arcs:
                far = [min([far[u]] + [c + far[v] for _, c, v in arcs[u]]) for u in range(len(arcs))]
            assert cost == far[origin]
        assert all(prices[u] <= c + prices[v] for u, out in enumerate(arcs) for _, c, v in out)


def test_segment_matrices_multiply():
    rnd = random.Random(3)
    for _ in range(50):
        parts = ["".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randrange(1, 5))) for _ in range(4)]
        whole = dialogue.matrix("".join(parts))
        assert dialogue.product([dialogue.matrix(p) for p in parts]) == whole
