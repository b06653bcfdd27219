"""Operator 11 against a search over all edits, and its hard rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from salesspark.llm import turn_repair as T

EMPTY = hashlib.sha256(b"").hexdigest()


def search(codes):
    """Cost and audit string of the best of all edits with at most three inserts in a gap."""
    best = [None]

    def go(i, roles, cost, audit, inserts):
        if not re.fullmatch("(s?(ua)*u?)?", roles) or best[0] is not None and cost > best[0][0]:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles) and (best[0] is None or (cost, audit) < best[0]):
            best[0] = (cost, audit)
        if inserts < 3:
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I", inserts + 1)
        if i < len(codes):
            kind, fault = divmod(int(codes[i], 16), 4)
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                go(i + 1, roles + "suax"[kind], cost + more, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_integer_program_is_the_best_of_all_edits_also_in_pieces():
    rng = random.Random(5)
    for _ in range(250):
        codes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(6)))
        want = search(codes)
        assert T.cheapest(codes) == want
        for cut in range(1, len(codes)):
            assert T.combined([T.transfer(codes[:cut]), T.transfer(codes[cut:])]) == want
        ops = T.operations(codes, want[1])
        assert len(ops) == len(codes) and sum(map(len, ops)) == len(want[1]) - (0 if codes else len(want[1]))


def test_pieces_of_long_conversations():
    rng = random.Random(6)
    codes = "".join(rng.choice("0456789a3") for _ in range(300))
    assert T.combined([T.transfer(codes[i:i + 64]) for i in range(0, 300, 64)]) == T.cheapest(codes)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k string, at int")


def plain(rows):
    """The repair of each conversation in plain Python, for rows as they are after the damage."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text, turn))
    out = {}
    for conv, own in by.items():
        own.sort()
        codes, seen = "", set()
        for _, _, role, _, text, _ in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            codes += "0123456789abcdef"[4 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault]
        cost, audit = T.cheapest(codes)
        lines, i, state = [], 0, ""
        for letter in audit:
            wanted = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(f"{wanted}:")
            else:
                role, text = own[i][2], own[i][4]
                i += 1
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else wanted}:{text}")
            state = lines[-1][0]
        turns = [r[5] for r in own if r[5] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *T.counts(codes), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_hard_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 5, "user", "cut off"),
            (2, None, "system", "Be kind."), (2, 0, "user", None), (2, 1, None, "What?"), (3, 0, "user", ""), (4, 0, "", "no role."),
            (None, 0, "user", "No id."), (None, None, "assistant", "First."), (5, 3, "user", "word " * 100_000),
            (6, 2, "tool", "x."), (6, 2, "assistant", "Same turn."), (6, 2, "assistant", "Another.\n ")]
    got = {r["conv_id"]: tuple(r)[1:] for r in T.repair(rows_of(spark, rows)).collect()}
    assert got == plain(rows)
    assert got[3] == (0, 1, 0, 0, 0, 4, "D", EMPTY)
    assert T.repair(rows_of(spark, [])).count() == 0


def test_one_conversation_holds_most_rows_and_spans_segments(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "Two", f"No {i}.", f"No {i}", " "]))
            for i in range(700)] + [(c, i, "user" if i % 2 == 0 else "assistant", f"{c} {i}.") for c in range(2, 40) for i in range(4)]
    got = {r["conv_id"]: tuple(r)[1:] for r in T.repair(rows_of(spark, rows), segment_bits=4).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("conv, turn", [(1, 0), (None, 3), (7, None)])
def test_damage(spark, conv, turn):
    import zlib

    fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    got = [tuple(r) for r in T.damaged(rows_of(spark, [(conv, turn, "assistant", "A. b?")])).collect()]
    text, role = ("" if fate == 1 else "A b" if fate == 2 else "A. b?"), "user" if fate == 4 else "assistant"
    assert got == [] if fate == 0 else got == [(conv, turn, role, text)] * (2 if fate == 3 else 1)


def test_conversations_without_rows_left(spark):
    rows = rows_of(spark, [(1, 0, "user", "a"), (2, 0, "user", "Hi.")])
    got = {r["conv_id"]: tuple(r)[1:] for r in T.repair(rows.filter(F.lit(False)), ids=rows).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", EMPTY), 2: (0, 0, 0, 0, 0, 0, "", EMPTY)}
