"""Operator 13 against plain Python, with long, repeated and empty conversations."""

import hashlib
import random
import zlib

from salesspark.llm import prefix_trie as T
from salesspark.llm.common import settled

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block string, n string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    paths = {}
    for c in own:
        own[c].sort()
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = [(r[2], r[4]) for r in own.get(base, [])[:h] + own[c][h:]]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for head in nodes:
        if head:
            kids.setdefault(head[:-1], []).append(head)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for head, members in nodes.items():
        for d in range(len(head) + 1):
            leaves[head[:d]] += head not in kids
            saved[head[:d]] += (len(members) - 1) * len(head[-1][1].encode()) if head else 0
    return sorted((min(m), len(h), min(nodes[h[:-1]]) if h else -10**9, len(m), len(kids.get(h, [])), leaves[h], saved[h],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(h)))).encode()).hexdigest())
                  for h, m in nodes.items())


def found(spark, rows):
    convs, turns = T.rebuilt(settled(T.turn_ids(rows_of(spark, rows))))
    got = T.trie(settled(convs), turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-10**9 if v is None else v for v in r) for r in got.collect())


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü" * 3, None, ""]))
            for c in range(-12, 60) for t in range(rng.randrange(1, 12))]
    assert found(spark, rows) == plain(rows)


def test_long_and_repeated_conversations(spark):
    """Several column blocks, one conversation with a third of all rows, and 150 copies of one with the same beginning."""
    rng = random.Random(4)
    rows = [(5, t, "user", f"{t % 7}") for t in range(600)] + [(6, t, "user", f"{t % 7}") for t in range(300)]
    rows += [(1000 + 5 * i, t, "user", f"same {t}") for i in range(150) for t in range(3)]
    rows += [(c, t, "user", rng.choice("01")) for c in range(20, 60, 5) for t in range(rng.randrange(7, 30))]
    assert found(spark, rows) == plain(rows)


def test_hard_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (0, 3, None, None),
            (7, 0, "user", "x" * 300_000), (7, 0, "assistant", "tie"), (-3, 0, "user", "minus"), (10, 0, "user", "a,b")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "x")]) == []
