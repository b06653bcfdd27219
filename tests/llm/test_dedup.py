"""Operators 1, 4 and 9 against brute force, with nulls, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesspark.llm import exact_dedup, line_dedup, near_dup

WS = " \t\n\x0b\x0c\r"


def _low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ---------------------------------------------------------------- lines

def _kept_lines(texts, min_docs, keep_first):
    keys = [[_low(line.strip(WS)) for line in (t or "").split("\n")] for t in texts]
    docs = Counter(k for ks in keys for k in set(ks) if k)
    seen, out = set(), []
    for t, ks in zip(texts, keys, strict=True):
        lines = []
        for line, k in zip((t or "").split("\n"), ks, strict=True):
            drop = k and docs[k] >= min_docs and not (keep_first and k not in seen)
            seen.add(k)
            if not drop:
                lines.append(line)
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("extra", ["h1", "keep", "row"])
def test_lines_against_brute_force(docs_of, keep_first, extra):
    rnd = random.Random(4)
    shared = ["Home | About", "  home | ABOUT\t", "cookie notice", "É é", "\x0b\x0c", "x"]
    texts = ["\n".join(rnd.choice(shared + [f"own {i}"]) for _ in range(rnd.randint(0, 9))) for i in range(60)]
    texts += [None, "", "\n", "\n\n", "cookie notice\n" * 200 + "end", "\n".join(f"l{k % 70}" for k in range(500))]
    docs = docs_of(texts, extra)
    out = line_dedup.drop_repeated_lines(docs, min_docs=3, keep_first=keep_first)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    for i, want in enumerate(_kept_lines(texts, 3, keep_first)):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want), i


def test_line_bitmaps_are_compressed_and_count(docs_of):
    texts = ["\n".join(["same"] + [f"a{i}-{k}" for k in range(200)]) for i in range(4)]
    docs = docs_of(texts)
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=4, keep_first=False).collect()
    assert all(r["n_dropped"] == 1 and r["keep"] == {0: -2} for r in bitmaps)  # one word of four; bit 0 is off


def test_lines_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (None, "a\nd"), (2, "a\ne")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=3, keep_first=False))
    got = sorted((r["row"]["doc_id"] or 0, r["kept"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == [(0, "c", 2, 1), (0, "d", 2, 1), (1, "b", 2, 1), (1, "b", 2, 1), (2, "e", 2, 1)]


def test_line_hot_key(docs_of):
    texts = ["hot" if i % 3 else f"own {i}\nhot" for i in range(600)]
    out = line_dedup.drop_repeated_lines(docs_of(texts), min_docs=10, keep_first=False).collect()
    assert Counter(r["text"] for r in out)[""] == 400


# ---------------------------------------------------------------- exact

def test_more_salts_change_nothing(docs_of, monkeypatch):
    texts = [f"hot line\nline {i % 7}\n{i}\nhot line" for i in range(60)] + [None, ""]
    want = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(docs_of(texts), min_docs=3).collect())
    monkeypatch.setattr(line_dedup, "ROWS_A_SALT", 1)
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(docs_of(texts), min_docs=3).collect()) == want


def test_exact_against_brute_force(docs_of):
    rnd = random.Random(9)
    base = ["alpha beta", "alpha  beta", "alphabeta ", "gamma", None, "", " \n\t", "é", "é", "gamma "]
    texts = [rnd.choice(base) for _ in range(300)] + ["z" * 200_000, "z" * 200_000 + " "]
    got = {r["doc_id"]: r for r in exact_dedup.dedup_table(docs_of(texts, "digest"), ).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups["".join(c for c in (t or "") if c not in WS)].append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
            assert bytes(r["digest"]) == hashlib.sha256(norm.encode()).digest() and r["in_history"]


def test_perfect_hash_is_minimal_and_matches_spark(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    pilots, place = exact_dedup.place_digests(rnd.integers(0, 750, 3000), base, 750)
    assert sorted(place) == list(range(3000))
    rows = spark.range(50).select(F.xxhash64(F.lit("x")).alias("b"), "id", F.xxhash64(F.lit("x"), "id").alias("h")).collect()
    mine = exact_dedup.spark_hash_long(np.array([r["id"] for r in rows], np.uint64), np.array([r["b"] for r in rows], np.int64).view(np.uint64))
    assert mine.view(np.int64).tolist() == [r["h"] for r in rows]


def test_history_and_batch(spark, docs_of):
    history = docs_of(["a b", "a  b", "c"])
    index = exact_dedup.build_index(history, shard_digests=2)
    batch = spark.createDataFrame([(10, "ab"), (11, "new"), (12, "n e w"), (1, "a  b"), (13, None), (13, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["kept"], r["in_history"]) for r in exact_dedup.dedup(batch, index).collect())
    assert got == [(1, 1, True, True), (10, 1, False, True), (11, 12, False, False), (12, 12, True, False), (13, 13, True, False),
                   (13, 13, True, False)]


def test_digests_without_place_group_separately(docs_of):
    base = np.array([5, 5, 7], np.uint64)  # two digests of one bucket with one hash
    _, place = exact_dedup.place_digests(np.array([0, 0, 1]), base, 2)
    assert place[0] == place[1] == -1 and place[2] >= 0


# ---------------------------------------------------------------- near

def _components(texts):
    sets = []
    for t in texts:
        w = _low(t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                at[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def _near_texts(seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 12, 40, 150]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    chain = [rnd.choice(words) for _ in range(120)]  # each alike its neighbour, the ends are not
    for k in range(10):
        texts.append(" ".join(chain[6 * k:6 * k + 60]))
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(25)) for _ in range(120)]
    texts += [None, "", " \n", "one two", "ONE\ttwo", "one two three four", "One two three four five", "one two three four five"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("extra", ["key", "c1", "row"])
def test_near_against_brute_force(docs_of, extra):
    texts = _near_texts()
    want, sizes = _components(texts)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(texts, extra)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_prefix_filter_finds_all_links_between_components(spark):
    texts = [t for t in _near_texts(5) if t and len(t.split()) >= 5]
    words = [near_dup.shingles(near_dup.words_of(t.encode())) for t in texts]
    sets = spark.createDataFrame([(i, w.view(np.int64).tolist()) for i, w in enumerate(words)], "doc long, shingles array<long>")
    none = spark.createDataFrame([], "node long, component long")
    got = {tuple(r) for r in near_dup._between_components(sets, none, 75).collect()}
    kinds = [set(w.tolist()) for w in words]
    want = {(i, j) for j in range(len(texts)) for i in range(j)
            if 100 * len(kinds[i] & kinds[j]) >= 75 * len(kinds[i] | kinds[j])}
    assert want and want <= got and len(got) < 3 * len(want) + 50


def test_near_texts_that_share_an_id(spark):
    """Each text under one doc_id is linked on its own, and a link goes to the class, not to the id."""
    rnd = random.Random(9)
    a, b, c = (" ".join(f"{x}{rnd.randrange(10**6)}" for _ in range(60)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (5, c), (3, a + " end"), (9, b + " end"), (9, c.upper())], "doc_id long, text string")
    found = near_dup.near_duplicates(docs).collect()
    got = sorted((r["doc_id"], r["component_id"], r["kept"], r["class_id"]) for r in found)
    assert got == [(3, 3, True, 3), (5, 3, False, 5), (5, 5, True, 5), (5, 5, True, 5), (9, 5, False, 5), (9, 5, False, 9)]
    assert len({r["component"] for r in found}) == 3 and all(r["component"] is not None for r in found)


def test_near_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (7, text + " end")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (7, 3, False)]


@pytest.mark.parametrize("hubs", [0, 3, 1000])
def test_components_of_random_links_and_hubs(spark, monkeypatch, hubs):
    """Against union-find; two hubs hold most links. With few hubs allowed, most nodes go by the join."""
    monkeypatch.setattr(near_dup, "HUBS", hubs)
    rnd = random.Random(hubs)
    links = [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(150)] + [(7, i) for i in range(100, 250)] + \
        [(390, i) for i in range(250, 350)] + [(12, 12)]
    at = {}

    def find(i):
        while at.setdefault(i, i) != i:
            i = at[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in at if find(i) != i}


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = near_dup.components(links).collect()
    assert {r["component"] for r in rows} == {0} and len(rows) == 200  # the smallest node needs no row


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.drop_repeated_lines(d), lambda d: exact_dedup.dedup_table(d), lambda d: near_dup.near_duplicates(d)])
def test_empty_tables(docs_of, run):
    assert run(docs_of(["x"]).limit(0)).count() == 0
