"""Operators 3, 5, 6, 8 and 10 against brute force, laws and held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesspark.llm import mixing, neighbours, quality, sharding, warc
from salesspark.llm.common import shared_folder
from salesspark.llm.files import file_system

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- sharding

def test_shards_keep_the_law(docs_of):
    rnd = random.Random(1)
    texts = ["w " * rnd.randint(0, 300) + str(rnd.randint(0, 700)) for _ in range(2000)] + ["copy me " * 20] * 1000 + [None, "", "x " * 90_000]
    rows = sharding.shard(docs_of(texts, "shard"), items=256, bucket_rows=50).collect()
    assert len(rows) == len(texts)
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[t].add(r["shard"])
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 8
    assert max(size.values()) - min(size.values()) <= 0.02 * mean + 180_001  # the longest text can't be cut
    assert all(len(h) == 1 for t, h in homes.items() if t != b"copy me " * 20)  # the copies are more than a shard's share


def test_even_sizes_without_a_giant(docs_of):
    rnd = random.Random(2)
    rows = sharding.shard(docs_of(["a" * rnd.randint(1, 900) + str(i) for i in range(3000)]), bucket_rows=100).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 0.005 * sum(size.values()) / 8


def test_packing_follows_the_residual_capacity():
    v = np.array([[0.5, 0.0, 0.25], [0.0, 0.5, 0.25], [0.5, 0.0, 0.25], [0.0, 0.5, 0.25]])
    at = sharding.pack(v, 2)
    assert sorted(np.bincount(at)) == [2, 2] and at[0] != at[2] and at[1] != at[3]


def test_only_groups_beyond_a_shards_share_are_cut(docs_of):
    """A third of all rows is one text without id, and three texts have a ninth of the bytes each, in many copies."""
    rnd = random.Random(3)
    rows = [(None, "hot text " * 30, "s")] * 1000 + [(i, f"group {i % 3} " * 20, "s") for i in range(1100)] + \
        [(i, "x" * rnd.randint(1, 200) + str(i), "s") for i in range(900)]
    size, homes, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in sharding.shard(docs_of(rows), bucket_rows=100).collect():
        size[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    hot = zlib.crc32(b"hot text " * 30)
    assert len(homes[hot]) > 4 and all(len(h) == 1 for crc, h in homes.items() if crc != hot)
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_to_cut():
    assert sharding.groups_to_cut(np.array([[0.3, 0, 0], [0.2, 0, 0], [0.05, 0, 0]]), 4).tolist() == [True, False, False]
    assert not sharding.groups_to_cut(np.full((8, 3), 1 / 8), 8).any() and sharding.groups_to_cut(np.zeros((0, 3)), 8).size == 0
    assert sharding.groups_to_cut(np.full((9, 3), 0.1), 8).sum() == 1


def test_packing_against_plain_loops(monkeypatch):
    monkeypatch.setattr(sharding, "even_out", lambda vectors, at, shards: at)
    rnd = random.Random(5)
    for _ in range(20):
        items = [[rnd.randint(1, 9) / 64 for _ in range(3)] for _ in range(30)]
        load, want = [[0.0] * 3 for _ in range(5)], [0] * 30
        for i in sorted(range(30), key=lambda i: -max(items[i])):
            gain = [sum((0.2 - load[s][m]) * items[i][m] for m in range(3)) for s in range(5)]
            want[i] = max(range(5), key=lambda s: (round(gain[s], 12), -s))
            load[want[i]] = [a + b for a, b in zip(load[want[i]], items[i], strict=True)]
        assert np.round(np.bincount(sharding.pack(np.array(items), 5), weights=[x[0] for x in items], minlength=5), 9).tolist() == \
            [round(sum(items[i][0] for i in range(30) if want[i] == s), 9) for s in range(5)]


def test_shard_repeats_nulls_and_empty_table(spark, docs_of):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    assert len(rows) == 3 and len({(r["shard"], r["slot"]) for r in rows}) == 3
    assert sharding.shard(docs_of(["x"]).limit(0)).count() == 0


# ---------------------------------------------------------------- mixing

def test_rows_without_id_or_of_one_id_spread_over_leaves(spark, monkeypatch):
    rows = [(None, "one two three", "s")] * 1500 + [(7, "four five", "s")] * 1500 + [(i, "w " * (i % 9), "s") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    largest, level = [], mixing._level

    def watched(rows, *rest):
        largest.append(rows.groupBy("s_idx", "leaf").count().agg(F.max("count")).first()[0])
        return level(rows, *rest)

    monkeypatch.setattr(mixing, "_level", watched)
    got = mixing.mix(docs, leaf_rows=100)
    assert got.count() == 4500 and largest[0] < 250
    assert sum(r["size"] * r["copies"] for r in got.collect()) == pytest.approx(1.5 * (4500 + 3000 + sum(i % 9 for i in range(1500))), rel=0.01)
    monkeypatch.setattr(mixing, "PART", 7)
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.take_copies(docs, leaf_rows=100).collect())
    taken = Counter()
    for r in got.collect():
        taken[r["doc_id"], r["size"]] += r["copies"]
    assert mixed[None, "one two three"] == taken[None, 3] and mixed[7, "four five"] == taken[7, 2]
    assert sum(mixed.values()) == sum(taken.values())


def _water_fill(sizes, share=1.5, cap=2.0):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mix_meets_targets(docs_of):
    rnd = random.Random(3)
    names = ["b", "a", None, "é", "Z", "hot"]
    rows = []
    for i in range(6000):
        source = "hot" if i % 3 == 0 else rnd.choice(names)
        rows.append((i, "w " * rnd.randint(0, 40), source))
    docs = docs_of(rows, "size")
    got = mixing.mix(docs, leaf_rows=64).collect()
    order = ["Z", "a", "b", "hot", "é", None]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    target = dict(zip(order, _water_fill([size[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        rate = target[r["source"]] / size[r["source"]]
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02), s
    again = mixing.mix(docs.repartition(7), leaf_rows=64).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_rounding_keeps_the_sum_and_is_fair():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50):
        p = rng.random(n)
        out, left = mixing.pair_off(p, (1, n))
        assert out.sum() == pytest.approx(p.sum()) and ((out == 0) | (out == 1)).sum() >= n - 1
        assert left < 0 or 0 < out[left] < 1
    for k in range(50):  # sums that come to a whole number but for rounding errors
        out, left = mixing.pair_off(np.full(50, 0.1 + k / 100), (2, k))
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
    p = np.array([0.3, 0.6, 0.8, 0.1])
    hits = np.mean([np.where(mixing.pair_off(p, (k,))[0] >= 1 - 1e-9, 1.0, mixing.pair_off(p, (k,))[0]) for k in range(4000)], axis=0)
    assert hits == pytest.approx(p, abs=0.03)


def test_mix_copies_rows(spark, docs_of):
    rows = [(i % 50, f"some words here {i % 50}", f"s{i % 4}") for i in range(200)] + [(None, None, None), (7, "", "s9")]
    docs = docs_of(rows, "copies")
    out = mixing.take_copies(docs)
    assert out.columns == docs.columns
    taken = Counter((r["doc_id"], r["source"]) for r in out.collect())
    wanted = Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["doc_id"], r["source"]] += r["copies"]
    assert {k: v for k, v in taken.items()} == {k: v for k, v in wanted.items() if v}
    assert mixing.take_copies(docs.limit(0)).count() == 0
    empty = docs_of([(1, None, "a"), (2, "", "b")])
    assert [r["target"] for r in mixing.mix(empty).collect()] == [0.0, 0.0]


# ---------------------------------------------------------------- neighbours

def _nearest(ids, x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[np.array(ids) == ids[i]] = np.inf
    return [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * 3 + 1
    x = (centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 32))).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<float>, at int")
    got = defaultdict(list)
    for r in neighbours.nearest(rows, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hit = 0
    for q in range(0, 3000, 100):
        want = _nearest(list(range(3000)), x, q, 10)
        assert [r[2] for r in got[q]] == list(range(1, 11)) and [r[1] for r in got[q]] == sorted(r[1] for r in got[q])
        assert all(s == pytest.approx(np.linalg.norm(x[v] - x[q]), abs=1e-12) for v, s, _ in got[q])
        hit += len({r[0] for r in got[q]} & {w[0] for w in want})
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("spread", [1e-2, 1e-6])
def test_neighbours_within_a_tight_group(spark, spread):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x[::3] = x[0] + spread * rng.standard_normal((1000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(rows, lambda i: i % 60 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = sum(len(got[q] & {w[0] for w in _nearest(list(range(3000)), x, q, 10)}) for q in range(0, 3000, 60))
    assert hit >= 0.9 * 500


def test_neighbours_ties_and_invalid_vectors(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot, "x") for i in range(400)] + [(400 + i, [float(i), 0.5, -1.0], "x") for i in range(50)]
    rows += [(500, None, "x"), (600, [], "x"), (700, [0.0, 0.0, 0.0], "x"), (800, [1.0, None, 2.0], "x"),
             (900, [1.0, float("nan"), 2.0], "x"), (1000, [1.0, float("inf"), 2.0], "x"), (1100, [1.0], "x"), (None, hot, "x"),
             (200, hot, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 400}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[200] == [(i, 0.0) for i in range(10)]
    d0 = float(np.linalg.norm(np.array([0.0, 0.5, -1.0]) - np.array([1.0, 0.5, -1.0])))
    assert got[400][0] == (401, pytest.approx(d0)) and len(got[400]) == 10


def test_neighbours_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in neighbours.nearest(few, lambda i: i % 100 == 0).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1)]
    assert neighbours.nearest(few.limit(0), lambda i: i % 100 == 0).count() == 0


def test_hilbert_places_are_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    keys = neighbours.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(64))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_bytes_are_the_same_places():
    cells = np.random.default_rng(7).integers(0, 8, (500, 16))
    assert np.argsort(neighbours.hilbert_bytes(cells, 3)).tolist() == np.argsort(neighbours.hilbert_keys(cells, 3)).tolist()


# ---------------------------------------------------------------- WARC

def _b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archives_round_trip(spark, min_bytes, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    big = "é<p>" * 9000
    pages = [(5, "http://a/ b", "same payload"), (3, None, "same payload"), (9, "u\r\nx", None), (10, "u", ""), (11, "u", big), (12, "v", big),
             (13, "w", "0\r\n\r\nWARC/1.1\r\n"), (14, "x", "tiny"), (15, "y", "tiny"), (14, "x", "tiny"), (None, "z", "same payload")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, block string")
    files = warc.write_archives(df, shared_folder(spark, "test-warc"), min_bytes=min_bytes, segment_bytes=1000)
    responses, revisits = warc.read_archives(spark, files)
    full = sorted((r["page_id"] or -1, bytes(r["payload"]).decode(), r["digest"]) for r in responses.collect())
    again = sorted(r["page_id"] for r in revisits.collect())
    if min_bytes:
        assert again == [5, 12]
    else:
        assert again == [5, 10, 12, 15]
    wanted = sorted((p[0] or -1, p[2] or "", _b32((p[2] or "").encode())) for p in pages if p[0] not in again)
    assert full == wanted
    names = {r["record_id"]: r["page_id"] for r in responses.collect()}
    assert {r["page_id"]: names[r["refers_to"]] for r in revisits.collect()}[12] == 11


def test_broken_segments_are_errors(spark):
    members = warc.page_records(1, "u", b"x" * 5000, _b32(b"x" * 5000), None, segment_bytes=1000)
    folder = shared_folder(spark, "test-broken")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def read(parts):
        with fs.open_output_stream(f"{path}/a.warc.gz") as f:
            f.write(b"".join(parts))
        files = spark.createDataFrame([(f"{folder}/a.warc.gz",)], "uri string")
        return [bytes(r["payload"]) for r in warc.read_archives(spark, files)[0].collect()]

    assert read(members[::-1]) == [b"x" * 5000]  # order in the file does not matter
    for bad in (members[:-1], members[:2] + members[3:]):
        with pytest.raises(Exception, match="segments are missing"):
            read(bad)


def test_chunks():
    assert warc.dechunked(b"4;ext=1\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia"
    assert warc.dechunked(warc.chunked(b"")) == b"" and warc.dechunked(warc.chunked(b"ab" * 9000)) == b"ab" * 9000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    responses, revisits = warc.read_archives(spark, warc.write_archives(df, shared_folder(spark, "test-no-pages")))
    assert responses.count() == 0 and revisits.count() == 0


# ---------------------------------------------------------------- quality

def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    weights = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    rows = quality.scored(docs.select("doc_id", "text"), weights).join(labels.filter(quality.held_out(F.col("doc_id"))), "doc_id").collect()
    right = np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in rows])
    assert len(rows) > 50 and right >= 0.95
    good = [r["score"] for r in rows if r["quality"]]
    bad = [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_classifier_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c", "x"), (4, "!! ## $$ " * 5000, "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (4, None), (2, 7), (None, 1)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    got = {r["doc_id"]: r["p"] for r in quality.scored(docs, weights, out="p").collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4] and all(0 <= p <= 1 for p in got.values())
    none = quality.train(docs, labels.limit(0))
    assert {r["p"] for r in quality.scored(docs, none, out="p").collect()} == {0.5}
    assert quality.scored(docs.limit(0), weights, out="p").count() == 0


def test_held_out_is_the_crc_rule(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
