"""The queries without SQL twin: exact columns, types and digests against plain Python over the whole table; the learner in plain loops;
recall on vectors like the table's; what workers keep."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from salesspark.llm import bpe, kept, neighbours, quality, token_files
from salesspark.llm.ordered import running_by_key

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def rows_of(spark, name, types):
    got = E.queries()[name](spark, SF)
    assert dict(got.dtypes).items() >= types.items()
    return got.collect()


def test_token_files_query(spark, documents):
    rows = rows_of(spark, "op2_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want[d["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(documents)


def test_sharding_query(spark, documents):
    rows = rows_of(spark, "op3_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                           "slot": "bigint", "grown_shard": "int"})
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert {r["law"] for r in rows} == {"bytes"} and set(size) <= set(range(8)) and {r["grown_shard"] for r in rows} == {None}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    share = sum(size.values()) / 8
    assert max(size.values()) - min(size.values()) <= max(0.02 * share, max(map(len, texts.values())) + 1 - share + 0.02 * share)


def test_mixing_query(spark, documents):
    rows = rows_of(spark, "op5_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    source = {d["doc_id"]: d["source"] for d in documents}
    whole, target, taken = Counter(), {}, Counter()
    for i, n in size.items():
        whole[source[i]] += n
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], whole[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        target[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] += r["taken"]
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    left, open_, want = 1.5 * sum(whole.values()), dict(zip(names, (3, 1, 2) * len(names), strict=False)), {}
    while open_:
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * whole[s]]
        for s in over or list(open_):
            want[s] = 2.0 * whole[s] if over else left * open_[s] / sum(open_.values())
        left, open_ = left - sum(want[s] for s in over), {s: w for s, w in open_.items() if over and s not in over}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 2 * max(n for i, n in size.items() if source[i] == s) for s in names)
    assert sorted(map(tuple, E.queries()["op5_mixing"](spark, SF).collect())) == sorted(map(tuple, rows))


def test_bpe_query(spark, documents):
    rows = rows_of(spark, "op7_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for d in documents:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want


def test_neighbours_query(spark):
    rows = rows_of(spark, "op6_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    table = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hit = 0
    for q in (i for i in table if i % 100 == 0):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        d = sorted((math.dist(table[q], v), i) for i, v in table.items() if i != q)[:10]
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        assert all(r["score"] == pytest.approx(math.dist(table[q], table[r["vec_id"]]), abs=1e-12) for r in own)
        hit += len({r["vec_id"] for r in own} & {i for _, i in d})
    assert hit >= 0.9 * 10 * sum(i % 100 == 0 for i in table)


def test_recall_on_isotropic_vectors(spark):
    """Vectors like the table's, 64 directions alike, and so many that the window is its share of the rows."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((5000, 64)) / 8
    assert neighbours.WINDOW_SHARE * len(x) > neighbours.LEAST_WINDOW
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in neighbours.nearest(rows, lambda i: i % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 5000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 500


def test_batches_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((800, 8)))], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.nearest(rows, lambda i: i % 4 == 0).collect()))
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    assert sorted(map(tuple, neighbours.nearest(rows, lambda i: i % 4 == 0).collect())) == whole


def test_quality_query(spark, documents):
    rows = rows_of(spark, "op10_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(held) >= 0.9


def test_learner_in_plain_loops(monkeypatch):
    """Follow the regularised leader, coordinate by coordinate, as it is published; and the mean of the parts."""
    monkeypatch.setattr(quality, "DIMS", 16)
    rng = random.Random(1)
    rows = []
    for _ in range(30):
        at = sorted(rng.sample(range(16), 4)) + [16]
        rows.append((np.array(at), np.array([rng.random() for _ in at[:-1]] + [1.0]), float(rng.random() < 0.5)))
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, x, y in rows:
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, wi, xi in zip(at, w, x, strict=True):
                g = (p - y) * xi
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * wi
                n[i] += g * g
    assert quality.follow_leader(rows) == pytest.approx([weight(i) for i in range(17)], abs=1e-12)


def test_parts_are_averaged(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 5} good" if i % 2 else f"word{i % 5} !!") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", F.xxhash64(F.lit(1), "doc_id").alias("at")).collect()
    want = []
    for part in range(quality.PARTS):
        own = sorted((r for r in rows if r["at"] % quality.PARTS == part), key=lambda r: r["at"])
        if own:
            want.append(quality.follow_leader([(*quality.sparse(r["text"].encode()), float(r["quality"])) for r in own]))
    assert quality.train(docs, labels) == pytest.approx(np.mean(want, axis=0), abs=1e-12)


def test_kept_entries_have_a_budget():
    made = []
    k = kept.Kept(lambda x: made.append(x) or x * 2, budget=40_000, longest=6)
    words = [f"w{i}" for i in range(3000)]
    assert [k[w] for w in words] == [w * 2 for w in words]
    real = sum(sys.getsizeof(a) + sys.getsizeof(b) for d in (k, k.old) for a, b in d.items()) + sys.getsizeof(k) + sys.getsizeof(k.old)
    assert real < 60_000 and 0 < len(k) + len(k.old) <= 200
    made.clear()
    assert k[words[-1]] == words[-1] * 2 and not made and k["longer key"] == "longer key" * 2 and "longer key" not in k
    k.forget()
    assert not k and not k.old


def test_a_task_gives_back_what_others_have_kept():
    kept.working_for("quality")
    quality.places(b"some words are kept here")
    assert quality._TOKENS
    kept.working_for("quality")
    assert quality._TOKENS  # the same operator's next task finds them
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        bpe.codec_of(f.read())
    kept.working_for("token_files")
    assert not quality._TOKENS and not bpe._CODECS and not token_files._ENCODERS


def test_running_by_key_spreads_a_hot_key(spark):
    rows = [("hot", i, i % 5) for i in range(3000)] + [(f"k{i % 40}", i, i % 3) for i in range(900)] + [("one", 1, 7)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = running_by_key(df, "k", [F.col("i")], {"upto": "v"}, place="nth")
    assert got.columns == ["k", "i", "v", "upto", "nth"]
    seen = defaultdict(list)
    for r in got.collect():
        seen[r["k"]].append((r["i"], r["v"], r["upto"], r["nth"]))
    for own in seen.values():
        own.sort()
        assert [r[3] for r in own] == list(range(1, len(own) + 1)) and [r[2] for r in own] == np.cumsum([r[1] for r in own]).tolist()
    assert len(seen["hot"]) == 3000
