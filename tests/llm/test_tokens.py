"""Operators 2 and 7 against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesspark.llm import bpe, token_files
from salesspark.llm.common import shared_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "The cat's   pyjamas\n\n ", "naïve Ünïcode, ÉCOLE. İstanbul ΣΑΣ", "<|endoftext|> in<|endoftext|>side",
         "<|startoftext|>x", "中文 and 😀😀", "x" * 3000, " " * 300, "1234567 89", "é ́e", "tab\tnbsp nel\u0085end\x1c", "\r\n\r\n",
         "word " * 20_000]


def _random_texts(n=400):
    rnd = random.Random(8)
    alphabet = "abcdehilnorstu ABCÉé  \n\t'123.,!?-ß中😀 "
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(BYTE, "rb") as f:
        return bpe.Codec(f.read())


def test_automaton_matches_the_library(codec):
    library = Tokenizer.from_file(BYTE)
    for t in TEXTS + _random_texts():
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids, t
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_what_bpe_makes(codec):
    a = codec.automaton
    th, t, h = (a.spelt[x] for x in (b"th", b"t", b"h"))
    assert not a.step(t, h) and a.step(-1, th)


def test_decode_of_strange_ids(codec):
    assert codec.decode(np.array([10**6, 220], "<u4").tobytes()) == " "
    half = codec.encode("é")[:0] + np.array([codec.automaton.spelt[b"\xc3"]], "<u4").tobytes()
    assert codec.decode(half) == "�" and codec.decode(None) == ""


def test_few_steps_are_tried(codec):
    """From a position the longest token comes first, so most positions inside of a token are never tried."""
    asked = []

    class Counted(dict):
        def __missing__(self, arc):
            asked.append(arc)
            return codec.automaton._has_arc(arc >> 32, arc & 0xFFFFFFFF)

    words = [w.encode() for w in (" international", " unquestionably", " thththanonerwhor", " einschreibungen", "x" * 500)]
    kept, codec.automaton.table = codec.automaton.table, Counted()
    try:
        ids = [codec.automaton.encode(w) for w in words]
    finally:
        codec.automaton.table = kept
    assert [b"".join(codec.labels[i] for i in x) for x in ids] == words
    assert len(asked) < sum(map(len, words)) / 4


def test_batches_match_single_texts_and_the_library(codec):
    library = Tokenizer.from_file(BYTE)
    texts = TEXTS + _random_texts() + ["naïve words, and words, naïve", "a b", "x  y", "'s 's it's", "ǅ ɐ ʰ ª"]
    every = pa.array(texts, pa.string())
    for part in (every, every.slice(3, 7), every.slice(len(texts) - 5), every.slice(len(texts) - 5, 2), pa.array([None, None], pa.string()),
                 pa.array([], pa.string())):
        ids = codec.encode_all(part)
        assert ids.to_pylist() == [codec.encode(t) for t in part.to_pylist()]
        assert codec.decode_all(ids).to_pylist() == [t or "" for t in part.to_pylist()]
        assert [np.frombuffer(i, "<u4").tolist() for i in ids.to_pylist()] \
            == [library.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_decode_of_strange_batches(codec):
    strange = [np.array(x, "<u4").tobytes() for x in ([10**6, 220], [], [2**32 - 1], [codec.automaton.spelt[b"\xc3"]],
                                                         [codec.automaton.spelt[b"\xa9"]], [220])]
    ids = pa.array([None, *strange, codec.encode("é and <|endoftext|>")], pa.binary())
    for part in (ids, ids.slice(1, 3), ids.slice(4), ids.slice(0, 1)):
        assert codec.decode_all(part).to_pylist() == [codec.decode(i) for i in part.to_pylist()]
    with pytest.raises(ValueError, match="32-bit"):
        codec.decode_all(pa.array([b"abc", b"defgh"], pa.binary()))


def test_a_batch_asks_once_for_what_repeats(codec):
    asked = []

    class Counted(dict):
        def __missing__(self, piece):
            asked.append(piece)
            return codec._piece(piece)

    kept, codec.pieces = codec.pieces, Counted()
    try:
        codec.encode_all(pa.array(["first some words and some words"] * 50))
    finally:
        codec.pieces = kept
    assert sorted(asked) == ["and", "first", "some", "words"]


def test_slices_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 4)
    monkeypatch.setattr(bpe, "BYTES", 10)
    texts = ["a", None, "", "bb", "c", "d" * 25, None, "e" * 6, "f" * 4, "g", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    slices = [s.column("text").to_pylist() for s in bpe._slices(batch, "text")]
    assert sum(slices, []) == texts
    assert all(len(s) == 1 or (len(s) <= 4 and sum(len(t or "") for t in s) <= 10) for s in slices)
    assert not list(bpe._slices(batch.slice(0, 0), "text"))


def test_caches_start_anew():
    with open(BYTE, "rb") as f:
        small = bpe.Codec(f.read(), kept=(2_000, 2_000, 2_000))
    library = Tokenizer.from_file(BYTE)
    for t in _random_texts(50):
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_and_decode_frames(docs_of):
    docs = docs_of(TEXTS, "ids")
    with open(BYTE, "rb") as f:
        spec = f.read()
    encoded = bpe.encode(docs, spec)
    back = {r["row"]["doc_id"]: r["decoded"] for r in bpe.decode(encoded, spec).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    both = {r["row"]["doc_id"]: r["decoded"] for r in bpe.round_trip(docs, spec).collect()}
    assert both == back
    assert bpe.round_trip(docs.limit(0), spec).count() == 0


def test_other_files_are_refused():
    with open(WORD, "rb") as f, pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(f.read())
    with open(BYTE, encoding="utf-8") as f, pytest.raises(ValueError, match="white space"):
        token_files.WordEncoder(f.read())


def test_pieces_match_the_library():
    with open(WORD, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    library = Tokenizer.from_file(WORD)
    for t in TEXTS + _random_texts():
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("file_bytes", [64, 1 << 20])
def test_token_files_round_trip(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    texts = TEXTS + _random_texts(60)
    rows = [(1000 - i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 1), (1000, None, 2), (1000, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    with open(WORD, encoding="utf-8") as f:
        spec = f.read()
    files = token_files.write_tokens(docs, shared_folder(spark, "test-tokens"), spec, end_id=1)
    got = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(WORD)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    place, text_of = 0, {}
    for d, t, _ in order:
        text_of.setdefault(d, []).append(t)
    for r in got:
        wanted = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in text_of[r["doc_id"]]]
        assert np.frombuffer(r["ids"], "<u4").tolist() in wanted and r["start"] == place and r["n_tokens"] * 4 == len(r["ids"])
        place += r["n_tokens"]


def test_one_document_is_read_alone_and_dictionary_is_checked(spark, docs_of):
    texts = ["some words to read " * 40 + str(i) for i in range(300)]
    with open(WORD, encoding="utf-8") as f:
        spec = f.read()
    files = token_files.write_tokens(docs_of(texts), shared_folder(spark, "test-one"), spec).collect()
    f = token_files.TokenFile(token_files.read_whole(files[0]["uri"]), token_files.read_whole(files[0]["dictionary"]))
    k = 3
    assert f.ids(k).tolist() == Tokenizer.from_str(spec).encode(texts[int(f.doc_ids[k])], add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(token_files.read_whole(files[0]["uri"]), b"other")


def test_no_documents(spark, docs_of):
    with open(WORD, encoding="utf-8") as f:
        spec = f.read()
    files = token_files.write_tokens(docs_of(["x"]).limit(0), shared_folder(spark, "test-none"), spec)
    assert files.count() == 0 and token_files.read_tokens(spark, files).count() == 0


def test_crc_is_of_the_ids(spark):
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(ids)


def test_shortcuts_for_every_latin_letter():
    with open(WORD, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    for c in filter(str.isalpha, map(chr, range(0x250))):
        for t in (f"{c},", f"{c}.", f"EVLER{c},", f"evler{c}.", f"{c}a,", f"EVLER{c}", f"1{c}.", f"it'{c},", f"{c}$$$", f"ab{c}!?", f"Ab{c}'",
                  f"{c}'s", f"A{c}-", f"({c})", f"{c}.,{c}"):
            assert encoder.encode(t) == encoder.library(t), t


def test_tokenizers_that_do_not_fold_are_left_alone():
    """Without lower-casing or byte letters the probes fail, and every piece goes to the library."""
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    encoder = token_files.WordEncoder(json.dumps(spec))
    assert not encoder.folds
    for t in _random_texts(100):
        assert encoder.encode(t) == encoder.library(t), t
