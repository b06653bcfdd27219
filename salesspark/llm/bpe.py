"""Operator 7: byte-level BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts just the sequences that BPE makes. It starts as one state with an arc for each
byte; each merge (a, b) -> c, in order of rank, applies a gadget: the state behind ``a`` no longer has the arc ``b``, and ``c`` gets an
arc wherever ``a`` has one, to the state that ``b`` led to before. States share what they have in common: the state behind a
token holds the arcs that gadgets have taken from it, by rank, and a link to the state that it was made from, as of the rank
that made it. Whether a state has an arc is found along these links and entered in a transition table, so from then on a step
is one look-up. That is the same automaton without a row of 50,000 arcs for each state.

Every byte string has one accepted path, so a pre-split word is encoded from left to right: from a position the tokens that
spell the next bytes are tried, the longest first, and where no arc is allowed the last step is taken back and its next shorter token
tried. The paths to two positions never meet, so each position is tried from once at most. That takes time linear in the word, however
long it is. Decoding emits the labels (bytes) of the arcs.

The vocabulary is a parameter (``path``): a tokenizer file of the ByteLevel kind. Texts are cut at the file's added tokens
first, then by the ByteLevel pattern, as the library does. Results of short words and transitions are kept, in bounded bytes. What stands
between spaces is looked up once per batch of texts, and the batch's ids and labels are put in their places as Arrow arrays.

Defined results: a null or empty text has no ids and decodes to the empty text. Ids outside the vocabulary decode to nothing. Bytes
that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesspark.llm.kept import Kept, owns, working_for

#: Bytes that a worker keeps of encoded words, of what stands between spaces, and of transitions: for a worker with an executor to itself, and
#: for one that shares it with what the stages of a pipeline have left in its heap. Less is slower, never different.
AMPLE, SMALL = (32 << 20, 160 << 20, 40 << 20), (8 << 20, 40 << 20, 24 << 20)
LONGEST = 48

#: Length from which the longest token at a position is searched, up or down.
GUESS = 4

#: Texts that go through the codec at once: rows, and bytes unless one text alone has more.
ROWS, BYTES = 256, 1 << 20

#: Fixed value: the ByteLevel split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters of the pattern up to U+024F: a space and only such letters are one word, without asking the pattern.
LETTERS = frozenset(regex.findall(r"\p{L}", "".join(map(chr, range(0x250)))))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a ByteLevel vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, nth = [""] * 256, 0
    for b in range(256):
        if b in own:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + nth)
            nth += 1
    return letters


class Automaton:
    """The state behind a token goes by the token's id; -1 is the start. ``taken[a, b]`` is the rank of the gadget that took the
    arc ``b`` from the state behind ``a``; ``made_from[c]`` is the token whose state ``c``'s was made from, and the rank;
    ``arcs_of[c]`` is the token whose arcs ``c``'s follow, and the rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], kept_steps: int = AMPLE[2]):
        letter_byte = {c: b for b, c in enumerate(byte_letters())}
        self.labels = {i: bytes(letter_byte[c] for c in t) for t, i in vocab.items() if all(c in letter_byte for c in t)}
        self.taken: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int]] = {}
        self.arcs_of: dict[int, tuple[int, int]] = {}
        tokens = [vocab[c] for c in byte_letters()]
        for rank, (left, right) in enumerate(merges):
            tokens.append(vocab[left + right])
            self._gadget(rank, vocab[left], vocab[right], tokens[-1])
        self.ranks = len(merges)
        #: The longest token that begins each beginning of a label.
        self.spelt = {self.labels[t]: t for t in tokens}
        for label in list(self.spelt):
            for end in range(2, len(label)):
                self.spelt.setdefault(label[:end], self.spelt[label[:end - 1]])
        self.size = {t: len(self.labels[t]) for t in tokens}
        self.shorter = {t: self.spelt[self.labels[t][:-1]] if n > 1 else -1 for t, n in self.size.items()}
        self.table = Kept(lambda arc: self._has_arc(arc >> 32, arc & 0xFFFFFFFF), kept_steps)

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        self.taken[a, b] = rank
        if c not in self.made_from:
            self.made_from[c], self.arcs_of[c] = (b, rank), (a, rank)

    def _has_arc(self, state: int, token: int) -> bool:
        before = self.ranks
        while True:
            t, until = token, self.ranks
            while True:
                rank = self.taken.get((state, t), self.ranks)
                if rank < before and rank <= until:
                    return False
                if t not in self.arcs_of:
                    break
                t, until = self.arcs_of[t]
            if state not in self.made_from:
                return True
            state, before = self.made_from[state]

    def step(self, state: int, token: int) -> bool:
        """Whether ``state`` has the arc ``token``; it leads to the state that goes by ``token``."""
        return self.table[(state << 32) | token]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        n, spelt, table, size, shorter = len(word), self.spelt.get, self.table, self.size, self.shorter
        ids, at, arcs = [], 0, -1 << 32
        while at < n:
            end = min(at + GUESS, n)
            token = spelt(word[at:end])
            if token is None:
                while token is None:
                    end -= 1
                    token = spelt(word[at:end])
            else:
                while end < n:
                    end += 1
                    t = spelt(word[at:end])
                    if t is None:
                        break
                    token = t
            while not table[arcs | token]:
                token = shorter[token]
                while token < 0:  # no arc is left here
                    last = ids.pop()
                    at -= size[last]
                    arcs = (ids[-1] if ids else -1) << 32
                    token = shorter[last]
            ids.append(token)
            at += size[token]
            arcs = token << 32
        return ids


def _bytes_of(values: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer]:
    """Where each value starts and the last ends, and the bytes of all."""
    _, starts, data = values.buffers()
    return np.frombuffer(starts, np.int64, len(values) + 1, 8 * values.offset), data or pa.py_buffer(b"")


def _joined(values: pa.LargeBinaryArray, at: np.ndarray) -> pa.LargeBinaryArray:
    """The values from ``at[i]`` to ``at[i + 1]`` as one, for each i; the bytes are not copied."""
    starts, data = _bytes_of(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(starts[at]), data])


class Codec:
    """Encode and decode whole texts with the vocabulary of a tokenizer file."""

    def __init__(self, spec: bytes, kept: tuple[int, int, int] = AMPLE):
        d = json.loads(spec)
        model, pre = d["model"], d.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or d.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        if any(t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or normalise are not supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, kept[2])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split = regex.compile(SPLIT)
        self.labels = self.automaton.labels | {i: t.encode() for t, i in self.added.items()}
        self.emitted = pa.array([self.labels.get(i, b"") for i in range(max(self.labels) + 2)], pa.large_binary())
        self.words = Kept(self._word, kept[0], LONGEST)
        self.pieces = Kept(self._piece, kept[1], LONGEST)

    def _word(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes | None:
        """The ids of what stands between two spaces, those of the space before it included; None if it is empty or has white space
        at an end."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self._word(" " + piece) if LETTERS.issuperset(piece) else self._split_encode(" " + piece)

    def _split_encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(text)))

    def _plain(self, text: str) -> bytes:
        """The pattern always cuts before a single space between two characters that are no white space, so such pieces are
        encoded one by one; a text with any other space is cut by the pattern as a whole."""
        pieces = text.split(" ")
        try:
            first = self.pieces[pieces[0]] and self._split_encode(pieces[0])
            return b"".join([first, *map(self.pieces.__getitem__, pieces[1:])])
        except TypeError:  # a piece that is None
            return self._split_encode(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """``encode`` of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        at, pieces = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        firsts, places = at[:-1], pieces.indices.to_numpy().copy()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.pieces.__getitem__, distinct))
        whole = np.zeros(len(texts), bool)  # texts that can't be cut at every space
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        uncut = np.array([i is None for i in ids], bool)
        if uncut.any():
            whole |= np.add.reduceat(uncut[places], firsts, dtype=np.int64) > 0
        for doc in np.flatnonzero(~whole).tolist():
            ids.append(self._split_encode(distinct[places[firsts[doc]]]))
            places[firsts[doc]] = len(ids) - 1
        cut = _joined(pa.array(ids, pa.large_binary()).take(pa.array(places)), at)
        if not whole.any():
            return cut
        others = pa.array([self.encode(t) for t in texts.filter(pa.array(whole)).to_pylist()], pa.large_binary())
        order = np.where(whole, len(cut) + np.cumsum(whole) - 1, np.arange(len(cut)))
        return pa.concat_arrays([cut, others]).take(pa.array(order))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """``decode`` of each element."""
        ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
        at, data = _bytes_of(ids)
        if (np.diff(at) % 4).any():
            raise ValueError("ids are unsigned 32-bit integers")
        labels = np.minimum(np.frombuffer(data, "<u4", (at[-1] - at[0]) // 4, at[0]), len(self.emitted) - 1)
        texts = _joined(self.emitted.take(pa.array(labels)), (at - at[0]) // 4)
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())

    def decode(self, ids: bytes | None) -> str:
        labels = self.labels
        return b"".join([labels.get(i, b"") for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}
owns("bpe", _CODECS.clear)


def codec_of(spec: bytes, kept: tuple[int, int, int] = AMPLE) -> Codec:
    """One compiled codec per worker process, vocabulary and budget; only the last one is held."""
    key = (hash(spec), kept)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec, kept)
    return _CODECS[key]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ROWS rows and BYTES bytes of ``column``, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, before + BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def _mapped(df: DataFrame, spec: bytes, steps: str, text_col: str, kept: tuple[int, int, int] = AMPLE) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("bpe")
        codec = codec_of(shared.value, kept)
        for b in batches:
            for part in _slices(b, "ids" if steps == "decode" else "text"):
                ids = part.column("ids") if steps == "decode" else codec.encode_all(part.column("text"))
                columns = [part.column("row"), ids.cast(pa.binary())]
                if steps != "encode":
                    columns.append(codec.decode_all(ids).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "decoded"][:len(columns)])

    if steps == "decode":
        given = df.select("row", "ids")
    else:
        given = df.select(F.struct(*[c for c in df.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {kind}, ids binary" + (", decoded string" if steps != "encode" else ""))


def encode(docs: DataFrame, spec: bytes, text_col: str = "text") -> DataFrame:
    """``row`` (the other columns of ``docs``) and ``ids``, little-endian unsigned 32-bit integers."""
    return _mapped(docs, spec, "encode", text_col)


def decode(encoded: DataFrame, spec: bytes) -> DataFrame:
    """``row``, ``ids`` and ``decoded`` of what ``encode`` returns."""
    return _mapped(encoded, spec, "decode", "")


def round_trip(docs: DataFrame, spec: bytes, text_col: str = "text", kept: tuple[int, int, int] = AMPLE) -> DataFrame:
    """``row``, ``ids`` and ``decoded``: both ways in one pass over the texts."""
    return _mapped(docs, spec, "both", text_col, kept)
