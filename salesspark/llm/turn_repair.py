"""Operator 11: repair of the structure of conversations by the cheapest edits, ties to the ASCII-least audit string.

Each row of a conversation is one code: the initial of its role (s, u, a, other) and its first fault. A dynamic program over the
rows, from the last to the first, chooses the edits. Its states are the last role written (none, s, u, a) and its weights are single
integers: the high digits carry the cost, the low digits the audit letters by place, first letter highest, zeros after the end. The
smaller integer is the cheaper repair, and among equally cheap ones the smaller string, so ``min`` on integers decides everything. Working
backwards, the strings that are compared share their whole past, and an edit in front moves the letters one place down.

Rows are range-partitioned by (conversation, turn, role, digest of the text), so a conversation of any length spreads over many tasks.
It is cut in segments of at most ``SEGMENT`` rows in a stretch. A conversation of one segment is solved at once. For a longer one, each
segment gives for every pair of states the least integer between them, on its own, and the pieces combine along the conversation: of two
equally cheap pieces between the same states over the same rows neither string begins the other (the longer one would hold
further inserts, which cost), so least pieces make the least whole. What one task holds of a conversation is then one code a row and the audit
string, which is a result anyway; texts are only streamed past, for the digest.

Defined results: rows without id form one conversation without id; null turns come first; a null role or text is one space. Rows that
share a turn stand by role, then by the SHA-256 of the text. A text of white space or nothing is blank. Long texts are read whole. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesspark.llm.common import settled, strip_white

SEGMENT_BITS = 12
#: Cost of each edit, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Audit letters in ASCII order; their places are the digits 1 to 4.
LETTERS = "DIKR"
#: Initials by class; faults by number, 0 for none.
INITIALS, BLANK, DUPLICATE, CUT = "sua", 1, 2, 3
#: States: last role written. What a kept row of each class leads to, and what an inserted or re-roled row must be.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {NONE: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
WANTED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPTED = (NONE, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}


def backward(codes: str, ends: tuple[int, ...]) -> tuple[list[int | None], int]:
    """For each state before the rows, the least integer that leads to a state of ``ends`` after them; and the number of letter places."""
    places = 3 * len(codes) + 2  # a row gives one letter, a gap at most two inserts
    bits = 3 * places
    low = (1 << bits) - 1

    def edit(cost: int, letter: str, rest: int | None) -> int | None:
        if rest is None:
            return None
        return (((rest >> bits) + cost) << bits) | ((LETTERS.index(letter) + 1) << (bits - 3)) | ((rest & low) >> 3)

    def least(*values: int | None) -> int | None:
        return min((v for v in values if v is not None), default=None)

    def with_inserts(values: list[int | None]) -> list[int | None]:
        once = [least(v, edit(INSERT, "I", values[WANTED[s]])) for s, v in enumerate(values)]
        return [least(v, edit(INSERT, "I", once[WANTED[s]])) for s, v in enumerate(values)]

    gap = with_inserts([0 if s in ends else None for s in range(4)])
    for code in reversed(codes):
        kind, fault = divmod(int(code, 16), 4)
        row = []
        for s in range(4):
            choices = [edit(DELETE, "D", gap[s])]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                choices.append(edit(REROLE + more, "R", gap[WANTED[s]]))
                if kind in KEPT[s]:
                    choices.append(edit(KEEP + more, "K", gap[KEPT[s][kind]]))
            row.append(least(*choices))
        gap = with_inserts(row)
    return gap, places


def decoded(value: int, places: int) -> tuple[int, str]:
    """Cost and audit string of a weight."""
    digits = format(value & ((1 << (3 * places)) - 1), "o").zfill(places).rstrip("0")
    return value >> (3 * places), "".join(LETTERS[int(d) - 1] for d in digits)


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit string of the repair of a conversation of one segment."""
    values, places = backward(codes, ACCEPTED)
    return decoded(values[NONE], places)


def transfer(codes: str) -> list[str | None]:
    """Cost and letters from each state before to each state after the rows, as 16 texts; None where no edit leads there."""
    by_end = [backward(codes, (end,)) for end in range(4)]
    return [None if by_end[end][0][start] is None else "{}:{}".format(*decoded(by_end[end][0][start], by_end[end][1]))
            for start in range(4) for end in range(4)]


def combined(pieces: list[list[str | None]]) -> tuple[int, str]:
    """Cost and audit string over segments in order, each given by ``transfer``."""
    best: dict[int, tuple[int, list[str]]] = {NONE: (0, [])}
    for piece in pieces:
        step: dict[int, tuple[int, list[str]]] = {}
        for start, (cost, letters) in best.items():
            for end in range(4):
                if piece[4 * start + end] is not None:
                    c, own = piece[4 * start + end].split(":")
                    new = (cost + int(c), [*letters, own])
                    if end not in step or (new[0], "".join(new[1])) < (step[end][0], "".join(step[end][1])):
                        step[end] = new
        best = {end: (cost, ["".join(letters)]) for end, (cost, letters) in step.items()}
    return min((best[s][0], best[s][1][0] if best[s][1] else "") for s in ACCEPTED if s in best)


def operations(codes: str, audit: str) -> list[str]:
    """What becomes of each row, in letters: u, a: insert a row of that role here; K: keep; U, A: keep with that role; D: delete."""
    ops, own, state, rows = [], "", NONE, iter(codes)
    for letter in audit:
        if letter == "I":
            state = WANTED[state]
            own += ROLES[state][0]
            continue
        kind = int(next(rows), 16) // 4
        if letter == "D":
            own += "D"
        elif letter == "K":
            state = KEPT[state][kind]
            own += "K"
        else:
            state = WANTED[state]
            own += ROLES[state][0].upper()
        ops.append(own)
        own = ""
    if own and ops:
        ops[-1] += own
    return ops


def counts(codes: str) -> tuple[int, int, int, int]:
    """Rows by first fault (blank, duplicate, truncated) and adjacent roles that must not follow each other."""
    faults = [int(c, 16) % 4 for c in codes]
    kinds = [int(c, 16) // 4 for c in codes]
    legal = {(0, 1), (1, 2), (2, 1)}
    return (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
            sum(pair not in legal for pair in zip(kinds, kinds[1:], strict=False)))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
            yield dict(zip(names, values, strict=True))


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        moves = [transfer(c) if n > 1 else None for c, n in zip(batch["codes"].to_pylist(), batch["n_segments"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["k"], batch["first"], batch["codes"], pa.array(moves, pa.list_(pa.string()))],
                                         ["k", "first", "codes", "moves"])


_SOLVED = pa.schema([("k", pa.string()), ("first", pa.int64()), ("ops", pa.list_(pa.string())), ("blank", pa.int64()),
                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                     ("audit", pa.string())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment, the figures of the conversation in its first; segments come sorted by conversation and place."""
    out: list[dict] = []
    for k, rows in groupby(_records(batches), key=lambda r: r["k"]):
        segments = list(rows)
        codes = "".join(s["codes"] for s in segments)
        cost, audit = cheapest(codes) if len(segments) == 1 else combined([s["moves"] for s in segments])
        ops, figures, at = operations(codes, audit), counts(codes), 0
        for nth, s in enumerate(segments):
            own = dict(zip(("blank", "duplicate", "truncated", "illegal", "cost", "audit"), (*figures, cost, audit), strict=True)) \
                if nth == 0 else {}
            out.append({"k": k, "first": s["first"], "ops": ops[at:at + len(s["codes"])]} | own)
            at += len(s["codes"])
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, _SOLVED)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation. For each row its operation comes first, then role and text; nothing else is held."""
    schema = pa.schema([("k", pa.string()), ("repaired_sha256", pa.string())])
    out: list[dict] = []
    for k, rows in groupby(_records(batches), key=lambda r: r["k"]):
        sha, lines, op = hashlib.sha256(), 0, ""
        for r in rows:
            if r["op"] is not None:
                op = r["op"]
                continue
            for letter in op:
                if letter == "D":
                    continue
                role = r["role"] if letter == "K" else {"u": "user", "a": "assistant"}[letter.lower()]
                line = f"{role}:{'' if letter in 'ua' else r['text']}"
                sha.update(("\n" if lines else "").encode() + line.encode())
                lines += 1
        out.append({"k": k, "repaired_sha256": sha.hexdigest()})
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the CRC-32 of ``conv_id:turn`` decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    own = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return own.filter("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")) \
        .drop("copy")


def repair(rows: DataFrame, ids: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text), or of ``ids`` if given: its faults, the cost and audit string of the
    cheapest repair and the SHA-256 of the repaired ``role:text`` lines."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("k")  # no id looks like a space
    own = rows.select(key, "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    ordered = own.withColumn("h", F.sha2("text", 256))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in ("k", "turn", "role", "h")]
    placed = settled(ordered.repartitionByRange(n, *order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()))

    firsts = placed.groupBy("k", "role", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    bare = strip_white(F.col("text"))
    fault = F.when(bare == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    kind = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    facts = placed.select("k", "at", kind.alias("kind"), F.when(bare == "", "").otherwise(F.concat(F.lit("x"), F.right(bare, F.lit(1)))).alias("text"))
    coded = facts.join(firsts, "at", "left").select("k", "at", F.lower(F.hex(F.col("kind") * 4 + fault)).alias("code"))
    stretch = coded.groupBy("k", F.shiftright("at", segment_bits).alias("segment")).agg(
        F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    segments = stretch.select("k", "first", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))
    several = segments.groupBy("k").agg(F.count(F.lit(1)).alias("n_segments"))
    moved = segments.join(several, "k").select("k", "first", "codes", "n_segments") \
        .mapInArrow(_transfers, "k string, first long, codes string, moves array<string>")
    solved = settled(moved.repartition(n, "k").sortWithinPartitions("k", "first").mapInArrow(
        _solve, "k string, first long, ops array<string>, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))

    ops = solved.select("k", "first", F.posexplode("ops").alias("nth", "op")).select(
        "k", (F.col("first") + F.col("nth")).alias("at"), "op", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = placed.select("k", "at", F.lit(None).cast("string").alias("op"), "role", "text")
    streamed = ops.unionByName(texts).repartition(n, "k").sortWithinPartitions("k", "at", F.col("op").asc_nulls_last())
    digests = streamed.mapInArrow(_digests, "k string, repaired_sha256 string")
    turns = placed.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))

    every = (rows if ids is None else ids).select("conv_id", key).distinct()
    full = every.join(turns, "k", "left").join(solved.filter("audit IS NOT NULL").drop("first", "ops"), "k", "left").join(digests, "k", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
