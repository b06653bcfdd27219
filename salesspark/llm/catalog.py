"""One query for each operator (``QUERIES``) and, where SQL can express it, its DuckDB SQL (``ORACLE``)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesspark.llm import (bpe, exact_dedup, exact_search, line_dedup, mixing, near_dup, neighbours, prefix_trie, quality, sharding,
                            token_files, turn_repair, warc)
from salesspark.llm.common import read, settled, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register("op1_line_dedup", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS dropped FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def q_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=False)
    out = line_dedup.apply_bitmaps(docs, bitmaps)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_sharding")
def q_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_mixing")
def q_mixing(spark, sf_dir):
    m = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    "source", "copies")


@register("op9_exact_dedup", """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM n) g""")
def q_exact_dedup(spark, sf_dir):
    d = exact_dedup.dedup_table(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op4_near_dup", """
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def q_near_dup(spark, sf_dir):
    d = near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_shingles", "component_id", "kept")


@register("op10_quality")
def q_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return quality.scored(docs, weights).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@register("op2_token_files")
def q_token_files(spark, sf_dir, path=None):
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    files = token_files.write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                     shared_folder(spark, "tokens"), spec, end_id=1)
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op7_bpe")
def q_bpe(spark, sf_dir, path=None):
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    both = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    return both.select("row.doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_HEX_DIGIT = "instr('0123456789abcdef', substr(h, 5 * g + {k}, 1)) - 1"
_GROUP = "(" + " + ".join(f"({_HEX_DIGIT.format(k=k)}) * {16 ** (5 - k)}" for k in range(1, 6)) + ")"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_GROUP} // {32 ** (3 - i)}) % 32 + 1, 1)" for i in range(4))


@register("op8_warc", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, string_agg({_BASE32}, '' ORDER BY g) AS payload_digest
      FROM (SELECT DISTINCT h FROM p) x, range(0, 8) AS r(g) GROUP BY h),
f AS (SELECT p.*, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f JOIN d ON f.h = d.h""")
def q_warc(spark, sf_dir):
    files = warc.write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_folder(spark, "warc"))
    responses, revisits = warc.read_archives(spark, files)
    full = settled(responses.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                    F.col("digest").alias("payload_digest")))
    origin = full.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("r_page"), "payload_bytes") \
        .dropDuplicates(["refers_to"])
    again = revisits.join(origin, "refers_to").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"),
        F.col("r_page").alias("refers_to"))
    return full.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                       F.lit(None).cast("long").alias("refers_to")).unionByName(again)


@register("op6_neighbours")
def q_neighbours(spark, sf_dir):
    return neighbours.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0, k=10)


def crc32_sql(text: str) -> str:
    """CRC-32 (unsigned) of an ASCII text in DuckDB SQL: eight shifts a byte by the reflected polynomial."""
    shifts = ("list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
              "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {shifts}), 4294967295::BIGINT)"


def _repair_sql() -> str:
    """The damage, then a forward program over four states (none, s, u, a), each a struct of cost, audit string and lines."""
    def then(state, cost, letter, line=None):
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"

    def least(*of):
        return "list_sort([x for x in [" + ", ".join(of) + "] if x IS NOT NULL])[1]"

    more, sound, own = "CASE WHEN fault = 't' THEN 3 ELSE 0 END", "fault NOT IN ('b', 'd')", "role || ':' || text"

    def said(state, initial, role):  # a row that must have this role: kept, or re-roled
        kept, changed = then(state, f"0 + {more}", "K", own), then(state, f"3 + {more}", "R", f"'{role}:' || text")
        return f"CASE WHEN {sound} THEN CASE WHEN i = '{initial}' THEN {kept} ELSE {changed} END END"

    system = f"CASE WHEN {sound} AND i = 's' THEN {then('n0', f'0 + {more}', 'K', own)} END"
    put_user, put_assistant = "'user:'", "'assistant:'"
    return f"""
WITH RECURSIVE damage AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
d AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM damage WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nth FROM d),
f AS (SELECT *, trim(text, {WS}) AS bare, row_number() OVER (PARTITION BY k, role, text ORDER BY nth) AS seen, left(role, 1) AS i,
  lag(left(role, 1)) OVER (PARTITION BY k ORDER BY nth) AS before FROM o),
g AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
figures AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate,
  count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated,
  count(*) FILTER (WHERE nth > 1 AND before || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(nth) AS n FROM g GROUP BY k),
starts AS (SELECT DISTINCT k, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS n0 FROM d),
best AS (
  SELECT k, 0::BIGINT AS nth, n0, CASE WHEN false THEN n0 END AS n1, {then('n0', 3, 'I', put_user)} AS n2,
    CASE WHEN true THEN {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} END AS n3 FROM starts
  UNION ALL
  SELECT k, nth, r0, r1, n2, {least('r3', then('n2', 3, 'I', put_assistant))} AS n3
  FROM (SELECT k, nth, r0, r1, r3,
          {least('r2', then('r0', 3, 'I', put_user), then('r1', 3, 'I', put_user), then('r3', 3, 'I', put_user))} AS n2
        FROM (SELECT g.k, g.nth, {then('n0', 4, 'D')} AS r0, {least(then('n1', 4, 'D'), system)} AS r1,
                {least(then('n2', 4, 'D'), said('n0', 'u', 'user'), said('n1', 'u', 'user'), said('n3', 'u', 'user'))} AS r2,
                {least(then('n3', 4, 'D'), said('n2', 'a', 'assistant'))} AS r3
              FROM best JOIN g ON g.k = best.k AND g.nth = best.nth + 1) x) y),
ends AS (SELECT best.k, {least('n0', 'n3')} AS e FROM best JOIN figures ON best.k = figures.k AND nth = n),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN figures ON figures.k = every.k LEFT JOIN ends ON ends.k = every.k"""


@register("op11_turn_repair", _repair_sql())
def q_turn_repair(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.repair(turn_repair.damaged(turns), ids=turns)


@register("op13_prefix_trie", f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY place) AS turns, {crc32_sql("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS path
          FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
steps AS (SELECT c, path, d, path[1:d] AS head FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM built) s),
nodes AS (SELECT head, d, min(c) AS conv_id, count(*) AS n,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends_sha256 FROM steps GROUP BY head, d),
family AS (SELECT a.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM nodes a LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.head = a.head[1:a.d - 1]
  LEFT JOIN (SELECT head[1:d - 1] AS head, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1) k ON k.head = a.head),
up AS (SELECT head[1:e] AS head, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum(CASE WHEN d > 0 THEN (n - 1) * strlen(head[d].text) ELSE 0 END) AS saved_tokens
  FROM (SELECT family.*, unnest(range(0, d + 1)) AS e FROM family) f GROUP BY 1)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM family JOIN up ON up.head = family.head""")
def q_prefix_trie(spark, sf_dir):
    turns = prefix_trie.turn_ids(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    convs, rebuilt = prefix_trie.rebuilt(settled(turns))
    return prefix_trie.trie(settled(convs), rebuilt)


@register("op12_exact_search", """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def q_exact_search(spark, sf_dir):
    return exact_search.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0, k=5)
