"""SQL that gives each query's rows independently of Spark."""

from __future__ import annotations

from mergeloom.functions.patterns import LETTER, LOWER, NUMBER, SUFFIX, UPPER, WHITE
from mergeloom.plans.queries import LIMIT
from mergeloom.sources.ranks import DEFAULT_RANKS

# DuckDB's patterns have no look-ahead: a mark is put before the last blank of a run instead.
_MARK = r"\x{E000}"
_LINELESS = WHITE.replace(r"\t-\r", r"\t\x{0B}\x{0C}")
_OTHER = rf"[^{WHITE}{_MARK}{LETTER}{NUMBER}]"
_END = rf"{NUMBER}{{1,3}}| ?{_OTHER}+%s|[{WHITE}]*[\r\n]+|[{WHITE}]+"
_LEAD = rf"[^\r\n{_MARK}{LETTER}{NUMBER}]?"
DUCK = {
    "cl": f"{SUFFIX}|{_LEAD}{LETTER}+|" + _END % r"[\r\n]*",
    "o2": f"{_LEAD}{UPPER}*{LOWER}+{SUFFIX}?|{_LEAD}{UPPER}+{LOWER}*{SUFFIX}?|" + _END % r"[\r\n/]*",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VOCAB = (
    "vocab AS MATERIALIZED (SELECT hex(from_base64(column0)) AS tok, column1::INT AS id FROM read_csv("
    + quoted(DEFAULT_RANKS)
    + ", delim=' ', header=false, quote='', escape='', columns={'column0': 'VARCHAR', 'column1': 'INT'}))"
)
#: At most so many merges' places; keys (rank, place) are packed as rank * PLACES + place.
PLACES = 100_000


def pieces(column: str, pattern: str = "cl") -> str:
    """List of a text's pieces."""
    marked = rf"regexp_replace({column}, '([{_LINELESS}]+)([{_LINELESS}][^{WHITE}])', '\1' || chr(57344) || '\2', 'g')"
    return f"regexp_extract_all({marked}, {quoted(DUCK[pattern])})"


def merged(source: str, guard: str = "true") -> str:
    """CTEs `src`, `r` and `enc` (p, parts): hex parts that p's hex h is merged to; source gives (p, h)."""
    return f"""src AS MATERIALIZED ({source}),
r(p, parts, step, live) AS (
  SELECT p, [h[2 * i - 1 : 2 * i] FOR i IN range(1, length(h) // 2 + 1)], 0, true FROM src
  UNION ALL
  SELECT r.p, CASE WHEN b.i IS NULL THEN r.parts ELSE r.parts[1 : b.i - 1] || [r.parts[b.i] || r.parts[b.i + 1]] || r.parts[b.i + 2 :] END, step + 1, b.i IS NOT NULL
  FROM r LEFT JOIN (
    SELECT p, arg_min(i, v.id * {PLACES}::BIGINT + i) AS i
    FROM (SELECT p, parts, unnest(range(1, len(parts))) AS i FROM r WHERE live) u
    JOIN vocab v ON v.tok = u.parts[u.i] || u.parts[u.i + 1] WHERE {guard} GROUP BY p) b USING (p)
  WHERE r.live),
enc AS MATERIALIZED (SELECT p, arg_max(parts, step) AS parts FROM r GROUP BY p)"""


def by_pieces(table: str, keys: str, column: str = "text", pattern: str = "cl") -> str:
    """CTEs down to `enc`, with `cut` (keys, n, p): a text's pieces in order."""
    return f"""WITH RECURSIVE {VOCAB},
cut AS MATERIALIZED (SELECT {keys}, generate_subscripts(ps, 1) AS n, unnest(ps) AS p FROM (SELECT {keys}, {pieces(column, pattern)} AS ps FROM {table})),
{merged("SELECT DISTINCT p, hex(encode(p)) AS h FROM cut")}"""


def encoded(table: str, keys: str, column: str = "text", pattern: str = "cl", more: str = "") -> str:
    """Token lists of a table's texts."""
    on = " AND ".join(f"t.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""{by_pieces(table, keys, column, pattern)},
flat AS (SELECT p, generate_subscripts(parts, 1) AS j, unnest(parts) AS tok FROM enc),
ids AS MATERIALIZED (SELECT p, list(id ORDER BY j) AS ids FROM flat JOIN vocab USING (tok) GROUP BY p),
e AS (SELECT {keys}, flatten(list(ids ORDER BY n)) AS tokens FROM cut JOIN ids USING (p) GROUP BY {keys})
SELECT {cols}, coalesce(e.tokens, []::INT[]) AS tokens FROM {table} t LEFT JOIN e ON {on}{more}"""


def counted(table: str, keys: str, select: str, column: str = "text") -> str:
    """A query over `c` (keys, n): token counts of a table's texts."""
    on = " AND ".join(f"t.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""{by_pieces(table, keys, column)},
e AS (SELECT {keys}, sum(len(parts)) AS n FROM cut JOIN enc USING (p) GROUP BY {keys}),
c AS (SELECT t.*, coalesce(e.n, 0)::BIGINT AS n FROM {table} t LEFT JOIN e ON {on})
{select}"""


def whole(source: str, select: str, extra: str = "") -> str:
    """A query over `enc` of texts that aren't split; source gives (p, h)."""
    return f"WITH RECURSIVE {VOCAB},{extra}\n{merged(source)}\n{select}"


_NAMES = "names AS MATERIALIZED (SELECT n_nationkey::INT AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region),"
_RAW_LIST = "SELECT item_id, list(id ORDER BY j) AS tokens FROM (SELECT p AS item_id, generate_subscripts(parts, 1) AS j, unnest(parts) AS tok FROM enc) JOIN vocab USING (tok) GROUP BY item_id"
_BENCH = "SELECT item_id AS p, hex(encode(text)) AS h FROM benchmark"
_BACK = """ grown AS MATERIALIZED (SELECT a.n_regionkey, a.n_nationkey, string_agg(b.n_name, '' ORDER BY b.n_nationkey DESC) AS t FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <= a.n_nationkey GROUP BY ALL),"""
_GROWN_COUNT = "SELECT n_regionkey, n_nationkey, octet_length(encode(t))::BIGINT AS n_bytes, len(parts)::BIGINT AS n_tokens FROM grown JOIN enc ON enc.p = t"
_AHEAD = """ grown AS MATERIALIZED (SELECT a.n_regionkey, a.n_nationkey, string_agg(b.n_name, '' ORDER BY b.n_nationkey) AS t FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <= a.n_nationkey GROUP BY ALL),"""
_FOUND = "found AS MATERIALIZED (SELECT DISTINCT v.id, v.tok FROM nation, vocab v WHERE contains(hex(encode(n_name)), v.tok) AND EXISTS (SELECT 1 FROM (SELECT unnest(range(1, length(hex(encode(n_name))), 2)) AS i) WHERE substr(hex(encode(n_name)), i, length(v.tok)) = v.tok)),"
_TRY_TEXT = "CASE WHEN v.tok IS NOT NULL AND try(decode(unhex(v.tok))) IS NOT NULL THEN decode(unhex(v.tok)) END"

SQL: dict[str, str] = {
    "vocab_lengths": f"WITH {VOCAB} SELECT (length(tok) // 2)::INT AS n_bytes, count(*) AS n_tokens, min(id) AS first_id FROM vocab GROUP BY 1",
    "vocab_next_prefix": f"""WITH {VOCAB}, p AS (SELECT id, tok, unnest(range(2, length(tok), 2)) AS n FROM vocab),
best AS (SELECT p.id, arg_max(v.id, p.n) AS next_prefix FROM p JOIN vocab v ON v.tok = p.tok[1 : p.n] GROUP BY p.id)
SELECT vocab.id, (length(tok) // 2)::INT AS n_bytes, next_prefix FROM vocab LEFT JOIN best USING (id)""",
    "vocab_splits": f"""WITH RECURSIVE {VOCAB}, {merged("SELECT id AS p, tok AS h FROM vocab", "v.id < p")}
SELECT p AS id, coalesce(a.id, p) AS "left", coalesce(b.id, p) AS "right" FROM enc
LEFT JOIN vocab a ON len(parts) = 2 AND a.tok = parts[1] LEFT JOIN vocab b ON len(parts) = 2 AND b.tok = parts[2]""",
    "vocab_self_check": whole("SELECT id AS p, tok AS h FROM vocab", "SELECT p AS id, len(parts) = 1 AS ok FROM enc"),
    "vocab_lookup": f"WITH {VOCAB}, cut AS (SELECT DISTINCT unnest({pieces('text')}) AS piece FROM conversations) SELECT piece, id FROM cut LEFT JOIN vocab ON tok = hex(encode(piece))",
    "vocab_token_bytes": f"WITH {VOCAB} SELECT n_nationkey * 1000 AS token, (length(tok) // 2)::INT AS n_bytes, tok AS hex FROM nation LEFT JOIN vocab ON id = n_nationkey * 1000",
    "vocab_next_match": f"""WITH {VOCAB}, p AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), q AS (SELECT p_partkey, h, unnest(range(2, length(h) + 1, 2)) AS n FROM p),
best AS (SELECT p_partkey, arg_max(v.id, n) AS id FROM q JOIN vocab v ON v.tok = h[1 : n] GROUP BY p_partkey) SELECT p_partkey, id FROM part LEFT JOIN best USING (p_partkey)""",
    "vocab_occurrences": f"""WITH {VOCAB}, {_NAMES} q AS (SELECT k, hex(encode(name)) AS h, unnest(range(1, octet_length(encode(name)) + 1)) AS i FROM names),
s AS (SELECT k, h, i, unnest(range(1, length(h) // 2 - i + 2)) AS n FROM q) SELECT k, (i - 1)::INT AS start, id FROM s JOIN vocab ON tok = h[2 * i - 1 : 2 * (i + n - 1)]""",
    "vocab_valid_pairs": f"WITH RECURSIVE {VOCAB}, {_FOUND} duo AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.tok AS x, b.tok AS y FROM found a, found b), "
    + merged("SELECT DISTINCT x || y AS p, x || y AS h FROM duo")
    + " SELECT a, b, parts = [x, y] AS ok FROM duo JOIN enc ON p = x || y",
    "split_pieces_cl": f"SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS piece FROM (SELECT doc_id, {pieces('text')} AS ps FROM documents)",
    "split_pieces_o2": f"SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS piece FROM (SELECT doc_id, {pieces('text', 'o2')} AS ps FROM documents)",
    "piece_frequency": f"SELECT piece, count(*) AS n FROM (SELECT unnest({pieces('text')}) AS piece FROM documents) GROUP BY piece",
    "pieces_by_lang": f"SELECT lang, sum(len({pieces('text')}))::BIGINT AS n_pieces FROM documents GROUP BY lang",
    "split_custom_pattern": f"""WITH RECURSIVE {VOCAB}, cut AS MATERIALIZED (SELECT item_id, unnest(regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]')) AS p FROM benchmark), {merged("SELECT DISTINCT p, hex(encode(p)) AS h FROM cut")}
SELECT item_id, count(*)::INT AS n_pieces, sum(len(parts))::INT AS n_tokens FROM cut JOIN enc USING (p) GROUP BY item_id""",
    "encode_documents": encoded("documents", "doc_id"),
    "encode_documents_o2": encoded("documents", "doc_id", pattern="o2"),
    "encode_conversations": encoded("conversations", "conv_id, turn"),
    "encode_pages": encoded("pages", "page_id", "html"),
    "count_documents": counted("documents", "doc_id", "SELECT doc_id, n::INT AS n_tokens FROM c"),
    "count_by_lang": counted("documents", "doc_id", "SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY lang"),
    "count_till_limit": counted("documents", "doc_id", f"SELECT doc_id, CASE WHEN n <= {LIMIT} THEN n::INT END AS n_tokens FROM c"),
    "encode_batch_totals": counted("conversations", "conv_id, turn", "SELECT count(*) AS n_texts, sum(n)::BIGINT AS total_tokens FROM c"),
    "token_top_k": f"{by_pieces('documents', 'doc_id')}, times AS (SELECT p, count(*) AS k FROM cut GROUP BY p) SELECT id AS token, sum(k)::BIGINT AS n FROM (SELECT k, unnest(parts) AS tok FROM times JOIN enc USING (p)) JOIN vocab USING (tok) GROUP BY id ORDER BY n DESC, id LIMIT 100",
    "tokens_by_quality": counted("documents", "doc_id", "SELECT quality, toxic, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c JOIN labels USING (doc_id) GROUP BY quality, toxic"),
    "running_tokens": counted("conversations", "conv_id, turn", "SELECT conv_id, turn, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS n_tokens FROM c"),
    "decode_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "decode_join": "SELECT item_id, text FROM benchmark",
    "decode_invalid": f"WITH {VOCAB} SELECT o_orderkey, {_TRY_TEXT} AS text FROM orders LEFT JOIN vocab v ON v.id = o_orderkey % 60000",
    "encode_raw": whole(_BENCH, _RAW_LIST),
    "encode_heap": whole(_BENCH, _RAW_LIST),
    "encode_table": whole(_BENCH, _RAW_LIST),
    "count_raw": whole(_BENCH, "SELECT p AS item_id, len(parts)::INT AS n_tokens FROM enc"),
    "count_raw_till_limit": whole(_BENCH, "SELECT p AS item_id, CASE WHEN len(parts) <= 100 THEN len(parts)::INT END AS n_tokens FROM enc"),
    "encode_greedy": f"""WITH RECURSIVE {VOCAB}, top AS (SELECT max(length(tok)) AS most FROM vocab),
r(p, h, ids) AS (SELECT item_id, hex(encode(text)), []::INT[] FROM benchmark UNION ALL
 SELECT p, h[length(best) + 1 :], list_append(ids, id) FROM (
  SELECT r.p, any_value(r.h) AS h, any_value(r.ids) AS ids, arg_max(v.tok, length(v.tok)) AS best, arg_max(v.id, length(v.tok)) AS id
  FROM (SELECT r.*, unnest(range(2, least(length(h), most) + 1, 2)) AS n FROM r, top WHERE h <> '') r JOIN vocab v ON v.tok = r.h[1 : r.n] GROUP BY r.p))
SELECT p AS item_id, ids AS tokens FROM r WHERE h = ''""",
    "encode_minimal": f"""WITH RECURSIVE {VOCAB}, spans AS MATERIALIZED (SELECT item_id, id, s AS a, s + length(tok) // 2 AS b FROM (SELECT item_id, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)))) AS s FROM benchmark) q,
 LATERAL (SELECT unnest(range(2, least(length(h) - 2 * s, 256) + 1, 2)) AS n) w JOIN vocab ON tok = h[2 * s + 1 : 2 * s + n]),
r(item_id, place, n) AS (SELECT item_id, 0::BIGINT, 0 FROM benchmark UNION
 SELECT r.item_id, spans.b, r.n + 1 FROM r JOIN spans ON spans.item_id = r.item_id AND spans.a = r.place),
best AS MATERIALIZED (SELECT item_id, place, min(n) AS n FROM r GROUP BY ALL),
pick AS MATERIALIZED (SELECT s.item_id, s.b, min(s.a) AS a, arg_min(s.id, s.a) AS id FROM spans s JOIN best x ON x.item_id = s.item_id AND x.place = s.a JOIN best y ON y.item_id = s.item_id AND y.place = s.b WHERE y.n = x.n + 1 GROUP BY s.item_id, s.b),
back(item_id, place, ids) AS (SELECT item_id, octet_length(encode(text))::BIGINT, []::INT[] FROM benchmark UNION ALL
 SELECT back.item_id, pick.a, [pick.id] || ids FROM back JOIN pick ON pick.item_id = back.item_id AND pick.b = back.place)
SELECT item_id, ids AS tokens FROM back WHERE place = 0""",
    "prefix_tokens": f"WITH RECURSIVE {VOCAB}, {_NAMES} pre AS MATERIALIZED (SELECT k, e, hex(encode(name))[1 : 2 * e] AS h FROM (SELECT k, name, unnest(range(1, octet_length(encode(name)) + 1)) AS e FROM names)), "
    + merged("SELECT DISTINCT h AS p, h FROM pre")
    + ' SELECT k, e::INT AS "end", id AS token FROM pre JOIN enc ON enc.p = pre.h JOIN vocab ON tok = parts[-1]',
    "interval_counts": f"WITH RECURSIVE {VOCAB}, {_NAMES} pre AS MATERIALIZED (SELECT k, a, e, hex(encode(name))[2 * a + 1 : 2 * e] AS h FROM (SELECT k, name, a, unnest(range(a, octet_length(encode(name)) + 1)) AS e FROM (SELECT k, name, unnest(range(0, octet_length(encode(name)) + 1)) AS a FROM names))), "
    + merged("SELECT DISTINCT h AS p, h FROM pre WHERE h <> ''")
    + ' SELECT k, a::INT AS start, e::INT AS "end", coalesce(len(parts), 0)::INT AS n_tokens FROM pre LEFT JOIN enc ON enc.p = pre.h',
    "append_nations": whole("SELECT DISTINCT t AS p, hex(encode(t)) AS h FROM grown", _GROWN_COUNT, _AHEAD),
    "prepend_nations": whole("SELECT DISTINCT t AS p, hex(encode(t)) AS h FROM grown", _GROWN_COUNT, _BACK),
}
