"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from mergeloom.llm.neardups import THRESHOLD
from mergeloom.llm.passages import PASSAGE
from mergeloom.plans.oracles import counted, encoded

#: Runs of ASCII letters and digits and of anything that isn't ASCII.
WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, greatest(len(w) - 2, 1) + 1)])) AS grams FROM w WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT min(r) AS c, min(doc_id) AS least, count(*) AS m, any_value(len(grams)) AS n, grams FROM g GROUP BY grams),
flat AS MATERIALIZED (SELECT c, unnest(grams) AS gram FROM classes),
shared AS MATERIALIZED (SELECT a.c AS a, b.c AS b, count(*) AS k FROM flat a JOIN flat b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c),
links AS MATERIALIZED (SELECT a, b, y.m FROM shared JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE k / (x.n + y.n - k) >= {THRESHOLD}),
reach AS (SELECT c, c AS other FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.other),
named AS (SELECT reach.c, min(least) AS class_id FROM reach JOIN classes o ON o.c = reach.other GROUP BY reach.c),
counted AS (SELECT a AS c, sum(m)::BIGINT AS n FROM links GROUP BY a),
info AS (SELECT classes.grams, class_id, coalesce(counted.n, 0) + m - 1 AS n_links FROM classes JOIN named USING (c) LEFT JOIN counted USING (c))
SELECT w.doc_id, CASE WHEN info.grams IS NULL THEN w.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM w LEFT JOIN g ON g.r = w.r LEFT JOIN info ON info.grams = g.grams"""

PASSAGES = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {PASSAGE}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {PASSAGE - 1})) AS i FROM w)),
ranked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows),
covered AS (SELECT doc_id, i + unnest(range(0, {PASSAGE})) AS word, k > 1 AS later FROM ranked WHERE n > 1),
state AS (SELECT doc_id, word, bool_or(later) AS later FROM covered GROUP BY doc_id, word),
runs AS (SELECT doc_id, word, later, word - row_number() OVER (PARTITION BY doc_id, later ORDER BY word) AS run FROM state)
SELECT doc_id, min(word)::INT AS start_word, max(word)::INT + 1 AS end_word, later FROM runs GROUP BY doc_id, later, run"""

SQL: dict[str, str] = {
    "op3_bpe_automaton": "SELECT *, len(tokens)::INT AS n_tokens, true AS round_trip FROM (" + encoded("documents", "doc_id") + ")",
    "op4_jaccard_join": JACCARD,
    "op6_token_counts": counted("documents", "doc_id", "SELECT doc_id, n AS n_tokens FROM c"),
    "op7_repeated_passages": PASSAGES,
}
