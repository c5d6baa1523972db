"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

import string

from tremora.llm.chat import CODES, CONTROL, END, MORE, TEXT, TURN

LOWERED = (
    f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
)
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, list_slice(w, s, s + 9) AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
),
place AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS g
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(p)
),
occ AS (
  SELECT DISTINCT doc_id, p, place.n, item_id FROM place JOIN win ON place.n = win.n AND place.g = win.g
),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM occ, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
),
tok AS (SELECT doc_id, p, w[p] AS term FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
seen AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
each AS (
  SELECT g, g[i] AS term, min(i) AS i
  FROM (SELECT DISTINCT g FROM win), unnest(range(1, len(g) + 1)) AS t(i) GROUP BY g, g[i]
),
term AS (SELECT each.g, each.term, each.i, seen.n FROM each LEFT JOIN seen ON seen.term = each.term),
rare AS (
  SELECT g, first(term ORDER BY n, i) AS rarest, count(*) AS total FROM term
  GROUP BY g HAVING count(*) > 1 AND count(*) = count(n)
),
near AS (
  SELECT doc_id, count(DISTINCT spot) AS n_near FROM (
    SELECT a.doc_id, a.p AS spot, rare.g
    FROM rare JOIN tok AS a ON a.term = rarest JOIN term ON term.g = rare.g
      JOIN tok AS k ON k.doc_id = a.doc_id AND k.term = term.term AND abs(k.p - a.p) <= 20
    GROUP BY a.doc_id, a.p, rare.g, total HAVING count(DISTINCT k.term) = total
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN near USING (doc_id)
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    LATERAL (SELECT unnest(a) AS line, unnest(range(len(a))) AS i)
),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
ends AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id
    AND b.i >= a.i AND b.upto >= a.upto - a.w + 10 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.i), a.i FROM c a JOIN c b ON a.doc_id = b.doc_id
    AND b.i <= a.i AND a.upto - b.upto + b.w >= 10 GROUP BY a.doc_id, a.i
),
run AS (
  SELECT ends.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS content
  FROM ends JOIN l ON l.doc_id = ends.doc_id AND i BETWEEN s AND e GROUP BY ALL
),
later AS (
  SELECT doc_id, s, e FROM run
  QUALIFY row_number() OVER (PARTITION BY content, e - s ORDER BY doc_id, s) > 1
),
gone AS (SELECT DISTINCT l.doc_id, i FROM l JOIN later ON l.doc_id = later.doc_id AND i BETWEEN s AND e),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
    string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS rest
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT doc_id, coalesce(rest, '') AS text, lang, source, n_chars, n_lines, n_removed
FROM documents JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g
    FROM d)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN edge ON edge.a = reach.other
),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM root LEFT JOIN n USING (doc_id)
""".replace("LOWERED", LOWERED)


def _escaped(column: str) -> str:
    for old, new in [("%", "%25"), *((c, CODES[c[0]] + c[1:]) for c in CONTROL)]:
        column = f"replace({column}, '{old}', '{new}')"
    return column


CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(END)} + sum(length({_escaped("text")}) + CASE WHEN before = role THEN {len(MORE)} ELSE
    {len(TURN) + len(TEXT)} + length({_escaped("role")}) + CASE WHEN before IS NULL THEN 0 ELSE {len(END)} END
    END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS positive,
    CAST(list_sum(list_transform(list_zip(a.e, r.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM r AS a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE positive
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT positive AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracles() -> dict[str, str]:
    return {
        "op1_decontaminate": DECONTAMINATION,
        "op3_neardup": NEAR_DUPLICATES,
        "op7_chat": CHAT,
        "op9_linededup": LINE_DEDUP,
        "op13_negatives": HARD_NEGATIVES,
    }
