"""DuckDB SQL for the queries that SQL can express.

Each statement is written from the definition of the result (all pairs, whole
windows, a slot-by-slot schedule), not from the operator's method.
"""

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

MIX = """
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, '') AS k, count(*) AS n, (count(*) + 15) // 16 AS b FROM documents GROUP BY ALL),
share AS (
  SELECT k, n, b, greatest(1, CAST(round(pow(CAST(n AS DOUBLE), 0.5) / (SELECT sum(pow(CAST(n AS DOUBLE), 0.5)) FROM counts) * 1073741824) AS BIGINT)) AS a
  FROM counts),
p AS (SELECT list(a ORDER BY k) AS aa, list(k ORDER BY k) AS kk, CAST(sum(a) AS BIGINT) AS w FROM share),
h AS (SELECT min(((b + 1) * w + a - 1) // a) AS slots FROM share, p),
play(t, served, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(aa, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT t + 1, list_transform(served, lambda s, i: s + CASE WHEN i = pk THEN 1 ELSE 0 END), pk
  FROM (SELECT t, served, slots, list_sort(list_filter(list_transform(aa, lambda a, i:
                 CASE WHEN (served[i] * w) // a <= t + 1 THEN [((served[i] + 1) * w + a - 1) // a, i] END),
               lambda x: x IS NOT NULL))[1][2] AS pk
        FROM play, p, h WHERE t + 1 < slots)),
turns AS (
  SELECT kk[pick] AS k, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM play, p WHERE t >= 0),
ends AS (SELECT min(slot) AS e FROM turns JOIN share USING (k) WHERE turn >= b),
blocks AS (SELECT k, unnest(range(b)) AS turn, a FROM share),
early AS (SELECT k, turn, slot FROM turns, ends WHERE slot < e),
late AS (
  SELECT k, turn, e - 1 + row_number() OVER (ORDER BY ((turn + 1) * w + a - 1) // a, k) AS slot
  FROM blocks ANTI JOIN early USING (k, turn), p, ends),
numbered AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
  FROM documents)
SELECT doc_id, source, CAST(r // 16 AS BIGINT) AS mix_block, CAST(slot AS BIGINT) AS mix_slot,
       CAST(slot * 16 + r % 16 AS BIGINT) AS mix_position, slot < e AS on_target
FROM numbered n JOIN (SELECT * FROM early UNION ALL SELECT * FROM late) s ON s.k = n.k AND s.turn = r // 16, ends
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> '')),
w AS (
  SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
solid AS (
  SELECT doc_id, i, array_to_string(ws, ' ') AS norm, len(ws) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o
  FROM w WHERE len(ws) > 0),
pairs AS (
  SELECT b.doc_id, b.i, b.o, b.n, a.doc_id AS from_id, b.o - a.o AS shift
  FROM solid a JOIN solid b USING (norm) WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.o < b.o)),
runs AS (
  SELECT *, o - row_number() OVER (PARTITION BY doc_id, from_id, shift ORDER BY o) AS run FROM pairs),
later AS (
  SELECT DISTINCT first, last, doc_id FROM (
    SELECT doc_id, min(i) AS first, max(i) AS last FROM runs GROUP BY doc_id, from_id, shift, run HAVING sum(n) >= 50)),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN later k ON k.doc_id = l.doc_id AND l.i BETWEEN k.first AND k.last),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

NGRAMS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UPPER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS gram
  FROM w WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM overlap JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * o >= 75 * (sx.n + sy.n - o)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY ALL
"""

LEAKS = rf"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
lengths AS (SELECT DISTINCT len(ws) AS m FROM w WHERE kind = 'i' AND len(ws) BETWEEN 1 AND 4 UNION SELECT 5),
g AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(len(ws) - m + 1), lambda i: array_to_string(ws[i + 1:i + m], ' '))) AS gram
  FROM w JOIN lengths ON len(ws) >= m WHERE kind = 'd' OR m = least(len(ws), 5)),
item AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id),
hit AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS o FROM g d JOIN g i ON d.gram = i.gram AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(o AS BIGINT) AS n_shared, o / CAST(n AS DOUBLE) AS containment
FROM hit JOIN item ON item.id = hit.item_id WHERE 100 * o >= 75 * n
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


#: CRC-32 of a decimal id, bit by bit; then the trie by prefixes of lists.
TRIE = """
WITH ids AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crcs AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda k, i: xor(k >> 1, 3988292384::BIGINT * (k & 1)))), 4294967295::BIGINT) AS crc
  FROM ids),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:(a.crc % 9)::INT], []), coalesce(a.turns[(a.crc % 9)::INT + 1:], [])) AS turns
  FROM crcs a LEFT JOIN ids b ON b.conv_id = a.conv_id - a.conv_id % 5),
steps AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS at_end FROM rebuilt, unnest(range(0, len(turns) + 1)) u(d)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS own
  FROM steps GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
sums AS (SELECT k.path[1:u.e] AS path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(k.own) AS saved_tokens
  FROM known k, unnest(range(0, k.d + 1)) u(e) GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (path) LEFT JOIN known p ON k.d > 0 AND p.path = k.path[1:k.d - 1]
"""
