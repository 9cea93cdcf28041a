"""DuckDB SQL for the queries of this folder that SQL can express whole."""

ORACLE = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id, s.doc_id = coalesce(m.comp, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh AND len(s.sh) > 0 LEFT JOIN m ON m.node = c.rep""",
    "op2_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    # Escaping is reversible, so the digests are those of the input; only the length needs the template.
    "op5_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, length(replace(replace(text, chr(9243), chr(9243) || '0'), '<|', '<' || chr(9243) || '1|'))
    + length(replace(replace(replace(role, chr(9243), chr(9243) || '0'), '<|', '<' || chr(9243) || '1|'), chr(10), chr(9243) || '2')) + 24 AS piece
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(piece) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 18, 1))) AS s, ws FROM w),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM x),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
k AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM r),
gone AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(gone.n, 0) AS n_removed,
  sha256(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT coalesce(list_contains(gone.gone, i), false)], ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    # Levels by recursion; proofs list the siblings of each level, and folding goes up with them. The inner reductions are crc32.
    "op11_merkle_manifest": r"""
WITH RECURSIVE enc AS (
  SELECT row_number() OVER () AS id, doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
leaf AS (
  SELECT id, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + t AS VARCHAR)) || ':' || (n_chars + t), '-') || tail) AS changed
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS t FROM enc)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
low AS (
  SELECT lang, 0 AS lvl, pos, leaf AS node, n FROM placed
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subs AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, subroot AS node, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT p.id, l.lvl AS step, l.pos % 2 = 0 AS on_left, l.node FROM placed p JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang AND l.n > 1 AND l.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL SELECT p.id, 1000 + h.lvl, h.pos % 2 = 0, h.node FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high h ON h.n > 1 AND h.pos = xor(s.pos >> h.lvl, 1)),
every AS (
  SELECT p.id, l.lvl AS step FROM placed p JOIN (SELECT DISTINCT lang, lvl FROM low WHERE n > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT p.id, 1000 + h.lvl FROM placed p, (SELECT DISTINCT lvl FROM high WHERE n > 1) h),
paths AS (
  SELECT id, list(struct_pack(l := CASE WHEN on_left THEN node ELSE '' END, r := CASE WHEN on_left THEN '' ELSE node END) ORDER BY step) AS path,
    sha256(coalesce(string_agg(node, '' ORDER BY step), '')) AS proof_sha256
  FROM (SELECT e.id, e.step, coalesce(s.on_left, true) AS on_left, coalesce(s.node, '') AS node FROM every e LEFT JOIN steps s USING (id, step)) GROUP BY id),
folded AS (
  SELECT p.id, p.changed AS node, 1 AS k FROM placed p
  UNION ALL SELECT f.id, sha256(x.path[k].l || f.node || x.path[k].r), k + 1 FROM folded f JOIN paths x USING (id) WHERE k <= len(x.path))
SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high r ON r.n = 1 LEFT JOIN paths x USING (id)
JOIN (SELECT id, max_by(node, k) AS node FROM folded GROUP BY id) f USING (id)""",
}
