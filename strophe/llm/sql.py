"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
wins AS (SELECT rid, unnest(range(0, greatest(len(ws) - 7, 0))) AS i, ws FROM d),
keyed AS (SELECT rid, i, array_to_string(ws[i + 1:i + 8], ' ') AS w FROM wins),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM dup) GROUP BY rid),
c1 AS (SELECT d.*, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (rid)),
c2 AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS kl, coalesce('=' || source, '') AS ks, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS caps,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words FROM c1),
c AS (SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c2),
r(ratio, size, event, low) AS (VALUES ('word_length', NULL, 0, true), ('symbols', 'chars', 1, false), ('dup_lines', 'lines', 1, false), ('repeats', 'words', 16, false), ('capitals', 'chars', 1, false)),
v AS (SELECT rid, kl, ks, base_failed, unnest([
  {{'ratio': 'word_length', 'v': word_chars / nullif(n_words, 0)::DOUBLE}}, {{'ratio': 'symbols', 'v': n_symbols / nullif(word_chars, 0)::DOUBLE}}, {{'ratio': 'dup_lines', 'v': n_dup_lines / nullif(n_lines, 0)::DOUBLE}},
  {{'ratio': 'repeats', 'v': n_repeat_words / nullif(n_words, 0)::DOUBLE}}, {{'ratio': 'capitals', 'v': caps / nullif(word_chars, 0)::DOUBLE}},
  {{'ratio': 'chars', 'v': word_chars::DOUBLE}}, {{'ratio': 'lines', 'v': n_lines::DOUBLE}}, {{'ratio': 'words', 'v': n_words::DOUBLE}}]) AS r FROM c),
s AS (SELECT kl, ks, r.ratio AS ratio, CASE WHEN r.v > 0 THEN ceil(ln(r.v) / ln(1.02))::INT ELSE -100000 END AS b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
lv AS (SELECT 2 AS lv, kl, ks, ratio, b, n FROM s UNION ALL SELECT 1, kl, NULL, ratio, b, sum(n) FROM s GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, ratio, b, sum(n) FROM s GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lv, kl, ks, ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lv, kl, ks, ratio) AS docs, CASE WHEN b = -100000 THEN 0.0::DOUBLE ELSE 2 * pow(1.02::DOUBLE, b) / (1.02::DOUBLE + 1) END AS val FROM lv),
q AS (SELECT lv, kl, ks, ratio, max(docs) AS docs, min(CASE WHEN upto > floor((docs - 1) / 4.0) THEN val END) AS q1, min(CASE WHEN upto > floor((docs - 1) * 3 / 4.0) THEN val END) AS q3 FROM run GROUP BY ALL),
g AS (SELECT DISTINCT kl, ks, ratio FROM s),
p AS (SELECT g.*, CASE WHEN a.docs >= 64 THEN a.q1 WHEN l.docs >= 64 THEN l.q1 ELSE t.q1 END AS q1, CASE WHEN a.docs >= 64 THEN a.q3 WHEN l.docs >= 64 THEN l.q3 ELSE t.q3 END AS q3
  FROM g JOIN q a ON a.lv = 2 AND a.kl = g.kl AND a.ks = g.ks AND a.ratio = g.ratio JOIN q l ON l.lv = 1 AND l.kl = g.kl AND l.ratio = g.ratio JOIN q t ON t.lv = 0 AND t.ratio = g.ratio),
w AS (SELECT p.kl, p.ks, p.ratio, p.q1, p.q3, r.low, greatest(p.q3 - p.q1, coalesce(r.event / z.q1, 0.0::DOUBLE)) AS spread FROM p JOIN r ON r.ratio = p.ratio LEFT JOIN p z ON z.kl = p.kl AND z.ks = p.ks AND z.ratio = r.size),
f AS (SELECT kl, ks, ratio, CASE WHEN low THEN q1 - 7 * spread ELSE -1 END AS lo, q3 + 7 * spread AS hi FROM w),
ok AS (SELECT v.rid, bool_and(v.r.v >= f.lo AND v.r.v <= f.hi) AS good FROM v JOIN f ON v.kl = f.kl AND v.ks = f.ks AND v.r.ratio = f.ratio GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, false) AS kept FROM c LEFT JOIN ok USING (rid)
"""

ORACLE = {"op4_quality_rules": OP4}

OP2 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + 13 * count(*))::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
ORACLE["op2_chat_format"] = OP2

#: CRC-32 of a text's bytes, unsigned, by the usual table of 256 remainders (polynomial EDB88320).
_CRC = """
crc_bits AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS crc_t FROM crc_bits WHERE k = 8)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


_LEAF = " || ".join(_field(f) for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))

#: Trees by recursion from level to level; sources are 's' trees, and the tree of their roots is 'r'.
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_field('text')}) AS leaf,
  sha256({_LEAF} || {_field("CASE WHEN coalesce(" + _crc("doc_id::VARCHAR") + ", 1) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
s AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM s WHERE n > 1 GROUP BY tree, level, pos // 3),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM s WHERE n = 1),
r AS (SELECT 1000 AS level, pos, h, n FROM sub
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM r WHERE n > 1 GROUP BY level, pos // 3),
up AS (SELECT rid, tree, level, pos, changed AS h, '' AS proof FROM (SELECT *, 0 AS level FROM l)
  UNION ALL SELECT u.rid, u.tree, u.level + 1, u.pos // 3, sha256(string_agg(CASE WHEN s.pos = u.pos THEN u.h ELSE s.h END, '' ORDER BY s.pos)), any_value(u.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos <> u.pos), '')
    FROM up u JOIN s ON s.tree = u.tree AND s.level = u.level AND s.pos // 3 = u.pos // 3 AND s.n > 1 GROUP BY u.rid, u.tree, u.level, u.pos // 3),
of_tree AS (SELECT rid, max_by(h, level) AS h, max_by(proof, level) AS proof, any_value(tree) AS tree FROM up GROUP BY rid),
top AS (SELECT rid, 1000 AS level, sub.pos, of_tree.h, proof FROM of_tree JOIN sub USING (tree)
  UNION ALL SELECT u.rid, u.level + 1, u.pos // 3, sha256(string_agg(CASE WHEN r.pos = u.pos THEN u.h ELSE r.h END, '' ORDER BY r.pos)), any_value(u.proof) || coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (r.pos <> u.pos), '')
    FROM top u JOIN r ON r.level = u.level AND r.pos // 3 = u.pos // 3 AND r.n > 1 GROUP BY u.rid, u.level, u.pos // 3),
folded AS (SELECT rid, max_by(h, level) AS folded_root, max_by(proof, level) AS proof FROM top GROUP BY rid),
root AS (SELECT h AS root FROM r WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN folded USING (rid) JOIN sub USING (tree), root
"""

#: Nodes by their whole prefixes: every sequence adds to each of its prefixes.
ORACLE["op13_prefix_trie"] = f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(b ORDER BY turn NULLS FIRST, d) AS bs, {_crc("conv_id::VARCHAR")} % 9 AS h FROM t, crc_table GROUP BY conv_id, crc_t),
s AS (SELECT c.conv_id, coalesce(o.ds[:c.h], []) || c.ds[c.h + 1:] AS ds, coalesce(o.bs[:c.h], []) || c.bs[c.h + 1:] AS bs FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, unnest(range(0, len(ds) + 1)) AS depth, ds, bs FROM s),
n AS (SELECT depth, ds[:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bs[depth]) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ds) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
w AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = n.k[:n.depth - 1]
  LEFT JOIN (SELECT depth - 1 AS depth, k[:depth - 1] AS k, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL) k ON k.depth = n.depth AND k.k = n.k),
o AS (SELECT unnest(range(0, depth + 1)) AS d, k, (kids = 0)::BIGINT AS leaf, coalesce((n_convs - 1) * b, 0) AS saved FROM w),
a AS (SELECT d AS depth, k[:d] AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM o GROUP BY ALL)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.kids AS n_children, a.n_leaves, a.saved_tokens, w.ends_sha256 FROM w JOIN a ON a.depth = w.depth AND a.k = w.k
"""
