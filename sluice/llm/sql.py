"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 3) AS bucket
  FROM documents),
classed AS (
  SELECT *, 2 * length(bin(size + 1)) + coalesce(TRY_CAST(substr(bin(size + 1), 2, 1) AS INT), 0) AS class FROM rows),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS room, (SELECT sum(source_size) FROM sums)::DOUBLE AS total
  FROM sums),
levels AS (
  SELECT *, room / weight AS full_at,
         (total - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY room / weight, source)),
found AS (SELECT arg_min(level, full_at) FILTER (full_at >= level) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN full_at < found.level THEN room ELSE weight * found.level END AS target,
         (('0x' || substr(md5('20240229' || chr(31) || (source IS NULL)::INT::VARCHAR || chr(31) || coalesce(source, '')), 1, 3))::INT + 0.5::DOUBLE) / 4096.0::DOUBLE AS offs
  FROM levels, found),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST) - 1 AS rank
  FROM classed),
stepped AS (
  SELECT r.*, t.source_size, t.target, t.offs, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
emitted AS (
  SELECT *, least(floor(offs + (rank + 1) * rate) - floor(offs + rank * rate), ceil(rate))::BIGINT AS copies FROM stepped)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size AS taken, source, copies FROM emitted
"""

OP2 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM docs),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
       AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached AS (
  SELECT u AS node, u AS goal FROM edges
  UNION
  SELECT r.node, e.v FROM reached r JOIN edges e ON e.u = r.goal),
least_reached AS (SELECT node, min(goal) AS label FROM reached GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least_reached ON node = doc_id
"""

OP4 = r"""
WITH rows AS (
  SELECT doc_id, row_number() OVER () AS r,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

SPACES = r"\t\n\v\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

OP5 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM split),
worded AS (
  SELECT r, doc_id, i, regexp_extract_all(line, '[^{SPACES}]+') AS w, row_number() OVER (PARTITION BY r ORDER BY i) AS place
  FROM lines WHERE regexp_matches(line, '[^{SPACES}]')),
placed AS (
  SELECT r, doc_id, i, place, len(w) AS n, array_to_string(w, ' ') AS body,
         (sum(len(w)) OVER (PARTITION BY r ORDER BY place))::BIGINT AS upto
  FROM worded),
spans AS (
  SELECT b.r, b.place AS first, e.place AS last
  FROM placed b ASOF JOIN placed e ON b.r = e.r AND b.upto - b.n + 50 <= e.upto
  UNION
  SELECT e.r, b.place, e.place
  FROM placed e ASOF JOIN (SELECT r, place, upto - n AS before FROM placed) b ON e.r = b.r AND e.upto - 50 >= b.before),
windows AS (
  SELECT s.r, any_value(doc_id) AS doc_id, s.first, s.last, string_agg(body, chr(10) ORDER BY place) AS run
  FROM spans s JOIN placed p ON p.r = s.r AND p.place BETWEEN s.first AND s.last
  GROUP BY s.r, s.first, s.last),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, r, first) AS occurrence FROM windows),
gone AS (
  SELECT DISTINCT p.r, p.i, p.n
  FROM ordered o JOIN placed p ON p.r = o.r AND p.place BETWEEN o.first AND o.last WHERE o.occurrence > 1),
cut AS (
  SELECT l.r, count(g.i) AS lines_removed, coalesce(sum(g.n), 0)::BIGINT AS words_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS left_text
  FROM lines l LEFT JOIN gone g ON g.r = l.r AND g.i = l.i GROUP BY l.r),
kept AS (
  SELECT doc_id, coalesce(lines_removed, 0)::BIGINT AS lines_removed, coalesce(words_removed, 0)::BIGINT AS words_removed,
         CASE WHEN coalesce(lines_removed, 0) = 0 THEN text WHEN regexp_matches(left_text, '[^{SPACES}]') THEN left_text ELSE '' END AS kept_text
  FROM docs LEFT JOIN cut USING (r))
SELECT doc_id, lines_removed, words_removed, length(kept_text)::BIGINT AS chars_left, sha256(kept_text) AS text_sha256 FROM kept
"""

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
placed AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (
  SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS g,
         lead(word, 4) OVER p AS last
  FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows WHERE last IS NOT NULL) WHERE c > 1),
repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY r),
lines AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[#*$%&<>]+(?:[\x20\x09-\x0D]|$)')) + len(regexp_extract_all(line, '!{2,}')) AS noise,
         len(regexp_extract_all(line, '[|\x{00BB}\x{203A}\x{2022}\x{00B7}]')) AS cuts
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (
  SELECT r, line, n,
         CASE WHEN cuts >= 3 AND cuts * 10 > n * 2 THEN 'navigation'
              WHEN noise * 10 > n * 3 OR NOT regexp_matches(line, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}]') THEN 'punctuation'
              WHEN 16 * len(regexp_extract_all(line, '(?i)all rights reserved|licen[sc]ed under|copyright|\(c\) ?[0-9]{4}|cookie policy|accept cookies|privacy policy|terms of (use|service)|click here|read more|sign (in|up)|log ?in|subscribe|javascript')) >= n THEN 'boilerplate'
         END AS failed
  FROM lines WHERE n > 0),
per_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (failed IS NOT NULL), 0) AS lost_words,
         coalesce(sum(n) FILTER (failed IS NULL), 0) AS left_words,
         count(failed) AS lines_removed
  FROM judged GROUP BY r),
joined AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost_words, 0)::BIGINT AS lost_words, coalesce(left_words, 0)::BIGINT AS left_words,
         coalesce(lines_removed, 0)::BIGINT AS lines_removed
  FROM words LEFT JOIN repeats USING (r) LEFT JOIN per_doc USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (lost_words * 100 > n_words * 50 OR left_words = 0) AS kept,
       lost_words, lines_removed
FROM joined
"""

OP7_MARKS = r"\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<</TURN>>"

OP7 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
judged AS (
  SELECT *, role IN ('user', 'assistant', 'system') AS known,
         regexp_matches(text, '{OP7_MARKS}|\\[\\<\[]')
         OR (role NOT IN ('user', 'assistant', 'system') AND regexp_matches(role, '{OP7_MARKS}|\\[\\<\[]|\\\z')) AS conflict
  FROM turns),
escaped AS (
  SELECT *, CASE WHEN conflict THEN regexp_replace(regexp_replace(replace(text, '\', '\\'), '\\\\([^\\<\[])', '\\\1', 'g'), '({OP7_MARKS})', '\\\1', 'g') ELSE text END AS inner_text,
         CASE WHEN conflict THEN regexp_replace(regexp_replace(replace(role, '\', '\\'), '\\\\([^\\<\[])', '\\\1', 'g'), '({OP7_MARKS})', '\\\1', 'g') ELSE role END AS inner_role
  FROM judged),
rendered AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || inner_text || ' [/INST]'
                      WHEN 'assistant' THEN '<s> ' || inner_text || ' </s>'
                      WHEN 'system' THEN '<<SYS>> ' || inner_text || ' <</SYS>>'
                      ELSE '<<ROLE>>' || inner_role || '<</ROLE>> ' || inner_text || ' <</TURN>>' END AS formatted
  FROM escaped)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""


OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) AS ks(k) WHERE len(w) >= k)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
frequent AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1),
inside AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS part
        FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) AS ms(m) WHERE m < k))
  GROUP BY lang, part),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, (1000 * c.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
  LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase
  WHERE longer IS NULL OR longer < c.a),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed WHERE rank <= 2000
"""


def merkle_sql(levels: int = 8, group_levels: int = 6) -> str:
    """op12 for groups of up to 8 ** levels documents and 8 ** group_levels groups."""
    def climb(name: str, most: int, tree: str) -> list[str]:
        """Nodes of each level, and what stands before and after each in its run."""
        out = []
        for k in range(most):
            out.append(f"""
{name}s{k} AS (
  SELECT {tree} AS tree, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM {name}{k} WINDOW w AS (PARTITION BY {tree}, pos // 8 ORDER BY pos))""")
            out.append(f"""
{name}{k + 1} AS (
  SELECT {tree} AS tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest
  FROM {name}{k} GROUP BY {tree}, pos // 8)""")
        return out

    def fold(source: str, name: str, most: int, tree: str, pos: str) -> list[str]:
        """node and proof of each row, level by level."""
        out = []
        for k in range(most):
            out.append(f"""
f_{name}{k} AS (
  SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.a || f.node || s.z) ELSE f.node END AS node, f.proof || s.a || s.z AS proof)
  FROM {source} f JOIN {name}s{k} s ON s.tree IS NOT DISTINCT FROM f.{tree} AND s.pos = f.{pos} // {8**k})""")
            source = f"f_{name}{k}"
        return out

    spelled = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(spelled, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END)), 4294967295::BIGINT)"""
    return ",".join([
        f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS tree, {leaf("text")} AS digest,
         CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS candidate
  FROM documents)""",
        """
d0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows)""",
        *climb("d", levels, "tree"),
        f"""
g0 AS (SELECT 0 AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM d{levels})""",
        *climb("g", group_levels, "tree"),
        """
start AS (
  SELECT d.r, d.doc_id, d.digest AS leaf, g.digest AS subroot, d.tree, d.pos, 0 AS top, g.pos AS gpos, coalesce(d.candidate, d.digest) AS node, '' AS proof
  FROM d0 d JOIN g0 g ON g.name IS NOT DISTINCT FROM d.tree)""",
        *fold("start", "d", levels, "tree", "pos"),
        *fold(f"f_d{levels - 1}", "g", group_levels, "top", "gpos"),
    ]) + f"""
SELECT doc_id, leaf, subroot, g.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = g.digest AS verified
FROM f_g{group_levels - 1}, g{group_levels} g"""


OP12 = merkle_sql()

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size),
hits AS (
  SELECT r, i, p.size, item FROM places p JOIN windows v ON v.size = p.size AND v.body = array_to_string(w[i:i + p.size - 1], ' ')),
hit_words AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items t USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op2_minhash_neardup": OP2, "op4_exact_dedup": OP4, "op5_line_dedup": OP5, "op6_quality_rules": OP6, "op7_chat_formatting": OP7, "op11_phrase_collocation": OP11, "op12_merkle_manifest": OP12, "op13_decontamination": OP13}
