"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from lodestone.llm.rules import COMMON_WORDS, GUARD_WORDS, LEAST_COMMON_PART, LEAST_COMMON_SHARE, MOST_CLASS_DISTANCE, MOST_WORD_SHARE

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
COMMON = "[" + ", ".join(f"'{w}'" for w in sorted({w for x in COMMON_WORDS.values() for w in x.split()})) + "]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda x: x <> '')"


#: Five-word shingles of a list of words ``w`` as texts; of fewer words one text that no shingle equals.
GRAMS = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END"

OP10 = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {words("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, length(text) AS chars,
  len(regexp_extract_all(text, '\\p{{Lu}}')) AS up, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Nd}}')) AS digits,
  list_transform({COMMON}, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS common FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  [up, letters - up, digits, n_symbols, chars - word_chars, greatest(chars - letters - digits - n_symbols - (chars - word_chars), 0)] AS classes, list_append(common, n_words - list_sum(common)) AS words FROM b),
h AS (SELECT doc_id, lang, base_failed, n_words, 'c' AS kind, unnest(classes) AS x, generate_subscripts(classes, 1) AS i, list_sum(classes) AS total FROM f
  UNION ALL SELECT doc_id, lang, base_failed, n_words, 'w', unnest(words), generate_subscripts(words, 1), list_sum(words) FROM f),
s AS (SELECT *, CASE WHEN total > 0 THEN x / total ELSE 0 END AS p FROM h),
q AS (SELECT lang, kind, i, avg(p) AS q FROM s WHERE NOT base_failed AND n_words >= {GUARD_WORDS} GROUP BY lang, kind, i),
d AS (SELECT doc_id, s.kind AS kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM s JOIN q ON s.lang IS NOT DISTINCT FROM q.lang AND s.kind = q.kind AND s.i = q.i GROUP BY doc_id, s.kind),
e AS (SELECT s.doc_id, 1 - p AS own, 1 - q AS usual, sqrt(((1 - q) + log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END) / 2) AS most FROM s JOIN q ON s.lang IS NOT DISTINCT FROM q.lang AND s.kind = q.kind AND s.i = q.i WHERE s.kind = 'w' AND s.i = len({COMMON}) + 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(c.d, 6) AS class_distance, round(v.d, 6) AS word_distance,
  NOT base_failed AND NOT (n_words >= {GUARD_WORDS} AND coalesce(c.d > {MOST_CLASS_DISTANCE} OR (usual >= {LEAST_COMMON_SHARE} AND own < {LEAST_COMMON_PART} * usual AND v.d > {MOST_WORD_SHARE} * most), false)) AS kept
FROM f LEFT JOIN d c ON c.doc_id = f.doc_id AND c.kind = 'c' LEFT JOIN d v ON v.doc_id = f.doc_id AND v.kind = 'w' LEFT JOIN e ON e.doc_id = f.doc_id
"""

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
w AS (SELECT *, {words("lower(line)")} AS w FROM l),
s AS (SELECT doc_id, n, list_distinct({GRAMS}) AS g FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, n, len(g) AS size, unnest(g) AS g FROM s),
o AS (SELECT y.doc_id, y.n, y.size AS a, x.size AS b, count(*) AS shared FROM e y JOIN e x ON x.g = y.g AND (x.doc_id, x.n) < (y.doc_id, y.n) GROUP BY y.doc_id, y.n, y.size, x.doc_id, x.n, x.size),
gone AS (SELECT DISTINCT doc_id, n FROM o WHERE shared >= 0.8 * (a + b - shared) - 1e-9),
k AS (SELECT l.*, gone.n IS NULL AS stays FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.n = l.n),
t AS (SELECT doc_id, count(*)::INT AS n_lines, count_if(NOT stays)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM t
"""

OP4 = f"""
WITH iw AS (SELECT item_id, {words("lower(coalesce(text, ''))")} AS w FROM benchmark),
dw AS (SELECT doc_id, {words("lower(coalesce(text, ''))")} AS w FROM documents),
i AS (SELECT item_id, len(w) AS m, unnest({GRAMS}) AS g FROM iw),
ic AS (SELECT item_id, m, g, count(*) AS c FROM i GROUP BY ALL),
d AS (SELECT doc_id, len(w) AS n, unnest({GRAMS}) AS g, generate_subscripts({GRAMS}, 1) - 1 AS p FROM dw),
hit AS (SELECT doc_id, n, p, g, item_id, m, c AS ci FROM d JOIN ic USING (g)),
win AS (SELECT *, unnest(range(0, greatest(n - m, 0) + 1)) AS s FROM (SELECT DISTINCT doc_id, n, item_id, m FROM hit)),
cnt AS (SELECT win.doc_id, win.item_id, win.m, win.n, win.s, hit.g, count(*) AS c, min(hit.ci) AS ci FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND hit.p BETWEEN win.s AND win.s + win.m - 5 GROUP BY ALL),
o AS (SELECT doc_id, item_id, m, n, s, sum(least(c, ci)) AS shared FROM cnt GROUP BY ALL),
v AS (SELECT *, shared / (least(m, n) - 4 + m - 4 - shared) AS similarity FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS k FROM v WHERE similarity >= 0.8 - 1e-9)
SELECT doc_id, item_id, s::INT AS start_word, round(similarity, 6) AS similarity FROM b WHERE k = 1
"""

OP8 = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {words("lower(coalesce(text, ''))")} AS w FROM documents),
e AS (SELECT doc_id, unnest({GRAMS}) AS g FROM dw),
c AS (SELECT doc_id, g, count(*) AS c FROM e GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS shared FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE shared >= 0.8 * (p.n + q.n - shared) - 1e-9),
u AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b)
SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS class_id FROM documents LEFT JOIN reach ON a = doc_id GROUP BY doc_id
"""

SQL = {"op4_decontamination": OP4, "op6_line_dedup": OP6, "op8_near_dedup": OP8, "op10_quality_rules": OP10}

OP12_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: crc32 by its table of 256 remainders, folded over the bytes of each distinct word.
OP12 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, {OP12_WORDS} AS w FROM documents),
b AS (SELECT {OP12_WORDS} AS w FROM benchmark),
f AS (SELECT row, unnest(w) AS w FROM d), g AS (SELECT unnest(w) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM g)),
k AS (SELECT w, list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295) AS c FROM v, crc),
h AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM k),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN h USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
p AS (SELECT row, sum(gain)::BIGINT AS weight FROM f JOIN h USING (w) JOIN gain USING (bucket) GROUP BY row),
x AS (SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN p USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (row)"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT row, doc_id, unnest(range(len(w) - 19)) AS i, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS x FROM d WHERE len(w) >= 20),
o AS (SELECT row, i, min((doc_id, i)) OVER (PARTITION BY x) < (doc_id, i) AS later FROM s),
c AS (SELECT DISTINCT row, unnest(range(i, i + 20)) AS i FROM o WHERE later),
g AS (SELECT row, list(i) AS gone FROM c GROUP BY row),
k AS (SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END AS kept FROM d LEFT JOIN g USING (row))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
SQL |= {"op12_importance": OP12, "op13_passage_dedup": OP13}
