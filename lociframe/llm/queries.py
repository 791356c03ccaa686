"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from lociframe.llm.fingerprints import op7_fingerprints
from lociframe.llm.html_extraction import op2_html_extraction
from lociframe.llm.jaccard_join import op6_jaccard_join
from lociframe.llm.language_id import op4_language_id
from lociframe.llm.license_scan import op10_license_scan
from lociframe.llm.merkle_manifest import op12_merkle_manifest
from lociframe.llm.mixing import op9_source_mixing
from lociframe.llm.packing import op1_best_fit_packing
from lociframe.llm.periodic_runs import op11_periodic_runs
from lociframe.llm.quality_rules import UNSPACED, op3_quality_rules
from lociframe.llm.substring_dedup import op8_substring_dedup
from lociframe.llm.suffix_dedup import op5_suffix_dedup
from lociframe.llm.url_filters import RULES, WORDS as BAD_WORDS, op13_url_filters

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filters": op13_url_filters,
}

WORD = r"[^\x20\x09-\x0D]+"
WORDS = rf"SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents"
LETTER, CAPITAL = r"\p{L}", r"\p{Lu}"
UNSPACED_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED)


def counted(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


FAILED = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "capitals": "100 * n_capitals > 50 * n_letters",
    "exclamations": "100 * n_bangs > 50 * n_words",
    "long_words": "word_chars - n_unspaced > 20 * n_words",
    "short_words": "10 * word_chars < 20 * n_words",
    "no_letters": "100 * n_letters < 25 * word_chars",
}

#: CRC-32 of a number's decimal digits: the register meets each byte, then is shifted eight times.
CRC32 = """xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256, 256]::UBIGINT[])),
  lambda r, x: CASE WHEN x < 256 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END), 4294967295::UBIGINT)"""
RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def encoded(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(encoded, ("doc_id", "source", "lang", "n_chars", text))) + ")"


ORACLE = {
    "op3_quality_rules": rf"""
WITH w AS ({WORDS}),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM grams) WHERE m > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + d AS at FROM twice, (VALUES (0), (1), (2)) AS v(d)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(ws) AS n_words, {counted(WORD)} AS word_chars, {counted('[#*$%&|<>]')} AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, {counted(LETTER)} AS n_letters, {counted(CAPITAL)} AS n_capitals, {counted('!')} AS n_bangs, {counted('[' + UNSPACED_CLASS + ']')} AS n_unspaced
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, {" + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(FAILED.values()))} AS failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM judged""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach AS r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id""",
    "op8_substring_dedup": rf"""
WITH w AS ({WORDS}),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + d AS place FROM again, range(50) AS v(d)),
kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w) AS e ANTI JOIN gone USING (doc_id, place) GROUP BY e.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_periodic_runs": rf"""
WITH w AS (SELECT doc_id, ({CRC32})::BIGINT AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
edit AS (SELECT *, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM w WHERE h % 10 = 0 AND len(ws) > 0),
d AS (SELECT doc_id, ws FROM w WHERE h % 10 <> 0 OR len(ws) = 0
  UNION ALL SELECT doc_id, list_transform(range(len(ws)::BIGINT), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) FROM edit),
-- a stretch of three periods holds two neighbouring multiples of the period
q AS (SELECT doc_id, ws, unnest(range(1, len(ws) // 4 + 1)) AS q FROM d),
m AS (SELECT doc_id, q, ws, unnest(range(0, len(ws) - 2 * q, q)) AS m FROM q),
maybe AS (SELECT DISTINCT doc_id, q FROM m WHERE ws[m + 1] = ws[m + q + 1] AND ws[m + q + 1] = ws[m + 2 * q + 1] AND ws[m + 1 : m + q] = ws[m + q + 1 : m + 2 * q]),
same AS (SELECT doc_id, q, i FROM (SELECT doc_id, q, ws, unnest(range(len(ws) - q)) AS i FROM maybe JOIN d USING (doc_id)) WHERE ws[i + 1] = ws[i + q + 1]),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches WHERE n >= greatest(6, 4 * q) GROUP BY doc_id, s, n),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
-- exact: lengths and periods stay far below 2^26
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d) AS e ANTI JOIN gone USING (doc_id, i) GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, n::BIGINT AS length, q::BIGINT AS period, (1000 * n // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE l AS (SELECT doc_id, source, {leaf("text")} AS leaf, {CRC32} % 2 = 0 AS tampers, {leaf("replace(text, chr(10), '')")} AS tampered FROM documents),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM l),
trees(source, lvl, i, m, h) AS (
  SELECT source, 0, i, m, leaf FROM pos
  UNION ALL SELECT source, lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE m > 1 GROUP BY source, lvl, i // 3, m),
subroots AS (SELECT source, h, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM trees WHERE m = 1),
top(lvl, i, m, h) AS (
  SELECT 0, i, m, h FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE m > 1 GROUP BY lvl, i // 3, m),
-- left and right siblings of every node that has a parent
near AS (SELECT source, lvl, i, string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft, string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt FROM trees WHERE m > 1 WINDOW a AS (PARTITION BY source, lvl, i // 3 ORDER BY i)),
near_top AS (SELECT lvl, i, string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft, string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt FROM top WHERE m > 1 WINDOW a AS (PARTITION BY lvl, i // 3 ORDER BY i)),
steps AS (
  SELECT p.doc_id, p.leaf, n.lvl AS step, n.lft, n.rgt FROM pos AS p JOIN near AS n ON n.source IS NOT DISTINCT FROM p.source AND n.i = p.i // (3 ** n.lvl)::BIGINT
  UNION ALL SELECT p.doc_id, p.leaf, s.height + n.lvl, n.lft, n.rgt FROM pos AS p JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source JOIN near_top AS n ON n.i = s.i // (3 ** n.lvl)::BIGINT),
paths AS (SELECT doc_id, leaf, list(coalesce(lft, '') ORDER BY step) AS ls, list(coalesce(rgt, '') ORDER BY step) AS rs, string_agg(coalesce(lft, '') || coalesce(rgt, ''), '' ORDER BY step) AS t FROM steps GROUP BY doc_id, leaf),
folds(doc_id, leaf, k, h, ls, rs) AS (
  SELECT p.doc_id, p.leaf, 0, CASE WHEN tampers THEN tampered ELSE p.leaf END, coalesce(ls, []), coalesce(rs, []) FROM pos AS p LEFT JOIN paths AS x ON x.doc_id = p.doc_id AND x.leaf = p.leaf
  UNION ALL SELECT doc_id, leaf, k + 1, sha256(ls[k + 1] || h || rs[k + 1]), ls, rs FROM folds WHERE k < len(ls))
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(x.t, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM pos AS p JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT h FROM top WHERE m = 1) AS r
LEFT JOIN paths AS x ON x.doc_id = p.doc_id AND x.leaf = p.leaf JOIN folds AS f ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.k = len(f.ls)""",
    "op13_url_filters": rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fits AS (SELECT page_id, h || x AS rule, v FROM p JOIN (VALUES {RULE_ROWS}) AS r(v, h, x) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || x) DESC, length(h) DESC) = 1)
SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {list(BAD_WORDS)}) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fits USING (page_id)""",
}
