"""SQL answers (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from loanlens.llm.secrets import BASE, RULES

SQL: dict[str, str] = {}

PLAIN = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(65, 91)))


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"


def windows(source: str, size: str) -> str:
    """Rows (id columns, s, g) of consecutive words; `w` is a list, s starts at 1."""
    return f"array_to_string(list_slice({source}.w, s, s + {size} - 1), ' ') AS g"


SQL["op2_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({lowered('text')}, '{PLAIN}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, {windows('d', '4')}
  FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""

SQL["op8_benchmark_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lowered('text')}, '{LETTERS}') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered('text')}, '{LETTERS}') AS w
  FROM benchmark),
asked AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, {windows('i', 'least(13, len(w))')}
  FROM i, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(s) WHERE len(w) > 0),
there AS (
  SELECT doc_id, s, size, {windows('d', 'size')}
  FROM d, (SELECT DISTINCT size FROM asked), unnest(generate_series(1, len(w) - size + 1)) AS t(s)),
matched AS (SELECT doc_id, s, size, item FROM there JOIN asked USING (size, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM matched, unnest(generate_series(s, s + size - 1)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM matched) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op10_substring_dedup"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
seen AS (
  SELECT doc_id, s, {windows('d', '20')}
  FROM d, unnest(generate_series(1, len(w) - 19)) AS t(s)),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM seen),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM ranked, unnest(generate_series(s, s + 19)) AS t(p) WHERE k > 1),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _found(rank: int) -> str:
    """Spans of a rule: lengths of the pieces between matches add up to positions."""
    rule = RULES[rank]
    pattern = rule.pattern
    if pattern.startswith("(?i)"):  # ASCII letters in either case, no others
        words, rest = pattern[4:].split(")", 1)
        pattern = "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in words) + ")" + rest
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, origin AS start, origin + size AS stop FROM (
    SELECT doc_id, len(m[k]) AS size, len(j[k]) AS judged,
      list_sum([len(x) FOR x IN gaps[1:k]]) + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0)
      AS origin
    FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps,
        regexp_extract_all(text, '{pattern}') AS m,
        regexp_extract_all(text, '{pattern}', {rule.group}) AS j FROM d),
      unnest(generate_series(1, len(m))) AS t(k))
  WHERE judged >= {rule.least}"""


SQL["op9_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_found(rank) for rank in range(len(RULES)))}),
told AS (
  SELECT doc_id, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)
    AS span FROM found)
SELECT d.doc_id, count(span) FILTER (WHERE rank = 0) AS n_assign,
  count(span) FILTER (WHERE rank = 1) AS n_access, count(span) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}), ''))
    AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id
"""

SQL["op13_ranked_search"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lowered('text')}, '{LETTERS}') AS w FROM documents),
total AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
asked AS (
  SELECT item_id, term, count(*) AS k
  FROM (SELECT item_id, unnest(regexp_extract_all({lowered('text')}, '{LETTERS}')) AS term
    FROM benchmark) GROUP BY ALL),
there AS (
  SELECT doc_id, term, n, count(*) AS tf
  FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM d)
  SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (
  SELECT term,
    CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS x
  FROM there, total GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(k * x * ((1000000000 * tf)
    // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN there USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: CRC-32 of ASCII text, bit by bit: the reversed polynomial is a fixed value.
_BIT = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"


def crc32(text: str) -> str:
    step = "xor(x, CAST(y AS BIGINT))"
    for k in range(8):
        step = f"list_transform([{step}], lambda z{k}: {_BIT.format(f'z{k}')})[1]"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda x, y: {step}), 4294967295)"


SQL["op11_conversation_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '')
    || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(id := id, bytes := bytes) ORDER BY turn NULLS FIRST, id) AS turns
  FROM t GROUP BY conv_id),
plan AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS p, {crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM plan a LEFT JOIN own b ON b.conv_id = a.p),
steps AS (
  SELECT conv_id, d, len(turns) AS length,
    sha256(array_to_string(list_transform(turns[1:d], lambda x: x.id), ',')) AS node,
    CASE WHEN d > 0
      THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.id), ',')) END AS parent,
    CASE WHEN d > 0 THEN turns[d].bytes ELSE 0 END AS bytes
  FROM rebuilt, unnest(generate_series(0, len(turns))) AS s(d)),
nodes AS (
  SELECT d, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (WHERE length = d), '')) AS ends_sha256
  FROM steps GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (
  SELECT DISTINCT a.d AS d, a.node AS node, b.d AS low_d, b.node AS low
  FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT above.d, above.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves,
    sum(saved) AS saved
  FROM above JOIN nodes ON nodes.d = low_d AND nodes.node = low
  LEFT JOIN kids ON kids.d = low_d AND kids.node = low GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
  coalesce(n_children, 0) AS n_children, n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens,
  n.ends_sha256
FROM nodes n JOIN sums ON sums.d = n.d AND sums.node = n.node
LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node
LEFT JOIN nodes up ON up.d = n.d - 1 AND up.node = n.parent
"""
