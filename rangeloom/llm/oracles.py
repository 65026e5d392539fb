"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from rangeloom.llm import filter_audit, jaccard_join, licenses, line_dedup

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup_sql(size: int = line_dedup.WINDOW, long: int = line_dedup.LONG) -> str:
    """Windows of lines, their first occurrences, and the texts without the lines that later ones cover."""
    def windows(width: int) -> str:
        at = lambda what, j: what if j == 0 else f"lead({what}, {j}) OVER w"
        key = ", ".join(at("x", j) for j in range(width))
        words = " + ".join(at("words", j) for j in range(width))
        return f"""SELECT doc_id, first, last, key FROM (SELECT doc_id, i AS first, coalesce(lead(i, {width}) OVER w, total) - 1 AS last, [{key}] AS key, r, n, {words} AS words
          FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)) q WHERE r + {width - 1} <= n AND (least(n, {size}) = {width} OR words > {long})"""

    every = " UNION ALL ".join(windows(width) for width in range(1, size + 1))
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS total FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, {_SPACE}) AS x FROM l),
r AS (SELECT doc_id, i, x, total, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id) AS n, len(regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+')) AS words FROM k WHERE x <> ''),
win AS ({every}), placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, first) AS place FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM placed WHERE place > 1),
done AS (SELECT k.doc_id, count(*) FILTER (WHERE x <> '') AS n_lines, count(*) FILTER (WHERE x <> '' AND gone.i IS NOT NULL) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, done.text FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id"""


def jaccard_sql(words: int = jaccard_join.WORDS, percent: int = jaccard_join.PERCENT) -> str:
    """Shingle sets, pairs by common shingles, and the least doc_id that links reach."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM t WHERE len(w) >= {words}) q UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {words - 1}),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM z UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


def licenses_sql() -> str:
    """Base phrases, votes of grams by diagonal, merged diagonals and verified spans."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    gram = licenses.GRAM
    notices = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    tests = " ".join("WHEN {} THEN '{}'".format(" AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split())), label) for phrase, label in licenses.PHRASES.items())
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(gram))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all({_LOW}, '{word}') AS w FROM documents), u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
p AS (SELECT doc_id, i - 1 AS i, CASE {tests} END AS label FROM u), base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id),
n AS (SELECT template, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{word}') AS w FROM (VALUES {notices}) v(template, text)),
g AS (SELECT template, len(w) AS t_len, i - 1 AS t_at, {grams} AS gram FROM (SELECT template, w, unnest(range(1, len(w) - {gram - 2})) AS i FROM n) q),
h AS (SELECT doc_id, template, t_len, u.i - 1 AS pos, t_at FROM u JOIN g ON u.i + {gram - 1} <= len(w) AND g.gram = {grams.replace('w[i', 'w[u.i')}),
v AS (SELECT doc_id, template, t_len, pos - t_at AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) + {gram - 1} AS last, list(t_at) AS ats FROM h GROUP BY 1, 2, 3, 4),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {licenses.SLACK} THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
o AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM s),
m AS (SELECT doc_id, template, t_len, sum(votes) AS votes, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda x: range(x, x + {gram}))))) / t_len AS coverage FROM o GROUP BY doc_id, template, t_len, island),
k AS (SELECT doc_id, list(template) FILTER (WHERE coverage >= {licenses.COVER} AND last - first + 1 <= t_len * {licenses.STRETCH}) AS method, max(coverage) FILTER (WHERE votes > 1) AS best FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(string_split_regex(coalesce(base_labels, ''), ',')[1:CASE WHEN base_labels IS NULL THEN 0 ELSE 99 END], coalesce(method, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(best, 0.0)::double END AS score
FROM t LEFT JOIN base ON base.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id"""


def filter_audit_sql() -> str:
    """Failed filters of each document, then each step of each order as a count over all documents' failed sets."""
    words = "[^ \\t\\n\\x0B\\f\\r]+"
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '{words}') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part, [len(w) < {filter_audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w),
  100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.CAPITALS_PERCENT} * len(text), regexp_matches(text, '{filter_audit.SYMBOLS}'), coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, fails),
k AS (SELECT unnest(range(1, 6)) AS k), o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, o, step, o[step] AS own, n, good, toxic, fails[o[step]] AS fails_own, len(list_filter(fails, lambda y: y)) AS failed, coalesce(list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y])), false) AS gone FROM c CROSS JOIN s),
r AS (SELECT part, array_to_string(list_transform(o, lambda y: chr(64 + CAST(y AS integer))), '') AS filter_order, CAST(step AS integer) AS step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_own AND failed = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fails_own), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_own), 0) AS toxic_lost FROM x GROUP BY part, o, step, own)
SELECT part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup_sql(), "op4_jaccard_join": jaccard_sql(), "op6_license_scans": licenses_sql(), "op12_filter_audit": filter_audit_sql()}
