"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def near_duplicates(percent: int = 80) -> str:
    """Sets of two-word shingles, links by their intersections, components by reachability."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS x FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
    m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id"""


def _removal(parts: str, hits: str, joint: str, text_of_none: str, names: tuple[str, str]) -> str:
    """Deletes the parts (doc_id, pos, part) at the positions of `hits` and digests what is left."""
    return f"""g AS ({hits}), u AS (SELECT u.doc_id, u.pos, part, g.pos IS NOT NULL AS gone FROM {parts} u LEFT JOIN g ON g.doc_id = u.doc_id AND g.pos = u.pos),
    k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS gone, count(*) FILTER (WHERE gone AND NOT before) AS runs, coalesce(string_agg(part, {joint} ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
    FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM u) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS {names[0]}, coalesce(gone, 0)::BIGINT AS {names[1]}, coalesce(runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, {text_of_none})) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def line_dedup(least: int = 8) -> str:
    """Pairs of equal lines, in runs along their diagonals: the maximal repeated runs; the later copy of each with enough words goes."""
    return f"""WITH d AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS part FROM d),
    p AS (SELECT a.doc_id AS da, b.doc_id AS db, b.pos, b.pos - a.pos AS apart, len(regexp_extract_all(b.part, {WORD})) AS n FROM x a JOIN x b ON a.part = b.part AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.pos < b.pos)),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY da, db, apart ORDER BY pos) AS island FROM p),
    c AS (SELECT db AS doc_id, min(pos) AS first, max(pos) AS last FROM i GROUP BY da, db, apart, island HAVING sum(n) >= {least}),
    {_removal("x", "SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM c", "chr(10)", "''", ("n_lines", "n_removed"))}"""


def substrings(window: int = 35) -> str:
    """Words below a window that starts more than once."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS part FROM d),
    s AS (SELECT doc_id, unnest(range(1, len(w) - {window} + 2)) AS pos, unnest(list_transform(range(1, len(w) - {window} + 2), lambda i: array_to_string(w[i:i + {window - 1}], ' '))) AS win FROM d WHERE len(w) >= {window}),
    c AS (SELECT doc_id, pos FROM s JOIN (SELECT win FROM s GROUP BY win HAVING count(*) > 1) USING (win)),
    {_removal("x", f"SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS pos FROM c", "' '", "''", ("n_words", "n_removed"))}"""


def decontamination(window: int = 13, percent: int = 5) -> str:
    """Windows of every length that items have, joined to the documents' windows."""
    return f"""WITH b AS (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {window}) + 2), lambda k: array_to_string(w[k:k + least(len(w), {window}) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
    d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
    s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
    h AS (SELECT doc_id, pos, n, item_id FROM s JOIN i USING (n, win)),
    c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS spot FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit > 0 AND 100 * n_hit >= {percent} * len(w), false) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
