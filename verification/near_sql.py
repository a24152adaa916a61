"""Token-set scores and greedy near-duplicate removal, stated in SQL.

The longest common subsequence goes by bit rows in words of 120 bits: a set bit
of ``v`` is a character of one text that is not matched yet, and each character of the
other moves matches by one addition with carries.
"""

_BITS = 120
_ALL = f"{(1 << _BITS) - 1}::HUGEINT"
_N_WORDS = f"(length(x) // {_BITS} + 1)"


def sql_lcs(pairs: str, out: str) -> str:
    """CTEs: ``out`` has ``a, b, lcs`` of the texts ``x`` and ``y`` of ``pairs(a, b, x, y)``."""
    words = f"list_transform(range({_N_WORDS}), lambda k: {{0}}::HUGEINT)"
    added = "q.v + (q.v & q.m) + s.carry"
    row = f"""list_reduce([{{'carry': 0::HUGEINT, 'row': []::HUGEINT[], 'v': 0::HUGEINT, 'm': 0::HUGEINT}}]
     || list_transform(list_zip(acc.v, e.m), lambda z: {{'carry': 0::HUGEINT, 'row': []::HUGEINT[], 'v': z[1], 'm': z[2]}}),
   lambda s, q: {{'carry': ({added}) >> {_BITS}, 'row': list_append(s.row, (({added}) & {_ALL}) | (q.v - (q.v & q.m))), 'v': 0::HUGEINT, 'm': 0::HUGEINT}}).row"""
    return f"""
{out}_at AS (SELECT a, b, i, substr(x, i + 1, 1) AS ch, {_N_WORDS} AS n_words FROM {pairs}, unnest(range(length(x))) r(i)),
{out}_words AS (SELECT a, b, ch, n_words, i // {_BITS} AS w, sum(1::HUGEINT << (i % {_BITS})::HUGEINT) AS m FROM {out}_at GROUP BY ALL),
{out}_chars AS (SELECT a, b, ch, n_words, map_from_entries(list((w, m))) AS by_word FROM {out}_words GROUP BY ALL),
{out}_masks AS (SELECT a, b, map_from_entries(list((ch, list_transform(range(n_words), lambda k: coalesce(by_word[k], 0::HUGEINT))))) AS masks FROM {out}_chars GROUP BY ALL),
{out} AS MATERIALIZED (SELECT a, b, {_BITS} * {_N_WORDS} - list_sum(list_transform(list_reduce(
   [{{'v': {words.format(_ALL.split('::')[0])}, 'm': NULL::HUGEINT[]}}]
   || list_transform(string_split(y, ''), lambda ch: {{'v': NULL::HUGEINT[], 'm': coalesce(masks[ch], {words.format(0)})}}),
   lambda acc, e: {{'v': {row}, 'm': NULL::HUGEINT[]}}).v, lambda z: bit_count(z))) AS lcs
 FROM {pairs} LEFT JOIN {out}_masks USING (a, b))"""


def sql_scores(pairs: str, threshold: float = 0) -> str:
    """CTEs: ``scored(a, b, score)`` of the sorted token lists ``ta`` and ``tb`` of ``pairs(a, b, ta, tb)``.

    Below ``threshold`` the score is some bound below it.
    """
    return f"""
parts AS MATERIALIZED (SELECT a, b, length(array_to_string(list_filter(ta, lambda v: list_contains(tb, v)), ' ')) AS s,
  array_to_string(list_filter(ta, lambda v: NOT list_contains(tb, v)), ' ') AS x,
  array_to_string(list_filter(tb, lambda v: NOT list_contains(ta, v)), ' ') AS y FROM {pairs}),
bounded AS MATERIALIZED (SELECT *, 2 * s + CASE WHEN s > 0 THEN 2 ELSE 0 END + length(x) + length(y) AS total,
  CASE WHEN s > 0 AND (x = '' OR y = '') THEN 100.0::DOUBLE
    WHEN s > 0 THEN 100 - 100.0::DOUBLE * (1 + least(length(x), length(y))) / (2 * s + 1 + least(length(x), length(y))) ELSE 0.0 END AS lower_bound FROM parts),
open AS MATERIALIZED (SELECT a, b, x, y FROM bounded WHERE lower_bound < {threshold or 100} AND x <> '' AND y <> ''
  AND 100 - 100.0 * abs(length(x) - length(y)) / total >= {threshold}),
{sql_lcs("open", "subsequence")},
scored AS (SELECT a, b, greatest(lower_bound, coalesce(100 - 100.0::DOUBLE * (length(x) + length(y) - 2 * lcs) / total, 0)) AS score
  FROM bounded LEFT JOIN subsequence USING (a, b))"""


def sql_kept(rows: str, threshold: float) -> str:
    """CTEs: ``kept(seq)`` of ``rows(id, block, t)``, the sequential pass over texts in comparison form."""
    return f"""
near_rows AS MATERIALIZED (SELECT id, block, array_to_string(string_split(t, ' ')[1:2], ' ') AS prefix, length(t) // 20 AS bucket,
  list_sort(list_distinct(string_split(t, ' '))) AS tokens FROM {rows} WHERE t <> ''),
near_pairs AS MATERIALIZED (SELECT p.id AS a, q.id AS b, p.tokens AS ta, q.tokens AS tb FROM near_rows p JOIN near_rows q
  ON p.block IS NOT DISTINCT FROM q.block AND p.prefix = q.prefix AND p.id < q.id AND abs(p.bucket - q.bucket) <= 1),
{sql_scores("near_pairs", threshold)},
links AS MATERIALIZED (SELECT a, b FROM scored WHERE score >= {threshold} - 1e-9),
places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM near_rows),
earlier AS MATERIALIZED (SELECT places.k, places.id, coalesce(list(links.a) FILTER (links.a IS NOT NULL), []) AS before
  FROM places LEFT JOIN links ON links.b = places.id GROUP BY ALL),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
  SELECT w.k + 1, CASE WHEN list_has_any(w.kept, earlier.before) THEN w.kept ELSE list_append(w.kept, earlier.id) END
  FROM walk w JOIN earlier ON earlier.k = w.k + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS seq FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))"""
