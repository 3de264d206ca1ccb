"""DuckDB SQL of clustering trees: joins one by one in a recursive query, whose rows hold the matrix as lists.

For the few samples of the registered queries.  The rules are those of `operators.tree.cluster`: the smallest distance, first in row
order; the larger cluster keeps its number, the one with the smaller number if they are as large.
"""

from __future__ import annotations

_RANGE = "range(1, len(size) + 1)"
_BOTH = "CASE linkage WHEN 'complete' THEN greatest({a}, {b}) WHEN 'single' THEN least({a}, {b}) ELSE (size[kept] * {a} + size[gone] * {b}) / (size[kept] + size[gone]) END"


def _number(x: str) -> str:
    """A number with up to seven decimals."""
    return f"regexp_replace(regexp_replace(printf('%.7f', {x}), '0+$', ''), '\\.$', '')"


def _put(column: str, value: str) -> str:
    """A list with another value for the cluster that is kept."""
    return f"list_transform({_RANGE}, lambda r: CASE WHEN r = kept THEN {value} ELSE {column}[r] END) AS {column}"


def joins(source: str, prefix: str, linkages: str) -> str:
    """Common table expressions that end in `joined` (grp, linkage, turn, lvl, own, text): each join's height, names and text.

    source is a query of grp, i, j, dist with i <= j, numbered from 0; names are the prefix and the number.
    """
    a, b = "m[kept][c]", "m[gone][c]"
    cell = _BOTH.format(a=a, b=b)
    across = _BOTH.format(a=a.replace("[c]", "[r]"), b=b.replace("[c]", "[r]"))
    branch = lambda k: f"text[{k}] || ':' || {_number(f'greatest(0.0, lvl - height[{k}])')}"
    pairs = f"flatten(list_transform({_RANGE}, lambda i: list_transform(range(1, i), lambda j: {{'d': m[i][j], 'i': i, 'j': j}})))"
    return f"""source AS ({source}),
cells AS (SELECT grp, i, j, CASE WHEN i < j THEN dist END AS d FROM source UNION ALL SELECT grp, j, i, dist FROM source WHERE i < j),
lines AS (SELECT grp, i, list(d ORDER BY j) AS l FROM cells GROUP BY grp, i),
begun AS (SELECT grp, list(l ORDER BY i) AS m, list('{prefix}' || i ORDER BY i) AS text, list(['{prefix}' || i] ORDER BY i) AS members, list(1 ORDER BY i) AS size, list(0.0::DOUBLE ORDER BY i) AS height FROM lines GROUP BY grp),
steps AS (
SELECT begun.*, linkage, 0 AS turn, NULL::DOUBLE AS lvl, NULL::BIGINT AS kept FROM begun, (SELECT unnest([{linkages}]) AS linkage)
UNION ALL
SELECT grp, list_transform({_RANGE}, lambda r: list_transform({_RANGE}, lambda c: CASE WHEN r = gone OR c = gone OR r = c THEN NULL WHEN r = kept THEN {cell} WHEN c = kept THEN {across} ELSE m[r][c] END)) AS m,
{_put("text", f"'(' || {branch('kept')} || ',' || {branch('gone')} || ')'")}, {_put("members", "list_sort(list_concat(members[kept], members[gone]))")}, {_put("size", "size[kept] + size[gone]")}, {_put("height", "lvl")},
linkage, turn + 1 AS turn, lvl, kept
FROM (SELECT grp, m, text, members, size, height, linkage, turn, p.d AS lvl, CASE WHEN size[p.i] <= size[p.j] THEN p.i ELSE p.j END AS gone, CASE WHEN size[p.i] <= size[p.j] THEN p.j ELSE p.i END AS kept
FROM (SELECT *, list_sort(list_filter({pairs}, lambda x: x.d IS NOT NULL))[1] AS p FROM (SELECT * EXCLUDE (lvl, kept) FROM steps) WHERE turn < len(size) - 1))),
joined AS (SELECT grp, linkage, turn, lvl, members[kept] AS own, text[kept] AS text, turn = len(size) - 1 AS top FROM steps WHERE turn > 0)"""


def newicks(source: str, prefix: str, linkages: str, columns: str) -> str:
    return f"WITH RECURSIVE {joins(source, prefix, linkages)} SELECT {columns}, text || ';' AS newick FROM joined WHERE top"


def support(source: str, prefix: str, replicates: int) -> str:
    """clade, n, support of the clades of group 0 among the groups above."""
    return f"""WITH RECURSIVE {joins(source, prefix, "'complete'")},
clades AS (SELECT DISTINCT grp, array_to_string(own, ' ') AS clade FROM joined WHERE NOT top)
SELECT a.clade, count(b.grp) AS n, CAST(floor(100 * count(b.grp) / {replicates} + 0.5) AS INT) AS support FROM clades a LEFT JOIN clades b ON a.clade = b.clade AND b.grp > 0 WHERE a.grp = 0 GROUP BY a.clade"""


def cut(source: str, prefix: str, height: float) -> str:
    """cluster_id and line of the clusters below a height."""
    return f"""WITH RECURSIVE {joins(source, prefix, "'complete'")},
names AS (SELECT DISTINCT '{prefix}' || i AS name FROM source),
held AS (SELECT name, max_by(own, len(own)) AS own FROM names JOIN joined ON list_contains(own, name) AND lvl <= {height} GROUP BY name),
clusters AS (SELECT DISTINCT coalesce(own, [names.name]) AS own FROM names LEFT JOIN held USING (name)),
numbered AS (SELECT own, CAST(row_number() OVER (ORDER BY len(own) DESC, own) AS INT) AS cluster_id FROM clusters)
SELECT cluster_id, cluster_id || ' ' || len(own) || ' ' || array_to_string(own, ' ') AS line FROM numbered"""
