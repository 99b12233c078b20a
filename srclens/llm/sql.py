"""SQL of the problems' queries where SQL can state them over whole tables. The others are tested against brute force."""

from __future__ import annotations

P3 = """
WITH RECURSIVE r AS (SELECT DISTINCT ON (candidate_id) candidate_id AS id, fragment, regexp_extract_all(lower(code), '[a-z0-9_]+') AS toks FROM clone_candidates WHERE code IS NOT NULL AND fragment IN (SELECT fragment FROM clone_limits)),
t AS (SELECT id, fragment, tok, count(*) AS n FROM (SELECT id, fragment, unnest(toks) AS tok FROM r) GROUP BY 1, 2, 3),
s AS (SELECT id, fragment, len(toks) AS size FROM r WHERE len(toks) > 0),
c AS (SELECT a.id AS a, b.id AS b, a.fragment, sum(least(a.n, b.n)) AS common FROM t a JOIN t b ON a.fragment = b.fragment AND a.tok = b.tok AND a.id < b.id GROUP BY 1, 2, 3),
e AS (SELECT c.a, c.b FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b JOIN clone_limits l ON l.fragment = c.fragment WHERE 2.0 * c.common / (x.size + y.size) >= l.similarity - 1e-9),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
g AS (SELECT a AS id, a AS label FROM b UNION SELECT b.b, g.label FROM g JOIN b ON b.a = g.id)
SELECT id AS candidate_id, min(label) AS group_id FROM g GROUP BY 1
"""

P4 = """
WITH s AS (SELECT symbol_id, types, identifiers, parameters, true AS own FROM symbols UNION ALL SELECT symbol_id, types, identifiers, parameters, false FROM catalog_symbols),
v AS (SELECT DISTINCT symbol_id AS id, own, trim(v, ' ' || chr(9)) AS v FROM (SELECT symbol_id, own, unnest(list_concat(list_concat(coalesce(types, []), coalesce(identifiers, [])), coalesce(parameters, []))) AS v FROM s) WHERE v IS NOT NULL AND trim(v, ' ' || chr(9)) <> ''),
n AS (SELECT id, own, count(*) AS size FROM v GROUP BY 1, 2 HAVING count(*) >= 5),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM v a JOIN v b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2)
SELECT c.a AS id_a, c.b AS id_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE (x.own OR y.own) AND c.common >= 0.75 * (x.size + y.size - c.common) - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p4_found": P4}
