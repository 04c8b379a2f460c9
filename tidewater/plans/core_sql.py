"""DuckDB SQL of the deduplication core and of name clusters: similarity, rules over pairs, clusters.

Written from the rules, not from the engine: all pairs of rows that share an identifier are judged, and clusters come from a
recursive query. Names have up to 61 characters here, as a row of the table of common subsequences is one BIGINT.
"""

from __future__ import annotations


def lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence: bit i of a row is unset where the table grows at x's character i."""
    full = f"((1::BIGINT << length({x})) - 1)"
    masks = f"list_transform(string_split({y}, ''), lambda ch: CAST(coalesce(list_sum(list_transform(range(length({x})), lambda i: CASE WHEN substr({x}, i + 1, 1) = ch THEN 1::BIGINT << i ELSE 0 END)), 0) AS BIGINT))"
    return f"(length({x}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def ratio(x: str, y: str) -> str:
    return f"CASE WHEN length({x}) + length({y}) = 0 THEN 100::DOUBLE ELSE 200::DOUBLE * {lcs(x, y)} / (length({x}) + length({y})) END"


def similarities(source: str) -> str:
    """CTEs that end in sim (na, nb, similarity) and ratios (x, y, r), for source (na, nb) of distinct pairs of names."""
    words = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
    joined = lambda c: f"array_to_string(list_sort({c}), ' ')"
    return f"""w AS MATERIALIZED (SELECT na, nb, {words('na')} AS wa, {words('nb')} AS wb FROM {source} WHERE na <> nb),
    u AS MATERIALIZED (SELECT na, nb, {joined('wa')} AS ta, {joined('wb')} AS tb, {joined("list_distinct(list_filter(wa, lambda x: list_contains(wb, x)))")} AS com,
      {joined("list_distinct(list_filter(wa, lambda x: NOT list_contains(wb, x)))")} AS oa, {joined("list_distinct(list_filter(wb, lambda x: NOT list_contains(wa, x)))")} AS ob,
      CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS sh, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS lg FROM w),
    t AS MATERIALIZED (SELECT *, trim(com || ' ' || oa) AS fa, trim(com || ' ' || ob) AS fb FROM u),
    pieces AS MATERIALIZED (SELECT na, nb, sh AS x, substr(lg, greatest(i, 0) + 1, i + length(sh) - greatest(i, 0)) AS y FROM t, unnest(range(1 - length(sh), length(lg))) AS g(i)),
    asked AS (SELECT ta AS x, tb AS y FROM t UNION SELECT fa, fb FROM t UNION SELECT com, fa FROM t UNION SELECT com, fb FROM t UNION SELECT x, y FROM pieces),
    ratios AS MATERIALIZED (SELECT x, y, {ratio('x', 'y')} AS r FROM asked),
    part AS (SELECT na, nb, max(r) AS r FROM pieces p JOIN ratios q ON p.x = q.x AND p.y = q.y GROUP BY na, nb),
    sim AS MATERIALIZED (SELECT t.na, t.nb, 0.5::DOUBLE * a.r + 0.3::DOUBLE * (CASE WHEN com <> '' AND (oa = '' OR ob = '') THEN 100 WHEN com <> '' THEN greatest(b.r, c.r, d.r) ELSE b.r END) + 0.2::DOUBLE * part.r AS similarity
      FROM t JOIN part ON t.na = part.na AND t.nb = part.nb JOIN ratios a ON a.x = ta AND a.y = tb JOIN ratios b ON b.x = fa AND b.y = fb JOIN ratios c ON c.x = com AND c.y = fa JOIN ratios d ON d.x = com AND d.y = fb
      UNION ALL SELECT na, nb, 100 FROM {source} WHERE na = nb)"""


def facts(key: str, phone: str) -> str:
    """CTE f of people: what the rules need of each row. key, phone: SQL of normal values, with {0} and without."""
    return f"""f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY record_id) - 1 AS rid, nullif({key.format('full_name')}, '') AS name, {key.format('pan')} AS gov, {key.format('email')} AS email,
      CASE WHEN length({phone}) >= 7 THEN {phone} ELSE '' END AS phone, {key.format('city')} AS addr FROM people)"""


SHARED = "p AS MATERIALIZED (" + " UNION ".join(f"SELECT a.rid AS x, b.rid AS y FROM f a JOIN f b ON a.{c} = b.{c} AND a.{c} <> '' AND a.rid < b.rid" for c in ("gov", "email", "phone")) + ")"
NEXT = "p AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM f a JOIN f b ON b.rid = a.rid + 1)"


def judged(pairs: str) -> str:
    """CTEs from f to j (rid_a, rid_b, similarity, decision, link, reason) for the pairs (x, y) of the CTE p."""
    equal = lambda c: f"(a.{c} = b.{c} AND a.{c} <> '')"
    apart = lambda c: f"(a.{c} <> '' AND b.{c} <> '' AND a.{c} <> b.{c})"
    valid = lambda s: f"({s}.gov || {s}.email || {s}.phone || {s}.addr) <> ''"
    flags = ", ".join([*(f"{equal(c)} AS e_{c}" for c in ("gov", "email", "phone", "addr")), *(f"{apart(c)} AS a_{c}" for c in ("gov", "email", "phone"))])
    return f"""{pairs},
    b AS MATERIALIZED (SELECT x, y, a.name AS na, b.name AS nb, a.addr AS la, b.addr AS lb, {flags}, {valid('a')} AND {valid('b')} AS valid FROM p JOIN f a ON a.rid = x JOIN f b ON b.rid = y),
    n AS MATERIALIZED (SELECT *, na IS NOT NULL AND nb IS NOT NULL AND NOT (a_gov OR (NOT e_gov AND (e_phone AND a_email OR e_email AND a_phone))) AS ask FROM b),
    need AS MATERIALIZED (SELECT DISTINCT na, nb FROM n WHERE ask),
    {similarities('need')},
    places AS (SELECT la, lb, {ratio('la', 'lb')} AS r FROM (SELECT DISTINCT la, lb FROM n WHERE la <> '' AND lb <> '')),
    m AS MATERIALIZED (SELECT n.*, CASE WHEN ask THEN s.similarity END AS sim, l.r AS place FROM n LEFT JOIN sim s ON n.na = s.na AND n.nb = s.nb LEFT JOIN places l ON n.la = l.la AND n.lb = l.lb),
    d AS (SELECT *, CASE WHEN NOT valid THEN 'skip' WHEN e_phone AND NOT e_gov AND (sim IS NULL OR sim < 85) THEN 'block' WHEN e_email AND NOT e_gov AND (sim IS NULL OR sim < 85) THEN 'block'
        WHEN e_addr AND sim < 75 THEN 'block' WHEN a_gov THEN 'block' WHEN e_gov AND sim >= 70 THEN 'merge' WHEN e_gov AND sim < 40 THEN 'block' WHEN e_gov THEN 'skip' WHEN sim >= 85 AND (a_phone OR a_email) THEN 'block' ELSE 'skip' END AS decision,
      (coalesce(0.60::DOUBLE * sim, 0) + CASE WHEN e_email THEN 20 ELSE 0 END + CASE WHEN e_phone THEN 15 ELSE 0 END + coalesce(0.05::DOUBLE * place, 0))
        / nullif(CASE WHEN sim IS NULL THEN 0 ELSE 0.60::DOUBLE END + CASE WHEN e_email OR a_email THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN e_phone OR a_phone THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN place IS NULL THEN 0 ELSE 0.05::DOUBLE END, 0) AS score FROM m),
    k AS (SELECT *, decision = 'merge' OR (decision = 'skip' AND coalesce(sim >= 82 OR (sim >= 72 AND score >= 82), false) AND (e_gov OR e_email OR e_phone)) AS link FROM d),
    j AS MATERIALIZED (SELECT x AS rid_a, y AS rid_b, sim AS similarity, decision, link,
      CASE WHEN decision = 'merge' THEN 'same identifier' WHEN link THEN 'similar name, same ' || CASE WHEN e_gov THEN 'identifier' WHEN e_email THEN 'email' ELSE 'phone' END ELSE decision END AS reason FROM k)"""


def clusters(columns: list[str]) -> str:
    """CTEs from j to c: people with rid, cid (the least rid that links reach) and gaps (nulls in columns)."""
    gaps = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in columns)
    return f"""edge AS MATERIALIZED (SELECT rid_a AS s, rid_b AS t FROM j WHERE link UNION SELECT rid_b, rid_a FROM j WHERE link),
    reach AS (SELECT rid AS s, rid AS t FROM f UNION SELECT reach.s, edge.t FROM reach JOIN edge ON reach.t = edge.s),
    c AS MATERIALIZED (SELECT people.*, r.rid, r.cid, {gaps} AS gaps FROM (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS i FROM people) people JOIN (SELECT s AS rid, min(t) AS cid FROM reach GROUP BY s) r ON people.i = r.rid)"""


def name_clusters(threshold: float = 80.0) -> str:
    """Names taken one by one, in a recursive query whose state is the list of openers so far."""
    words = "array_to_string(list_sort(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: w <> '')), ' ')"
    return f"""WITH RECURSIVE n AS MATERIALIZED (SELECT full_name AS name, count(*) AS n, {words.replace('name', 'full_name')} AS key FROM people WHERE full_name IS NOT NULL GROUP BY full_name),
    o AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY min(name)) AS i FROM n GROUP BY key),
    s AS MATERIALIZED (SELECT b.i, list(a.i) AS before FROM o a JOIN o b ON a.i < b.i AND 200 * least(length(a.key), length(b.key)) >= {threshold} * (length(a.key) + length(b.key)) AND {ratio('a.key', 'b.key')} >= {threshold} GROUP BY b.i),
    w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS opened UNION ALL
      SELECT w.i + 1, CASE WHEN list_has_any(coalesce(s.before, []), w.opened) THEN w.opened ELSE list_append(w.opened, w.i + 1) END FROM w LEFT JOIN s ON s.i = w.i + 1 WHERE w.i < (SELECT max(i) FROM o)),
    z AS MATERIALIZED (SELECT opened FROM w ORDER BY i DESC LIMIT 1),
    g AS (SELECT o.key, coalesce(list_min(list_filter(s.before, lambda x: list_contains(z.opened, x))), o.i) AS cluster FROM o CROSS JOIN z LEFT JOIN s ON o.i = s.i),
    h AS (SELECT n.name, first_value(n.name) OVER (PARTITION BY g.cluster ORDER BY n.n DESC, length(n.name) DESC, n.name) AS canonical FROM n JOIN g ON n.key = g.key)
    SELECT name, canonical FROM h"""


__all__ = ["NEXT", "SHARED", "clusters", "facts", "judged", "lcs", "name_clusters", "ratio", "similarities"]
