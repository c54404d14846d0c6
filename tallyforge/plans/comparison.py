"""SQL for the comparison engine, put together from common table expressions."""

from __future__ import annotations

from tallyforge.operators.items import POPULATIONS
from tallyforge.operators.prepare import RULES
from tallyforge.sources.canonical import TIEBREAKS, cte
from tallyforge.sources.contracts import CONTRACTS

#: The mining settings of the registered queries. The status of the stand-in rows is spread evenly
#: over three values, so thresholds above one third and lift 1 leave no rules to compare.
SUPPORT, CONFIDENCE, LIFT, LONGEST, MOST = 0.01, 0.33, 1.0, 4, 100
START, END, FRACTION = "1995-01-01", "2001-09-01", 0.2


def staged(table: str) -> str:
    c = CONTRACTS[table]
    order = ", ".join(f"{x} DESC" for x in (c.freshness, *TIEBREAKS.get(table, ())))
    names = ", ".join(f.name for f in c.fields)
    return (
        f"stg_{table} AS (SELECT {names} FROM (SELECT *, row_number() OVER (PARTITION BY {c.primary_key} ORDER BY {order}) AS rn FROM {table} "
        f"WHERE {c.primary_key} IS NOT NULL AND {c.freshness} IS NOT NULL) WHERE rn = 1)"
    )


def curated(table: str, mode: str = "canonical", source: str | None = None) -> str:
    """CTEs up to cur_<table>."""
    c, rules = CONTRACTS[table], RULES[table]
    ruled = {r.column: r for r in rules}
    source = source or f"stg_{table}"

    def normal(name: str) -> str:
        rule = ruled.get(name)
        if not rule:
            return name
        return f"nullif(upper(trim({name})), '') AS {name}" if rule.kind == "categorical" else f"try_cast({name} AS DOUBLE) AS {name}"

    out = [f"n_{table} AS (SELECT {', '.join(normal(f.name) for f in c.fields)} FROM {source})"]
    previous, flags = f"n_{table}", []
    for i, rule in enumerate(rules):
        col, step, look = rule.column, f"s{i}_{table}", f"l{i}_{table}"
        carried = ", ".join([f"s.{f.name}" for f in c.fields if f.name != col] + [f"s.{x}" for x in flags])
        flag = f"(s.{col} IS NULL) AS {col}_was_imputed"
        group = ", ".join(rule.group_by)
        if rule.kind == "categorical":
            part = f"PARTITION BY {group} " if group else ""
            out.append(
                f"{look} AS (SELECT * FROM (SELECT {group + ', ' if group else ''}{col} AS mode_value, row_number() OVER ({part}ORDER BY count(*) DESC, {col}) AS rn "
                f"FROM {previous} WHERE {col} IS NOT NULL GROUP BY {group + ', ' if group else ''}{col}) WHERE rn = 1)"
            )
            join = f"LEFT JOIN {look} m ON " + (" AND ".join(f"s.{g} = m.{g}" for g in rule.group_by) or "TRUE")
            value = f"coalesce(s.{col}, m.mode_value, 'UNKNOWN')" if group or mode == "canonical" else f"coalesce(s.{col}, 'UNKNOWN')"
            out.append(f"{step} AS (SELECT {carried}, {value} AS {col}, {flag} FROM {previous} s {join})")
        else:
            out.append(f"{look} AS (SELECT {group}, quantile_cont({col}, 0.5) AS g FROM {previous} GROUP BY {group})")
            join = f"LEFT JOIN {look} m ON " + " AND ".join(f"s.{g} IS NOT DISTINCT FROM m.{g}" for g in rule.group_by)
            everything = f"(SELECT quantile_cont({col}, 0.5) FROM {previous})"
            if mode == "strict":
                everything = f"(SELECT quantile_cont(coalesce(s.{col}, m.g), 0.5) FROM {previous} s {join})"
            out.append(f"{step} AS (SELECT {carried}, coalesce(s.{col}, m.g, {everything}) AS {col}, {flag} FROM {previous} s {join})")
        flags.append(f"{col}_was_imputed")
        previous = step
    out.append(f"cur_{table} AS (SELECT * FROM {previous})")
    return ",\n".join(out)


def tables(*names: str) -> str:
    """WITH clause up to the curated tables named."""
    parts = [cte(*names)] + [staged(n) for n in names] + [curated(n) for n in names]
    return "WITH " + ",\n".join(parts)


def sanitized(column: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(upper(trim(CAST({column} AS VARCHAR))), '[^A-Z0-9_.-]', '_', 'g'), 1, 64), ''), 'UNKNOWN')"


def population_rows(name: str) -> str:
    where = "WHERE upper(category) = 'TRANSACTIONS'" if name == "complaints" else ""
    return f"rows_{name} AS (SELECT * FROM cur_{name} {where})"


def item_rows(name: str, source: str | None = None, out: str = "it") -> str:
    """CTE out(key, time, item) in long form; bounds are fitted on the source itself."""
    p = POPULATIONS[name]
    source = source or f"rows_{name}"
    numeric = [c for c in p.numeric if c not in p.leaking]
    parts = []
    for c in (p.target, *p.categorical):
        few = "" if c == p.target else f" WHERE (SELECT count(DISTINCT {c}) FROM {source}) <= {MOST}"
        parts.append(f"SELECT {p.key} AS key, {p.time} AS time, '{c}=' || {sanitized(c)} AS item FROM {source}{few}")
    for c in p.boolean:
        if c not in p.leaking:
            parts.append(f"SELECT {p.key}, {p.time}, '{c}=' || CASE WHEN {c} IS NULL THEN 'UNKNOWN' WHEN {c} THEN 'TRUE' ELSE 'FALSE' END FROM {source}")
    for c in numeric:
        q = f"(SELECT quantile_cont(abs({c}), [0.5, 0.9, 0.99]) AS q FROM {source})"
        parts.append(f"SELECT {p.key}, {p.time}, '{c}=MISSING' FROM {source} WHERE {c} IS NULL")
        bucket = f"CASE WHEN abs({c}) <= q[1] THEN 'LOW' WHEN abs({c}) <= q[2] THEN 'MEDIUM' WHEN abs({c}) <= q[3] THEN 'HIGH' ELSE 'EXTREME' END"
        parts.append(f"SELECT {p.key}, {p.time}, '{c}_bucket=' || {bucket} FROM {source}, {q} WHERE {c} IS NOT NULL")
        parts.append(f"SELECT {p.key}, {p.time}, '{c}_sign=NEGATIVE' FROM {source} WHERE {c} < 0")
        if c not in p.non_negative:
            parts.append(f"SELECT {p.key}, {p.time}, '{c}_sign=NON_NEGATIVE' FROM {source} WHERE {c} >= 0")
    return f"{out} AS ({' UNION ALL '.join(parts)})"


def itemsets(source: str = "it", prefix: str = "") -> str:
    """CTEs <prefix>total, least and sets(items, k, n) of up to four items; each length joins the frequent sets of the length before on the row."""
    p = prefix
    return f"""{p}tot AS (SELECT count(DISTINCT key) AS total FROM {source}),
{p}lst AS (SELECT greatest(1, ceil({SUPPORT} * total - 1e-12)) AS least FROM {p}tot),
{p}f1 AS (SELECT item, count(*) AS n FROM {source} GROUP BY item HAVING count(*) >= (SELECT least FROM {p}lst)),
{p}h AS (SELECT key, item FROM {source} JOIN {p}f1 USING (item)),
{p}p2 AS MATERIALIZED (SELECT key, a.item AS i1, b.item AS i2 FROM {p}h a JOIN {p}h b USING (key) WHERE a.item < b.item),
{p}f2 AS MATERIALIZED (SELECT i1, i2, count(*) AS n FROM {p}p2 GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM {p}lst)),
{p}q2 AS MATERIALIZED (SELECT key, i1, i2 FROM {p}p2 JOIN {p}f2 USING (i1, i2)),
{p}p3 AS MATERIALIZED (SELECT key, i1, a.i2, b.i2 AS i3 FROM {p}q2 a JOIN {p}q2 b USING (key, i1) WHERE a.i2 < b.i2),
{p}f3 AS MATERIALIZED (SELECT i1, i2, i3, count(*) AS n FROM {p}p3 GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT least FROM {p}lst)),
{p}q3 AS MATERIALIZED (SELECT key, i1, i2, i3 FROM {p}p3 JOIN {p}f3 USING (i1, i2, i3)),
{p}f4 AS MATERIALIZED (SELECT i1, i2, a.i3, b.i3 AS i4, count(*) AS n FROM {p}q3 a JOIN {p}q3 b USING (key, i1, i2) WHERE a.i3 < b.i3 GROUP BY 1, 2, 3, 4 HAVING count(*) >= (SELECT least FROM {p}lst)),
{p}sets AS (SELECT [item] AS items, 1 AS k, n FROM {p}f1 UNION ALL SELECT [i1, i2], 2, n FROM {p}f2 UNION ALL SELECT [i1, i2, i3], 3, n FROM {p}f3
  UNION ALL SELECT [i1, i2, i3, i4], 4, n FROM {p}f4)"""


def rules(name: str, prefix: str = "") -> str:
    """CTEs up to <prefix>raw, <prefix>flat (no hierarchy), <prefix>han and <prefix>refined rules."""
    p, pop = prefix, POPULATIONS[name]
    t = f"'{pop.target}='"
    above, below = pop.hierarchy[0] if pop.hierarchy else ("-", "-")
    feature = lambda x: f"split_part({x}, '=', 1)"
    general = f"list_sort(list_transform(antecedents, lambda x: CASE WHEN {feature('x')} IN ('{above}', '{below}') THEN '{above}=*' ELSE x END))"
    has = lambda f: f"list_contains(list_transform(antecedents, lambda x: {feature('x')}), '{f}')"
    return f"""{p}whole AS (SELECT list_filter(items, lambda x: NOT starts_with(x, {t})) AS antecedents, list_filter(items, lambda x: starts_with(x, {t}))[1] AS consequent, n
  FROM {p}sets WHERE k > 1 AND len(list_filter(items, lambda x: starts_with(x, {t}))) = 1),
{p}met AS (SELECT w.antecedents, w.consequent, w.n / total AS s, w.n / l.n AS c, (w.n / l.n) / (r.n / total) AS l
  FROM {p}whole w JOIN {p}sets l ON l.items = w.antecedents JOIN {p}f1 r ON r.item = w.consequent, {p}tot),
{p}raw AS (SELECT antecedents, consequent, round(s, 6) AS support, round(c, 6) AS confidence, round(l, 6) AS lift FROM {p}met WHERE c >= {CONFIDENCE} AND l >= {LIFT}),
{p}flat AS (SELECT * FROM {p}raw WHERE NOT ({has(above)} AND {has(below)})),
{p}han AS (SELECT * FROM {p}flat a WHERE NOT ({has(below)} AND EXISTS (SELECT 1 FROM (SELECT antecedents AS wide, consequent AS wc, confidence AS wf FROM {p}flat WHERE {has(above)}) b
  WHERE b.wc = a.consequent AND abs(b.wf - a.confidence) <= 0.05 AND {general} = {general.replace('antecedents', 'b.wide')}))),
{p}refined AS (SELECT * FROM {p}han a WHERE NOT EXISTS (SELECT 1 FROM {p}han b WHERE b.consequent = a.consequent AND len(b.antecedents) < len(a.antecedents)
  AND list_has_all(a.antecedents, b.antecedents) AND a.support = b.support AND a.confidence = b.confidence AND a.lift = b.lift))"""


def mined(name: str) -> str:
    return ",\n".join([tables(name), population_rows(name), item_rows(name), itemsets(), rules(name)])
