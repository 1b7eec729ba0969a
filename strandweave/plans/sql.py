"""Common table expressions of the DuckDB oracles: the adapters of ``adapters`` in SQL."""

from __future__ import annotations

import re

ORDER = "l_linenumber, l_partkey, l_suppkey, l_linestatus, l_quantity, l_extendedprice"
REV = "list_transform(list_reverse({p}), lambda x: {{'n': x.n, 'e': NOT x.e}})"


def rev(p: str) -> str:
    return REV.format(p=p)


def gaf(p: str) -> str:
    return f"array_to_string(list_transform({p}, lambda x: CASE WHEN x.e THEN '>' ELSE '<' END || x.n), '')"


def canon(p: str) -> str:
    return f"CASE WHEN {p} <= {rev(p)} THEN {p} ELSE {rev(p)} END"


def segments(name: str, key: str, length: str) -> str:
    return f"""SELECT name, ln AS len, cov, substr(translate(repeat(md5(name), 110), '0123456789abcdef', 'ACGTTGCAACGTCATG'), 1, ln) AS seq
  FROM (SELECT '{name}' || i AS name, ({length})::INT AS ln, cov FROM (SELECT {key} AS i, avg(l_quantity) AS cov FROM lineitem GROUP BY 1))"""


def links(paths: str, share: float) -> str:
    return f"""SELECT v1, e1, v2, e2, 55 AS overlap, support FROM (
    SELECT v1, e1, v2, e2, count(*) AS support, sum(count(*)) OVER () / count(*) OVER () AS mean FROM (
      SELECT p[i].n AS v1, p[i].e AS e1, p[i + 1].n AS v2, NOT p[i + 1].e AS e2 FROM {paths}, unnest(range(1, len(p))) AS r(i)
      UNION ALL
      SELECT p[i + 1].n, NOT p[i + 1].e, p[i].n, p[i].e FROM {paths}, unnest(range(1, len(p))) AS r(i)
    ) GROUP BY ALL) WHERE support >= {share} * mean"""


CTES = {
    "ln": f"""SELECT l_orderkey AS read, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS k,
    'c' || (l_suppkey % 8) AS n, l_linestatus = 'F' AS e, 's' || l_suppkey AS s, (l_quantity * 100)::INT AS len,
    1 - (l_discount + 0.0) / 10 AS ident, round(l_tax * 1000 - 40)::INT AS gap FROM lineitem""",
    "rp": "SELECT read, list({'n': n, 'e': e} ORDER BY k) AS p, sum(len) AS len FROM ln GROUP BY read",
    "rs": "SELECT read, list({'n': s, 'e': e} ORDER BY k) AS p FROM ln GROUP BY read",
    "cp": f"SELECT read, len, {canon('p')} AS p FROM rp",
    "pc": "SELECT p, count(*) AS n FROM cp GROUP BY p",
    "win": f"SELECT {canon('w')} AS w FROM (SELECT p[i : i + k - 1] AS w FROM pc, unnest(range(1, len(p))) AS a(k), unnest(range(1, len(p) - k + 2)) AS b(i))",
    "sup": "SELECT pc.p, pc.n, pc.n + coalesce(h.c, 0) AS support FROM pc LEFT JOIN (SELECT w, count(*) AS c FROM win GROUP BY w) h ON pc.p = h.w WHERE pc.n + coalesce(h.c, 0) >= 3",
    "sg": segments("c", "l_suppkey % 8", "1000 + 250 * i"),
    "ss": segments("s", "l_suppkey", "1000 + 250 * (i % 9)"),
    "he": links("rp", 1.0),
    "hs": links("rs", 2.5),
    "va": "SELECT s_nationkey AS cid, list({'n': 'c' || (s_suppkey % 8), 'e': s_acctbal > 0} ORDER BY s_suppkey) AS p FROM supplier GROUP BY s_nationkey",
    "comp": """WITH RECURSIVE reach(a, b) AS (
      SELECT name, name FROM ss UNION SELECT reach.a, hs.v2 FROM reach JOIN hs ON reach.b = hs.v1)
    SELECT a AS name, min(b) AS component FROM reach GROUP BY a""",
    "cw": "SELECT component, sum(len * cov) AS weight FROM ss JOIN comp USING (name) GROUP BY component",
    # Alignment records: a line is a record; query positions follow from lengths and gaps.
    "rec": """SELECT read, k, len, ident, gap, n, e,
      (sum(len + gap) OVER w - len - gap)::INT AS q_start, (sum(len + gap) OVER w - gap)::INT AS q_end
      FROM ln WINDOW w AS (PARTITION BY read ORDER BY k)""",
}


def needs(text: str) -> list[str]:
    """Names of the expressions that a text uses, in the order they must be written."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in CTES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s|,|$)", t) and name not in out:
                visit(CTES[name])
                out.append(name)

    visit(text)
    return out


def query(text: str) -> str:
    """A SELECT (or further named expressions and a SELECT) over the shared expressions."""
    shared = [f"{n} AS ({CTES[n]})" for n in needs(text)]
    own = text.strip()
    if own[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*shared, own[15:]])
    if own[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*shared, own[5:]])
    return ("WITH " + ",\n".join(shared) + "\n" if shared else "") + own
