"""The shared views as SQL: what the checking engine reads. `views.py` builds the same in Spark."""

from __future__ import annotations

KEYED = "USING KEY"
CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(names: list[str], body: str) -> str:
    """Put the named views, and the views they need, before the query."""
    order: list[str] = []

    def visit(n: str) -> None:
        deps, _ = CTES[n]
        for d in [deps] if KEYED in deps else deps.split():
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    heads = ",\n".join(
        f"{n} AS {'' if KEYED in n else 'MATERIALIZED '}({CTES[n][1].strip()})" for n in order)
    start = "WITH RECURSIVE" if any(KEYED in n for n in order) else "WITH"
    extra = body.strip()
    if extra.upper().startswith("WITH RECURSIVE "):
        start, extra = "WITH RECURSIVE", "WITH " + extra[15:]
    if extra.upper().startswith("WITH "):
        return f"{start} {heads},\n{extra[5:]}"
    return f"{start} {heads}\n{extra}"


cte("grid", "", """
SELECT CAST(floor(sqrt(count(*) / 4.0)) AS INT) AS side FROM orders
""")

cte("scene_obs", "grid", """
SELECT CAST(2022 + (year(l_shipdate) - 1995) % 5 AS INT) AS year,
       CAST((l_orderkey % (side * side)) // side AS INT) AS row,
       CAST((l_orderkey % (side * side)) % side AS INT) AS col,
       l_shipdate AS ts, l_suppkey AS scene_id, CAST(l_suppkey % 100 AS INT) AS cloud_pct,
       CASE l_partkey % 10 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 2 ELSE 0 END AS qa,
       CASE l_partkey % 12 WHEN 3 THEN 3 WHEN 8 THEN 9 ELSE 4 END AS scl,
       40000 + l_extendedprice / 10.5 AS st_b10,
       l_discount AS b2, 0.03 + l_tax AS b3, 0.05 + l_discount AS b4, 0.08 + l_tax AS b5,
       0.1 + l_quantity / 100 AS b8, 0.1 + l_quantity / 110 AS b8a,
       0.15 + l_extendedprice / 500000 AS b6, 0.12 + l_extendedprice / 400000 AS b11,
       CAST(l_suppkey % 9 AS INT) AS lulc
FROM lineitem, grid
""")

_BLOCK = ("(CAST(row * 5 // side AS INT) * 5 + CAST(col * 5 // side AS INT))")

cte("composites", "scene_obs", """
SELECT year, row, col,
       quantile_cont(CASE WHEN (qa & 24) = 0 THEN st_b10 END, 0.5) AS st_b10,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) AND b2 > 0 THEN b2 END, 0.5) AS b2,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b3 END, 0.5) AS b3,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) AND b2 > 0 THEN b4 END, 0.5) AS b4,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b5 END, 0.5) AS b5,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b6 END, 0.5) AS b6,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) AND b2 > 0 THEN b8 END, 0.5) AS b8,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b8a END, 0.5) AS b8a,
       quantile_cont(CASE WHEN scl NOT IN (3, 8, 9, 10) THEN b11 END, 0.5) AS b11,
       count(CASE WHEN (qa & 24) = 0 THEN st_b10 END) AS clear_count
FROM scene_obs GROUP BY year, row, col
""")

cte("modes", "scene_obs", """
SELECT year, row, col, lulc AS lulc_class, n AS mode_count FROM (
  SELECT year, row, col, lulc, count(*) AS n,
         row_number() OVER (PARTITION BY year, row, col ORDER BY count(*) DESC, lulc) AS k
  FROM scene_obs GROUP BY year, row, col, lulc) WHERE k = 1
""")

cte("cells", "composites modes grid", f"""
SELECT c.year, c.row, c.col,
       round(st_b10 * 0.00341802 + 149.0 - 273.15, 6) AS lst_c,
       round((b8 - b4) / nullif(b8 + b4, 0), 6) AS ndvi,
       round((b11 - b8a) / nullif(b11 + b8a, 0), 6) AS ndbi,
       round((b8a - b5) / nullif(b8a + b5, 0), 6) AS ndre,
       round((b5 - b6) / nullif(b5 + b6, 0), 6) AS ndmi,
       round((b3 - b6) / nullif(b3 + b6, 0), 6) AS mndwi,
       round(((b6 + b4) - (b5 + b2)) / nullif((b6 + b4) + (b5 + b2), 0), 6) AS bsi,
       CASE WHEN b8 IS NOT NULL AND b4 IS NOT NULL THEN
         round(least(greatest((round((b8 - b4) / nullif(b8 + b4, 0), 6) - 0.05) / 0.75, 0), 1), 6) END
         AS vegetation_cover,
       m.lulc_class, c.clear_count, {_BLOCK.replace('row', 'c.row').replace('col', 'c.col')} AS block_id,
       ((2 * c.row - side + 1) * (2 * c.row - side + 1)
        + (2 * c.col - side + 1) * (2 * c.col - side + 1)) <= side * side AS in_study
FROM composites c JOIN modes m ON c.year = m.year AND c.row = m.row AND c.col = m.col, grid
""")

cte("lattice", "grid", f"""
SELECT CAST(i // side AS INT) AS row, CAST(i % side AS INT) AS col,
       CAST((i // side) * 5 // side AS INT) * 5 + CAST((i % side) * 5 // side AS INT) AS block_id
FROM (SELECT unnest(generate_series(0, CAST(side * side - 1 AS BIGINT))) AS i, side FROM grid)
""")

for _name, _src in (("roads", "SELECT s_suppkey AS k FROM supplier"),
                    ("vegetation", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
                    ("buildings", "SELECT p_partkey AS k FROM part WHERE p_size > 40")):
    cte(_name, "grid", f"""
SELECT DISTINCT CAST((k * 7919 % (side * side)) // side AS INT) AS row,
       CAST((k * 7919 % (side * side)) % side AS INT) AS col FROM ({_src}), grid
""")


def _dist(name: str) -> str:
    return f"""(SELECT l.row, l.col, sqrt(min((l.row - f.row) * (l.row - f.row)
      + (l.col - f.col) * (l.col - f.col))) * 30.0 AS d FROM lattice l, {name} f GROUP BY l.row, l.col)"""


cte("cells_static", "lattice roads vegetation buildings", f"""
SELECT l.row, l.col, l.block_id,
       CAST(nullif(CASE WHEN (l.row + l.col) % 17 = 0 THEN 255 ELSE (l.row * 7 + l.col * 3) % 9 END, 255) AS INT)
         AS landuse_class,
       r.d AS dist_road_m, v.d AS dist_vegetation_m, b.d AS dist_building_m
FROM lattice l JOIN {_dist('roads')} r ON l.row = r.row AND l.col = r.col
JOIN {_dist('vegetation')} v ON l.row = v.row AND l.col = v.col
JOIN {_dist('buildings')} b ON l.row = b.row AND l.col = b.col
""")

cte("dense", "lattice cells", """
SELECT y.year, l.row, l.col, l.block_id, c.lst_c, c.ndvi, c.ndbi, c.ndre, c.ndmi, c.mndwi, c.bsi,
       c.vegetation_cover, c.lulc_class
FROM (SELECT DISTINCT year FROM cells) y CROSS JOIN lattice l
LEFT JOIN cells c ON c.year = y.year AND c.row = l.row AND c.col = l.col
""")

cte("domain", "cells cells_static", """
SELECT c.*, s.landuse_class, s.dist_road_m, s.dist_vegetation_m, s.dist_building_m
FROM cells c JOIN cells_static s ON c.row = s.row AND c.col = s.col
WHERE lst_c IS NOT NULL AND ndvi IS NOT NULL AND ndbi IS NOT NULL AND ndre IS NOT NULL
  AND ndmi IS NOT NULL AND mndwi IS NOT NULL AND bsi IS NOT NULL AND vegetation_cover IS NOT NULL
""")

cte("terciles", "domain", """
SELECT year, quantile_cont(lst_c, 1.0/3) AS t1, quantile_cont(lst_c, 2.0/3) AS t2
FROM domain WHERE block_id NOT IN (2, 9, 15, 23) GROUP BY year
""")

cte("rule_score", "domain", """
SELECT d.*, round(
    CASE WHEN b95 = b5 THEN 0 ELSE (least(greatest(ndbi, b5), b95) - b5) / (b95 - b5) END
  - CASE WHEN v95 = v5 THEN 0 ELSE (least(greatest(ndvi, v5), v95) - v5) / (v95 - v5) END, 6) AS s
FROM domain d JOIN (
  SELECT year AS qy, quantile_cont(ndbi, 0.05) AS b5, quantile_cont(ndbi, 0.95) AS b95,
         quantile_cont(ndvi, 0.05) AS v5, quantile_cont(ndvi, 0.95) AS v95
  FROM domain GROUP BY year) ON qy = d.year
""")

cte("classed", "rule_score terciles", """
SELECT *, CASE WHEN c2 >= c0 AND c2 >= c1 AND NOT (c0 >= c2) AND NOT (c1 >= c2) THEN 2
               WHEN c1 > c0 THEN 1 ELSE 0 END AS y_pred,
       greatest(p0, p1, p2) AS confidence, round(p1 + 2 * p2, 6) AS severity_score
FROM (
  SELECT r.*, CAST(lst_c >= t1 AS INT) + CAST(lst_c >= t2 AS INT) AS y_true,
         round(w0 / (w0 + w1 + w2), 6) AS p0, round(w1 / (w0 + w1 + w2), 6) AS p1,
         round(w2 / (w0 + w1 + w2), 6) AS p2,
         CAST(round(w0 / (w0 + w1 + w2), 6) AS FLOAT) AS c0, CAST(round(w1 / (w0 + w1 + w2), 6) AS FLOAT) AS c1,
         CAST(round(w2 / (w0 + w1 + w2), 6) AS FLOAT) AS c2
  FROM (SELECT *, greatest(0, 1 - abs(2 * s + 1) / 2) AS w0, greatest(0, 1 - abs(2 * s) / 2) AS w1,
               greatest(0, 1 - abs(2 * s - 1) / 2) AS w2 FROM rule_score) r
  JOIN terciles t ON t.year = r.year)
""")
