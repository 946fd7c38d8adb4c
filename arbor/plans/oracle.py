"""The training plans written out as SQL text for another engine: one block of CTEs per level of a tree.

These texts are an independent statement of what the operators compute; nothing in the engine runs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from arbor.functions.sampling import feature_subset
from arbor.plans.params import TreeParams

EMPTY_VARIANCE = 1.7976931348623157e307


def distinct_bins(columns: list[str], source: str, carry: str, name: str = "b") -> list[str]:
    """CTEs ``{name}`` (carry, b0, b1, ...) and ``thr(f, s, t)`` where every distinct value but the first is a threshold."""
    bins = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS b{i}" for i, c in enumerate(columns))
    values = " UNION ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v FROM {source}" for i, c in enumerate(columns))
    return [f"{name} AS (SELECT {carry}, {bins} FROM {source})", f"thr AS (SELECT f, s - 1 AS s, v AS t FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS s FROM ({values})) WHERE s > 0)"]


def local_thresholds(columns: list[str], source: str) -> str:
    """``thr`` of the local dialect: every distinct value but the last."""
    values = " UNION ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v FROM {source}" for i, c in enumerate(columns))
    return f"thr AS (SELECT f, s, v AS t FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS s, count(*) OVER (PARTITION BY f) AS m FROM ({values})) WHERE s < m - 1)"


@dataclass
class Sums:
    """Sums of an impurity in SQL."""

    kind: str = "variance"
    labels: tuple[float, ...] = ()
    classes: int = 1
    empty: float = EMPTY_VARIANCE
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = {"variance": ["n", "s", "q"], "logistic": ["n", "s", "q", "h"], "gini": ["n", *(f"c{i}" for i in range(len(self.labels)))]}[self.kind]

    def select(self) -> str:
        of = {"n": "w", "s": "w * y", "q": "w * y * y", "h": "w * abs(y) * (1 - abs(y))"} | {f"c{i}": f"CASE WHEN y = {v} THEN w ELSE 0 END" for i, v in enumerate(self.labels)}
        return ", ".join(f"sum(CAST({of[n]} AS DOUBLE)) AS {n}" for n in self.names)

    def value(self, p: str) -> str:
        n = f"{p}n"
        if self.kind == "gini":
            return f"CASE WHEN {n} > 0 THEN 1.0::DOUBLE" + "".join(f" - ({p}c{i} / {n}) * ({p}c{i} / {n})" for i in range(len(self.labels))) + " ELSE 1.0 END"
        return f"CASE WHEN {n} > 0 THEN ({p}q - {p}s * {p}s / {n}) / {n} ELSE {self.empty} END"

    def predict(self, p: str) -> str:
        n = f"{p}n"
        if self.kind == "gini":
            top = f"greatest({', '.join(f'{p}c{i}' for i in range(len(self.labels)))})"
            return "CASE " + " ".join(f"WHEN {p}c{i} = {top} THEN {float(v)}::DOUBLE" for i, v in enumerate(self.labels)) + " END"
        if self.kind == "logistic":
            return f"CASE WHEN {n} > 0 AND {p}h <> 0 THEN {(self.classes - 1) / self.classes!r}::DOUBLE * {p}s / {p}h ELSE 0.0::DOUBLE END"
        return f"CASE WHEN {n} > 0 THEN {p}s / {n} ELSE 0.0::DOUBLE END"


def candidates(points: str, nf: int, sums: Sums, min_child: float, where: str = "TRUE") -> str:
    """A query for every split of the nodes of ``points(node, y, w, b0, ...)``, with weighted impurity."""
    long = " UNION ALL ".join(f"SELECT node, y, w, {i} AS f, b{i} AS b FROM {points} WHERE {where}" for i in range(nf))
    hist = f"SELECT node, f, b, {sums.select()} FROM ({long}) GROUP BY node, f, b"
    left = ", ".join(f"sum({n}) OVER (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS l{n}, sum({n}) OVER (PARTITION BY node, f) AS t{n}" for n in sums.names)
    right = ", ".join(f"t{n} - l{n} AS r{n}" for n in sums.names)
    sides = f"SELECT node, f, b AS s, ln, rn, {sums.value('l')} AS il, {sums.value('r')} AS ir, {sums.predict('l')} AS pl, {sums.predict('r')} AS pr FROM (SELECT *, {right} FROM (SELECT *, {left} FROM ({hist}))) WHERE ln > 0 AND rn > 0 AND ln >= {min_child} AND rn >= {min_child}"
    return f"SELECT *, (ln * il + rn * ir) / (ln + rn) AS wi FROM ({sides})"


def tree(pre: str, base: str, nf: int, p: TreeParams, sums: Sums, tree_id: int = 0) -> list[str]:
    """CTEs of one tree: ``{pre}_p{d}`` rows with node, ``{pre}_nodes`` the nodes and ``{pre}_out`` rows with prediction.

    ``base`` has y, w, b0, b1, ... and whatever is carried along; CTE ``thr`` must exist.
    """
    local = p.dialect == "local"
    out = [f"{pre}_p0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM {base})"]
    parts = []
    for d in range(p.max_depth + 1):
        pts, first = f"{pre}_p{d}", 1 << d
        count = "CAST(count(*) AS DOUBLE)" if d == 0 and not local else "sum(CAST(w AS DOUBLE))"
        out.append(f"{pre}_t{d} AS (SELECT node, cnt, {sums.value('')} AS impurity, {sums.predict('')} AS predict FROM (SELECT node, {count} AS cnt, {sums.select()} FROM {pts} WHERE node >= {first} GROUP BY node))")
        if d == p.max_depth:
            parts.append(f"SELECT node, {d} AS depth, cnt, impurity, predict, TRUE AS is_leaf, NULL::INTEGER AS f, NULL::INTEGER AS s FROM {pre}_t{d}")
            break
        allowed = "TRUE"
        if p.col_rate < 1 - 1e-6:
            allowed = "(" + " OR ".join(f"(node = {n} AND f IN ({', '.join(map(str, feature_subset(nf, p.col_rate, p.seed, tree_id, n)))}))" for n in range(first, 2 * first)) + ")"
        size = f" AND cnt > {p.min_node_size}" if local else ""
        out.append(
            f"{pre}_s{d} AS (SELECT k.node, f, s FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(wi, 9), f, s) AS rk FROM ({candidates(pts, nf, sums, 0 if local else p.min_node_size, f'node >= {first}')}) WHERE {allowed}) k"
            f" JOIN {pre}_t{d} t ON t.node = k.node WHERE rk = 1 AND impurity - wi >= {p.min_info_gain}{size})"
        )
        parts.append(f"SELECT t.node, {d} AS depth, cnt, impurity, predict, z.node IS NULL AS is_leaf, z.f, z.s FROM {pre}_t{d} t LEFT JOIN {pre}_s{d} z ON z.node = t.node")
        bin_of = "CASE z.f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(nf)) + " END"
        out.append(f"{pre}_p{d + 1} AS (SELECT q.* REPLACE (CASE WHEN z.node IS NULL THEN q.node ELSE 2 * q.node + CASE WHEN {bin_of} > z.s THEN 1 ELSE 0 END END AS node) FROM {pts} q LEFT JOIN {pre}_s{d} z ON z.node = q.node)")
    out.append(
        f"{pre}_nodes AS (SELECT n.node AS node_id, CAST(n.depth AS INTEGER) AS depth, n.cnt AS count, n.impurity, n.predict, n.is_leaf, CAST(n.f AS INTEGER) AS split_f, CAST(n.s AS INTEGER) AS split_s, thr.t AS threshold FROM ({' UNION ALL '.join(parts)}) n LEFT JOIN thr ON thr.f = n.f AND thr.s = n.s)"
    )
    out.append(f"{pre}_out AS (SELECT q.*, n.predict AS pred FROM {pre}_p{p.max_depth} q JOIN {pre}_nodes n ON n.node_id = q.node)")
    return out


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def greedy_thresholds(source: str, column: str, bins: int, dialect: str = "distributed") -> list[str]:
    """Recursive CTEs ending in ``g(i, t)``: the greedy thresholds of a column of more than ``bins`` distinct values."""
    values = f"v AS (SELECT row_number() OVER (ORDER BY x) - 1 AS i, x, c, count(*) OVER () AS m, sum(c) OVER () AS n FROM (SELECT CAST({column} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY 1))"
    if dialect == "distributed":
        step = f"""g0 AS (
  SELECT 0::BIGINT AS i, c AS acc, n / {bins} AS target, abs(n / {bins} - c) AS bias, 0::BIGINT AS emitted, NULL::DOUBLE AS t FROM v WHERE i = 0
  UNION ALL
  SELECT i, acc, CASE WHEN emit AND NOT force THEN target + n / {bins} ELSE target END, CASE WHEN force THEN bias WHEN emit THEN abs(target + n / {bins} - acc) ELSE new_bias END, emitted + CASE WHEN emit THEN 1 ELSE 0 END, CASE WHEN emit THEN x END
  FROM (SELECT v.i, v.x, v.n, g0.target, g0.bias, g0.emitted, {bins - 1} - g0.emitted >= v.m - v.i AS force,
      CASE WHEN {bins - 1} - g0.emitted >= v.m - v.i THEN g0.acc ELSE g0.acc + v.c END AS acc, abs(g0.target - (g0.acc + v.c)) AS new_bias,
      {bins - 1} - g0.emitted >= v.m - v.i OR abs(g0.target - (g0.acc + v.c)) > g0.bias AS emit
    FROM g0 JOIN v ON v.i = g0.i + 1))"""
    else:
        step = f"""g0 AS (
  SELECT 0::BIGINT AS i, c AS acc, n / {bins} AS target, x AS last, NULL::DOUBLE AS t FROM v WHERE i = 0
  UNION ALL
  SELECT v.i, g0.acc + v.c, CASE WHEN abs(g0.target - g0.acc) < abs(g0.target - (g0.acc + v.c)) THEN g0.target + v.n / {bins} ELSE g0.target END, v.x,
    CASE WHEN abs(g0.target - g0.acc) < abs(g0.target - (g0.acc + v.c)) THEN g0.last END
  FROM g0 JOIN v ON v.i = g0.i + 1)"""
    return [values, step, "g AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, t FROM g0 WHERE t IS NOT NULL)"]
