"""DuckDB SQL that the graph queries are held against: graph tables as common table expressions."""

from __future__ import annotations

from ..functions import hashing as H
from ..functions.scalars import PROXY_BUCKETS, PROXY_REST
from ..operators.sampling import PAIR_A, PAIR_B, PAIR_SEED, UNIT
from ..operators.sketches import alpha
from .fixtures import EDGE_LINES_SQL, EDGE_SQL

WRAP = f"{1 << 64}::UHUGEINT"
STRIPPED = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
PARSED = rf"SELECT line, f[1] AS a, f[2] AS b FROM (SELECT line, regexp_split_to_array({STRIPPED}, '\s+') AS f FROM ({EDGE_LINES_SQL}) WHERE {STRIPPED} <> '' AND {STRIPPED}[1] NOT IN ('#', '%')) WHERE len(f) >= 2"
CANONICAL = f"SELECT least(x, y) AS u, greatest(x, y) AS v FROM (SELECT CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y FROM ({PARSED})) WHERE x <> y"
PROXY_CASE = "CASE " + " ".join(f"WHEN proxy <= {top} THEN '{name}'" for top, name in PROXY_BUCKETS) + f" ELSE '{PROXY_REST}' END"
SUMMARY = """SELECT count(*) AS active_nodes, CAST(sum(deg) AS BIGINT) AS degree_sum, round(avg(deg), 9) AS avg_degree, min(deg) AS min_degree, max(deg) AS max_degree,
round(sqrt(greatest(0.0::DOUBLE, avg(deg::DOUBLE * deg) - avg(deg::DOUBLE) * avg(deg::DOUBLE))), 9) AS std_degree,
round(sum(deg)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)), 9) AS density_active_nodes, CAST(sum(CASE WHEN deg = 1 THEN 1 ELSE 0 END) AS BIGINT) AS degree_1_nodes, max(node) AS max_node_id FROM d"""

STATISTICS = f"""WITH q AS MATERIALIZED ({CANONICAL}),
d AS MATERIALIZED (SELECT node, count(*) AS deg FROM (SELECT unnest([u, v]) AS node FROM q) GROUP BY node),
t AS (SELECT count(*) AS active_nodes, CAST(sum(deg) AS BIGINT) AS degree_sum, sum(deg)::DOUBLE / count(*) AS avg_degree, sum(deg::DOUBLE * deg) / count(*) AS sq, min(deg) AS min_degree, max(deg) AS max_degree, CAST(count_if(deg = 1) AS BIGINT) AS degree_1_nodes, max(node) AS max_node_id FROM d),
x AS (SELECT list({{'node': node, 'degree': deg}} ORDER BY deg DESC, node) AS top_degrees FROM (SELECT node, deg FROM d ORDER BY deg DESC, node LIMIT 10)),
e AS (SELECT count(*) AS edges FROM q)
SELECT CAST(to_json({{'raw_edges': edges, 'used_edges': edges, 'active_nodes': active_nodes, 'degree_sum': degree_sum, 'avg_degree': avg_degree, 'min_degree': min_degree, 'max_degree': max_degree,
'std_degree': sqrt(greatest(0.0::DOUBLE, sq - avg_degree * avg_degree)), 'density_active_nodes': degree_sum::DOUBLE / (active_nodes::DOUBLE * (active_nodes::DOUBLE - 1)), 'degree_1_nodes': degree_1_nodes, 'max_node_id': max_node_id, 'top_degrees': top_degrees}}) AS VARCHAR) AS document FROM e, t, x"""


def parsed(columns: str) -> str:
    return f"SELECT {columns} FROM ({PARSED})"


def times(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT * {k}::UHUGEINT) % {WRAP})::UBIGINT"


def xorshift(x: str, n: int) -> str:
    return f"xor({x}, ({x}) >> {n})"


def chain(x: str, steps: list[tuple[str, int]]) -> str:
    """Nested subqueries, so that no step's text is repeated: a scalar subquery binds z each time."""
    out = f"SELECT {x} AS z"
    for kind, k in steps:
        out = f"SELECT {xorshift('z', k) if kind == 'x' else times('z', k)} AS z FROM ({out})"
    return f"({out})"


def hash_s(x: str) -> str:
    return chain(x, [("x", 30), ("*", H.MULTIPLIER_1), ("x", 27), ("*", H.MULTIPLIER_2), ("x", 31)])


def hash_c(x: str, seed: int = 0) -> str:
    k = (H.GAMMA + seed) & ((1 << 64) - 1)
    return chain(f"((({x})::UHUGEINT + {k}::UHUGEINT) % {WRAP})::UBIGINT", [("x", 30), ("*", H.MULTIPLIER_1), ("x", 27), ("*", H.MULTIPLIER_2), ("x", 31)])


def hash_x(x: str) -> str:
    out = f"SELECT xor(({x}) & {H.M32}::UBIGINT, {H.MURMUR_SEED}::UBIGINT) AS z"
    for _ in range(2):
        out = f"SELECT ({xorshift('z', 16)} * {H.MURMUR_MULTIPLIER}::UBIGINT) & {H.M32}::UBIGINT AS z FROM ({out})"
    return f"(SELECT {xorshift('z', 16)} AS z FROM ({out}))"


def as_signed(x: str) -> str:
    return f"(SELECT CASE WHEN q >= {1 << 63}::HUGEINT THEN CAST(q - {1 << 64}::HUGEINT AS BIGINT) ELSE CAST(q AS BIGINT) END FROM (SELECT ({x})::HUGEINT AS q))"


def bits(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 0 ELSE length(bin({x})) END)"


def registers(p: int, kind: str, theta: int) -> str:
    """(node, j, rho) of nodes with theta out-neighbours or more."""
    keep = f"WHERE src IN (SELECT node FROM p WHERE d_out >= {theta})" if theta else ""
    rows = f"SELECT src, {dict(s=hash_s, c=hash_c, x=hash_x)[kind]('dst::UBIGINT')} AS h FROM f {keep}"
    if kind == "x":
        rest = f"(((h << {p}) | 1) & {(1 << (32 - p)) - 1}::UBIGINT)"
        j, rho = f"h >> {32 - p}", f"{33 - p} - {bits(rest)}"
    else:
        w = f"(h & {(1 << (64 - p)) - 1}::UBIGINT)" if kind == "s" else f"(h >> {p})"
        j = f"h >> {64 - p}" if kind == "s" else f"h & {(1 << p) - 1}::UBIGINT"
        rho = f"{65 - p} - {bits(w)}"
    return f"SELECT src AS node, CAST({j} AS INTEGER) AS j, CAST(max({rho}) AS INTEGER) AS rho FROM ({rows}) GROUP BY 1, 2"


def estimate(z: str, v: str, p: int, domain: int) -> str:
    m = f"{1 << p}.0::DOUBLE"
    raw = f"({alpha(1 << p)!r}::DOUBLE * {m} * {m} / {z})"
    top = f"{float(2**domain)!r}::DOUBLE"
    large = f"WHEN {raw} > {top} / 30 THEN -{top} * ln(1 - {raw} / {top})" if domain else ""
    return f"(CASE WHEN {raw} <= 2.5::DOUBLE * {m} AND {v} > 0 THEN {m} * ln({m} / {v}) {large} ELSE {raw} END)"


def with_graph(body: str, g: str = "g1", last: str = "c", regs: tuple[int, str, int] | None = None, gamma: str = ">= 0", domain: int = 64, exact: bool = True, upper: bool = True, theta: int = 0, remap: bool = False) -> str:
    """``body`` over: e edges, d degrees, f oriented edges, p out-degrees, c costs, b both directions, s supports, r registers,
    w union estimates of the routed edges, x their intersections, y all edges with their method. Only what ``last`` needs is defined."""
    edges = EDGE_SQL[g]
    if remap:
        edges = f"SELECT a.id AS u, b.id AS v FROM ({edges}) e0 JOIN ids a ON e0.u = a.node JOIN ids b ON e0.v = b.node"
    with_ = [f"ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT unnest([u, v]) AS node FROM ({EDGE_SQL[g]})))"] if remap else []
    with_ += [
        f"e AS MATERIALIZED ({edges})",
        "d AS MATERIALIZED (SELECT node, count(*) AS deg FROM (SELECT unnest([u, v]) AS node FROM e) GROUP BY node)",
        "f AS MATERIALIZED (SELECT CASE WHEN (a.deg, e.u) < (b.deg, e.v) THEN e.u ELSE e.v END AS src, CASE WHEN (a.deg, e.u) < (b.deg, e.v) THEN e.v ELSE e.u END AS dst FROM e JOIN d a ON e.u = a.node JOIN d b ON e.v = b.node)",
        "p AS MATERIALIZED (SELECT d.node, coalesce(k, 0) AS d_out FROM d LEFT JOIN (SELECT src, count(*) AS k FROM f GROUP BY src) q ON d.node = q.src)",
        "c AS MATERIALIZED (SELECT src, dst, a.d_out AS deg_u, b.d_out AS deg_v, least(a.d_out, b.d_out) AS proxy FROM f JOIN p a ON src = a.node JOIN p b ON dst = b.node)",
    ]
    if last == "b":
        with_.append("b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)")
    if last in "sy":
        with_.append("s AS MATERIALIZED (SELECT f.src, f.dst, coalesce(k, 0) AS support FROM f LEFT JOIN (SELECT a.src, a.dst, count(*) AS k FROM f a JOIN f b ON a.dst = b.src JOIN f c ON c.src = a.src AND c.dst = b.dst GROUP BY 1, 2) t ON f.src = t.src AND f.dst = t.dst)")
    if regs:
        p, kind, th = regs
        m = 1 << p
        with_.append(f"r AS MATERIALIZED ({registers(p, kind, th)})")
        if last in "wxy":
            route = f"SELECT src, dst FROM c WHERE proxy {gamma}" + (f" AND proxy >= {theta}" if theta else "")
            both = f"SELECT src, dst, j, max(rho) AS rho FROM (SELECT t.src, t.dst, j, rho FROM ({route}) t JOIN r ON r.node = t.src UNION ALL SELECT t.src, t.dst, j, rho FROM ({route}) t JOIN r ON r.node = t.dst) GROUP BY 1, 2, 3"
            with_.append(f"w AS MATERIALIZED (SELECT src, dst, {estimate('z', 'v', p, domain)} AS union_estimate FROM (SELECT src, dst, sum(pow(2.0::DOUBLE, -rho)) + {m} - count(*) AS z, ({m} - count(*))::DOUBLE AS v FROM ({both}) GROUP BY 1, 2))")
        if last in "xy":
            if exact:
                hat = "SELECT c.*, c.deg_u + c.deg_v - w.union_estimate AS s_hat FROM c JOIN w ON c.src = w.src AND c.dst = w.dst"
            else:
                with_.append(f"n AS MATERIALIZED (SELECT p.node, coalesce({estimate('z', 'v', p, domain)}, 0.0) AS k FROM p LEFT JOIN (SELECT node, sum(pow(2.0::DOUBLE, -rho)) + {m} - count(*) AS z, ({m} - count(*))::DOUBLE AS v FROM r GROUP BY node) q ON p.node = q.node)")
                hat = "SELECT c.*, a.k + b.k - w.union_estimate AS s_hat FROM c JOIN w ON c.src = w.src AND c.dst = w.dst JOIN n a ON c.src = a.node JOIN n b ON c.dst = b.node"
            high = "least(s_hat, proxy::DOUBLE)" if upper else "s_hat"
            with_.append(f"x AS MATERIALIZED (SELECT *, greatest(0.0::DOUBLE, {high}) AS s_clamped FROM ({hat}))")
        if last == "y":
            with_.append(f"y AS MATERIALIZED (SELECT src, dst, deg_u, deg_v, proxy, TRUE AS hll, proxy {gamma} AS wanted, s_hat, s_clamped FROM x UNION ALL SELECT c.src, c.dst, deg_u, deg_v, proxy, FALSE, proxy {gamma}, support::DOUBLE, support::DOUBLE FROM c JOIN s ON c.src = s.src AND c.dst = s.dst LEFT JOIN (SELECT src AS xs, dst AS xd FROM x) q ON c.src = xs AND c.dst = xd WHERE xs IS NULL)")
    return f"WITH {', '.join(with_)} {body}"


def hybrid_stats() -> str:
    n = "SELECT sum(s_clamped) AS total, count(*) AS n, sum(CASE WHEN hll THEN 1 ELSE 0 END) AS a, sum(CASE WHEN wanted AND NOT hll THEN 1 ELSE 0 END) AS fb, sum(CASE WHEN hll AND s_hat <> s_clamped THEN 1 ELSE 0 END) AS cl FROM y"
    return f"""SELECT round(total, 2) AS total, n AS n_edges, CAST(a AS BIGINT) AS n_approx, CAST(n - a AS BIGINT) AS n_exact, CAST(fb AS BIGINT) AS n_fallback, CAST(cl AS BIGINT) AS n_clamped,
round(a::DOUBLE / n, 9) AS approx_coverage, CASE WHEN a + fb = 0 THEN 0.0::DOUBLE ELSE round(fb::DOUBLE / (a + fb), 9) END AS fallback_ratio, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE round(cl::DOUBLE / a, 9) END AS clamp_ratio FROM ({n})"""


def coin(u: str, v: str, seed: str) -> str:
    part = lambda x, k: f"((({x})::UBIGINT & {H.M32}::UBIGINT) * {k}::UBIGINT & {H.M32}::UBIGINT)"
    inner = hash_x(f"xor({part(v, PAIR_B)}, {part(seed, PAIR_SEED)})")
    return hash_x(f"xor({part(u, PAIR_A)}, {inner})")


def doulion(q: float, seed: int = 42) -> str:
    kept = f"k AS MATERIALIZED (SELECT u, v FROM e WHERE {coin('u', 'v', str(seed))} < {int(q * UNIT)})"
    return f"WITH e AS MATERIALIZED ({EDGE_SQL['g1']}), {kept} SELECT round((SELECT count(*) FROM k a JOIN k b ON a.v = b.u JOIN k c ON c.u = a.u AND c.v = b.v) / {q**3!r}::DOUBLE, 3) AS estimate"


def doulion_repeated(q: float, n: int = 10, base: int = 42, g: str = "g4") -> str:
    kept = f"k AS MATERIALIZED (SELECT seed, u, v FROM e, (SELECT unnest(range({base}, {base + n})) AS seed) WHERE {coin('u', 'v', 'seed')} < {int(q * UNIT)})"
    t = "SELECT seed, count(*) AS t FROM k a JOIN k b USING (seed) JOIN k c USING (seed) WHERE a.v = b.u AND c.u = a.u AND c.v = b.v GROUP BY seed"
    est = f"SELECT coalesce(t, 0) / {q**3!r}::DOUBLE AS x FROM (SELECT unnest(range({base}, {base + n})) AS seed) s LEFT JOIN ({t}) t USING (seed)"
    return f"WITH e AS MATERIALIZED ({EDGE_SQL[g]}), {kept} SELECT {q!r}::DOUBLE AS q, count(*) AS n_seeds, round(avg(x), 3) AS mean_estimate, round(stddev_pop(x), 3) AS std_estimate FROM ({est})"
