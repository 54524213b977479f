"""SQL for the driver's tables that gives the rows of :mod:`allelia.queries`, written for DuckDB."""

from __future__ import annotations

from .params import Hard, Observing, Risk, Soft
from .queries import CAP, CONTACT, N_HYPER, NORMS, SITE

O, R = Observing(), Risk()
EPS = f"least(greatest(1 - (1 - pow(10.0, -(%s) / 10.0)) * (1 - pow(10.0, -least(%s, {O.mapq_cap}) / 10.0)), {O.eps_floor}), {O.eps_ceiling})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def raw(kind: str = "dense") -> str:
    eps = EPS % ("CAST(floor(l_quantity) AS INT)", "l_linenumber * 10")
    return f"""raw AS (SELECT read_id, snp_idx, b, baseq, mapq, ln((1 - eps) / eps) AS weight, l_linenumber, l_extendedprice FROM (
        SELECT l_orderkey AS read_id, {SITE[kind]} AS snp_idx, CAST(floor(l_quantity) AS INT) AS baseq, l_linenumber * 10 AS mapq, {eps} AS eps, l_linenumber, l_extendedprice,
            (CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN {SITE[kind]} % 3 = 0 THEN -1 ELSE 1 END) * (CASE WHEN l_discount > 0.085 THEN -1 ELSE 1 END) AS b
        FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity >= 13 AND l_linenumber * 10 >= 20))"""


def obs(kind: str = "dense") -> str:
    return f"""{raw(kind)}, obs AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY read_id, snp_idx ORDER BY abs(weight) DESC, l_linenumber, l_extendedprice) = 1)"""


def sites(kind: str = "dense") -> str:
    name, key = ("supplier", "s_suppkey") if kind == "dense" else ("part", "p_partkey")
    return f"sites AS (SELECT {key} AS snp_idx, ({key} + 1) * 1000 AS pos1, CASE WHEN {key} % 3 = 0 THEN -1 ELSE 1 END AS tau, {key} // 5 AS block FROM {name})"


def edges(kind: str = "dense", weighted: bool = False) -> str:
    g = "least(wi, wj)" if weighted else "1.0::DOUBLE"
    return f"""{obs(kind)}, {sites(kind)}, pairs AS (SELECT read_id, snp_idx AS i, lead(snp_idx) OVER w AS j, b * lead(b) OVER w AS s, weight AS wi, lead(weight) OVER w AS wj
        FROM obs WINDOW w AS (PARTITION BY read_id ORDER BY snp_idx)),
      edges AS (SELECT i, j, sum(g * s) AS score, sum(abs(g)) AS support, count(*) AS cnt, max(abs(g)) AS max_abs FROM (SELECT *, {g} AS g FROM pairs WHERE j IS NOT NULL AND j <> i) GROUP BY i, j)"""


def measured(kind: str = "dense", weighted: bool = False) -> str:
    return f"""{edges(kind, weighted)}, m0 AS (SELECT e.*, abs(b.pos1 - a.pos1) AS distance_bp, CASE WHEN support > 0 THEN abs(score) / support ELSE 0 END AS confidence,
        CASE WHEN support > 0 THEN max_abs / support ELSE 1 END AS domination, a.tau * b.tau AS expected FROM edges e JOIN sites a ON a.snp_idx = e.i JOIN sites b ON b.snp_idx = e.j),
      measured AS (SELECT *, 1 - confidence AS conflict, {R.confidence} * (1 - confidence) + {R.count} * (CASE WHEN cnt > 0 THEN 1 / ln(1 + cnt) ELSE 1 END) + {R.conflict} * (1 - confidence)
        + {R.distance} * least(distance_bp / {float(R.distance_norm)}, 1.0) + {R.domination} * domination AS risk FROM m0)"""


def classes(kind: str = "dense", h: Hard = Hard(), s: Soft = Soft()) -> str:
    passes = f"confidence >= {h.min_confidence}" if h.mode == "confidence" else f"risk <= {h.max_risk}"
    soft = "FALSE" if s.mode == "none" else f"support >= {s.min_support} AND cnt >= {s.min_count} AND confidence >= {s.min_confidence} AND risk <= {s.max_risk}"
    weak = "drop_weak_hard_confidence" if h.mode == "confidence" else "drop_high_hard_risk"
    return f"""{measured(kind)}, tested AS (SELECT *, support >= {h.min_support} AND cnt >= {h.min_count} AS sup, {passes} AS pas, score * expected > 0 AS sgn, {soft} AS sof FROM measured WHERE distance_bp <= {h.max_distance}),
      kinds AS (SELECT *, CASE WHEN sup AND pas AND sgn THEN 'hard' WHEN sof AND sgn THEN 'soft' WHEN sof THEN 'soft_conflicting_tau' ELSE 'drop' END AS edge_class FROM tested),
      classes AS (SELECT *, CASE edge_class WHEN 'hard' THEN 'hard' WHEN 'soft' THEN 'soft_bridge' WHEN 'soft_conflicting_tau' THEN 'soft_bridge_conflicting_tau' ELSE
        CASE WHEN NOT sup THEN 'drop_weak_hard_support' WHEN NOT pas THEN '{weak}' WHEN NOT sgn THEN 'drop_conflicting_tau' ELSE 'drop_noisy_soft' END END AS status, sup AND pas AND NOT sgn AS conflicting FROM kinds)"""


CLASS_OUT = "SELECT i, j, edge_class, status, conflicting, status IN ('drop_weak_hard_support', 'drop_weak_hard_confidence', 'drop_high_hard_risk') AS weak FROM classes"
EDGE_OUT = f"SELECT i, j, cnt, {r6('score')} AS score, {r6('support')} AS support, {r6('max_abs')} AS max_abs, {r6('CASE WHEN support > 0 THEN abs(score) / support ELSE 0 END')} AS confidence FROM edges"


def margin(kind: str = "dense") -> str:
    """Expects obs and sites; unweighted."""
    return """matrix AS (SELECT read_id, snp_idx, sum(b)::DOUBLE AS v FROM obs GROUP BY ALL),
      field AS (SELECT m.*, s.tau, sum(m.v * s.tau) OVER (PARTITION BY read_id) AS f FROM matrix m JOIN sites s USING (snp_idx)),
      votes AS (SELECT snp_idx, sum(tau * v * sign(f - v * tau)) AS margin FROM field GROUP BY snp_idx),
      margins AS (SELECT snp_idx, coalesce(margin, 0.0) AS margin FROM sites LEFT JOIN votes USING (snp_idx))"""


def closure(pairs: str, nodes: str) -> str:
    """Components of a small graph: pairs(u, v), nodes(node) → roots(node, root)."""
    return f"""link AS (SELECT u, v FROM {pairs} UNION SELECT v, u FROM {pairs}),
      reach(a, b) AS (SELECT node, node FROM {nodes} UNION SELECT r.a, l.v FROM reach r JOIN link l ON l.u = r.b),
      roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


def forest(ranked: str) -> str:
    """ranked(u, v, sign, r), r from 1 in the order that edges are preferred → kept(u, v, sign) of the one forest, and
    walk(a, b, s): the sign of the way from a to b in it.

    An edge is in the forest if no other way between its ends has only better edges: ways by their worst edge."""
    return f"""link AS (SELECT u AS a, v AS b, r FROM {ranked} UNION ALL SELECT v, u, r FROM {ranked}),
      ways(a, b, r) USING KEY (a, b) AS (SELECT a, b, min(r) FROM link GROUP BY a, b UNION
        SELECT n.a, n.b, n.r FROM (SELECT w.a, l.b, min(greatest(w.r, l.r)) AS r FROM ways w JOIN link l ON l.a = w.b WHERE w.a <> l.b GROUP BY w.a, l.b) n
        LEFT JOIN recurring.ways o ON o.a = n.a AND o.b = n.b WHERE o.r IS NULL OR n.r < o.r),
      kept AS (SELECT k.* FROM {ranked} k JOIN ways w ON w.a = k.u AND w.b = k.v WHERE k.r <= w.r),
      step AS (SELECT u AS a, v AS b, sign FROM kept UNION ALL SELECT v, u, sign FROM kept),
      walk(a, b, s) AS (SELECT DISTINCT a, a, 1 FROM step UNION SELECT w.a, t.b, w.s * t.sign FROM walk w JOIN step t ON t.a = w.b)"""


def projected() -> str:
    return f"""{obs()}, {sites()}, matrix AS (SELECT read_id, snp_idx, sum(b)::DOUBLE AS v FROM obs GROUP BY ALL),
      proj AS (SELECT read_id, block, sum(v * tau) AS v FROM matrix JOIN sites USING (snp_idx) GROUP BY ALL HAVING sum(v * tau) <> 0)"""


def vectors() -> str:
    return f"{projected()}, vec AS (SELECT read_id, list(block ORDER BY block) AS path, list(v ORDER BY block) AS vals FROM proj GROUP BY read_id)"


def hyper(norm: str = "sqrt_cap") -> str:
    cap, dom = CAP["cap"], CAP["domination"]
    clip = lambda x: f"greatest(-{cap}, least({cap}, {x}))"
    value = {
        "sum": "raw", "mean": "raw / reads", "sqrt": "raw / sqrt(reads)", "cap": clip("raw"), "sqrt_cap": clip("raw / sqrt(reads)"),
        "degree_norm_cap": clip("raw / sqrt(degree * block_degree)"), "adaptive_dom_cap": f"CASE WHEN domination >= {dom} THEN {clip('raw')} ELSE raw END",
    }[norm]
    capped = f"CASE WHEN domination >= {dom} THEN 1 ELSE 0 END" if norm == "adaptive_dom_cap" else "0"
    return f"""{vectors()}, turned AS (SELECT path, list_transform(vals, lambda x: x * sign(vals[1])) AS vals FROM vec WHERE len(path) > 1),
      keyed AS (SELECT path, vals, list_transform(vals, lambda x: CAST(sign(x) AS INT)) AS signs FROM turned),
      flat AS (SELECT path, signs, unnest(path) AS block, unnest(vals) AS v FROM keyed),
      pats AS (SELECT path, signs, block, sum(v) AS raw, count(*) AS reads FROM flat GROUP BY ALL),
      ids AS (SELECT path, signs, row_number() OVER (ORDER BY path, signs) - 1 AS hyper FROM (SELECT DISTINCT path, signs FROM pats)),
      degrees AS (SELECT p.*, hyper, len(path) AS degree, count(*) OVER (PARTITION BY block) AS block_degree, abs(raw) / sum(abs(raw)) OVER (PARTITION BY block) AS domination FROM pats p JOIN ids USING (path, signs)),
      hyper AS (SELECT *, {value} AS value, {capped} AS capped FROM degrees)"""


def soft() -> str:
    s = Soft()
    return f"""softs AS (SELECT least(a.block, b.block) AS l, greatest(a.block, b.block) AS r, sum(greatest(-{s.cap}, least({s.cap}, score * expected * {s.scale}))) AS coeff, sum(cnt) AS support, sum(abs(score)) AS raw
        FROM classes c JOIN sites a ON a.snp_idx = c.i JOIN sites b ON b.snp_idx = c.j WHERE edge_class LIKE 'soft%' AND a.block <> b.block GROUP BY ALL),
      soft AS (SELECT * FROM softs WHERE coeff <> 0)"""


def without(text: str, *names: str) -> str:
    """A list of CTEs without those that another list in front of it has already."""
    head = ", ".join(names)
    assert text.startswith(head), names
    return text[len(head) :].lstrip(", \n")


def both() -> str:
    """hyper and soft together."""
    shared = f"{obs()}, {sites()}"
    return f"{hyper()}, {without(classes(), shared)}, {soft()}"


def ising() -> str:
    return f"""{both()}, half AS (SELECT hyper AS u, block + {N_HYPER} AS v, value AS w FROM hyper UNION ALL SELECT l + {N_HYPER}, r + {N_HYPER}, coeff FROM soft),
      ising AS (SELECT u, v, sum(w) AS w FROM (SELECT * FROM half UNION ALL SELECT v, u, w FROM half) GROUP BY ALL HAVING sum(w) <> 0)"""


CANDS = "cands AS (SELECT unnest(range(6)) AS cand)"
SAMPLES = f"{CANDS}, samples AS (SELECT block, cand, CASE WHEN (block * 7 + cand * 3) % 5 < 2 THEN -1 ELSE 1 END AS z FROM (SELECT DISTINCT block FROM sites), cands), labels AS (SELECT DISTINCT block, block // 4 AS component FROM sites)"
#: The projection with each read's values moved to the component that its number names, as the queries deal them.
DEALT = """parts AS (SELECT count(*) AS n FROM (SELECT DISTINCT block FROM sites)),
      dealt AS (SELECT read_id, CASE WHEN first + block % 4 < n THEN first + block % 4 ELSE first END AS block, sum(v) AS v
        FROM (SELECT read_id, block, v, n, read_id % CAST(ceil(n / 4) AS BIGINT) * 4 AS first FROM proj, parts) GROUP BY 1, 2)"""
FIELDS = "fields AS (SELECT read_id, cand, min(component) AS component, abs(sum(v * z)) AS f FROM %s JOIN samples USING (block) JOIN labels USING (block) GROUP BY read_id, cand)"
CONTACTS = """anchors AS (SELECT user_id AS q, CAST(event_id % 20 AS VARCHAR) AS c, value AS score, event_id AS o,
        (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN event_id % 20 % 3 = 0 THEN -1 ELSE 1 END) * (CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS s FROM events),
      best AS (SELECT * FROM anchors QUALIFY row_number() OVER (PARTITION BY q, c ORDER BY score DESC, o) = 1),
      met AS (SELECT a.c AS ci, b.c AS cj, a.s * b.s AS s, greatest(0.1, least(a.score, b.score)) AS w FROM best a JOIN best b ON a.q = b.q AND a.c < b.c),
      e0 AS (SELECT ci, cj, sum(s * w) AS score, count(*) AS contacts, sum(CASE WHEN s > 0 THEN w ELSE 0 END) AS same, sum(CASE WHEN s < 0 THEN w ELSE 0 END) AS opposite FROM met GROUP BY ALL),
      cedges AS (SELECT *, abs(score) AS abs_score, CASE WHEN same + opposite > 0 THEN abs(score) / (same + opposite) ELSE 0 END AS confidence FROM e0)"""
KEEP = f"contacts >= {CONTACT.min_contacts} AND confidence >= {CONTACT.min_confidence} AND abs_score >= {CONTACT.min_abs_score}"
CALLS = """records AS (SELECT (p_partkey + 1) * 100 AS pos, CASE WHEN p_partkey % 11 = 0 THEN 'GT' ELSE 'C' END AS alt, ['0|1', '1|0', '0/1', '1/1', '0|1'][p_partkey % 5 + 1] AS gt, p_partkey AS k FROM part),
      pred AS (SELECT pos, CASE WHEN gt = '0|1' THEN 0 ELSE 1 END AS phase, k // 50 AS ps FROM records WHERE alt = 'C' AND gt IN ('0|1', '1|0')),
      truth AS (SELECT (p_partkey + 1) * 100 AS pos, (p_partkey // 3) % 2 AS phase, p_partkey // 80 AS ps FROM part WHERE p_partkey % 13 <> 0)"""


def n50(spans: str) -> str:
    return f"sized AS ({spans}), run AS (SELECT span, sum(span) OVER (ORDER BY span DESC ROWS UNBOUNDED PRECEDING) AS total, sum(span) OVER () AS whole FROM sized) SELECT {r6('coalesce(max(span), 0) / 1000')} AS n50_kb FROM run WHERE total * 2 >= whole"


def _all() -> dict[str, str]:
    eps = EPS % ("CAST(floor(l_quantity) AS INT)", "l_linenumber * 10")
    edge_hard = f"{classes()}, hard AS (SELECT i AS u, j AS v FROM classes WHERE edge_class = 'hard'), nodes AS (SELECT snp_idx AS node FROM sites)"
    relaxed = f"""{classes('sparse')}, {margin()}, bad AS (SELECT snp_idx FROM margins WHERE margin < 0),
      hard AS (SELECT i AS u, j AS v FROM classes WHERE edge_class = 'hard' AND i NOT IN (SELECT snp_idx FROM bad) AND j NOT IN (SELECT snp_idx FROM bad)), nodes AS (SELECT snp_idx AS node FROM sites)"""
    out = {
        "observation_weight": f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(eps, 9) AS epsilon, {r6('ln((1 - eps) / eps)')} AS weight FROM (SELECT *, {eps} AS eps FROM lineitem)",
        "site_scan": f"WITH {CALLS} SELECT 'chr1' AS chrom, pos, row_number() OVER (ORDER BY pos) - 1 AS snp_idx, 'A' AS ref, alt FROM records WHERE length(alt) = 1 AND gt <> '1/1'",
        "interval_join": "SELECT o_orderkey AS k, p_partkey AS p, p_partkey * 100 + 50 AS at FROM orders JOIN part ON p_partkey * 100 + 50 >= o_custkey * 100 AND p_partkey * 100 + 50 < o_custkey * 100 + o_orderkey % 1500 + 1",
        "cigar_walk": """WITH c AS (SELECT event_id, user_id * 10 AS a, event_id % 7 + 1 AS s, user_id % 20 + 5 AS m, event_id % 3 + 1 AS d, event_id % 30 + 1 AS e FROM events)
            SELECT event_id, a AS ref_start, a + m AS ref_end, s AS query_start FROM c UNION ALL SELECT event_id, a + m + d, a + m + d + e, s + m + 2 FROM c""",
        "dedup_best": f"WITH {obs()} SELECT read_id, snp_idx, CAST(b AS BIGINT) AS b, CAST(baseq AS BIGINT) AS baseq, CAST(mapq AS BIGINT) AS mapq, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r6('weight')} AS weight FROM obs",
        "read_snp_matrix": f"WITH {raw()} SELECT read_id, snp_idx, {r6('sum(weight * b)')} AS v FROM raw GROUP BY ALL",
        "parity_edges": f"WITH {edges()} {EDGE_OUT}",
        "parity_edges_weighted": f"WITH {edges(weighted=True)} {EDGE_OUT}",
        "parity_edges_near": f"WITH {edges()} {EDGE_OUT} WHERE (j - i) * 1000 <= 20000",
        "edge_risk": f"WITH {measured(weighted=True)} SELECT i, j, distance_bp, " + ", ".join(f"{r6(c)} AS {c}" for c in ("confidence", "conflict", "domination", "risk")) + " FROM measured",
        "edge_class": f"WITH {classes()} {CLASS_OUT}",
        "edge_class_confidence": f"WITH {classes('sparse', Hard(mode='confidence', max_distance=10**9), Soft(mode='none'))} {CLASS_OUT}",
        "hard_components": f"WITH RECURSIVE {edge_hard}, {closure('hard', 'nodes')} SELECT node, root FROM roots",
        "read_components": f"""WITH RECURSIVE {obs()}, pair AS (SELECT DISTINCT snp_idx AS u, min(snp_idx) OVER (PARTITION BY read_id) AS v FROM obs),
            link AS (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
            least(node, root) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM link GROUP BY u UNION
              SELECT n.node, n.root FROM (SELECT l.v AS node, min(c.root) AS root FROM least c JOIN link l ON l.u = c.node GROUP BY l.v) n JOIN recurring.least o ON o.node = n.node WHERE n.root < o.root)
            SELECT node AS snp_idx, min((root + 1) * 1000) OVER (PARTITION BY root) AS ps FROM least""",
        "backbone_forest": f"""WITH RECURSIVE {obs()}, {sites()}, pairs AS (SELECT read_id, snp_idx AS i, lead(snp_idx) OVER w AS j, b * lead(b) OVER w AS s, min(l_linenumber) OVER (PARTITION BY read_id) AS seen FROM obs WINDOW w AS (PARTITION BY read_id ORDER BY snp_idx)),
            summed AS (SELECT i AS u, j AS v, sum(s) AS score, min(seen) AS seen FROM pairs WHERE j IS NOT NULL GROUP BY i, j HAVING sum(s) <> 0),
            ranked AS (SELECT u, v, CAST(sign(score) AS INT) AS sign, row_number() OVER (ORDER BY abs(score) DESC, seen, u, v) AS r FROM summed), {forest('ranked')}
            SELECT snp_idx, CAST(coalesce(s, 1) AS BIGINT) AS tau, coalesce(a, snp_idx) AS root FROM sites LEFT JOIN (SELECT b, a, s FROM walk QUALIFY a = min(a) OVER (PARTITION BY b)) ON b = snp_idx""",
        "phaselet_forest": f"""WITH RECURSIVE {classes()}, ranked AS (SELECT i AS u, j AS v, 1 AS sign, row_number() OVER (ORDER BY abs(score) DESC, i, j) AS r FROM classes WHERE edge_class = 'hard'), {forest('ranked')}
            SELECT u AS i, v AS j, CASE WHEN (u, v) IN (SELECT (u, v) FROM kept) THEN 'hard_retained' ELSE 'hard_cycle' END AS status FROM ranked""",
        "orient_components": f"""WITH RECURSIVE {CONTACTS}, ranked AS (SELECT ci AS u, cj AS v, CASE WHEN score >= 0 THEN 1 ELSE -1 END AS sign, row_number() OVER (ORDER BY abs_score DESC, ci, cj) AS r FROM cedges WHERE {KEEP}), {forest('ranked')},
            signed AS (SELECT b AS component, a AS root, s FROM walk QUALIFY a = min(a) OVER (PARTITION BY b))
            SELECT component, CAST(s AS BIGINT) AS orientation, first_value(component) OVER (PARTITION BY root ORDER BY coalesce(try_cast(component AS BIGINT), 1000000000000000000), component) AS hic_ps FROM signed""",
        "phaselet_table": f"""WITH RECURSIVE {relaxed}, {closure('hard', 'nodes')}
            SELECT row_number() OVER (ORDER BY root) - 1 AS block, min((node + 1) * 1000) AS start, max((node + 1) * 1000) AS "end", count(*) AS n_sites, 'chr1' AS chrom FROM roots GROUP BY root""",
        "consistency_margin": f"WITH {obs()}, {sites()}, {margin()} SELECT snp_idx, {r6('margin')} AS margin FROM margins",
        "released_edges": f"WITH {edges('sparse')}, {margin()}, bad AS (SELECT snp_idx FROM margins WHERE margin < 0) SELECT i, j FROM edges WHERE i IN (SELECT snp_idx FROM bad) OR j IN (SELECT snp_idx FROM bad)",
        "haplotags": f"WITH {obs()}, {sites()}, f AS (SELECT read_id, sum(b * tau)::DOUBLE AS f FROM obs JOIN sites USING (snp_idx) GROUP BY read_id) SELECT read_id, CAST(CASE WHEN f < 0 THEN -1 ELSE 1 END AS BIGINT) AS sigma, {r6('f')} AS f FROM f",
        "profiled_objective": f"WITH {obs()}, {sites()}, f AS (SELECT read_id, abs(sum(b * tau))::DOUBLE AS f, count(*)::DOUBLE AS t FROM obs JOIN sites USING (snp_idx) GROUP BY read_id) SELECT {r6('sum(f)')} AS objective, {r6('sum(t)')} AS total, {r6('(sum(t) - sum(f)) / 2')} AS disagreement FROM f",
        "read_projection": f"WITH {projected()} SELECT read_id, block, {r6('v')} AS v FROM proj",
        "single_profile": f"WITH {vectors()} SELECT count(*) FILTER (len(path) = 1) AS single_reads, count(*) FILTER (len(path) > 1) AS multi_reads, {r6('coalesce(sum(abs(vals[1])) FILTER (len(path) = 1), 0.0)')} AS single_constant FROM vec",
        "hyperread_rows": f"WITH {hyper()} SELECT hyper, max(reads) AS reads, max(degree) AS degree, array_to_string(path, ',') AS path, array_to_string(signs, ',') AS signs, {r6('sum(abs(raw))')} AS raw_weight, {r6('sum(abs(value))')} AS weight FROM hyper GROUP BY hyper, path, signs",
        "soft_coupling": f"WITH {classes()}, {soft()} SELECT l, r, CAST(support AS BIGINT) AS support, {r6('coeff')} AS coeff, {r6('raw')} AS raw FROM soft",
        "ising_coupling": f"WITH {ising()} SELECT u, v, {r6('w')} AS w FROM ising",
        "coupling_scale": f"WITH {ising()} SELECT {r6('max(s)')} AS largest FROM (SELECT sum(abs(w)) AS s FROM ising GROUP BY u)",
        "compressed_score": f"""WITH {both()}, {SAMPLES}, h AS (SELECT hyper, cand, sum(value * z) * (CASE WHEN (hyper + cand) % 3 = 0 THEN -1 ELSE 1 END) AS x FROM hyper JOIN samples USING (block) GROUP BY hyper, cand),
            x AS (SELECT cand, sum(x) AS x FROM h GROUP BY cand), y AS (SELECT a.cand, sum(coeff * a.z * b.z) AS y FROM soft JOIN samples a ON a.block = l JOIN samples b ON b.block = r AND a.cand = b.cand GROUP BY a.cand)
            SELECT CAST(cand AS BIGINT) AS cand, {r6('coalesce(x, 0) + coalesce(y, 0)')} AS score FROM x FULL JOIN y USING (cand)""",
        "candidate_scores": f"WITH {projected()}, {SAMPLES}, {DEALT}, {FIELDS % 'dealt'} SELECT component, CAST(cand AS BIGINT) AS cand, {r6('sum(f)')} AS score FROM fields GROUP BY component, cand",
        "candidate_select": f"""WITH {projected()}, {SAMPLES}, {DEALT}, {FIELDS % 'dealt'}, scores AS (SELECT component, cand, sum(f) AS score FROM fields GROUP BY ALL),
            pick AS (SELECT component, cand FROM scores QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, cand) = 1)
            SELECT l.block, CAST(s.z AS BIGINT) AS z FROM labels l LEFT JOIN pick p USING (component) JOIN samples s ON s.block = l.block AND s.cand = coalesce(p.cand, 0)""",
        "candidate_select_global": f"""WITH {projected()}, {SAMPLES}, {FIELDS % 'proj'}, scores AS (SELECT cand, sum(f) AS score FROM fields GROUP BY ALL), pick AS (SELECT cand FROM scores ORDER BY score DESC, cand LIMIT 1)
            SELECT block, CAST(z AS BIGINT) AS z FROM samples JOIN pick USING (cand)""",
        "phase_sets": f"WITH {sites()} SELECT snp_idx, min(pos1) OVER (PARTITION BY block // 4) AS ps FROM sites",
        "read_index": "SELECT user_id AS read_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS read_idx FROM events GROUP BY user_id",
        "component_edges": f"WITH {CONTACTS} SELECT ci, cj, contacts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("score", "abs_score", "same", "opposite", "confidence")) + " FROM cedges",
        "retained_edges": f"WITH {CONTACTS} SELECT ci, cj, CAST(CASE WHEN score >= 0 THEN 1 ELSE -1 END AS BIGINT) AS edge_sign FROM cedges WHERE {KEEP}",
        "contact_qc": f"WITH {CONTACTS} SELECT count(*) AS edges, count(*) FILTER ({KEEP}) AS retained_edges, max(contacts) AS max_contacts, {r6(f'count(*) FILTER ({KEEP}) / count(*)')} AS retained_fraction, {r6('avg(confidence)')} AS mean_confidence, {r6('avg(contacts)')} AS mean_contacts FROM cedges",
        "apply_orientation": f"WITH {sites()}, p AS (SELECT snp_idx, tau, snp_idx // 7 AS c FROM sites) SELECT snp_idx, CAST(CASE WHEN c % 4 <> 3 AND c % 2 = 1 THEN -tau ELSE tau END AS BIGINT) AS delta, CAST(CASE WHEN c % 4 <> 3 THEN c // 2 ELSE c END AS VARCHAR) AS ps FROM p",
        "phase_errors": f"""WITH {CALLS}, d AS (SELECT p.pos, p.ps, t.ps AS tps, xor(p.phase, CAST(t.phase AS INT)) AS d FROM pred p JOIN truth t USING (pos)),
            l AS (SELECT *, d <> lag(d) OVER (PARTITION BY ps, tps ORDER BY pos) AS turn FROM d), b AS (SELECT count(*) AS n, sum(d) AS d, count(*) FILTER (turn) AS sw FROM l GROUP BY ps, tps HAVING count(*) > 1),
            s AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS a, CAST(sum(sw) AS BIGINT) AS sw, CAST(sum(least(d, n - d)) AS BIGINT) AS h FROM b)
            SELECT n AS covered_variants, a AS assessed_pairs, sw AS switches, h AS hamming, n AS hamming_denominator, {r6('sw / a')} AS switch_error_rate, {r6('h / n')} AS hamming_error_rate FROM s""",
        "span_n50": f"WITH {CALLS}, " + n50("SELECT max(pos) - min(pos) + 1 AS span FROM pred GROUP BY ps HAVING count(*) > 1"),
        "block_n50": """WITH c AS (SELECT (p_partkey + 1) * 100 AS pos, CASE WHEN p_partkey % 17 < 3 THEN 'in' || (p_partkey // 60) ELSE 'out' || (p_partkey // 40) END AS ps FROM part),
            big AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY ps) > 1), f AS (SELECT *, coalesce(CAST(lag(ps) OVER (ORDER BY pos) <> ps AS INT), 1) AS fresh FROM big), g AS (SELECT *, sum(fresh) OVER (ORDER BY pos) AS run FROM f), """
        + n50("SELECT max(pos) - min(pos) AS span FROM g GROUP BY run HAVING count(*) > 1"),
        "completeness": f"""WITH {CALLS}, n AS (SELECT (SELECT count(*) FROM pred) AS p, (SELECT count(*) FROM records WHERE alt = 'C' AND gt <> '1/1') AS h, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM (SELECT pos FROM pred INTERSECT SELECT pos FROM truth)) AS s)
            SELECT 'grounded' AS method, {r6('100 * p / h')} AS phasing, {r6('100 * s / t')} AS snp, p AS phased_snps, h AS input_het_snps, t AS truth_het_snps FROM n""",
        "key_intersection": f"WITH {CALLS} SELECT 'chr1' AS chrom, pos, 'A' AS ref, 'C' AS alt FROM (SELECT pos FROM pred INTERSECT SELECT pos FROM truth)",
        "chunking": "WITH p AS (SELECT p_partkey AS snp_idx, p_partkey * 100 + 70 AS pos FROM part WHERE p_partkey % 97 < 40) SELECT snp_idx, dense_rank() OVER (ORDER BY (pos - (SELECT min(pos) FROM p)) // 1500) - 1 AS chunk FROM p",
    }
    for norm in NORMS:
        out[f"hyperreads_{norm}"] = f"WITH {hyper(norm)} SELECT hyper, block, reads, degree, block_degree, CAST(capped AS BIGINT) AS capped, {r6('raw')} AS raw, {r6('value')} AS value, {r6('domination')} AS domination FROM hyper"
    return out


ORACLE_SQL = _all()
