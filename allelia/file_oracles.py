"""SQL on the driver's tables that gives the rows of :mod:`allelia.file_queries`, written for DuckDB."""

from __future__ import annotations

from .file_queries import DEPTH, REGION
from .oracles import CONTACTS, EPS, classes, edges, hyper, margin, obs, r6, sites, soft

#: Fixed values of the grounded files, as the queries make them.
VARIANTS = """variants AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, (p_partkey + 1) * 100 AS pos, ['A', 'c', 'G'][p_partkey % 3 + 1] AS ref,
        CASE WHEN p_partkey % 11 = 0 THEN 'GT' ELSE ['T', 't', 'T', '*'][p_partkey % 4 + 1] END AS alt, CASE WHEN p_partkey % 4 = 0 THEN '0/1' ELSE '1|1' END AS s1,
        ['0|1', '1|0', '0/1', '1/1', './.', '1|0', '0|1'][p_partkey % 7 + 1] AS s2, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey // 50 AS VARCHAR) END AS ps FROM part)"""
SINGLE = "length(alt) = 1 AND alt <> '*'"
INSIDE = f"chrom = '{REGION[0]}' AND pos BETWEEN {REGION[1]} AND {REGION[2]}"
READS = """reads AS (SELECT event_id AS k, 'r' || (event_id // 2) || '/' || (event_id % 2 + 1) AS name,
        CASE WHEN event_id % 13 = 0 THEN 1024 WHEN event_id % 17 = 0 THEN 256 WHEN event_id % 19 = 0 THEN 4 WHEN event_id % 2 = 0 THEN 0 ELSE 16 END AS flag, (event_id * 131) % 200000 AS start0, event_id % 60 AS mapq FROM events)"""
SEEN = f"""{READS}, snps AS (SELECT p_partkey AS snp_idx, (p_partkey + 1) * 100 AS pos1, substr(['AC', 'CG', 'GT', 'TA', 'AG'][p_partkey % 5 + 1], 1, 1) AS ref, substr(['AC', 'CG', 'GT', 'TA', 'AG'][p_partkey % 5 + 1], 2, 1) AS alt FROM part),
      met AS (SELECT *, pos1 - 1 - start0 AS d FROM reads JOIN snps ON pos1 - 1 >= start0 AND pos1 - 1 < start0 + 18),
      placed AS (SELECT *, CASE WHEN d < 7 THEN 3 + d WHEN d BETWEEN 9 AND 13 THEN d + 1 ELSE d + 2 END AS j FROM met WHERE d < 7 OR d > 8),
      based AS (SELECT *, substr('ACGT', (k * (7 + j) + j * j) % 4 + 1, 1) AS base, (k * 3 + j * 5) % 40 + 2 AS baseq FROM placed),
      seen AS (SELECT *, CASE WHEN base = ref THEN 1 WHEN base = alt THEN -1 ELSE 0 END AS b FROM based)"""
DEEP = f"""{READS}, deep AS (SELECT k, name, CASE WHEN regexp_matches(name, '^r[0-9]*7/') THEN flag | 2048 ELSE flag END AS flag, start0 // 10 AS start0, mapq, row_number() OVER (ORDER BY start0, k) AS ordinal FROM reads),
      snps AS (SELECT p_partkey AS snp_idx, (p_partkey + 1) * 100 AS pos1, substr(['AC', 'CG', 'GT', 'TA', 'AG'][p_partkey % 5 + 1], 1, 1) AS ref, substr(['AC', 'CG', 'GT', 'TA', 'AG'][p_partkey % 5 + 1], 2, 1) AS alt FROM part),
      met AS (SELECT *, pos1 - 1 - start0 AS d FROM deep JOIN snps ON pos1 - 1 >= start0 AND pos1 - 1 < start0 + 18 WHERE flag & {4 | 256 | 512 | 1024} = 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY snp_idx ORDER BY start0, ordinal) AS rank FROM met),
      placed AS (SELECT *, CASE WHEN d < 7 THEN 3 + d WHEN d BETWEEN 9 AND 13 THEN d + 1 ELSE d + 2 END AS j, d BETWEEN 7 AND 8 AS gap FROM ranked WHERE rank <= {DEPTH}),
      based AS (SELECT *, substr('ACGT', (k * (7 + j) + j * j) % 4 + 1, 1) AS base, (k * 3 + j * 5) % 40 + 2 AS baseq FROM placed),
      seen AS (SELECT *, CASE WHEN base = ref THEN 1 WHEN base = alt THEN -1 ELSE 0 END AS b, NOT gap AND flag & 2048 = 0 AND mapq >= 20 AND baseq >= 13 AS passed FROM based)"""
READ_SCAN, PILEUP = 4 | 256 | 2048, 4 | 256 | 2048 | 512 | 1024
PASSED = "flag & %d = 0 AND mapq >= 20 AND baseq >= 13"
NAMED = "named AS (SELECT 'q' || read_id AS read_id, 'chr1:' || ((snp_idx + 1) * 1000) || ':A>C' AS snp_id, snp_idx, (snp_idx + 1) * 1000 AS pos1, b, baseq, mapq, weight FROM obs)"


def _all() -> dict[str, str]:
    eps = EPS % ("baseq", "mapq")
    long = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    exported = "CAST(coalesce(CASE WHEN k % 4 <> 1 THEN k // 50 END, 7) AS VARCHAR)"
    return {
        "vcf_het_sites": f"""WITH {VARIANTS} SELECT row_number() OVER (ORDER BY pos) - 1 AS snp_idx, pos AS pos1, 'chr2:' || pos || ':' || ref || '>' || alt AS snp_id, chrom, upper(ref) AS ref, upper(alt) AS alt
            FROM variants WHERE chrom = 'chr2' AND pos BETWEEN 3000 AND 150000 AND {SINGLE} AND s2 IN ('0|1', '1|0', '0/1')""",
        "vcf_region_records": f"WITH {VARIANTS} SELECT chrom, pos, ref, alt, s1 AS gt FROM variants WHERE {INSIDE}",
        "vcf_pushdown": f"WITH {VARIANTS} SELECT chrom, pos, ref, alt, s1 AS gt FROM variants WHERE {INSIDE} AND length(ref) = 1",
        "vcf_phase_calls": f"WITH {VARIANTS} SELECT chrom, pos, CAST(s2 = '1|0' AS BIGINT) AS phase, ref, alt, coalesce(ps, chrom) AS ps FROM variants WHERE length(alt) = 1 AND s2 IN ('0|1', '1|0')",
        "vcf_phased_export": f"""WITH {VARIANTS} SELECT chrom, pos, ref, alt, 'GT:PS' AS format, CASE WHEN k % 3 = 0 THEN '1|0' ELSE '0|1' END AS gt, {exported} AS ps
            FROM variants WHERE chrom = 'chr1' AND pos BETWEEN 8000 AND 90000 AND {SINGLE} AND k % 5 <> 2""",
        "vcf_export_counts": f"WITH {VARIANTS} SELECT count(*) FILTER ({SINGLE} AND k % 5 <> 2) AS written, count(*) FILTER (NOT ({SINGLE} AND k % 5 <> 2)) AS skipped FROM variants WHERE {INSIDE}",
        "bam_scan": f"""WITH {READS} SELECT name, {long('flag', 'start0', 'mapq')}, '3S7M2D5M1I4M' AS cigar, array_to_string([substr('ACGT', (k * (7 + j) + j * j) % 4 + 1, 1) FOR j IN range(20)], '') AS seq,
            array_to_string([(k * 3 + j * 5) % 40 + 2 FOR j IN range(20)], ',') AS qual FROM reads WHERE start0 + 18 > 5000 AND start0 < 150000""",
        "bam_observations": f"WITH {SEEN} SELECT name AS read_id, {long('snp_idx', 'b', 'baseq', 'mapq')}, {r6(f'ln((1 - {eps}) / {eps})')} AS weight FROM seen WHERE {PASSED % READ_SCAN} AND b <> 0",
        "bam_pileup": f"WITH {SEEN} SELECT name AS read_id, {long('snp_idx', 'b', 'baseq', 'mapq')} FROM seen WHERE {PASSED % PILEUP} AND b <> 0",
        "bam_pileup_depth": f"WITH {DEEP} SELECT name AS read_id, {long('snp_idx', 'b', 'baseq', 'mapq')} FROM seen WHERE passed AND b <> 0",
        "bam_pileup_columns": f"""WITH {DEEP}, covered AS (SELECT snp_idx, count(*) AS covering FROM met GROUP BY snp_idx),
            counted AS (SELECT snp_idx, count(*) AS depth, count(*) FILTER (passed AND b = 1) AS n_ref, count(*) FILTER (passed AND b = -1) AS n_alt, count(*) FILTER (passed AND b = 0) AS n_other,
                count(*) FILTER (NOT gap AND NOT passed) AS n_low, count(*) FILTER (gap) AS n_gap FROM seen GROUP BY snp_idx)
            SELECT 'chr1' AS chrom, {long('snp_idx', 'pos1')}, coalesce(covering, 0) AS covering, coalesce(depth, 0) AS depth, coalesce(n_ref, 0) AS n_ref, coalesce(n_alt, 0) AS n_alt, coalesce(n_other, 0) AS n_other, coalesce(n_low, 0) AS n_low, coalesce(n_gap, 0) AS n_gap
            FROM snps LEFT JOIN covered USING (snp_idx) LEFT JOIN counted USING (snp_idx)""",
        "component_sites": """WITH snps AS (SELECT p_partkey AS k, (p_partkey + 1) * 100 AS pos1, ['AC', 'CG', 'GT', 'TA', 'AG'][p_partkey % 5 + 1] AS pair, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END AS delta FROM part WHERE p_partkey % 6 <> 0),
            named AS (SELECT 'phases' AS sets, *, k // 25 AS c FROM snps UNION ALL SELECT 'reads', *, k // 40 FROM snps WHERE k % 7 <> 0)
            SELECT sets, 'chr1' AS chrom, CAST(pos1 AS BIGINT) AS pos1, CAST(delta AS BIGINT) AS delta, substr(pair, 1, 1) AS ref, substr(pair, 2, 1) AS alt, CAST(c AS VARCHAR) AS component FROM named""",
        "tsv_order": f"WITH {obs()}, {NAMED} SELECT count(*) AS n, CAST(0 AS BIGINT) AS breaks FROM named",
        "bam_counts": f"WITH {SEEN} SELECT count(*) FILTER (b = 1) AS n_ref, count(*) FILTER (b = -1) AS n_alt, count(*) FILTER (b = 0) AS n_other FROM seen WHERE {PASSED % READ_SCAN}",
        "bam_anchors": f"""WITH {SEEN} SELECT split_part(name, '/', 1) AS query_name, CAST(snp_idx // 10 AS VARCHAR) AS component, CAST(CASE WHEN snp_idx % 3 = 0 THEN -b ELSE b END AS BIGINT) AS sign, CAST(1 AS BIGINT) AS n_sites,
            start0 + 1 AS start, start0 + 18 AS "end", {long('mapq')}, {r6('greatest(mapq / 60, 0.05)')} AS score FROM seen WHERE flag & {READ_SCAN} = 0 AND mapq >= 10 AND b <> 0""",
        "tsv_observations": f"WITH {obs()}, {NAMED} SELECT read_id, snp_id, {long('b')}, round(weight, 4) AS weight FROM named",
        "tsv_indexed": f"WITH {obs()}, {NAMED} SELECT row_number() OVER (ORDER BY pos1) - 1 AS snp_idx, pos1, n, snp_id, 'chr1' AS chrom, 'A' AS ref, 'C' AS alt FROM (SELECT pos1, snp_id, count(*) AS n FROM named GROUP BY ALL)",
        "npz_graph": f"WITH {obs()}, {NAMED} SELECT read_id, dense_rank() OVER (ORDER BY snp_idx) - 1 AS snp_idx, pos1, {long('b', 'baseq')}, round(weight, 4) AS weight FROM named",
        "npz_pairs": f"WITH {obs()}, {NAMED} SELECT read_id, snp_id FROM named",
        "npz_count": f"WITH {obs()}, {NAMED} SELECT count(*) AS n, CAST(sum(baseq) AS BIGINT) AS baseq FROM named",
        "debug_pattern_matrix": f"WITH {hyper()} SELECT hyper, CAST(block AS BIGINT) AS block, {r6('value')} AS value FROM hyper",
        "debug_row_pointers": f"""WITH {classes()}, {soft()}, cells AS (SELECT l AS b FROM soft UNION ALL SELECT r FROM soft), n AS (SELECT b, count(*) AS n FROM cells GROUP BY b),
            every AS (SELECT CAST(unnest(range((SELECT max(block) + 2 FROM sites))) AS BIGINT) AS row)
            SELECT row, CAST(coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS indptr FROM every LEFT JOIN n ON b = row - 1""",
        "debug_mapping": f"WITH {obs()}, {sites()}, {margin()} SELECT snp_idx, CAST(block AS BIGINT) AS block, CAST(tau AS BIGINT) AS tau, 'chr1:' || pos1 || ':A>C' AS snp_id, {r6('margin')} AS margin FROM margins JOIN sites USING (snp_idx)",
        "debug_blocks": f"WITH {sites()} SELECT 'chr1' AS chrom, CAST(block AS BIGINT) AS phaselet_id, min(pos1) AS start, max(pos1) AS \"end\", count(*) AS n_snps FROM sites GROUP BY block",
        "debug_patterns": f"WITH {hyper()} SELECT hyper AS hyperread_id, max(reads) AS support_reads, max(degree) AS degree, array_to_string(path, ',') AS path, array_to_string(signs, ',') AS signs, {r6('sum(abs(raw))')} AS raw_abs_weight FROM hyper GROUP BY hyper, path, signs",
        "debug_pattern_edges": f"WITH {hyper()} SELECT hyper AS hyperread_id, CAST(block AS BIGINT) AS phaselet_id, {r6('raw')} AS raw_value, {r6('value')} AS normalized_value FROM hyper",
        "tsv_parity_edges": f"""WITH {edges()} SELECT i, j, cnt, (j - i) * 1000 AS distance_bp, {r6('score')} AS score, {r6('support')} AS support, {r6('CASE WHEN support > 0 THEN abs(score) / support ELSE 0 END')} AS confidence
            FROM edges WHERE (j - i) * 1000 <= 20000""",
        "tsv_phases": f"WITH {sites()} SELECT 'chr1:' || pos1 || ':A>C' AS snp_id, CAST(tau AS BIGINT) AS delta, CASE WHEN snp_idx % 4 > 1 THEN snp_idx // 7 END AS ps FROM sites",
        "tsv_component_edges": f"WITH {CONTACTS} SELECT ci, cj, contacts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("score", "abs_score", "same", "opposite", "confidence")) + " FROM cedges",
        "tsv_orientations": "SELECT CAST(n_nationkey AS VARCHAR) AS component, CAST(CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END AS BIGINT) AS orientation, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE n_nationkey END AS VARCHAR) AS hic_ps FROM nation",
        "tsv_metrics": "SELECT 'nations' AS metric, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'last', CAST(max(n_nationkey) AS VARCHAR) FROM nation",
        "elapsed_log": f"SELECT {r6('sum(CASE WHEN k % 2 = 0 THEN k % 3 * 3600 + k * 60 + k * 2 WHEN k % 5 = 0 THEN k * 60 + k + 0.5 ELSE 0 END)::DOUBLE')} AS seconds FROM (SELECT n_nationkey AS k FROM nation)",
        "debug_edges": f"""WITH {classes()} SELECT i AS snp_i, j AS snp_j, a.pos1 AS pos_i, b.pos1 AS pos_j, distance_bp, cnt AS count, 'chr1:' || a.pos1 || ':A>C' AS snp_id_i, 'chr1:' || b.pos1 || ':A>C' AS snp_id_j, """
        + ", ".join(f"{r6(c)} AS {c}" for c in ("score", "support", "confidence", "conflict", "domination", "risk")) + ", edge_class, status FROM classes JOIN sites a ON a.snp_idx = i JOIN sites b ON b.snp_idx = j",
        "debug_soft_edges": f"""WITH {classes()} SELECT a.block AS block_i, b.block AS block_j, i AS snp_i, j AS snp_j, cnt AS count, """ + ", ".join(f"{r6(c)} AS {c}" for c in ("score", "support", "risk"))
        + ", status FROM classes JOIN sites a ON a.snp_idx = i JOIN sites b ON b.snp_idx = j WHERE edge_class LIKE 'soft%' AND a.block <> b.block",
        "site_names": f"WITH {VARIANTS} SELECT chrom || ':' || pos || ':' || ref || '>' || alt AS snp_id, chrom, pos AS pos1, upper(ref) AS ref, upper(alt) AS alt FROM variants",
        "read_entries": f"WITH {obs()} SELECT read_id, string_agg(snp_idx || ':' || b, ',' ORDER BY snp_idx) AS entries FROM obs GROUP BY read_id",
        "required_sites": f"WITH {obs()}, {sites()} SELECT read_id, CAST(sum(b * tau) AS BIGINT) AS field FROM obs JOIN sites USING (snp_idx) GROUP BY read_id",
        "risk_summary": f"WITH {classes()} SELECT " + ", ".join(f"{r6(f'coalesce({fn}(risk) FILTER ({where}), 0.0)')} AS {n}_{k}_risk" for k, where in (("retained", "edge_class = 'hard' AND (i + j) % 2 = 0"), ("soft", "edge_class LIKE 'soft%'")) for n, fn in (("mean", "avg"), ("max", "max"))) + " FROM classes",
    }


ORACLE_SQL = _all()
