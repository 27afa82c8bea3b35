"""SQL of the queries, for another engine to hold them against. Written from the operators' definitions."""
from __future__ import annotations

from .fixtures import CTE

#: Reads that pass the filter, observations with their flags, and counters of sites.
BASE = (
    CTE
    + """,
ok AS (SELECT * FROM fx_reads WHERE (flag & 2308) = 0 AND (flag & 1536) = 0 AND mapq >= 30),
ob AS (SELECT o.*, CASE WHEN o.allele = 1 AND o.q < 10 THEN 1 ELSE 0 END AS lq, CAST(o.read_id % 2 + 1 AS INT) AS hap FROM fx_obs o JOIN ok USING (read_id)),
cnt AS (SELECT site_id, tid, pos, typ AS type, alt,
  CAST(SUM(CASE WHEN lq = 0 THEN 1 ELSE 0 END) AS INT) AS total_cov,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 0 THEN 1 ELSE 0 END) AS INT) AS ref_cov,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 1 THEN 1 ELSE 0 END) AS INT) AS alt_cov,
  CAST(SUM(lq) AS INT) AS low_qual_cov,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 0 AND rev = 0 THEN 1 ELSE 0 END) AS INT) AS forward_ref,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 0 AND rev = 1 THEN 1 ELSE 0 END) AS INT) AS reverse_ref,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 1 AND rev = 0 THEN 1 ELSE 0 END) AS INT) AS forward_alt,
  CAST(SUM(CASE WHEN lq = 0 AND allele = 1 AND rev = 1 THEN 1 ELSE 0 END) AS INT) AS reverse_alt
  FROM ob GROUP BY site_id, tid, pos, typ, alt),
frac AS (SELECT *, CASE WHEN total_cov = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(alt_cov AS DOUBLE) / CAST(total_cov AS DOUBLE) END AS af FROM cnt),
cls AS (SELECT *, CASE WHEN total_cov + low_qual_cov < 5 OR alt_cov < 2 THEN 'LOW_COV' WHEN af < CAST(0.2 AS DOUBLE) THEN 'LOW_AF' WHEN af > CAST(0.8 AS DOUBLE) THEN 'CLEAN_HOM'
  WHEN type = 'SNP' THEN 'CLEAN_HET_SNP' ELSE 'CLEAN_HET_INDEL' END AS category FROM frac),
xs AS (SELECT site_id, forward_alt AS a, reverse_alt AS b, CAST(floor((forward_alt + reverse_alt) / 2.0) AS INT) AS e FROM cnt),
tables AS (SELECT site_id, a, b, e, UNNEST(range(greatest(0, a + e - 2 * e), least(a + b, a + e) + 1)) AS x FROM xs WHERE e > 0),
prob AS (SELECT site_id, x, a, exp(lgamma(a + b + 1) + lgamma(2 * e + 1) + lgamma(a + e + 1) + lgamma(b + e + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + e - x + 1) - lgamma(e - a + x + 1) - lgamma(a + b + 2 * e + 1)) AS p
  FROM tables),
pv AS (SELECT cnt.site_id, forward_alt, reverse_alt, coalesce(t.p, CAST(1 AS DOUBLE)) AS p FROM cnt LEFT JOIN (
  SELECT q.site_id, sum(CASE WHEN q.p <= o.p * (1 + 1e-9) THEN q.p ELSE 0 END) AS p FROM prob q JOIN prob o ON q.site_id = o.site_id AND o.x = o.a GROUP BY q.site_id) t ON cnt.site_id = t.site_id),
ho AS (SELECT * FROM ob WHERE q >= 10),
ha AS (SELECT site_id, tid, pos, hap, allele, COUNT(*) AS n FROM ho GROUP BY ALL),
hc AS (SELECT site_id, tid, pos, hap, FIRST(allele ORDER BY n DESC, allele) AS cons, MAX(n) AS n_cons, CAST(SUM(n) AS BIGINT) AS n_all FROM ha GROUP BY site_id, tid, pos, hap),
co AS (SELECT site_id, tid, pos, coalesce(MAX(CASE WHEN hap = 1 THEN cons END), -1) AS cons1, coalesce(MAX(CASE WHEN hap = 2 THEN cons END), -1) AS cons2 FROM hc GROUP BY site_id, tid, pos),
het AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY pos, site_id) AS k FROM co WHERE cons1 <> -1 AND cons2 <> -1 AND cons1 <> cons2),
hs AS (SELECT o.read_id, o.hap, o.allele, h.site_id, h.tid, h.k, CASE WHEN o.hap = 1 THEN cons1 ELSE cons2 END AS mine, CASE WHEN o.hap = 1 THEN cons2 ELSE cons1 END AS other FROM ho o JOIN het h USING (site_id)),
li AS (SELECT h.site_id, h.tid, h.pos, COUNT(CASE WHEN b.allele = b.mine THEN 1 END) AS n_agree, COUNT(CASE WHEN b.allele = b.other THEN 1 END) AS n_conflict
  FROM het h LEFT JOIN (SELECT b.* FROM hs a JOIN hs b ON a.read_id = b.read_id AND a.tid = b.tid AND a.k = b.k - 1 WHERE a.allele = a.mine) b ON h.site_id = b.site_id GROUP BY h.site_id, h.tid, h.pos),
ps AS (SELECT *, last_value(CASE WHEN n_agree < 2 AND n_conflict < 2 THEN pos END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase_set FROM li),
lci AS (SELECT *, max(fin) OVER (PARTITION BY tid ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4 FROM fx_lowcomp),
lcn AS (SELECT *, sum(CASE WHEN b4 IS NULL OR beg > b4 + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM lci),
lcs AS (SELECT tid, min(beg) AS beg, max(fin) AS fin, count(*) AS n, max(lc_id) AS lc_id FROM lcn GROUP BY tid, isl),
sp AS (SELECT site_id, tid, pos, typ, alt, zyg, pos AS beg, CASE WHEN typ = 'DEL' THEN pos + zyg + 19 ELSE pos END AS fin, CASE WHEN typ = 'SNP' THEN 1 WHEN typ = 'INS' THEN 0 ELSE zyg + 20 END AS ref_len FROM fx_sites),
ni AS (SELECT *, max(fin) OVER (PARTITION BY tid ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4 FROM fx_noise),
nn AS (SELECT *, sum(CASE WHEN b4 IS NULL OR beg > b4 + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM ni),
nr AS (SELECT tid, min(beg) AS beg, max(fin) AS fin FROM nn GROUP BY tid, isl),
tl AS (SELECT row_number() OVER (ORDER BY tid, beg, fin) - 1 AS chunk_id, CAST(dense_rank() OVER (ORDER BY tid) - 1 AS INT) AS reg_chunk_i, CAST(row_number() OVER w - 1 AS INT) AS reg_i, tid, beg, fin,
  lag(beg) OVER w AS prev_beg, lag(fin) OVER w AS prev_fin, lead(beg) OVER w AS next_beg, lead(fin) OVER w AS next_fin FROM fx_chunks WINDOW w AS (PARTITION BY tid ORDER BY beg, fin)),
ri AS (SELECT r.read_id, r.tid, t.chunk_id, t.beg AS cbeg, coalesce(r.beg <= t.prev_fin AND r.fin >= t.prev_beg, false) AS in_prev, coalesce(r.beg <= t.next_fin AND r.fin >= t.next_beg, false) AS in_next, r.mapq, r.flag
  FROM fx_reads r JOIN tl t ON r.tid = t.tid AND r.beg <= t.fin AND r.fin >= t.beg),
rh AS (SELECT *, (read_id + chunk_id + CASE WHEN read_id % 7 = 0 AND chunk_id % 2 = 0 THEN 1 ELSE 0 END) % 2 + 1 AS hap, cbeg + read_id % 3 * 10 AS phase_set FROM ri),
ts AS (SELECT r.tid, (r.beg - 1) - (r.beg - 1) % 20000 AS block, t.thread, COUNT(CASE WHEN r.read_id % 2 = 0 THEN 1 END) AS h1, COUNT(CASE WHEN r.read_id % 2 = 1 THEN 1 END) AS h2
  FROM fx_reads r JOIN (SELECT DISTINCT h.read_id, s.thread FROM fx_hs h JOIN fx_sidecar s USING (set_id)) t USING (read_id) GROUP BY ALL),
tp AS (SELECT *, CASE WHEN h1 - h2 >= 2 THEN 1 WHEN h2 - h1 >= 2 THEN 2 END AS p FROM ts),
qh AS (SELECT tid, q, COUNT(*) AS n FROM fx_obs GROUP BY tid, q),
qv AS (SELECT *, n * 10000 >= SUM(n) OVER (PARTITION BY tid) AS valid FROM qh),
gt AS (SELECT c.*, coalesce(co.cons1, -1) AS cons1, coalesce(co.cons2, -1) AS cons2, CASE WHEN alt_cov > ref_cov THEN 1 ELSE 0 END AS cons0 FROM cls c LEFT JOIN co ON c.site_id = co.site_id),
gh AS (SELECT *, CASE WHEN cons1 = -1 AND cons2 = -1 THEN cons0 WHEN cons1 = -1 THEN 0 ELSE cons1 END AS one, CASE WHEN cons1 = -1 AND cons2 = -1 THEN cons0 WHEN cons2 = -1 THEN 0 ELSE cons2 END AS two,
  substr('ACGT', CAST(pos % 4 + 1 AS INT), 1) AS b0, substr('ACGT', CAST((pos + 1) % 4 + 1 AS INT), 1) AS b1, substr('ACGT', CAST(greatest(pos - 1, 1) % 4 + 1 AS INT), 1) AS an FROM gt
  WHERE category IN ('CLEAN_HET_SNP', 'CLEAN_HET_INDEL', 'CLEAN_HOM') AND total_cov >= 5 AND alt_cov >= 2),
vr AS (SELECT site_id, tid, one, two, 'chr' || tid AS chrom, CASE WHEN type = 'SNP' THEN pos ELSE greatest(pos - 1, 1) END AS vpos, CASE type WHEN 'SNP' THEN b0 WHEN 'INS' THEN an ELSE an || b0 || b1 END AS ref,
  CASE type WHEN 'SNP' THEN alt WHEN 'INS' THEN an || alt ELSE an END AS valt, total_cov, ref_cov, alt_cov, low_qual_cov, af, category FROM gh WHERE one <> 0 OR two <> 0)
"""
)

ORACLE_SQL = {
    "site_classification": "SELECT site_id, tid, pos, type, total_cov, ref_cov, alt_cov, low_qual_cov, forward_ref, reverse_ref, forward_alt, reverse_alt, af, category FROM cls",
    "strand_bias_fisher": "SELECT site_id, forward_alt, reverse_alt, round(p, 8) AS p FROM pv",
    "ont_classification": "SELECT CASE WHEN total_cov + low_qual_cov < 5 OR alt_cov < 2 THEN 'LOW_COV' WHEN pv.p < 0.2 THEN 'STRAND_BIAS' ELSE category END AS category, COUNT(*) AS n FROM cls JOIN pv USING (site_id) GROUP BY 1",
    "read_filter": "SELECT read_id, tid, beg, fin FROM ok",
    "multi_input_union": "SELECT tid, input_idx, COUNT(*) AS n, CAST(SUM(fin - beg) AS BIGINT) AS bases FROM fx_reads GROUP BY tid, input_idx",
    "tile_neighbors": "SELECT chunk_id, reg_chunk_i, reg_i, tid, beg, fin, CASE WHEN prev_beg IS NOT NULL THEN chunk_id - 1 END AS prev_chunk_id, prev_beg, prev_fin, CASE WHEN next_beg IS NOT NULL THEN chunk_id + 1 END AS next_chunk_id, next_beg, next_fin FROM tl",
    "tile_cutting": "SELECT tid, b AS beg, least(b + 6999, fin) AS fin FROM (SELECT tid, fin, UNNEST(range(beg, fin + 1, 7000)) AS b FROM (SELECT tid, min(pos) AS beg, max(pos) AS fin FROM fx_sites GROUP BY tid))",
    "tile_reads": "SELECT chunk_id, COUNT(*) AS n_reads, COUNT(CASE WHEN in_prev THEN 1 END) AS n_prev, COUNT(CASE WHEN in_next THEN 1 END) AS n_next FROM ri WHERE (flag & 3844) = 0 AND mapq >= 30 GROUP BY chunk_id",
    "interval_overlap_join": "SELECT n.read_id, n.tid, n.beg, n.fin, l.lc_id FROM fx_noise n JOIN fx_lowcomp l ON n.tid = l.tid AND n.beg <= l.fin AND n.fin >= l.beg",
    "interval_containment": "SELECT site_id, tid, pos AS beg, pos + 2 AS fin FROM fx_sites s WHERE EXISTS (SELECT 1 FROM lcs l WHERE l.tid = s.tid AND l.beg <= s.pos AND l.fin >= s.pos + 2)",
    "interval_islands": "SELECT tid, beg, fin, n, lc_id FROM lcs",
    "site_density": "SELECT a.site_id, COUNT(*) AS n_ov FROM sp a JOIN sp b ON a.tid = b.tid AND a.beg <= b.fin AND a.fin >= b.beg GROUP BY a.site_id",
    "noisy_mask": "SELECT site_id, CASE WHEN EXISTS (SELECT 1 FROM fx_noise n WHERE n.tid = s.tid AND n.beg <= s.fin AND n.fin >= s.beg) THEN 'NON_VAR' ELSE 'CLEAN' END AS category FROM sp s",
    "noisy_support": """SELECT tid, beg, fin, n_total, n_noisy, n_noisy >= 2 AND (n_total = 0 OR CAST(n_noisy AS FLOAT) / CAST(n_total AS FLOAT) >= CAST(0.2 AS FLOAT)) AS kept FROM (
        SELECT nr.tid, nr.beg, nr.fin, (SELECT COUNT(*) FROM fx_reads r WHERE r.tid = nr.tid AND r.beg <= nr.fin AND r.fin >= nr.beg) AS n_total,
          (SELECT COUNT(DISTINCT x.read_id) FROM fx_noise x WHERE x.tid = nr.tid AND x.beg <= nr.fin AND x.fin >= nr.beg) AS n_noisy FROM nr)""",
    "low_complexity_extend": """SELECT n.read_id, n.tid, least(n.beg, coalesce(g.b, n.beg)) AS beg, greatest(n.fin, coalesce(g.f, n.fin)) AS fin FROM fx_noise n LEFT JOIN (
        SELECT n.read_id, n.tid, n.beg, n.fin, min(l.beg) AS b, max(l.fin) AS f FROM fx_noise n JOIN fx_lowcomp l ON n.tid = l.tid AND n.beg <= l.fin AND n.fin >= l.beg GROUP BY n.read_id, n.tid, n.beg, n.fin) g
        ON n.read_id = g.read_id AND n.tid = g.tid AND n.beg = g.beg AND n.fin = g.fin""",
    "exact_dedupe_prefer_region": """SELECT tid, pos, typ, alt, site_id, chunk_id, anyp AS region_pass FROM (
        SELECT *, row_number() OVER (PARTITION BY tid, pos, typ, alt ORDER BY pass DESC, chunk_id, site_id) AS rn, bool_or(pass) OVER (PARTITION BY tid, pos, typ, alt) AS anyp FROM (
          SELECT s.tid, s.pos, s.typ, s.alt, s.site_id, c.beg AS chunk_id, s.pos BETWEEN c.beg AND c.fin AS pass FROM fx_sites s JOIN fx_chunks c ON s.tid = c.tid AND s.pos BETWEEN c.beg - 100 AND c.fin + 100)) WHERE rn = 1""",
    "candidate_order": "SELECT site_id, tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY CASE WHEN typ = 'SNP' THEN pos ELSE pos - 1 END, CASE typ WHEN 'INS' THEN 1 WHEN 'DEL' THEN 2 ELSE 8 END, ref_len, length(alt), alt, site_id) AS INT) AS ord FROM sp",
    "read_support": "SELECT read_id, tid, pos, typ AS type, alt, allele AS is_alt, lq AS low_qual, rev AS reverse, pos - (pos - 1) % 5000 AS chunk_beg, pos - (pos - 1) % 5000 + 4999 AS chunk_end FROM ob",
    "noise_window_snp": "SELECT read_id, site_id, pos, n_window, n_window > 5 AS noisy FROM (SELECT read_id, site_id, pos, COUNT(*) OVER (PARTITION BY read_id ORDER BY pos RANGE BETWEEN 1499 PRECEDING AND CURRENT ROW) AS n_window FROM fx_obs WHERE typ = 'SNP' AND allele = 1 AND q >= 10)",
    "quality_histogram": "SELECT tid, q, n, valid FROM qv",
    "quality_quartiles": "SELECT tid, v[1] AS q_min, v[1 + len(v) // 4] AS q_first, v[1 + len(v) // 2] AS q_median, v[1 + len(v) * 3 // 4] AS q_third, v[len(v)] AS q_max FROM (SELECT tid, list(q ORDER BY q) AS v FROM qv WHERE valid GROUP BY tid)",
    "hap_allele_argmax": "SELECT site_id, hap, cons, n_cons, n_all FROM hc",
    "adjacent_het_links": "SELECT site_id, n_agree, n_conflict FROM li",
    "phase_set_carry": "SELECT site_id, tid, pos, phase_set FROM ps",
    "read_phase_set": "SELECT read_id, FIRST(phase_set ORDER BY pos, site_id) AS phase_set FROM (SELECT o.read_id, p.pos, p.site_id, p.phase_set FROM ho o JOIN ps p USING (site_id)) GROUP BY read_id",
    "boundary_vote": "SELECT b.tid, b.chunk_id, CAST(SUM(CASE WHEN a.hap = b.hap THEN -1 ELSE 1 END) AS BIGINT) AS score, MAX(a.phase_set) AS left_ps, MIN(b.phase_set) AS right_ps, COUNT(*) AS n_reads FROM rh a JOIN rh b ON a.tid = b.tid AND a.chunk_id + 1 = b.chunk_id AND a.read_id = b.read_id WHERE a.in_next AND b.in_prev GROUP BY b.tid, b.chunk_id",
    "thread_support": "SELECT tid, block, thread, h1, h2 FROM ts",
    "thread_concordance": """SELECT tid, block, same, crossed, same <> crossed AND greatest(same, crossed) >= 2 AS merge, same <> crossed AND greatest(same, crossed) >= 2 AND crossed > same AS flip FROM (
        SELECT b.tid, b.block, COUNT(CASE WHEN a.p = b.p THEN 1 END) AS same, COUNT(CASE WHEN a.p <> b.p THEN 1 END) AS crossed FROM tp a JOIN tp b ON a.tid = b.tid AND a.block + 20000 = b.block AND a.thread = b.thread
        WHERE a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY b.tid, b.block)""",
    "vcf_projection": """SELECT chrom, vpos AS pos, ref, valt AS alt, 'PASS' AS filter, 'END=' || (vpos + length(ref) - 1) || ';CLEAN;DP=' || total_cov || ';REFC=' || ref_cov || ';ALTC=' || alt_cov || ';LQC=' || low_qual_cov || ';AF=' ||
        printf('%.6g', af) || ';CAT=' || category AS info FROM vr""",
    "phased_gt": "SELECT chrom, vpos AS pos, ref, valt AS alt, CASE WHEN one <> 0 AND two <> 0 THEN '1|1' WHEN one <> 0 THEN '1|0' ELSE '0|1' END AS gt, CASE WHEN (one <> 0) <> (two <> 0) AND p.phase_set > 0 THEN CAST(p.phase_set AS VARCHAR) ELSE '.' END AS ps FROM vr LEFT JOIN ps p ON vr.site_id = p.site_id",
    "digar_events": """SELECT read_id, CAST(ord AS INT) AS ord, CAST(pos AS BIGINT) AS pos, type, CAST(len AS INT) AS len, CAST(qi AS INT) AS qi, false AS low_quality, alt FROM (
        WITH v AS (SELECT read_id, beg, pos, typ, alt, ref_len, row_number() OVER w AS k, coalesce(lag(pos + ref_len) OVER w, beg) AS before,
                     coalesce(sum(length(alt) - ref_len) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM fx_shown JOIN ok USING (read_id, beg, fin) WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
        t AS (SELECT read_id, count(*) AS n, max(pos + ref_len) AS at, sum(length(alt) - ref_len) AS shift FROM fx_shown GROUP BY read_id)
        SELECT read_id, 2 * k - 2 AS ord, before AS pos, 'EQ' AS type, pos - before AS len, before - beg + shift AS qi, '' AS alt FROM v
        UNION ALL SELECT read_id, 2 * k - 1, pos, typ, CASE typ WHEN 'SNP' THEN 1 WHEN 'INS' THEN length(alt) ELSE ref_len END, pos - beg + shift, alt FROM v
        UNION ALL SELECT r.read_id, 2 * coalesce(t.n, 0), coalesce(t.at, r.beg), 'EQ', r.fin + 1 - coalesce(t.at, r.beg), coalesce(t.at - r.beg + t.shift, 0), '' FROM ok r LEFT JOIN t ON r.read_id = t.read_id)""",
    "pivot_variant": """SELECT tid, site_id, category, total_cov FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CASE category WHEN 'CLEAN_HET_SNP' THEN 0 ELSE 1 END, total_cov DESC, pos, site_id) AS rn
        FROM cls WHERE category IN ('CLEAN_HET_SNP', 'CLEAN_HET_INDEL')) WHERE rn = 1""",
}
ORACLE_SQL = {name: BASE + sql for name, sql in ORACLE_SQL.items()}
