"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

#: The derived log: ev(case_id, pos, a, en), st adds the following set nx, the choice set c and what is kept k.
EV = """
ev0 AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS case_id, user_id * 100000000 + strftime(ts, '%Y%m%d')::BIGINT AS ord, ts, event_id, event_type AS a FROM events),
ev1 AS (SELECT *, lead(a) OVER w AS nxt, row_number() OVER w AS pos FROM ev0 WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
ev AS (SELECT case_id, ord, pos::INT AS pos, a, list_sort(list_distinct(list_filter([a, nxt, CASE WHEN event_id % 3 = 0 THEN (['click', 'error', 'purchase', 'signup', 'view'])[(event_id % 5)::INT + 1] END], lambda x: x IS NOT NULL))) AS en FROM ev1),
st0 AS (SELECT *, coalesce(lead(en) OVER (PARTITION BY case_id ORDER BY pos), []::VARCHAR[]) AS nx, lead(a) OVER (PARTITION BY case_id ORDER BY pos) AS next_a, count(*) OVER (PARTITION BY case_id) AS len FROM ev),
st AS (SELECT *, list_sort(list_distinct(list_concat([a], list_filter(en, lambda x: NOT list_contains(nx, x))))) AS c, list_filter(en, lambda x: list_contains(nx, x)) AS k FROM st0),
tr AS (SELECT case_id, any_value(ord) AS ord, string_agg(a || '{' || array_to_string(en, ',') || '}', ' ' ORDER BY pos) AS trace, string_agg(a, ' -> ' ORDER BY pos) AS variant, max(pos) AS len FROM ev GROUP BY case_id),
va AS (SELECT trace, any_value(variant) AS variant, any_value(len) AS len, count(*)::BIGINT AS n_cases, min(ord)::BIGINT AS first_ord, arg_min(case_id, ord) AS rep_case FROM tr GROUP BY trace),
rep AS (SELECT va.*, st.pos, st.a, st.en, st.nx, st.next_a, st.c, st.k FROM va JOIN st ON st.case_id = va.rep_case),
"""


def _chase(kind: str) -> str:
    """CTEs that end in dec(trace, p, q): the intervals of each variant's decomposition, and kap(trace, kappa)."""
    pairs = """
pr AS (SELECT x.trace, x.pos AS i, y.pos AS j, NOT list_has_any(x.c, y.c) AND list_has_all(x.k, y.c) AS ok FROM rep x JOIN rep y ON x.trace = y.trace AND x.pos < y.pos),
"""
    if kind == "leftmost":
        step = """
lb AS (SELECT r.trace, r.pos AS j, r.len, coalesce(max(CASE WHEN NOT pr.ok THEN pr.i END), 0) AS bad FROM rep r LEFT JOIN pr ON pr.trace = r.trace AND pr.j = r.pos GROUP BY ALL),
nxp AS (SELECT p.trace, p.j AS p, coalesce(min(q.j), p.len + 1) AS nxt FROM lb p LEFT JOIN lb q ON q.trace = p.trace AND q.j > p.j AND q.bad >= p.j GROUP BY p.trace, p.j, p.len),
ch(trace, p, nxt) AS (SELECT trace, p, nxt FROM nxp WHERE p = 1 UNION ALL SELECT n.trace, n.p, n.nxt FROM ch JOIN nxp n ON n.trace = ch.trace AND n.p = ch.nxt),
dec AS (SELECT trace, p, nxt - 1 AS q FROM ch),
"""
    elif kind == "rightmost":
        step = """
fb AS (SELECT r.trace, r.pos AS i, r.len, coalesce(min(CASE WHEN NOT pr.ok THEN pr.j END), r.len + 1) AS bad FROM rep r LEFT JOIN pr ON pr.trace = r.trace AND pr.i = r.pos GROUP BY r.trace, r.pos, r.len),
nxp AS (SELECT q.trace, q.i AS q, q.len, coalesce(max(p.i), 0) AS nxt FROM fb q LEFT JOIN fb p ON p.trace = q.trace AND p.i < q.i AND p.bad <= q.i GROUP BY q.trace, q.i, q.len),
ch(trace, q, nxt) AS (SELECT trace, q, nxt FROM nxp WHERE q = len UNION ALL SELECT n.trace, n.q, n.nxt FROM ch JOIN nxp n ON n.trace = ch.trace AND n.q = ch.nxt),
dec AS (SELECT trace, nxt + 1 AS p, q FROM ch),
"""
    else:
        step = """
nxp AS (SELECT r.trace, r.pos AS p, r.pos + 1 + coalesce(pr.ok, false)::INT AS nxt FROM rep r LEFT JOIN pr ON pr.trace = r.trace AND pr.i = r.pos AND pr.j = r.pos + 1),
ch(trace, p, nxt) AS (SELECT trace, p, nxt FROM nxp WHERE p = 1 UNION ALL SELECT n.trace, n.p, n.nxt FROM ch JOIN nxp n ON n.trace = ch.trace AND n.p = ch.nxt),
dec AS (SELECT trace, p, nxt - 1 AS q FROM ch),
"""
    names = """
bl AS (SELECT trace, pos, CASE WHEN len(c) = 1 THEN c[1] ELSE 'xor(' || array_to_string(c, ', ') || ')' END AS b FROM rep),
iv AS (SELECT dec.trace, dec.p, dec.q, CASE WHEN count(DISTINCT bl.b) = 1 THEN min(bl.b) ELSE 'and(' || string_agg(DISTINCT bl.b, ', ' ORDER BY bl.b) || ')' END AS b FROM dec JOIN bl ON bl.trace = dec.trace AND bl.pos BETWEEN dec.p AND dec.q GROUP BY dec.trace, dec.p, dec.q),
kap AS (SELECT trace, CASE WHEN count(*) = 1 THEN min(b) ELSE 'seq(' || string_agg(b, ', ' ORDER BY p) || ')' END AS kappa FROM iv GROUP BY trace),
vk AS (SELECT va.*, kap.kappa FROM va JOIN kap ON kap.trace = va.trace),
vw0 AS (SELECT kappa, sum(n_cases)::BIGINT AS n_cases, count(*)::BIGINT AS n_traces, count(DISTINCT variant)::BIGINT AS n_variants, min(first_ord) AS first_ord FROM vk GROUP BY kappa),
vw AS (SELECT 'C' || row_number() OVER (ORDER BY n_cases DESC, first_ord)::VARCHAR AS label, *, round(n_cases / sum(n_cases) OVER (), 6) AS coverage FROM vw0)
"""
    return pairs + step + names


def _log(body: str) -> str:
    return f"WITH {EV.rstrip().rstrip(',')} {body}"


def over_log(ctes: str, body: str) -> str:
    """A query over the derived log (tr, va, rep, st) and further common tables."""
    return f"WITH {EV} {ctes} {body}"


def over_views(body: str, kind: str = "leftmost") -> str:
    """A query over the derived log's traces with their identifiers (vk) and views (vw)."""
    return f"WITH RECURSIVE {EV} {_chase(kind)} {body}"


_UNI = """
uni AS (SELECT list(DISTINCT a) AS u FROM ev),
us AS (SELECT trace, n_cases, pos, len, a, next_a, list_filter(en, lambda x: list_contains(u, x)) AS en, list_filter(nx, lambda x: list_contains(u, x)) AS nx FROM rep, uni),
df AS (SELECT a AS x, unnest(nx) AS a, n_cases FROM us WHERE pos < len),
co AS (SELECT a AS x, unnest(list_filter(en, lambda y: NOT list_contains(nx, y))) AS a, n_cases FROM us WHERE pos < len),
pa AS (SELECT a AS x, unnest(list_filter(en, lambda y: list_contains(nx, y))) AS a, n_cases FROM us WHERE pos < len),
dfw AS (SELECT x, a, sum(n_cases)::BIGINT AS w FROM df GROUP BY ALL),
cow AS (SELECT x, a, sum(n_cases)::BIGINT AS w FROM (SELECT x, a, n_cases FROM co UNION ALL SELECT a, x, n_cases FROM co) GROUP BY ALL),
paw AS (SELECT x, a, sum(n_cases)::BIGINT AS w FROM (SELECT x, a, n_cases FROM pa UNION ALL SELECT a, x, n_cases FROM pa) GROUP BY ALL),
sa AS (SELECT a, sum(n_cases)::BIGINT AS w FROM (SELECT unnest(en) AS a, n_cases FROM us WHERE pos = 1) GROUP BY a),
ea AS (SELECT a, sum(n_cases)::BIGINT AS w FROM (SELECT unnest(en) AS a, n_cases FROM us WHERE pos = len) GROUP BY a),
cd AS (SELECT 'edge' AS kind, a AS src, next_a AS dst, sum(n_cases)::BIGINT AS w FROM us WHERE pos < len GROUP BY ALL
  UNION ALL SELECT 'start', '', a, sum(n_cases)::BIGINT FROM us WHERE pos = 1 GROUP BY a UNION ALL SELECT 'end', a, '', sum(n_cases)::BIGINT FROM us WHERE pos = len GROUP BY a)
"""

_ACTS = "ka AS (SELECT trace, array_to_string(list_sort(list_distinct(flatten(list(c)))), '|') AS acts FROM rep GROUP BY trace)"
_LABEL = "'u' || (split_part(case_id, '-', 1)::BIGINT % 4)::VARCHAR"
_CELLS = f"cl AS (SELECT {_LABEL} AS t, kap.kappa AS p, count(*)::DOUBLE AS n FROM tr JOIN kap ON kap.trace = tr.trace GROUP BY ALL)"
_ENTROPY = """
ht AS (SELECT coalesce(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS h FROM (SELECT t, sum(n) AS n FROM {c} GROUP BY t)),
hp AS (SELECT coalesce(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS h FROM (SELECT p, sum(n) AS n FROM {c} GROUP BY p)),
hj AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM {c}),
mi AS (SELECT greatest(0, ht.h + hp.h - hj.h) AS mi, ht.h AS h_t, hp.h AS h_p FROM ht, hp, hj)
"""
_PROFILE = """
sz AS (SELECT kappa, sum(n_cases) AS n FROM vk GROUP BY kappa),
kept AS (SELECT kappa FROM sz WHERE n >= 0.01 * (SELECT sum(n) FROM sz) UNION SELECT kappa FROM (SELECT kappa FROM sz ORDER BY n DESC, kappa DESC LIMIT 1) WHERE (SELECT max(n) FROM sz) < 0.01 * (SELECT sum(n) FROM sz)),
eb AS (SELECT rep.trace, unnest(rep.en) AS a FROM rep),
pk AS (SELECT vk.kappa, eb.a, count(*) AS n FROM eb JOIN vk ON vk.trace = eb.trace WHERE vk.kappa IN (SELECT kappa FROM kept) GROUP BY ALL),
nk AS (SELECT kappa, sqrt(sum(n * n)::DOUBLE) AS norm FROM pk GROUP BY kappa),
pt AS (SELECT trace, a, count(*) AS n FROM eb WHERE trace IN (SELECT trace FROM vk WHERE kappa NOT IN (SELECT kappa FROM kept)) GROUP BY ALL),
sc AS (SELECT pt.trace, pk.kappa, round(sum(pt.n * pk.n) / any_value(nk.norm), 9) AS score FROM pt JOIN pk ON pk.a = pt.a JOIN nk ON nk.kappa = pk.kappa GROUP BY ALL),
best AS (SELECT trace, kappa FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY score DESC, kappa) AS r FROM sc) WHERE r = 1)
"""

ORACLES: dict[str, str] = {
    "log_kpis": over_views("SELECT sum(n_cases)::BIGINT AS n_cases, sum(n_cases * len)::BIGINT AS n_events, count(*)::BIGINT AS n_traces, count(DISTINCT variant)::BIGINT AS n_variants, (SELECT count(DISTINCT a) FROM ev)::INT AS n_activities, count(DISTINCT kappa)::BIGINT AS n_views, round(sum(n_cases * len) / sum(n_cases), 6)::DOUBLE AS mean_length FROM vk"),
    "log_validate": _log("SELECT count(*) FILTER (NOT list_contains(en, a))::BIGINT AS n_invalid FROM ev").replace("),  SELECT", ") SELECT"),
    "trace_variants": _log("SELECT trace, n_cases, first_ord FROM va"),
    "classical_variants": _log("SELECT variant, sum(n_cases)::BIGINT AS n_cases, count(*)::BIGINT AS n_traces FROM va GROUP BY variant"),
    "executed_projection": _log("SELECT case_id, variant FROM tr"),
    "executed_activities": _log("SELECT DISTINCT a FROM ev"),
    "sublog_top_views": over_views("SELECT trace, vk.n_cases FROM vk JOIN vw ON vw.kappa = vk.kappa WHERE label IN ('C1', 'C2', 'C3')"),
    "project_log": over_log(
        "pe AS (SELECT case_id, pos, a, list_filter(en, lambda x: x IN ('click', 'purchase', 'view')) AS en FROM ev WHERE a IN ('click', 'purchase', 'view')), pt AS (SELECT tr.ord, coalesce(string_agg(pe.a || '{' || array_to_string(pe.en, ',') || '}', ' ' ORDER BY pe.pos), '') AS trace FROM tr LEFT JOIN pe ON pe.case_id = tr.case_id GROUP BY tr.ord)",
        "SELECT trace, count(*)::BIGINT AS n_cases, min(ord)::BIGINT AS first_ord FROM pt GROUP BY trace",
    ),
    "split_enabled_parse": "SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(concat_ws(' | ', event_type, ' ', CASE WHEN event_id % 2 = 0 THEN 'view ' END, event_type, ''), '|'), lambda x: trim(x)), lambda x: x <> ''))), ',') AS en FROM events",
    "event_records": _log("SELECT case_id, a, strftime(TIMESTAMP '2000-01-01' + to_minutes(pos - 1), '%Y-%m-%d %H:%M:%S') AS stamp, array_to_string(en, ', ') AS en FROM ev"),
    "successor_enabled": _log("SELECT a, array_to_string(en, ',') AS en, array_to_string(nx, ',') AS nx, sum(n_cases)::BIGINT AS n_cases FROM rep GROUP BY ALL"),
    "local_choice": _log("SELECT array_to_string(c, ',') AS choice, array_to_string(k, ',') AS kept, sum(n_cases)::BIGINT AS n_cases FROM rep GROUP BY ALL"),
    "local_block": _log("SELECT CASE WHEN len(c) = 1 THEN c[1] ELSE 'xor(' || array_to_string(c, ', ') || ')' END AS block, sum(n_cases)::BIGINT AS n_cases FROM rep GROUP BY 1"),
    "supports_parallel_pairs": _log("SELECT x.trace, x.pos AS i, y.pos AS j FROM rep x JOIN rep y ON x.trace = y.trace AND x.pos < y.pos WHERE NOT list_has_any(x.c, y.c) AND list_has_all(x.k, y.c)"),
    **{f"decomposition_{kind}": over_views("SELECT trace, string_agg('[' || array_to_string(range(p, q + 1), ',') || ']', '' ORDER BY p) AS intervals FROM dec GROUP BY trace", kind) for kind in ("leftmost", "rightmost", "shortest")},
    "kappa_per_case": over_views("SELECT case_id, kappa FROM tr JOIN kap ON kap.trace = tr.trace"),
    "induce_views": over_views("SELECT label, kappa, n_cases, n_traces, n_variants, coverage, first_ord FROM vw"),
    "induce_views_rightmost": over_views("SELECT label, kappa, n_cases FROM vw", "rightmost"),
    "induce_views_shortest": over_views("SELECT label, kappa, n_cases FROM vw", "shortest"),
    "assign_view": over_views("SELECT trace, label FROM vk JOIN vw ON vw.kappa = vk.kappa"),
    "crosstab_long": over_views("SELECT variant, label, sum(vk.n_cases)::BIGINT AS n_cases FROM vk JOIN vw ON vw.kappa = vk.kappa GROUP BY ALL"),
    "view_coverage": over_views("SELECT label, coverage FROM vw"),
    "view_screen_map": over_views("SELECT DISTINCT label, a FROM (SELECT trace, unnest(en) AS a FROM rep) r JOIN vk ON vk.trace = r.trace JOIN vw ON vw.kappa = vk.kappa WHERE a IN (SELECT a FROM ev)"),
    "only_here": over_views("SELECT min(label) AS label, a FROM (SELECT trace, unnest(en) AS a FROM rep) r JOIN vk ON vk.trace = r.trace JOIN vw ON vw.kappa = vk.kappa GROUP BY a HAVING min(label) = max(label)"),
    "enabled_heatmap": _log("SELECT a, pos, sum(n_cases)::BIGINT AS n_cases FROM (SELECT pos, n_cases, unnest(en) AS a FROM rep) WHERE a IN (SELECT a FROM ev) GROUP BY ALL"),
    "kappa_multiset": _log("SELECT key, sum(n_cases)::BIGINT AS n_cases FROM (SELECT trace, any_value(n_cases) AS n_cases, string_agg(array_to_string(c, '+'), '|' ORDER BY array_to_string(c, '+')) AS key FROM rep GROUP BY trace) GROUP BY key"),
    "kappa_set": _log("SELECT key, sum(n_cases)::BIGINT AS n_cases FROM (SELECT trace, any_value(n_cases) AS n_cases, array_to_string(list_sort(list(DISTINCT array_to_string(c, '+'))), '|') AS key FROM rep GROUP BY trace) GROUP BY key"),
    "kappa_acts": over_log(_ACTS, "SELECT acts AS key, sum(n_cases)::BIGINT AS n_cases FROM ka JOIN va ON va.trace = ka.trace GROUP BY acts"),
    "start_acts": over_log(_UNI, "SELECT a, w FROM sa"),
    "end_acts": over_log(_UNI, "SELECT a, w FROM ea"),
    "end_acts_strict": over_log(_UNI, "SELECT a, w FROM ea WHERE a IN (SELECT a FROM us WHERE pos = len)"),
    "df_freq": over_log(_UNI, "SELECT x, a, w FROM dfw"),
    "choice_freq": over_log(_UNI, "SELECT x, a, w FROM cow"),
    "parallel_freq": over_log(_UNI, "SELECT x, a, w FROM paw"),
    "classical_dfg": over_log(_UNI, "SELECT kind, src, dst, w FROM cd"),
    "translucent_dfg": over_log(_UNI, "SELECT 'edge' AS kind, x AS src, a AS dst, count(*)::BIGINT AS w FROM (SELECT x, a FROM dfw UNION ALL SELECT x, a FROM paw) GROUP BY ALL UNION ALL SELECT 'start', '', a, 1 FROM sa UNION ALL SELECT 'end', a, '', 1 FROM ea"),
    "frequent_tdfg": over_log(_UNI, "SELECT 'edge' AS kind, x AS src, a AS dst, w FROM (SELECT x, a, sum(w)::BIGINT AS w, max(m) AS m FROM (SELECT x, a, w, 1 AS m FROM dfw UNION ALL SELECT x, a, w, 1 FROM paw UNION ALL SELECT x, a, -w, 0 FROM cow) GROUP BY ALL) WHERE m = 1 AND w > 0 UNION ALL SELECT 'start', '', a, w FROM sa UNION ALL SELECT 'end', a, '', w FROM ea"),
    "filter_infrequent": over_log(
        _UNI + ", ed AS (SELECT *, w >= 0.8 * max(w) OVER (PARTITION BY src) AS keep FROM cd WHERE kind = 'edge'), ed2 AS (SELECT *, bool_or(keep) OVER (PARTITION BY dst) AS fed, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r FROM ed)",
        "SELECT kind, src, dst, w FROM ed2 WHERE keep OR (NOT fed AND r = 1) UNION ALL SELECT kind, src, dst, w FROM (SELECT *, max(w) OVER (PARTITION BY kind) AS m FROM cd WHERE kind <> 'edge') WHERE w >= 0.8 * m",
    ),
    "project_dfg": over_log(_UNI, "SELECT kind, src, dst, w FROM cd WHERE src IN ('click', 'view', '') AND dst IN ('click', 'view', '')"),
    "footprint_jaccard": over_log(
        f"fp AS (SELECT DISTINCT {_LABEL} || '-' || substr(split_part(case_id, '-', 2), 8, 1) AS g, a AS src, next_a AS dst FROM st WHERE pos < len), fs AS (SELECT g, count(*) AS n FROM fp GROUP BY g), sh AS (SELECT x.g, y.g AS h, count(*) AS n FROM fp x JOIN fp y ON x.src = y.src AND x.dst = y.dst AND x.g < y.g GROUP BY ALL)",
        "SELECT x.g, y.g AS h, round(coalesce(sh.n, 0) / greatest(1, x.n + y.n - coalesce(sh.n, 0)), 6) AS jaccard FROM fs x JOIN fs y ON x.g < y.g LEFT JOIN sh ON sh.g = x.g AND sh.h = y.g",
    ),
    "variant_overlap": _log(f"SELECT round(sum(n) FILTER (g > 1) / sum(n), 6)::DOUBLE AS overlap FROM (SELECT variant, count(*) AS n, count(DISTINCT {_LABEL}) AS g FROM tr GROUP BY variant)"),
    "group_supported": over_views("SELECT vk.trace, CASE WHEN vk.kappa IN (SELECT kappa FROM kept) THEN vk.kappa ELSE coalesce(best.kappa, (SELECT min(kappa) FROM kept)) END AS group_id FROM vk LEFT JOIN best ON best.trace = vk.trace").replace("AS coverage FROM vw0)\n", "AS coverage FROM vw0)," + _PROFILE),
    "group_supported_solo": over_log(_ACTS, "SELECT acts AS group_id, count(*)::BIGINT AS n_traces FROM ka GROUP BY acts"),
    "group_sizes": over_views("SELECT 'global' AS method, 1::BIGINT AS n_groups UNION ALL SELECT 'kappa', count(DISTINCT kappa)::BIGINT FROM vk UNION ALL SELECT 'kappa_acts', count(DISTINCT acts)::BIGINT FROM ka UNION ALL SELECT 'classical_variants', count(DISTINCT variant)::BIGINT FROM va UNION ALL SELECT 'translucent_variants', count(*)::BIGINT FROM va").replace("AS coverage FROM vw0)\n", f"AS coverage FROM vw0), {_ACTS}\n"),
    "ari": over_views("SELECT CASE WHEN (sa + sb) / 2 = sa * sb / sn THEN 1.0 ELSE round((si - sa * sb / sn) / ((sa + sb) / 2 - sa * sb / sn), 6) END::DOUBLE AS ari FROM (SELECT sum(n * (n - 1) / 2) AS si, sum(n) * (sum(n) - 1) / 2 AS sn FROM cl), (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT t, sum(n) AS n FROM cl GROUP BY t)), (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT p, sum(n) AS n FROM cl GROUP BY p))").replace("AS coverage FROM vw0)\n", f"AS coverage FROM vw0), {_CELLS}\n"),
    "label_accuracy": over_views("SELECT round(sum(m) / sum(n), 6) AS accuracy FROM (SELECT p, max(n) AS m, sum(n) AS n FROM cl GROUP BY p)").replace("AS coverage FROM vw0)\n", f"AS coverage FROM vw0), {_CELLS}\n"),
    "nmi_vmeasure": over_views("SELECT round(2 * mi / (h_t + h_p), 6) AS nmi, round(mi / h_t, 6) AS homogeneity, round(mi / h_p, 6) AS completeness, round(2 * (mi / h_t) * (mi / h_p) / (mi / h_t + mi / h_p), 6) AS v_measure, (SELECT round(sum(m) / sum(n), 6) FROM (SELECT p, max(n) AS m, sum(n) AS n FROM cl GROUP BY p)) AS purity FROM mi").replace("AS coverage FROM vw0)\n", f"AS coverage FROM vw0), {_CELLS}, {_ENTROPY.format(c='cl')}\n"),
    "incoherence": over_log(
        _ACTS + ", sg AS (SELECT acts, variant, count(*) AS sigs, sum(n_cases)::DOUBLE AS n, log2(sum(n_cases)) - sum(n_cases * log2(n_cases)) / sum(n_cases) AS h FROM ka JOIN va ON va.trace = ka.trace GROUP BY ALL)",
        "SELECT round(avg(sigs), 6) AS mean_signatures, max(sigs)::BIGINT AS max_signatures, round(sum(h * n) / sum(n), 6) AS entropy FROM sg",
    ),
    "attr_informativeness": f"""
WITH q AS (SELECT list_distinct(quantile_cont(o_totalprice::DOUBLE, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM orders),
c1 AS (SELECT o_orderstatus AS t, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
c2 AS (SELECT o_orderstatus AS t, len(list_filter(cuts, lambda c: o_totalprice::DOUBLE >= c))::VARCHAR AS p, count(*)::DOUBLE AS n FROM orders, q GROUP BY ALL)
SELECT 'o_orderpriority' AS attribute, nmi FROM (WITH {_ENTROPY.format(c='c1')} SELECT round(2 * mi / (h_t + h_p), 6) AS nmi FROM mi)
UNION ALL SELECT 'o_totalprice', nmi FROM (WITH {_ENTROPY.format(c='c2')} SELECT round(2 * mi / (h_t + h_p), 6) AS nmi FROM mi)""",
    "top_attr_groups": "SELECT c_mktsegment AS value, count(*)::BIGINT AS n_cases FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "first_attr_per_case": "SELECT l_orderkey AS case_id, (list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) FILTER (l_linenumber % 2 = 0))[1] AS value FROM lineitem GROUP BY l_orderkey",
    "two_stage_mean": "SELECT o_orderpriority, round(avg(m), 6) AS price FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice::DOUBLE) AS m FROM orders GROUP BY ALL) GROUP BY 1",
    "weighted_mean": "SELECT l_returnflag, round(sum(l_discount::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE), 6) AS discount FROM lineitem GROUP BY 1",
    "models_to_cov_running": over_views("SELECT row_number() OVER o AS rank, kappa AS group_id, n_cases, sum(good) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS covered, sum(good) OVER (o ROWS UNBOUNDED PRECEDING) - good <= 0.9 * sum(n_cases) OVER () AS needed FROM (SELECT *, CASE WHEN length(kappa) % 5 = 0 THEN 0 ELSE n_cases END AS good FROM vw) WINDOW o AS (ORDER BY n_cases DESC, kappa)"),
    "view_confusion": over_log(_ACTS, f"SELECT {_LABEL} AS role, acts AS view, count(*)::BIGINT AS n_cases FROM tr JOIN ka ON ka.trace = tr.trace GROUP BY ALL"),
    "view_lengths": over_views(f"SELECT {_LABEL} AS group_id, len::INT AS length, count(DISTINCT kappa)::BIGINT AS n_views FROM tr JOIN kap ON kap.trace = tr.trace GROUP BY ALL"),
    "cf_features": over_log(
        "tk AS (SELECT trace, 'a:' || a AS token, count(*)::DOUBLE / any_value(len) AS value FROM rep GROUP BY ALL UNION ALL SELECT trace, 'df:' || a || '>' || next_a, count(*)::DOUBLE / any_value(len) FROM rep WHERE next_a IS NOT NULL GROUP BY ALL UNION ALL SELECT trace, 'len', len::DOUBLE FROM va)",
        "SELECT token, round(sum(value), 5) AS total, count(*)::BIGINT AS n_traces FROM tk GROUP BY token",
    ).replace("GROUP BY ALL UNION ALL SELECT trace, 'df:'", "GROUP BY trace, a UNION ALL SELECT trace, 'df:'").replace("WHERE next_a IS NOT NULL GROUP BY ALL", "WHERE next_a IS NOT NULL GROUP BY trace, a, next_a"),
    "en_features": over_log(
        "tk AS (SELECT trace, 'en:' || x AS token, count(*)::DOUBLE / any_value(len) AS value FROM (SELECT trace, len, unnest(en) AS x FROM rep) GROUP BY trace, x UNION ALL SELECT trace, 'sig:' || array_to_string(en, '+'), count(*)::DOUBLE / any_value(len) FROM rep GROUP BY trace, en)",
        "SELECT token, round(sum(value), 5) AS total, count(*)::BIGINT AS n_traces FROM tk GROUP BY token",
    ),
    "attr_aggregate": """
WITH c AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' -> ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS key FROM lineitem GROUP BY l_orderkey),
j AS (SELECT key, o_totalprice::DOUBLE AS price, o_orderstatus AS status FROM c LEFT JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT key, status FROM (SELECT key, status, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, status) AS r FROM j WHERE status IS NOT NULL GROUP BY key, status) WHERE r = 1)
SELECT j.key, round(coalesce(avg(price), 0.0), 7) AS price, coalesce(any_value(m.status), '?') AS status FROM j LEFT JOIN m ON m.key = j.key GROUP BY j.key""",
}


def _other_log(source: str, kind: str = "leftmost") -> str:
    """The views' CTEs over another table: its first CTE gives (case_id, ord, a, rn)."""
    return f"""WITH RECURSIVE {source},
ev1 AS (SELECT *, lead(a) OVER (PARTITION BY case_id ORDER BY rn) AS nxt FROM ev0),
ev AS (SELECT case_id, ord, rn::INT AS pos, a, list_sort(list_distinct(list_filter([a, nxt], lambda x: x IS NOT NULL))) AS en FROM ev1),
st0 AS (SELECT *, coalesce(lead(en) OVER (PARTITION BY case_id ORDER BY pos), []::VARCHAR[]) AS nx FROM ev),
st AS (SELECT *, list_sort(list_distinct(list_concat([a], list_filter(en, lambda x: NOT list_contains(nx, x))))) AS c, list_filter(en, lambda x: list_contains(nx, x)) AS k FROM st0),
tr AS (SELECT case_id, any_value(ord) AS ord, string_agg(a || array_to_string(en, ','), ' ' ORDER BY pos) AS trace, string_agg(a, ' -> ' ORDER BY pos) AS variant, max(pos) AS len FROM ev GROUP BY case_id),
va AS (SELECT trace, any_value(variant) AS variant, any_value(len) AS len, count(*)::BIGINT AS n_cases, min(ord) AS first_ord, arg_min(case_id, ord) AS rep_case FROM tr GROUP BY trace),
rep AS (SELECT va.*, st.pos, st.a, st.en, st.nx, st.c, st.k FROM va JOIN st ON st.case_id = va.rep_case),
{_chase(kind)} SELECT label, kappa, n_cases, n_traces FROM vw"""


ORACLES["order_views"] = _other_log("ev0 AS (SELECT l_orderkey::VARCHAR AS case_id, l_orderkey AS ord, l_returnflag || l_linestatus AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem)")
ORACLES["conversation_views"] = _other_log("ev0 AS (SELECT conv_id::VARCHAR AS case_id, conv_id AS ord, role AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)")
ORACLES["attribute_scan"] = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS attribute, count(*)::BIGINT AS n_values, round(min(n) FILTER (r <= 4) / sum(n), 6)::DOUBLE AS least_share FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM orders GROUP BY {c})) WHERE n_values BETWEEN 2 AND 60"
    for c in ("o_orderstatus", "o_orderpriority")
)
