"""Queries over the tables whose results can be stated although SQL cannot compute them: models, replay and conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import abstraction as ab
from ..operators import clustering as cl
from ..operators import enrich as en
from ..operators import grouping as gr
from ..operators import levels, quality
from ..operators import log as lg
from ..operators import metrics as mt
from ..operators import views as vw
from ..operators.model import net_of, parse_identifier
from ..sources.logs import derived_traces, load_classical, sequences_of
from .oracles import ORACLES, over_log, over_views
from .registry import query, user_label

T = "trace"
#: A model of visits that may end in a purchase, and one of any clicks, purchases and views in any order.
VISIT, FREE = "seq(loop(xor(click, view), tau), xor(purchase, tau))", "loop(tau, click, purchase, view)"


def sequences(spark, sf_dir):
    """(group_id, acts, n_cases) of the log, by hidden label."""
    acts = ab.executed(F.col(T))
    return derived_traces(spark, sf_dir).groupBy(user_label().alias("group_id"), acts.alias("acts")).agg(F.count(F.lit(1)).alias("n_cases"))


@query
def replay_visits(spark, sf_dir):
    """The sequences that the model of visits can replay, with the sets that it enables."""
    visit = net_of(parse_identifier(VISIT))
    found = en.split_and_enrich(sequences(spark, sf_dir), {f"u{i}": visit for i in range(4)})
    return found.select("group_id", ab.trace_text(F.col(T)).alias("trace"), "n_cases")


@query
def replay_visits_report(spark, sf_dir):
    every = sequences(spark, sf_dir)
    return en.reports(every, en.split_and_enrich(every, {f"u{i}": net_of(parse_identifier(VISIT)) for i in range(4)}))


@query
def conformance_free(spark, sf_dir):
    """The log and the model of any clicks, purchases and views: each other event costs a log move."""
    v = lg.variants_of(derived_traces(spark, sf_dir))
    return quality.model_quality(v, net_of(parse_identifier(FREE))).select("fitness", "precision", "replayed_share")


@query
def model_allows_log(spark, sf_dir):
    """Pairs that follow each other in the derived log of a hidden label, and how many of them its mined model does not allow."""
    grouped = derived_traces(spark, sf_dir).groupBy(user_label().alias("group_id"), T).agg(F.count(F.lit(1)).alias("n_cases"))
    acts = ab.executed(F.col(T))
    rest = F.greatest(F.size(acts) - 1, F.lit(0))
    seen = grouped.select("group_id", F.explode(F.zip_with(F.slice(acts, 1, rest), F.slice(acts, 2, rest), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p")).select("group_id", "p.*").distinct()
    allowed = levels.mine_follows(grouped, "im").withColumn("ok", F.lit(1))
    return seen.join(allowed, ["group_id", "x", "y"], "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_pairs"), (F.count(F.lit(1)) - F.count("ok")).alias("n_missing"))


def _shipments(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return load_classical(items, "l_returnflag", ["A", "R"], "l_orderkey", "l_linestatus", "l_shipdate")


@query
def classical_cases(spark, sf_dir):
    """Orders as cases of a plain log, those of two groups kept."""
    return _shipments(spark, sf_dir).select("case_id", "value", F.array_join("acts", " -> ").alias("variant"))


@query
def classical_sequences(spark, sf_dir):
    return sequences_of(_shipments(spark, sf_dir)).select(F.array_join("acts", " -> ").alias("variant"), "n_cases", F.element_at("case_ids", 1).alias("first_case"))


@query
def case_groups(spark, sf_dir):
    """The group of every case, from a grouping of distinct traces."""
    v = lg.variants_of(derived_traces(spark, sf_dir), with_ids=True)
    return gr.case_labels(gr.group_kappa_acts(v), v)


@query
def group_sublog_sizes(spark, sf_dir):
    v = lg.variants_of(derived_traces(spark, sf_dir))
    return gr.group_sublogs(gr.group_kappa_acts(v), v).groupBy("group_id").agg(F.sum("n_cases").alias("n_cases"), F.sum(F.size(T) * F.col("n_cases")).alias("n_events"))


@query
def view_sublog_sizes(spark, sf_dir):
    v = vw.with_kappa(lg.variants_of(derived_traces(spark, sf_dir)))
    return vw.view_sublogs(vw.assign_views(v, vw.induce_views(v))).groupBy("label").agg(F.sum("n_cases").alias("n_cases"), F.sum(F.size(T) * F.col("n_cases")).alias("n_events"))


@query
def pivot_and_combine(spark, sf_dir):
    """Two summaries of orders side by side, one of them with a column for each status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    wide = mt.pivoted(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "price")
    counts = o.where("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_open"))
    return mt.combined(wide, counts, ["o_orderpriority"])


@query
def standardised_features(spark, sf_dir):
    """Standardised control-flow features: each that varies has mean 0 and mean square 1 over the distinct traces."""
    v = lg.variants_of(derived_traces(spark, sf_dir))
    cells = cl.control_flow(v).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return cells.agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum(F.abs("s")), 4).alias("off_mean"), F.round(F.sum("q"), 4).alias("squares"))


ORACLES["model_allows_log"] = """
WITH ev AS (SELECT 'u' || (user_id % 4)::VARCHAR AS group_id, event_type AS x, lead(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS y FROM events)
SELECT group_id, count(DISTINCT x || '>' || y)::BIGINT AS n_pairs, 0::BIGINT AS n_missing FROM ev WHERE y IS NOT NULL GROUP BY group_id"""

_SEQUENCES = """WITH ev AS (SELECT 'u' || (user_id % 4)::VARCHAR AS group_id, user_id, ts::DATE AS day, ts, event_id, event_type AS a FROM events),
seqs AS (SELECT group_id, list(a ORDER BY ts, event_id) AS acts FROM ev GROUP BY group_id, user_id, day),
fits AS (SELECT *, regexp_full_match(array_to_string(acts, ' '), '(click|view)( (click|view))*( purchase)?') AS fits FROM seqs)"""

ORACLES["replay_visits"] = f"""{_SEQUENCES}
SELECT group_id, array_to_string(list_transform(acts, lambda a, i: a || CASE WHEN i = 1 THEN '{{click,view}}' ELSE '{{click,purchase,view}}' END), ' ') AS trace, count(*)::BIGINT AS n_cases FROM fits WHERE fits GROUP BY group_id, acts"""

ORACLES["replay_visits_report"] = f"""{_SEQUENCES}
SELECT group_id, count(*)::BIGINT AS cases_in, sum(fits::INT)::BIGINT AS cases_kept, round(sum(fits::INT) / count(*), 6) AS retention FROM fits GROUP BY group_id"""

# A model that is mined without a threshold allows its log.
ORACLES["replay_mined"] = f"{_SEQUENCES} SELECT group_id, count(*)::BIGINT AS cases_in, count(*)::BIGINT AS cases_kept, 1.0::DOUBLE AS retention FROM seqs GROUP BY group_id"
ORACLES["conformance_mined"] = f"{_SEQUENCES} SELECT group_id AS scope, count(*)::BIGINT AS n_cases, 1.0::DOUBLE AS fitness, 0.0::DOUBLE AS replayed_share FROM seqs GROUP BY group_id"

# The shortest run is empty, so the worst cost of a trace is its length. The model allows its three activities at every prefix of what is left of a trace without the others.
ORACLES["conformance_free"] = """
WITH ev AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type AS a, event_type IN ('click', 'purchase', 'view') AS own FROM events),
own AS (SELECT list(a ORDER BY ts, event_id) AS acts FROM ev WHERE own GROUP BY user_id, day),
visits AS (SELECT array_to_string(acts[:i - 1], ' ') AS prefix, acts[i] AS a FROM (SELECT acts, unnest(range(1, len(acts) + 1)) AS i FROM own)),
prefixes AS (SELECT prefix, count(*) AS n, count(DISTINCT a) AS went FROM visits GROUP BY prefix)
SELECT (SELECT round(1 - count(*) FILTER (NOT own) / count(*), 6) FROM ev) AS fitness, (SELECT round(1 - sum(n * (3 - went)) / sum(n * 3), 6) FROM prefixes) AS precision, 0.0::DOUBLE AS replayed_share"""

ORACLES["views_repeat"] = over_views("SELECT count(*)::BIGINT AS n_views, 0::BIGINT AS n_different FROM vw")

_CASES = """WITH e AS (SELECT l_orderkey::VARCHAR AS case_id, l_shipdate AS ts, l_linestatus AS a, l_returnflag AS v FROM lineitem WHERE l_shipdate IS NOT NULL AND l_orderkey IS NOT NULL),
c AS (SELECT case_id, string_agg(a, ' -> ' ORDER BY ts, a, v) AS variant, arg_min(v, {'t': ts, 'a': a, 'v': v}) AS value FROM e GROUP BY case_id HAVING value IN ('A', 'R'))"""
ORACLES["classical_cases"] = f"{_CASES} SELECT case_id, value, variant FROM c"
ORACLES["classical_sequences"] = f"{_CASES} SELECT variant, count(*)::BIGINT AS n_cases, min(case_id) AS first_case FROM c GROUP BY variant"
_GROUPS = "ka AS (SELECT trace, array_to_string(list_sort(list_distinct(flatten(list(c)))), '|') AS group_id FROM rep GROUP BY trace)"
ORACLES["case_groups"] = over_log(_GROUPS, "SELECT case_id, group_id FROM tr JOIN ka ON ka.trace = tr.trace")
ORACLES["group_sublog_sizes"] = over_log(_GROUPS, "SELECT group_id, sum(n_cases)::BIGINT AS n_cases, sum(n_cases * len)::BIGINT AS n_events FROM va JOIN ka ON ka.trace = va.trace GROUP BY group_id")
ORACLES["view_sublog_sizes"] = over_views("SELECT label, sum(vk.n_cases)::BIGINT AS n_cases, sum(vk.n_cases * vk.len)::BIGINT AS n_events FROM vk JOIN vw ON vw.kappa = vk.kappa GROUP BY label")
ORACLES["pivot_and_combine"] = """SELECT o_orderpriority, round(avg(o_totalprice::DOUBLE) FILTER (o_orderstatus = 'F'), 6) AS "F", round(avg(o_totalprice::DOUBLE) FILTER (o_orderstatus = 'O'), 6) AS "O",
  round(avg(o_totalprice::DOUBLE) FILTER (o_orderstatus = 'P'), 6) AS "P", nullif(count(*) FILTER (o_orderstatus = 'P'), 0)::BIGINT AS n_open FROM orders GROUP BY o_orderpriority"""

ORACLES["standardised_features"] = ORACLES["cf_features"].replace(
    "SELECT token, round(sum(value), 5) AS total, count(*)::BIGINT AS n_traces FROM tk GROUP BY token",
    "SELECT count(*)::BIGINT AS n_features, 0.0::DOUBLE AS off_mean, sum(varies * n)::DOUBLE AS squares FROM (SELECT token, n, (sum(value * value) / n - (sum(value) / n) ** 2 > 1e-18)::INT AS varies FROM tk, (SELECT count(*)::DOUBLE AS n FROM va) GROUP BY token, n)",
)

_CURVE = """SELECT '{name}' AS key, {share}::DOUBLE AS share, round(coalesce(sum(n_cases) FILTER (k IN (SELECT k FROM drawn WHERE draw < {share})), 0) / sum(n_cases), 6)::DOUBLE AS coverage FROM drawn WHERE draw >= {share}"""


def _curve(name: str, key: str) -> str:
    drawn = f"WITH drawn AS (SELECT {key} AS k, n_cases, (('0x' || substr(md5('0:' || vk.trace), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS draw FROM vk)"
    return " UNION ALL ".join(f"SELECT * FROM ({drawn} {_CURVE.format(name=name, share=share)})" for share in (0.1, 0.3, 0.7))


ORACLES["coverage_curve"] = over_views(" UNION ALL ".join(_curve(n, k) for n, k in (("kappa", "kappa"), ("variant", "variant"), ("constant", "'all'"))))

_KPIS = ORACLES["log_kpis"][ORACLES["log_kpis"].rindex("SELECT sum(n_cases)::BIGINT AS n_cases, sum(n_cases * len)") :]
_OTHER = {name: ORACLES[query_].replace("SELECT label, kappa, n_cases, n_traces FROM vw", _KPIS) for name, query_ in (("orders", "order_views"), ("conversations", "conversation_views"))}
ORACLES["log_overview"] = " UNION ALL ".join(f"SELECT '{name}' AS log, * FROM ({sql})" for name, sql in ({"events": ORACLES["log_kpis"]} | _OTHER).items())


def _agreement(ctes: str, key: str) -> str:
    """ari and n_views by a key of the common table cells(key, t, p, n)."""
    return f"""{ctes},
whole AS (SELECT {key}, sum(n * (n - 1) / 2) AS idx, sum(n) * (sum(n) - 1) / 2 AS pairs FROM cells GROUP BY {key}),
of_t AS (SELECT {key}, sum(n * (n - 1) / 2) AS a FROM (SELECT {key}, t, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY {key}),
of_p AS (SELECT {key}, sum(n * (n - 1) / 2) AS b, count(*) AS n_views FROM (SELECT {key}, p, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY {key}),
agreed AS (SELECT {key}, CASE WHEN (a + b) / 2 = a * b / pairs THEN 1.0 ELSE round((idx - a * b / pairs) / ((a + b) / 2 - a * b / pairs), 6) END::DOUBLE AS ari, n_views FROM whole JOIN of_t USING ({key}) JOIN of_p USING ({key}))"""


_KINDS = {kind: over_views("SELECT trace, kappa, n_cases FROM vk", kind) for kind in ("leftmost", "rightmost", "shortest")}
_PAIRS = " UNION ALL ".join(f"SELECT '{kind}' AS decomposition, l.kappa AS t, o.kappa AS p, l.n_cases::DOUBLE AS n FROM ({_KINDS['leftmost']}) l JOIN ({sql}) o ON o.trace = l.trace" for kind, sql in _KINDS.items())
ORACLES["decompositions_compared"] = _agreement(f"WITH cells AS (SELECT decomposition, t, p, sum(n) AS n FROM ({_PAIRS}) GROUP BY ALL)", "decomposition") + " SELECT decomposition, ari, n_views::BIGINT AS n_views FROM agreed"

_DAYS = over_views("SELECT 'u' || (split_part(case_id, '-', 1)::BIGINT % 4)::VARCHAR AS t, vk.kappa AS p, right(case_id, 2)::INT AS day FROM tr JOIN vk ON vk.trace = tr.trace")
ORACLES["growing_log"] = (
    _agreement(f"WITH cases AS ({_DAYS}), cells AS (SELECT days, t, p, count(*)::DOUBLE AS n FROM cases, (VALUES (10), (20), (31)) v(days) WHERE day <= days GROUP BY ALL)", "days")
    + " SELECT 'kappa' AS method, round(avg(ari), 6) AS mean, round(stddev_pop(ari), 6) AS std, round(max(abs(ari - m)), 6) AS max_deviation, round(regr_slope(ari, days), 6) AS slope FROM agreed, (SELECT avg(ari) AS m FROM agreed)"
)
