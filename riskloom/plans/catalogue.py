"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import caps, clusters, entity, graph, ids, live, metrics, model, resample, split, values
from ..scratch import Scratch
from ..sources import tables
from ..streaming import core_tables, decision_log, ingest, live_index
from . import views
from .views import CAP, KEYS, TEST, edges, entities, features, graph_sql, scored, sql, table, test_rows, txn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAG = 0.6
#: Bootstrap draws and permutations of the original workload.
DRAWS, PERMUTATIONS = 400, 200
#: More characters than any name has.
WHOLE = 1 << 30


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# --- sources, splits, projections

@query(sql("SELECT count(*) AS n_rows, 11 AS n_columns, sum(isFraud) AS fraud_count, round(avg(isFraud), 6) AS fraud_rate, round((max(TransactionDT) - min(TransactionDT))/86400, 4) AS span_days FROM txn"))
def dataset_summary(spark, d):
    return split.dataset_summary(txn(spark, d))


@query(sql("SELECT count(*) AS n_rows, round(avg(isFraud), 6) AS fraud_rate, count(*) = (SELECT count(*) FROM orders) AND abs(round(avg(isFraud), 6) - 0.065) <= 0.02 AS ok FROM txn"))
def integrity_check(spark, d):
    return split.integrity_check(txn(spark, d), table(spark, d, "orders").count(), 0.065, 0.02)


@query(sql("SELECT TransactionID, CAST(((floor(TransactionDT/3600) % 24) + 24) % 24 AS BIGINT) AS tx_hour, CAST(((floor(TransactionDT/86400) % 7) + 7) % 7 AS BIGINT) AS tx_dayofweek, CAST(floor(TransactionDT/86400) AS BIGINT) AS tx_day FROM txn"))
def time_features(spark, d):
    return split.add_time_features(txn(spark, d)).select("TransactionID", "tx_hour", "tx_dayofweek", "tx_day")


@query(sql("SELECT TransactionID, uid FROM scored"))
def build_uid(spark, d):
    return entity.build_uid(txn(spark, d)).select("TransactionID", "uid")


SUMMARY = """SELECT count(*) FILTER (WHERE TransactionDT < c) AS train_rows, count(*) FILTER (WHERE TransactionDT >= c) AS test_rows,
  round(count(*) FILTER (WHERE TransactionDT >= c)/count(*), 6) AS test_fraction, CAST(any_value(c) AS DOUBLE) AS boundary,
  round(avg(isFraud) FILTER (WHERE TransactionDT < c), 6) AS train_rate, round(avg(isFraud) FILTER (WHERE TransactionDT >= c), 6) AS test_rate,
  round((max(TransactionDT) FILTER (WHERE TransactionDT < c) - min(TransactionDT) FILTER (WHERE TransactionDT < c))/86400, 4) AS train_span_days,
  round((max(TransactionDT) FILTER (WHERE TransactionDT >= c) - min(TransactionDT) FILTER (WHERE TransactionDT >= c))/86400, 4) AS test_span_days FROM """


@query(sql(SUMMARY + "txn, cut"))
def temporal_split_summary(spark, d):
    return split.split_summary(txn(spark, d))


@query(sql(SUMMARY + "tr, (SELECT quantile_cont(TransactionDT, 0.8) AS c FROM tr)", "tr AS (SELECT * FROM txn WHERE TransactionDT < (SELECT c FROM cut))"))
def inner_split_summary(spark, d):
    return split.split_summary(split.temporal_split(txn(spark, d))[0])


@query("SELECT o_orderkey AS TransactionID, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS DeviceType FROM orders")
def merged_tables(spark, d):
    """Two CSV files joined, through the cache that the first reading leaves."""
    s, o = Scratch(spark, "merged"), table(spark, d, "orders")
    o.select(F.col("o_orderkey").alias("TransactionID"), F.col("o_orderstatus").alias("status")).write.csv(s.path("transactions"), header=True)
    o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("TransactionID"), F.col("o_orderpriority").alias("DeviceType")).write.csv(s.path("identity"), header=True)
    for _ in range(2):
        out = tables.load_merged(spark, s.path("transactions"), s.path("identity"), s.path("cache"))
    return out.select(F.col("TransactionID").cast("bigint").alias("TransactionID"), "status", "DeviceType")


# --- entities and graph

G = graph_sql("scored")


@query(sql("SELECT uid, key_name, value FROM links", G))
def link_keys_long(spark, d):
    return entity.links_long(entities(txn(spark, d)), KEYS)


@query(sql("SELECT uid, card1, addr1, P_emaildomain, card3, card5, card6 FROM ent", G))
def entity_frame(spark, d):
    return entities(txn(spark, d))


@query(sql("SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS id, (SELECT count(*) FROM ent) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges FROM ent", G))
def entity_index(spark, d):
    rows = txn(spark, d)
    return ids.entity_index(entities(rows), edges(rows))


@query(sql("SELECT uid, key_name, value FROM edges", G))
def hub_suppressed_edges(spark, d):
    return edges(txn(spark, d))


@query(sql(f"SELECT count(*) AS dropped_hub_values, coalesce(sum(members), 0) AS dropped_hub_members FROM grp WHERE members > {CAP}", G))
def hub_drop_counts(spark, d):
    return entity.hub_drops(entity.links_long(entities(txn(spark, d)), KEYS), CAP)


@query(sql("""SELECT cap, (SELECT sum(members) FROM grp WHERE members BETWEEN 2 AND cap) AS n_edges,
  (SELECT count(DISTINCT uid) FROM links JOIN grp USING (key_name, value) WHERE members BETWEEN 2 AND cap) AS linked_entities,
  round((SELECT avg(CASE WHEN uid IN (SELECT uid FROM links JOIN grp USING (key_name, value) WHERE members BETWEEN 2 AND cap) THEN 1.0 ELSE 0.0 END) FROM scored WHERE TransactionDT >= (SELECT c FROM cut)), 6) AS row_coverage
FROM (VALUES (5), (20), (50)) AS t(cap)""", G).replace("WHERE uid IN", "WHERE uid IN"))
def coverage_by_cap(spark, d):
    rows = entity.build_uid(txn(spark, d))
    return entity.coverage(rows.where(F.col("TransactionDT") >= split.cutoff(rows)), entities(txn(spark, d)), KEYS)


#: Hub caps of the sweep. Fixed values.
CAPS = (5, 20, 50)
CAP_FEATURES = (*[graph_sql("scored", f"k{c}_", c) for c in CAPS], "swept AS (" + " UNION ALL ".join(f"SELECT {c} AS cap, * FROM k{c}_feat" for c in CAPS) + ")")


def swept(spark, d):
    rows = txn(spark, d)
    return caps.features_by_cap(entities(rows), entity.links_long(entities(rows), KEYS), CAPS)


@query(sql("SELECT * FROM swept", *CAP_FEATURES))
def features_by_cap(spark, d):
    return swept(spark, d)


@query(sql("""SELECT * FROM (SELECT cap, sum(g_degree) AS edges, count(*) FILTER (WHERE g_is_linked = 1) AS linked_entities, count(DISTINCT g_component) FILTER (WHERE g_is_linked = 1) AS components, max(g_component_size) AS largest_component, max(g_core_number) AS max_core FROM swept GROUP BY 1)
JOIN (SELECT cap, round(avg(CASE WHEN g_is_linked = 1 THEN 1.0 ELSE 0.0 END), 6) AS row_coverage, count(*) FILTER (WHERE g_is_linked = 1) AS linked_rows, coalesce(sum(y) FILTER (WHERE g_is_linked = 1), 0) AS linked_fraud FROM late GROUP BY 1) USING (cap)
LEFT JOIN (SELECT cap, round(max(ap) FILTER (WHERE m = 's'), 6) AS base_ap, round(max(ap) FILTER (WHERE m = 'v'), 6) AS variant_ap FROM (SELECT cap, m, sum(tp*ctp/cn)/sum(tp) AS ap FROM
  (SELECT cap, m, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (SELECT cap, m, x, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM (SELECT cap, 's' AS m, s AS x, y FROM late WHERE g_is_linked = 1 UNION ALL SELECT cap, 'v', v, y FROM late WHERE g_is_linked = 1) GROUP BY ALL)
   WINDOW w AS (PARTITION BY cap, m ORDER BY x DESC)) GROUP BY ALL) GROUP BY cap) USING (cap)""", *CAP_FEATURES,
           f"late AS (SELECT t.cap, r.y, r.s, r.v, f.g_is_linked FROM scored r CROSS JOIN (VALUES {', '.join(f'({c})' for c in CAPS)}) t(cap) LEFT JOIN swept f ON f.uid = r.uid AND f.cap = t.cap WHERE r.TransactionDT >= (SELECT c FROM cut))"))
def cap_metrics(spark, d):
    rows = entity.build_uid(scored(spark, d))
    return caps.cap_report(swept(spark, d), rows.where(F.col("TransactionDT") >= split.cutoff(rows)), CAPS)


@query(sql("SELECT uid, component FROM comp", G))
def connected_components(spark, d):
    c = graph.components(graph.bipartite(edges(txn(spark, d)))).where(F.col("node").startswith("0|"))
    return c.select(F.substring("node", 3, WHOLE).alias("uid"), F.substring("component", 3, WHOLE).alias("component"))


@query(sql("SELECT n AS size, count(*) AS components FROM size GROUP BY 1", G))
def component_sizes(spark, d):
    return connected_components(spark, d).groupBy("component").count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("components"))


@query(sql("SELECT node, core FROM core", G))
def k_core(spark, d):
    return graph.k_core(graph.bipartite(edges(txn(spark, d))))


@query(sql("SELECT * FROM feat", G))
def graph_features(spark, d):
    return features(txn(spark, d))


@query(sql(f"""SELECT count(*) AS entities, sum(g_degree) AS edges, round(avg(g_is_linked), 6) AS linked_fraction, max(g_component_size) AS largest_component,
  round(avg(g_component_size) FILTER (WHERE g_is_linked = 1), 4) AS mean_component_of_linked, max(g_core_number) AS max_core,
  (SELECT count(*) FROM grp WHERE members > {CAP}) AS dropped_hub_values, (SELECT coalesce(sum(members), 0) FROM grp WHERE members > {CAP}) AS dropped_hub_members FROM feat""", G))
def graph_summary(spark, d):
    rows = txn(spark, d)
    return graph.graph_summary(features(rows), entity.links_long(entities(rows), KEYS), CAP)


@query(sql("""SELECT 'train' AS side, TransactionID, f.* EXCLUDE (uid) FROM tr LEFT JOIN t_feat f USING (uid)
UNION ALL SELECT 'test', TransactionID, f.* EXCLUDE (uid) FROM (SELECT * FROM scored WHERE TransactionDT >= (SELECT c FROM cut)) LEFT JOIN feat f USING (uid)""",
           "tr AS (SELECT * FROM scored WHERE TransactionDT < (SELECT c FROM cut))", graph_sql("tr", "t_"), G))
def train_test_graph_features(spark, d):
    a, b = split.temporal_split(entity.build_uid(txn(spark, d)))
    a, b = graph.features_for_split(a, b, views.COLUMNS, KEYS, CAP)
    cols = ["TransactionID", "g_component", "g_component_size", "g_component_size_total", "g_core_number", "g_degree", "g_is_linked"]
    return a.select(F.lit("train").alias("side"), *cols).union(b.select(F.lit("test"), *cols))


@query(sql("SELECT DISTINCT e1.uid AS a, e2.uid AS b FROM edges e1 JOIN edges e2 USING (key_name, value) WHERE e1.uid < e2.uid", G))
def bipartite_projection(spark, d):
    return graph.project(edges(txn(spark, d)))


@query(sql("""SELECT 'entities' AS name, (SELECT count(*) FROM ent) AS nodes, (SELECT count(*) FROM p) AS edges, round(2.0*(SELECT count(*) FROM p)/(SELECT count(*) FROM ent), 4) AS mean_degree,
  round(1.0 - (SELECT count(*) FROM comp)/(SELECT count(*) FROM ent), 6) AS isolated_share, count(*) AS components, max(n) AS largest_component, round(avg(n), 4) AS mean_component, (SELECT max(h) FROM pk WHERE i = 80) AS max_core FROM size""",
           G, "p AS (SELECT DISTINCT e1.uid AS a, e2.uid AS b FROM edges e1 JOIN edges e2 USING (key_name, value) WHERE e1.uid < e2.uid)", "pa AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)",
           "pk(i, v, h) AS (SELECT 0, src, count(*) FROM pa GROUP BY src UNION ALL SELECT i + 1, v, CAST(max(least(h, rn)) AS BIGINT) FROM (SELECT k.i, a.src AS v, k.h, row_number() OVER (PARTITION BY a.src ORDER BY k.h DESC) AS rn FROM pk k JOIN pa a ON a.dst = k.v WHERE k.i < 80) GROUP BY i, v)"))
def graph_shape(spark, d):
    rows = txn(spark, d)
    pairs = Scratch(spark, "shape").table(graph.project(edges(rows)).select(F.col("a").alias("src"), F.col("b").alias("dst")), "pairs")
    return graph.describe_graph("entities", entities(rows).select("uid"), pairs)


@query(sql("SELECT node, round(r, 8) AS rank FROM pr WHERE i = 20", G, "pd AS (SELECT src AS node, count(*) AS d FROM adj GROUP BY 1)", "pn AS (SELECT count(*) AS n FROM pd)",
           """pr(i, node, r) AS (SELECT 0, node, 1.0::DOUBLE/n FROM pd, pn UNION ALL SELECT p.i + 1, a.dst, 0.15::DOUBLE/pn.n + 0.85::DOUBLE*sum(p.r/pd.d)
  FROM pr p JOIN pd USING (node) JOIN adj a ON a.src = p.node, pn WHERE p.i < 20 GROUP BY p.i, a.dst, pn.n)"""))
def pagerank(spark, d):
    return graph.pagerank(graph.bipartite(edges(txn(spark, d))), rounds=20, tolerance=0.0).select("node", F.round("rank", 8).alias("rank"))


@query()
def betweenness(spark, d):
    return graph.betweenness(graph.bipartite(edges(txn(spark, d)))).select("node", F.round("betweenness", 10).alias("betweenness"))


@query()
def centrality_rows(spark, d):
    a, b = split.temporal_split(entity.build_uid(txn(spark, d)))
    a, b = graph.centrality_for_split(a, b, views.COLUMNS, KEYS, CAP)
    cols = ["TransactionID", F.round("g_pagerank", 9).alias("g_pagerank"), F.round("g_betweenness", 12).alias("g_betweenness")]
    return a.select(F.lit("train").alias("side"), *cols).union(b.select(F.lit("test"), *cols))


@query()
def centrality_variance(spark, d):
    e = Scratch(spark, "central").table(graph.bipartite(edges(txn(spark, d))), "e")
    uid = F.substring("node", 3, WHOLE).alias("uid")
    own = F.col("node").startswith("0|")
    ranks = graph.pagerank(e).where(own).select(uid, "rank").join(graph.betweenness(e).where(own).select(uid, "betweenness"), "uid")
    return graph.centrality_variance(ranks, graph.components(e).where(own).select(uid, "component"))


@query(sql("""SELECT node, kind, round(cos(2*pi()*(r - 1)/least(40, total)), 4) AS x, round(sin(2*pi()*(r - 1)/least(40, total)), 4) AS y, total > 40 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY kind DESC, node) AS r, count(*) OVER () AS total FROM
  (SELECT DISTINCT uid AS node, 'entity' AS kind FROM own UNION SELECT DISTINCT key_name || '|' || value, 'attribute' FROM own)) WHERE r <= 40""", G,
           "big AS (SELECT g_component FROM feat ORDER BY g_component_size DESC, g_component LIMIT 1)", "own AS (SELECT e.* FROM edges e JOIN feat USING (uid) WHERE g_component = (SELECT g_component FROM big))"))
def component_subgraph(spark, d):
    f = features(txn(spark, d))
    best = f.orderBy(F.desc("g_component_size"), "g_component").first()["g_component"]
    return graph_display(spark, d, f, best)


def graph_display(spark, d, f, best):
    return clusters.cluster_subgraph(edges(txn(spark, d)), f, best)


# --- metrics of scored rows

def ap_sql(source: str, w: str = "1.0", y: str = "y", s: str = "s") -> str:
    return f"""(SELECT sum(tp*ctp/cn)/sum(tp) FROM (SELECT tp, sum(tp) OVER (ORDER BY x DESC) AS ctp, sum(n) OVER (ORDER BY x DESC) AS cn
  FROM (SELECT {s} AS x, sum(({w})*{y})::DOUBLE AS tp, sum({w})::DOUBLE AS n FROM {source} GROUP BY 1)))"""


def auc_sql(source: str) -> str:
    return f"(SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1)*(count(*) FILTER (WHERE y = 1) + 1)/2)/(count(*) FILTER (WHERE y = 1)::DOUBLE*count(*) FILTER (WHERE y = 0)) FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2.0::DOUBLE AS r FROM {source}))"


@query(sql(f"SELECT round({ap_sql('scored')}, 6) AS ap"))
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d)).select(F.round("ap", 6).alias("ap"))


@query(sql(f"SELECT round({ap_sql('scored', 'amount_inr')}, 6) AS ap"))
def value_weighted_ap(spark, d):
    return metrics.average_precision(scored(spark, d), weight="amount_inr").select(F.round("ap", 6).alias("ap"))


@query(sql(f"SELECT round({auc_sql('scored')}, 6) AS auc"))
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(sql("""SELECT s AS threshold, round(ctp/cn, 6) AS precision, round(ctp/p, 6) AS recall FROM (SELECT s, sum(tp) OVER (ORDER BY s DESC)::DOUBLE AS ctp, sum(n) OVER (ORDER BY s DESC)::DOUBLE AS cn, sum(tp) OVER () AS p
  FROM (SELECT s, sum(y) AS tp, count(*) AS n FROM scored GROUP BY s)) UNION ALL SELECT NULL, 1.0, 0.0"""))
def pr_curve(spark, d):
    return metrics.pr_curve(scored(spark, d))


def costs_sql(ts: str, source: str = "scored") -> str:
    return f"""SELECT t AS threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp/(tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp/(tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp/(fp + tn) ELSE 0 END, 6) AS insult_rate, round(caught, 2) AS caught_inr, round(lost + fn*1200.0::DOUBLE, 2) AS missed_inr, round(bad*0.12::DOUBLE, 2) AS insult_cost_inr,
  round(lost + fn*1200.0::DOUBLE + bad*0.12::DOUBLE, 2) AS total_cost_inr FROM (
  SELECT t, count(*) FILTER (WHERE y = 1 AND s >= t) AS tp, count(*) FILTER (WHERE y = 0 AND s >= t) AS fp, count(*) FILTER (WHERE y = 1 AND s < t) AS fn, count(*) FILTER (WHERE y = 0 AND s < t) AS tn,
    coalesce(sum(amount_inr) FILTER (WHERE y = 1 AND s >= t), 0) AS caught, coalesce(sum(amount_inr) FILTER (WHERE y = 1 AND s < t), 0) AS lost, coalesce(sum(amount_inr) FILTER (WHERE y = 0 AND s >= t), 0) AS bad
  FROM {source}, ({ts}) GROUP BY t)"""


def levels_sql(levels: tuple, extra: str = "") -> str:
    """Distinct exact quantiles: order statistics and what lies between two that differ."""
    at = "q*(n - 1)"
    low, high = f"a[CAST(floor({at}) AS BIGINT) + 1]", f"a[CAST(ceil({at}) AS BIGINT) + 1]"
    value = f"CASE WHEN {low} = {high} THEN {low} ELSE {low}*(1 - ({at} - floor({at}))) + {high}*({at} - floor({at})) END"
    return f"SELECT DISTINCT unnest(list_transform({metrics.linspace(*levels)}::DOUBLE[], lambda q: {value})) AS t FROM (SELECT list(s ORDER BY s) AS a, count(*)::DOUBLE AS n FROM scored){extra}"


def shown(costs: str) -> str:
    return f"SELECT round(threshold, 6) AS threshold, c.* EXCLUDE (threshold) FROM ({costs}) c"


def shown_costs(df):
    return df.withColumn("threshold", F.round("threshold", 6))


@query(sql(shown(costs_sql(f"SELECT {FLAG}::DOUBLE AS t"))))
def cost_at_threshold(spark, d):
    return shown_costs(metrics.at_thresholds(scored(spark, d), [FLAG]))


BY_COST = costs_sql(levels_sql(metrics.BY_COST)) + " ORDER BY total_cost_inr, threshold LIMIT 1"
BY_CAP = "SELECT * FROM (" + costs_sql(levels_sql(metrics.UNDER_CAP)) + ") ORDER BY insult_rate > 0.01, CASE WHEN insult_rate > 0.01 THEN insult_rate ELSE total_cost_inr END, threshold LIMIT 1"


@query(sql(shown(BY_COST)))
def threshold_by_cost(spark, d):
    return shown_costs(metrics.threshold_by_cost(scored(spark, d)))


@query(sql(shown(BY_CAP)))
def threshold_under_cap(spark, d):
    return shown_costs(metrics.threshold_under_cap(scored(spark, d)))


@query(sql(shown(costs_sql(levels_sql(metrics.SWEEP, f" UNION SELECT {FLAG}::DOUBLE")))))
def threshold_sweep(spark, d):
    return shown_costs(metrics.threshold_sweep(scored(spark, d), extra=(FLAG,)))


@query(sql(f"SELECT point, t.* EXCLUDE (point) FROM (SELECT 'cost' AS point, * FROM ({shown(BY_COST)}) UNION ALL SELECT 'cap', * FROM ({shown(BY_CAP)})) t"))
def operating_points(spark, d):
    return shown_costs(metrics.evaluate("base", scored(spark, d))[1])


REPORT = f"""SELECT 'base' AS name, (SELECT count(*) FROM scored) AS rows, round((SELECT avg(y) FROM scored), 6) AS prevalence, round({ap_sql('scored')}, 6) AS auc_pr, round({ap_sql('scored')}/(SELECT avg(y) FROM scored), 4) AS lift,
  round({auc_sql('scored')}, 6) AS auc_roc, round(a.threshold, 6) AS cost_threshold, a.total_cost_inr AS cost_total_inr, round(b.threshold, 6) AS cap_threshold, b.total_cost_inr AS cap_total_inr FROM ({BY_COST}) a, ({BY_CAP}) b"""


@query(sql(REPORT))
def evaluation_report(spark, d):
    return metrics.evaluation_report("base", scored(spark, d)).withColumns({c: F.round(c, 6) for c in ("cost_threshold", "cap_threshold")})


@query(sql(f"SELECT name, printf('%s: AUC-PR %.4f (%.1fx prevalence), AUC-ROC %.4f', name, auc_pr, lift, auc_roc) AS line FROM ({REPORT})"))
def report_line(spark, d):
    return metrics.report_line(metrics.evaluation_report("base", scored(spark, d)))


POINT = """printf('%s at %.4f: precision %.4f, recall %.4f, %d caught and %d missed, %d legitimate declined (%.3f%%), Rs %.2f missed, Rs %.2f insult cost, Rs %.2f in all', point, threshold, precision, recall, tp, fn, fp, insult_rate*100, missed_inr, insult_cost_inr, total_cost_inr)"""


@query(sql(f"""SELECT 0 AS place, printf('%s: AUC-PR %.4f (%.1fx prevalence), AUC-ROC %.4f', name, auc_pr, lift, auc_roc) AS line FROM ({REPORT})
UNION ALL SELECT CASE WHEN point = 'cost' THEN 1 ELSE 2 END, {POINT} FROM (SELECT 'cost' AS point, * FROM ({BY_COST}) UNION ALL SELECT 'cap', * FROM ({BY_CAP}))"""))
def summary_lines(spark, d):
    report, points, _ = metrics.evaluate("base", scored(spark, d))
    return metrics.summary_lines(report, points)


BINS = """(SELECT len(list_filter(e, lambda x: x < s)) AS bin, count(*) AS n, avg(s) AS ms, avg(y) AS ry FROM scored, (SELECT quantile_cont(s, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM scored) GROUP BY 1)"""


@query(sql(f"SELECT bin, n, round(ms, 6) AS mean_score, round(ry, 6) AS observed_rate FROM {BINS}"))
def calibration_bins(spark, d):
    return metrics.calibration_bins(scored(spark, d)).select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed_rate", 6).alias("observed_rate"))


@query(sql(f"SELECT 'base' AS name, round((SELECT avg(pow(s - y, 2)) FROM scored), 6) AS brier, round(sum(abs(ms - ry)*n)/sum(n), 6) AS ece, round(max(abs(ms - ry)), 6) AS worst_bin, count(*) AS bins FROM {BINS}"))
def calibration_report(spark, d):
    return metrics.calibration_report("base", scored(spark, d))


@query(sql("SELECT round(avg(pow(s - y, 2)), 6) AS brier FROM scored"))
def brier(spark, d):
    return metrics.brier(scored(spark, d))


PSI_OF = ("TransactionAmt", "addr1", "card3", "s")


def psi_sql(c: str) -> str:
    side = lambda x: f"(SELECT {c}::DOUBLE AS x FROM scored, cut WHERE TransactionDT {x} c AND {c} IS NOT NULL)"
    count = lambda x: f"(SELECT len(list_filter(e, lambda z: z <= x)) AS bin, count(*)::DOUBLE AS n FROM {side(x)}, i GROUP BY 1)"
    return f"""SELECT '{c}' AS feature, (WITH u AS (SELECT list_sort(list_distinct(quantile_cont(x, {[i / 10 for i in range(11)]}))) AS q FROM {side('<')}), i AS (SELECT q[2:len(q) - 1] AS e, len(q) - 1 AS k FROM u),
  b AS (SELECT unnest(range(0, k)) AS bin FROM i)
  SELECT round(sum((qq - pp)*ln(qq/pp)), 6) FROM (SELECT greatest(coalesce(p.n, 0)/sum(coalesce(p.n, 0)) OVER (), 1e-6) AS pp, greatest(coalesce(q.n, 0)/sum(coalesce(q.n, 0)) OVER (), 1e-6) AS qq
    FROM b LEFT JOIN {count('<')} p USING (bin) LEFT JOIN {count('>=')} q USING (bin))) AS psi"""


VERDICT = "CASE WHEN psi IS NULL THEN 'undefined' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate shift' ELSE 'significant shift' END AS verdict"


@query(sql(f"SELECT feature, psi, {VERDICT} FROM ({' UNION ALL '.join(map(psi_sql, PSI_OF))})"))
def psi_by_feature(spark, d):
    rows = scored(spark, d)
    at = split.cutoff(rows)
    early, late = rows.where(F.col("TransactionDT") < at), rows.where(F.col("TransactionDT") >= at)
    return metrics.psi_table(early, late, list(PSI_OF)).select("feature", "psi", metrics.psi_verdict(F.col("psi")).alias("verdict"))


@query(sql(f"SELECT feature, psi FROM ({' UNION ALL '.join(map(psi_sql, PSI_OF))}) ORDER BY psi DESC, feature LIMIT 1"))
def worst_psi_feature(spark, d):
    return metrics.worst_psi(psi_by_feature(spark, d))


@query(sql("""SELECT w AS "window", rows, fraud, brier, round(ap, 6) AS auc_pr, round(auc, 6) AS auc_roc FROM
  (SELECT w, count(*) AS rows, sum(y) AS fraud, round(avg(pow(s - y, 2)), 6) AS brier FROM win GROUP BY w) JOIN
  (SELECT w, sum(tp*ctp/cn)/sum(tp) AS ap FROM (SELECT w, tp, sum(tp) OVER (PARTITION BY w ORDER BY s DESC)::DOUBLE AS ctp, sum(n) OVER (PARTITION BY w ORDER BY s DESC)::DOUBLE AS cn FROM (SELECT w, s, sum(y) AS tp, count(*) AS n FROM win GROUP BY 1, 2)) GROUP BY w) USING (w) JOIN
  (SELECT w, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1)*(count(*) FILTER (WHERE y = 1) + 1)/2)/(count(*) FILTER (WHERE y = 1)::DOUBLE*count(*) FILTER (WHERE y = 0)) AS auc
    FROM (SELECT w, y, rank() OVER (PARTITION BY w ORDER BY s) + (count(*) OVER (PARTITION BY w, s) - 1)/2.0::DOUBLE AS r FROM win) GROUP BY w) USING (w) WHERE fraud > 0""",
           "ed AS (SELECT [a + i*(b + 1 - a)/6.0::DOUBLE for i in range(1, 6)] AS e FROM (SELECT min(TransactionDT) AS a, max(TransactionDT) AS b FROM scored))",
           "win AS (SELECT len(list_filter(e, lambda x: x <= TransactionDT)) AS w, y, s FROM scored, ed)"))
def drift_windows(spark, d):
    return metrics.drift_windows(scored(spark, d))


DRIFT_OF, DRIFT_DRAWS = ("TransactionAmt", "addr1", "card3"), 200


def window_psi_sql(c: str) -> str:
    side = lambda x, more="": f"(SELECT {more}{c}::DOUBLE AS x FROM {x} WHERE {c} IS NOT NULL)"
    place = "len(list_filter(e, lambda z: z <= x)) AS bin"
    return f"""SELECT w, '{c}' AS feature, round(sum((qq - pp)*ln(qq/pp)), 6) AS psi FROM (SELECT w, greatest(coalesce(p.n, 0)/sum(coalesce(p.n, 0)) OVER (PARTITION BY w), 1e-6) AS pp, greatest(coalesce(q.n, 0)/sum(coalesce(q.n, 0)) OVER (PARTITION BY w), 1e-6) AS qq
    FROM (SELECT unnest(range(0, k)) AS bin, w FROM i_{c}, (SELECT DISTINCT w FROM win)) b LEFT JOIN (SELECT {place}, count(*)::DOUBLE AS n FROM {side('early')}, i_{c} GROUP BY 1) p USING (bin)
    LEFT JOIN (SELECT w, {place}, count(*)::DOUBLE AS n FROM {side('win', 'w, ')}, i_{c} GROUP BY 1, 2) q USING (w, bin)) GROUP BY w"""


LATE = ("early AS (SELECT * FROM scored WHERE TransactionDT < (SELECT c FROM cut))", "late AS (SELECT * FROM scored WHERE TransactionDT >= (SELECT c FROM cut))",
        "ed AS (SELECT [a + i*(b + 1 - a)/6.0::DOUBLE for i in range(0, 7)] AS e FROM (SELECT min(TransactionDT) AS a, max(TransactionDT) AS b FROM late))",
        "win AS (SELECT len(list_filter(e[2:6], lambda x: x <= TransactionDT)) AS w, late.* FROM late, ed)")


def resampled_sql(source: str, by: str) -> tuple[str, ...]:
    """Average precision and ROC area of every draw, and their intervals, by the columns ``by`` (with a comma after them)."""
    return (f"rs AS (SELECT * FROM (SELECT {by}y, s, b, {poisson_sql('id', 'b')} AS k FROM {source}, range(1, {DRIFT_DRAWS + 1}) AS t(b)) WHERE k > 0)",
            f"""rc AS (SELECT *, sum(pos) OVER (PARTITION BY {by}b ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY {by}b ORDER BY s DESC) AS cn FROM (SELECT {by}b, s, sum(k*y)::DOUBLE AS pos, sum(k*(1 - y))::DOUBLE AS neg FROM rs GROUP BY ALL))""",
            f"rm AS (SELECT {by}b, sum(pos*cp/(cp + cn))/sum(pos) AS ap, sum(neg*(cp - pos/2))/(sum(pos)*sum(neg)) AS auc FROM rc GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0)",
            f"""ci AS (SELECT {by}count(*) AS draws, round(quantile_cont(ap, 0.025), 6) AS auc_pr_low, round(quantile_cont(ap, 0.975), 6) AS auc_pr_high, round(quantile_cont(auc, 0.025), 6) AS auc_roc_low, round(quantile_cont(auc, 0.975), 6) AS auc_roc_high FROM rm GROUP BY ALL)""")


def drift_ctes() -> tuple[str, ...]:
    inner = [f"i_{c} AS (SELECT q[2:len(q) - 1] AS e, len(q) - 1 AS k FROM (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, {[i / 10 for i in range(11)]}))) AS q FROM early WHERE {c} IS NOT NULL))" for c in DRIFT_OF]
    return (*LATE, *resampled_sql("win", "w, "), *inner,
            f"ps AS ({' UNION ALL '.join(map(window_psi_sql, DRIFT_OF))})", "wp AS (SELECT w, first(feature ORDER BY psi DESC, feature) AS worst_feature, max(psi) AS worst_psi FROM ps GROUP BY w)",
            """ec AS (SELECT w, round(sum(g*n)/sum(n), 6) AS ece FROM (SELECT w, len(list_filter(q, lambda x: x < s)) AS bin, count(*) AS n, abs(avg(s) - avg(y)) AS g FROM win JOIN (SELECT w, quantile_cont(s, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM win GROUP BY w) USING (w) GROUP BY 1, 2) GROUP BY w)""",
            """dw AS (SELECT w, count(*) AS rows, sum(y) AS fraud, round(avg(y), 6) AS prevalence, round(avg(pow(s - y, 2)), 6) AS brier, round(any_value(e)[w + 1]/86400, 4) AS start_day, round(any_value(e)[w + 2]/86400, 4) AS end_day FROM win, ed GROUP BY w HAVING sum(y) > 0)""",
            """da AS (SELECT w, round(sum(pos*cp/(cp + cn))/sum(pos), 6) AS auc_pr, round(sum(neg*(cp - pos/2))/(sum(pos)*sum(neg)), 6) AS auc_roc FROM (SELECT *, sum(pos) OVER (PARTITION BY w ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY w ORDER BY s DESC) AS cn FROM (SELECT w, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM win GROUP BY ALL)) GROUP BY w)""",
            'dr AS (SELECT w AS "window", rows, fraud, prevalence, brier, start_day, end_day, ece, auc_pr, auc_pr_low, auc_pr_high, auc_roc, auc_roc_low, auc_roc_high, worst_feature, worst_psi FROM dw LEFT JOIN da USING (w) LEFT JOIN ec USING (w) LEFT JOIN ci USING (w) LEFT JOIN wp USING (w))')


def poisson_sql(key: str, b: str) -> str:
    h = f"substr(md5(concat({key}, ':', {b})), 1, 8)"
    return "CASE " + " ".join(f"WHEN {h} < '{x}' THEN {i}" for i, x in enumerate(resample.POISSON)) + " ELSE 7 END"


@query(sql("SELECT * FROM dr", *drift_ctes()))
def drift_report(spark, d):
    rows = scored(spark, d)
    at = split.cutoff(rows)
    return metrics.drift_report(rows.where(F.col("TransactionDT") >= at), rows.where(F.col("TransactionDT") < at), list(DRIFT_OF), draws=DRIFT_DRAWS)


def trend_sql(metric: str) -> str:
    return f"""SELECT f."window" AS first, l."window" AS last, (SELECT count(*) FROM dr) >= 2 AND (f.{metric}_low > l.{metric}_high OR l.{metric}_low > f.{metric}_high) AS distinguishable
  FROM (SELECT * FROM dr ORDER BY "window" LIMIT 1) f, (SELECT * FROM dr ORDER BY "window" DESC LIMIT 1) l"""


@query(sql(f"SELECT 'auc_pr' AS metric, * FROM ({trend_sql('auc_pr')}) UNION ALL SELECT 'auc_roc', * FROM ({trend_sql('auc_roc')})", *drift_ctes()))
def ranking_quality_trend(spark, d):
    w = Scratch(spark, "trend").table(drift_report(spark, d), "windows")
    return metrics.trend(w, "auc_pr").select(F.lit("auc_pr").alias("metric"), "*").union(metrics.trend(w, "auc_roc").select(F.lit("auc_roc"), "*"))


@query(sql("SELECT draws, auc_pr_low, auc_pr_high, auc_roc_low, auc_roc_high FROM ci", *resampled_sql("scored", "")))
def metric_intervals(spark, d):
    found = resample.intervals_of(resample.draw_metrics(scored(spark, d), "id", DRIFT_DRAWS, ["s"]))
    return found.select("draws", F.col("ap_low").alias("auc_pr_low"), F.col("ap_high").alias("auc_pr_high"), F.col("auc_low").alias("auc_roc_low"), F.col("auc_high").alias("auc_roc_high"))


@query(sql(f"""SELECT count(*) AS fraud_rows, round(count(*) FILTER (WHERE m)/count(*), 6) AS count_share, round(coalesce(sum(amount_inr) FILTER (WHERE m), 0)/sum(amount_inr), 6) AS value_share,
  round(avg(amount_inr) FILTER (WHERE m), 2) AS mean_in, round(avg(amount_inr) FILTER (WHERE NOT m), 2) AS mean_out, round(quantile_cont(amount_inr, 0.5) FILTER (WHERE m), 2) AS median_in, round(quantile_cont(amount_inr, 0.5) FILTER (WHERE NOT m), 2) AS median_out,
  round((sum(amount_inr) FILTER (WHERE m)/sum(amount_inr))/(count(*) FILTER (WHERE m)/count(*)), 4) AS enrichment FROM (SELECT amount_inr, s >= {FLAG} AS m FROM scored WHERE y = 1)"""))
def value_concentration(spark, d):
    return metrics.value_concentration(scored(spark, d), F.col("s") >= FLAG)


@query(sql(f"SELECT round(sum(amount_inr) FILTER (WHERE s >= {FLAG})/sum(amount_inr), 6) AS vdr FROM scored WHERE y = 1"))
def value_detection_rate(spark, d):
    return metrics.value_detection_rate(scored(spark, d), FLAG)


WEIGHTS = "wt AS (SELECT y, w/avg(w) OVER () AS w FROM (SELECT y, greatest(CASE WHEN y = 1 THEN amount*88.0::DOUBLE + 1200 ELSE amount*88.0::DOUBLE*0.12::DOUBLE END, 1e-6) AS w FROM scored))"


@query(sql("""SELECT round(avg(w), 6) AS mean, round(pow(sum(w), 2)/sum(w*w), 4) AS ess, round(pow(sum(w), 2)/sum(w*w)/count(*), 6) AS ess_share, round(avg(w) FILTER (WHERE y = 1), 6) AS mean_fraud, round(avg(w) FILTER (WHERE y = 0), 6) AS mean_legit,
  round(avg(w) FILTER (WHERE y = 1)/avg(w) FILTER (WHERE y = 0), 4) AS asymmetry, round(min(w), 6) AS least, round(max(w), 6) AS greatest FROM wt""", WEIGHTS))
def cost_weights_summary(spark, d):
    return metrics.weight_summary(metrics.cost_weights(scored(spark, d)))


@query(sql("SELECT round(pow(sum(w), 2)/sum(w*w), 4) AS ess FROM wt", WEIGHTS))
def effective_sample_size(spark, d):
    return metrics.effective_sample_size(metrics.cost_weights(scored(spark, d)))


# --- resampling and permutation

def interval_sql(source: str) -> str:
    return f"""SELECT draws, delta, low, high, low > 0 OR high < 0 AS significant, CASE WHEN NOT (low > 0 OR high < 0) THEN 'no significant difference' WHEN delta > 0 THEN 'better' ELSE 'worse' END AS verdict
  FROM (SELECT count(*) AS draws, round(avg(delta), 6) AS delta, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM {source})"""


DRAWN = f"dr AS (SELECT * FROM (SELECT scored.*, b, {poisson_sql('id', 'b')} AS w FROM scored, range(1, {DRAWS + 1}) AS t(b)) WHERE w > 0)"


@query(sql(interval_sql(f"(SELECT b, (sum(CASE WHEN v >= 0.5 THEN w*amount_inr ELSE 0 END) - sum(CASE WHEN s >= {FLAG} THEN w*amount_inr ELSE 0 END))/sum(w*amount_inr) AS delta FROM dr WHERE y = 1 GROUP BY b)"), DRAWN))
def bootstrap_vdr_delta_hash(spark, d):
    return resample.vdr_delta(scored(spark, d), "id", DRAWS, FLAG, 0.5)


@query(sql(interval_sql("(SELECT b, max(ap) FILTER (WHERE m = 1) - max(ap) FILTER (WHERE m = 0) AS delta FROM aps GROUP BY b)"), DRAWN,
           """aps AS (SELECT b, m, sum(tp*ctp/cn)/sum(tp) AS ap FROM (SELECT b, m, tp, sum(tp) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS ctp, sum(n) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS cn
  FROM (SELECT b, m, x, sum(w*y)::DOUBLE AS tp, sum(w)::DOUBLE AS n FROM (SELECT b, 0 AS m, s AS x, w, y FROM dr UNION ALL SELECT b, 1, v, w, y FROM dr) GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""))
def bootstrap_ap_delta_hash(spark, d):
    return resample.ap_delta(scored(spark, d), "id", DRAWS)


@query(sql(interval_sql("(SELECT b, coalesce(max(ap) FILTER (WHERE m = 1), 0) - coalesce(max(ap) FILTER (WHERE m = 0), 0) AS delta FROM aps GROUP BY b)"), DRAWN,
           """aps AS (SELECT b, m, sum(tp*ctp/cn)/sum(tp) AS ap FROM (SELECT b, m, tp, sum(tp) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS ctp, sum(n) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS cn
  FROM (SELECT b, m, x, sum(w*y*amount_inr)::DOUBLE AS tp, sum(w*amount_inr)::DOUBLE AS n FROM (SELECT b, 0 AS m, s AS x, w, y, amount_inr FROM dr UNION ALL SELECT b, 1, v, w, y, amount_inr FROM dr) GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""))
def bootstrap_value_ap_delta_hash(spark, d):
    return resample.ap_delta(scored(spark, d), "id", DRAWS, weight="amount_inr")


@query()
def bootstrap_exact(spark, d):
    import numpy as np

    def ap(y, s, n):
        order = np.argsort(-s, kind="stable")
        y, s, n = y[order], s[order], n[order]
        last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
        tp, seen = np.cumsum(y * n)[last], np.cumsum(n)[last]
        return float((np.diff(np.append(0, tp)) * tp / seen).sum() / max(tp[-1], 1))

    return resample.exact_bootstrap(scored(spark, d), ap, draws=DRAWS, counted=True)


@query(sql("""SELECT round(avg(s) FILTER (WHERE y = 1) - avg(s) FILTER (WHERE y = 0), 6) AS gap, (SELECT round(max(2*ctp/(cn + p)), 6) FROM (SELECT sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER () AS p
  FROM (SELECT s, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM scored GROUP BY 1))) AS best_f1 FROM scored"""))
def pluggable_metric(spark, d):
    """The gap of mean scores, and the best F1 of any threshold."""
    rows = Scratch(spark, "pluggable").table(scored(spark, d).select("y", "s"), "rows")
    gap = metrics.metric(rows, lambda y, s: F.round(F.avg(F.when(y == 1, s)) - F.avg(F.when(y == 0, s)), 6), "gap")
    positives = rows.agg(F.sum("y")).first()[0]
    return gap.crossJoin(metrics.metric_by_score(rows, lambda tp, n, ctp, cn: F.round(F.max(2 * ctp / (cn + positives)), 6), "best_f1"))  # one row each


MEMBERS = "mem AS (SELECT f.uid, g_component AS component, CAST(fraud AS INT) AS fraud FROM feat f JOIN (SELECT uid, max(isFraud) AS fraud FROM scored WHERE uid IS NOT NULL GROUP BY uid) USING (uid) WHERE g_is_linked = 1)"


def members(spark, d):
    rows = txn(spark, d)
    labels = entity.build_uid(rows).where("uid is not null").groupBy("uid").agg(F.max("isFraud").alias("fraud"))
    f = features(rows).where("g_is_linked = 1").select("uid", F.col("g_component").alias("component"))
    return Scratch(spark, "members").table(f.join(labels, "uid"), "m")


@query(sql("SELECT count(*) AS components, count(*) FILTER (WHERE f = n) AS all_fraud, count(*) FILTER (WHERE f > 0 AND f < n) AS mixed, count(*) FILTER (WHERE f = 0) AS clean FROM (SELECT component, count(*) AS n, sum(fraud) AS f FROM mem GROUP BY 1 HAVING count(*) >= 2)", G, MEMBERS))
def ring_observed(spark, d):
    return resample.ring_counts(members(spark, d))


PERMUTED = f"perm AS (SELECT b, uid, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY md5(concat(uid, ':', b)), uid) <= (SELECT sum(fraud) FROM mem) THEN 1 ELSE 0 END AS fraud FROM mem, range(1, {PERMUTATIONS + 1}) AS t(b))"


@query(sql("""SELECT o.components, o.all_fraud, o.mixed, o.clean, round(m, 6) AS null_mean, round(sd, 6) AS null_std, round((o.all_fraud - m)/(sd + 1e-9), 4) AS z FROM
  (SELECT count(*) AS components, count(*) FILTER (WHERE f = n) AS all_fraud, count(*) FILTER (WHERE f > 0 AND f < n) AS mixed, count(*) FILTER (WHERE f = 0) AS clean FROM (SELECT component, count(*) AS n, sum(fraud) AS f FROM mem GROUP BY 1 HAVING count(*) >= 2)) o,
  (SELECT avg(k) AS m, stddev_pop(k) AS sd FROM (SELECT b, count(*) FILTER (WHERE f = n) AS k FROM (SELECT b, component, count(*) AS n, sum(p.fraud) AS f FROM perm p JOIN mem USING (uid) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY b))""", G, MEMBERS, PERMUTED))
def ring_permutation_hash(spark, d):
    return resample.ring_test(members(spark, d), draws=PERMUTATIONS)


PAIRS = "pairs AS (SELECT DISTINCT e1.uid AS src, e2.uid AS dst FROM edges e1 JOIN edges e2 USING (key_name, value) WHERE e1.uid < e2.uid)"


@query(sql("SELECT count(*) AS edges, round(avg(a.fraud*b.fraud), 6) AS share FROM pairs JOIN mem a ON src = a.uid JOIN mem b ON dst = b.uid", G, MEMBERS, PAIRS))
def homophily_observed(spark, d):
    pairs = graph.project(edges(txn(spark, d))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return resample.homophily(pairs, members(spark, d).select(F.col("uid").alias("node"), F.col("fraud").alias("bad"))).select("edges", F.round("share", 6).alias("share"))


@query(sql("""SELECT edges, round(share, 6) AS share, round(m, 6) AS null_mean, round(sd, 6) AS null_std, round((share - m)/(sd + 1e-9), 4) AS z FROM
  (SELECT count(*) AS edges, avg(a.fraud*b.fraud) AS share FROM pairs JOIN mem a ON src = a.uid JOIN mem b ON dst = b.uid),
  (SELECT avg(k) AS m, stddev_pop(k) AS sd FROM (SELECT a.b, avg(a.fraud*b.fraud) AS k FROM pairs JOIN perm a ON src = a.uid JOIN perm b ON dst = b.uid AND a.b = b.b GROUP BY a.b))""", G, MEMBERS, PAIRS, PERMUTED))
def homophily_permutation_hash(spark, d):
    pairs = Scratch(spark, "pairs").table(graph.project(edges(txn(spark, d))).select(F.col("a").alias("src"), F.col("b").alias("dst")), "p")
    return resample.homophily_test(pairs, members(spark, d).select(F.col("uid").alias("node"), F.col("fraud").alias("bad")), PERMUTATIONS)


# --- clusters

CLUSTERS = f"""fc AS (SELECT row_number() OVER (ORDER BY ms DESC, g_component) - 1 AS cluster_id, g_component AS component, round(ms, 4) AS max_score FROM
  (SELECT g_component, max(s) AS ms FROM test WHERE g_component IS NOT NULL AND g_component_size > 1 GROUP BY 1 HAVING count(DISTINCT uid) >= 2 AND max(s) >= {FLAG} ORDER BY ms DESC, g_component LIMIT 12)),
ev AS (SELECT cluster_id, count(DISTINCT uid) AS entity_count, count(*) AS transaction_count, count(*) FILTER (WHERE s >= {FLAG}) AS flagged_transaction_count, max(g_component_size) AS component_size, max(g_core_number) AS core_number,
  max(g_degree) AS max_degree, count(DISTINCT card1) AS distinct_cards, count(DISTINCT addr1) AS distinct_addresses, count(DISTINCT P_emaildomain) AS distinct_email_domains,
  CAST(floor((max(TransactionDT) - min(TransactionDT))/86400) AS BIGINT) AS span_days, round(sum(TransactionAmt)*88.0::DOUBLE, 2) AS total_amount_inr, round(max(s), 4) AS max_risk_score, round(avg(s), 4) AS mean_risk_score,
  CASE WHEN count(DISTINCT card1) <> 1 AND count(DISTINCT addr1) <> 1 AND count(DISTINCT P_emaildomain) <> 1 THEN ['indirect_attribute_chain'] ELSE
    list_filter([CASE WHEN count(DISTINCT card1) = 1 THEN 'card1' END, CASE WHEN count(DISTINCT addr1) = 1 THEN 'addr1' END, CASE WHEN count(DISTINCT P_emaildomain) = 1 THEN 'P_emaildomain' END], lambda x: x IS NOT NULL) END AS shared_attributes
  FROM test JOIN fc ON g_component = component GROUP BY cluster_id)"""
FIGURES = ", ".join(c for c in (*text.INTEGERS, *text.DECIMALS))


@query(sql("SELECT * FROM fc", TEST, CLUSTERS))
def flagged_clusters(spark, d):
    return clusters.flagged_clusters(test_rows(spark, d), FLAG)


def evidence(spark, d):
    rows = Scratch(spark, "evidence").table(test_rows(spark, d), "rows")
    return clusters.cluster_evidence(rows, FLAG)


@query(sql(f"SELECT {FIGURES}, array_to_string(shared_attributes, ',') AS shared_attributes FROM ev", TEST, CLUSTERS))
def cluster_evidence(spark, d):
    return evidence(spark, d).withColumn("shared_attributes", F.array_join("shared_attributes", ","))


OUTCOMES = f"""oc AS (SELECT cluster_id, count(s) AS n, count(*) FILTER (WHERE y = 1) AS fraud, round(CASE WHEN count(s) > 0 THEN count(*) FILTER (WHERE y = 1)/count(s) ELSE 0 END, 6) AS fraud_share, count(s) > 0 AND count(*) FILTER (WHERE y = 1) = count(s) AS all_fraud,
  count(*) FILTER (WHERE y = 1 AND s >= {FLAG}) AS caught, count(*) FILTER (WHERE y = 1 AND s < {FLAG}) AS missed, count(*) FILTER (WHERE y = 0 AND s >= {FLAG}) AS false_alarms FROM fc LEFT JOIN test ON g_component = component GROUP BY cluster_id)"""


def outcomes(rows):
    return clusters.cluster_outcomes(rows, clusters.flagged_clusters(rows, FLAG).select("cluster_id", "component"), FLAG)


@query(sql("SELECT * FROM oc", TEST, CLUSTERS, OUTCOMES))
def cluster_outcomes(spark, d):
    return outcomes(Scratch(spark, "outcomes").table(test_rows(spark, d), "rows"))


@query(sql("SELECT count(*) AS clusters, sum(n) AS n, sum(fraud) AS fraud, count(*) FILTER (WHERE all_fraud) AS all_fraud_clusters, round(sum(fraud)/sum(n), 6) AS cluster_rate, round((SELECT avg(y) FROM test), 6) AS base_rate, round(sum(fraud)/sum(n)/(SELECT avg(y) FROM test), 4) AS enrichment FROM oc", TEST, CLUSTERS, OUTCOMES))
def outcome_enrichment(spark, d):
    rows = Scratch(spark, "outcomes").table(test_rows(spark, d), "rows")
    return clusters.outcome_enrichment(outcomes(rows), rows)


CASES = """cf AS (SELECT *, 'case-' || cluster_id AS case_id, row_number() OVER (ORDER BY max_risk_score DESC, cluster_id) AS rank, count(*) OVER () AS total_flagged_clusters, round(100.0::DOUBLE*(rank() OVER (ORDER BY max_risk_score) - 1)/count(*) OVER (), 4) AS risk_percentile,
  round(avg(mean_risk_score) OVER (), 4) AS population_mean_risk, round(flagged_transaction_count/transaction_count, 4) AS flagged_share, round(transaction_count/entity_count, 4) AS transactions_per_entity,
  count(*) OVER (PARTITION BY array_to_string(list_sort(shared_attributes), '|')) - 1 AS entities_in_other_clusters FROM ev)"""
CASE_COLUMNS = ("case_id", "rank", "total_flagged_clusters", "risk_percentile", "population_mean_risk", "flagged_share", "transactions_per_entity", "entities_in_other_clusters")


@query(sql(f"SELECT {', '.join(CASE_COLUMNS)} FROM cf", TEST, CLUSTERS, CASES))
def case_files(spark, d):
    return clusters.case_files(evidence(spark, d)).select(*CASE_COLUMNS)


@query(sql("SELECT case_id, rank, cluster_id FROM cf WHERE case_id = 'case-1'", TEST, CLUSTERS, CASES))
def case_by_id(spark, d):
    return tables.case_by_id(clusters.case_files(evidence(spark, d)), "case-1").select("case_id", "rank", "cluster_id")


SAID = clusters.STATEMENTS
FINDINGS = f"""SELECT case_id, concat_ws('; ', CASE WHEN len(na) >= 2 THEN printf('{SAID['several']}', entity_count, len(na), array_to_string(na, ', ')) WHEN len(na) = 1 THEN printf('{SAID['one']}', entity_count, na[1]) END,
  CASE WHEN core_number >= 2 THEN printf('{SAID['core']}', core_number) END, CASE WHEN span_days <= {clusters.BURST_DAYS} THEN printf('{SAID['burst']}', span_days) END,
  CASE WHEN flagged_share >= {clusters.HALF} THEN printf('{SAID['flagged']}', flagged_transaction_count, transaction_count) END, CASE WHEN entities_in_other_clusters > 0 THEN printf('{SAID['elsewhere']}', entities_in_other_clusters) END) AS corroborating,
  concat_ws('; ', CASE WHEN len(na) = 0 THEN '{SAID['chain']}' END, CASE WHEN span_days > {clusters.BURST_DAYS} THEN printf('{SAID['spread']}', span_days) END,
  CASE WHEN flagged_share <= {clusters.LOW_SHARE} THEN printf('{SAID['few']}', flagged_transaction_count, transaction_count) END,
  CASE WHEN distinct_cards = 1 AND entity_count > 1 THEN '{SAID['card']}' END) AS contradicting
FROM (SELECT *, list_filter(shared_attributes, lambda x: x <> 'indirect_attribute_chain') AS na FROM cf)"""


@query(sql(FINDINGS, TEST, CLUSTERS, CASES))
def case_findings(spark, d):
    return clusters.case_findings(clusters.case_files(evidence(spark, d)))


BUCKET = "CASE WHEN coalesce(g_component_size, 0) = 0 THEN 'none' WHEN g_component_size = 1 THEN '1' WHEN g_component_size = 2 THEN '2' WHEN g_component_size <= 4 THEN '3-4' ELSE '5+' END"


@query(sql(f"SELECT {BUCKET} AS bucket, count(*) AS n, round(avg(abs(v - s)), 6) AS mean_abs_delta, round(avg(v - s), 6) AS mean_delta, count(*) FILTER (WHERE y = 0) AS legit, count(*) FILTER (WHERE y = 0 AND v - s > 0.10::DOUBLE + 1e-9) AS harmed, round(count(*) FILTER (WHERE y = 0 AND v - s > 0.10::DOUBLE + 1e-9)/count(*) FILTER (WHERE y = 0), 6) AS harmed_rate FROM test GROUP BY 1", TEST))
def score_shift_by_bucket(spark, d):
    return clusters.score_shift(test_rows(spark, d))


@query(sql("SELECT * FROM (SELECT 'legit_up' AS side, id, round(v - s, 4) AS delta FROM test WHERE y = 0 AND g_component_size >= 3 ORDER BY delta DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'fraud_down' AS side, id, round(v - s, 4) AS delta FROM test WHERE y = 1 AND g_component_size IS NOT NULL ORDER BY delta, id LIMIT 3)", TEST))
def top_pushed_rows(spark, d):
    return clusters.top_pushed(Scratch(spark, "pushed").table(test_rows(spark, d), "rows"))


@query(sql(f"SELECT (SELECT count(*) FROM lt) AS rows, (SELECT sum(y) FROM lt) AS fraud, round({ap_sql('lt')}, 6) AS base_ap, round({ap_sql('lt', s='v')}, 6) AS variant_ap", TEST, "lt AS (SELECT * FROM test WHERE g_is_linked = 1)"))
def linked_subgroup_ap(spark, d):
    rows = Scratch(spark, "linked").table(test_rows(spark, d).where("g_is_linked = 1").select("y", "s", "v"), "rows")
    one = rows.agg(F.count("*").alias("rows"), F.sum("y").alias("fraud"))
    return one.crossJoin(metrics.average_precision(rows).select(F.round("ap", 6).alias("base_ap"))).crossJoin(metrics.average_precision(rows, s="v").select(F.round("ap", 6).alias("variant_ap")))  # one row each


# --- events, decisions, payments

@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_dedup(spark, d):
    e = table(spark, d, "events")
    return ingest.deduplicated(e.union(e.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events")
def event_count(spark, d):
    return tables.event_count(table(spark, d, "events"))


def decisions(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("case_id"), F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("approved").alias("decision"))


TRAIL = "(SELECT event_id AS id, user_id % 40 AS case_id, CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS decision FROM events)"


@query(f"SELECT * FROM (SELECT 'all' AS asked, * FROM {TRAIL} ORDER BY id DESC LIMIT 200) UNION ALL SELECT * FROM (SELECT 'case' AS asked, * FROM {TRAIL} WHERE case_id = 7 ORDER BY id DESC LIMIT 50)")
def audit_trail(spark, d):
    rows = decisions(spark, d)
    return tables.audit_trail(rows, limit=500).select(F.lit("all").alias("asked"), "*").union(tables.audit_trail(rows, 7).select(F.lit("case"), "*"))


@query("""SELECT case_id, decision, CASE WHEN reviewer = '' THEN 'unattributed' ELSE reviewer END AS reviewer, n AS decisions, last AS evidence_seen FROM (
  SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) AS n, max(event_id) AS last, arg_max(CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'approved' END, event_id) AS decision, arg_max(trim(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END), event_id) AS reviewer FROM events GROUP BY 1)""")
def recorded_decisions(spark, d):
    """Events as decisions, recorded in three batches, the second of which is sent again."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("case_id"), F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("approved").alias("decision"),
                                            F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("reviewer"), F.col("event_id").cast("string").alias("evidence_seen"), "event_id")
    log = decision_log.DecisionLog(spark)
    ends = rows.agg((F.max("event_id") / 3).alias("a"), (F.max("event_id") * 2 / 3).alias("b")).first()
    for number, part in ((0, rows.where(F.col("event_id") <= ends["a"])), (1, rows.where((F.col("event_id") > ends["a"]) & (F.col("event_id") <= ends["b"]))), (1, rows.where("event_id % 7 = 0")), (2, rows.where(F.col("event_id") > ends["b"]))):
        log.record(part, ["event_id"], number)
    count = log.rows().groupBy("case_id").agg(F.count("*").alias("decisions"))
    return tables.latest_decisions(log.rows()).join(count, "case_id").select("case_id", "decision", "reviewer", "decisions", F.col("evidence_seen").cast("long").alias("evidence_seen"))


@query("SELECT 'ok' AS status, (SELECT count(*) FROM events) AS events, true AS results, false AS model, true AS ready")
def health(spark, d):
    return tables.health(table(spark, d, "events"), table(spark, d, "region"))


def live_rows(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("payer_key"), F.col("value").cast("decimal(18,2)").cast("string").alias("v"), F.col("event_type").alias("t")).select("payer_key", F.concat("t", F.lit("~"), "v").alias("mark"))


LIVE = f"""WITH RECURSIVE l AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid, event_type || '~' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events WHERE value IS NOT NULL),
g AS (SELECT value FROM l GROUP BY 1 HAVING count(*) BETWEEN 2 AND {CAP}), e AS (SELECT l.* FROM l JOIN g USING (value)),
r(a, b) AS (SELECT x.uid, y.uid FROM e x JOIN e y USING (value) UNION SELECT r.a, y.uid FROM r JOIN e x ON r.b = x.uid JOIN e y ON x.value = y.value)
SELECT u.uid AS payer_key, coalesce((SELECT count(*) FROM r WHERE a = u.uid), 1) AS size0, greatest(1, (SELECT count(*) FROM r WHERE a = u.uid)) AS component_size, (SELECT count(*) FROM e WHERE e.uid = u.uid) AS degree,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT y.uid)), ',') FROM e x JOIN e y USING (value) WHERE x.uid = u.uid AND y.uid <> u.uid), '') AS linked_payers FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid FROM events) u"""


@query(f"SELECT payer_key, component_size, degree, linked_payers FROM ({LIVE})")
def live_entities(spark, d):
    return live.analyse_all(live_rows(spark, d), ("mark",)).select("payer_key", "component_size", "degree", F.array_join("linked_payers", ",").alias("linked_payers"))


def payment_marks(spark, d):
    """Events as payments: each brings one of the four attributes of its payer, by turns."""
    v = F.concat("event_type", F.lit("~"), F.col("value").cast("decimal(18,2)").cast("string"))
    at = lambda i: F.when(F.col("event_id") % 4 == i, v)
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("payer_key"), *[at(i).alias(a) for i, a in enumerate(live.ATTRIBUTES)])


MARKS = f"""l AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid, {list(live.ATTRIBUTES)}[CAST(event_id % 4 AS INT) + 1] AS key_name, event_type || '~' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events WHERE value IS NOT NULL),
g AS (SELECT key_name, value FROM l GROUP BY ALL HAVING count(*) BETWEEN 2 AND {CAP}), e AS (SELECT l.* FROM l JOIN g USING (key_name, value)),
r(a, b) AS (SELECT x.uid, y.uid FROM e x JOIN e y USING (key_name, value) UNION SELECT r.a, y.uid FROM r JOIN e x ON r.b = x.uid JOIN e y USING (key_name, value)),
adj AS (SELECT '0|' || uid AS src, key_name || '|' || value AS dst FROM e UNION ALL SELECT key_name || '|' || value, '0|' || uid FROM e),
kc(i, v, h) AS (SELECT 0, src, count(*) FROM adj GROUP BY src UNION ALL SELECT i + 1, v, CAST(max(least(h, rn)) AS BIGINT) FROM (
  SELECT k.i, a.src AS v, k.h, row_number() OVER (PARTITION BY a.src ORDER BY k.h DESC) AS rn FROM kc k JOIN adj a ON a.dst = k.v WHERE k.i < 60) GROUP BY i, v),
near AS (SELECT x.uid, array_to_string(list_sort(list(DISTINCT y.uid)), ',') AS linked_payers, array_to_string(list_sort(list(DISTINCT key_name)), ',') AS shared_attributes FROM e x JOIN e y USING (key_name, value) WHERE x.uid <> y.uid GROUP BY 1),
size AS (SELECT a AS uid, count(*) AS n FROM r GROUP BY 1), deg AS (SELECT uid, count(*) AS n FROM e GROUP BY 1),
live AS (SELECT u.uid AS payer_key, coalesce(size.n, 1) AS component_size, coalesce(kc.h, 0) AS core_number, coalesce(deg.n, 0) AS degree, coalesce(near.linked_payers, '') AS linked_payers, coalesce(near.shared_attributes, '') AS shared_attributes
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid FROM events) u LEFT JOIN size USING (uid) LEFT JOIN deg USING (uid) LEFT JOIN near USING (uid) LEFT JOIN kc ON kc.v = '0|' || u.uid AND kc.i = 60)"""


def shown(analysis: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return analysis.select("payer_key", "component_size", "core_number", "degree", joined("linked_payers"), joined("shared_attributes"))


@query(f"WITH RECURSIVE {MARKS} SELECT * FROM live")
def live_attributes(spark, d):
    return shown(live.analyse_all(payment_marks(spark, d)))


#: Events of the last of the batches that live_batches() takes.
BATCHES = 3


@query(f"WITH RECURSIVE {MARKS} SELECT live.*, (SELECT count(DISTINCT user_id) FROM events) AS total_entities FROM live WHERE payer_key IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_id % {BATCHES} = {BATCHES - 1})")
def live_batches(spark, d):
    index, rows = live_index.LiveIndex(spark, buckets=16), payment_marks(spark, d)
    for i in range(BATCHES):
        last = index.take(rows.where(F.col("event_id") % BATCHES == i), i)
    return shown(last).withColumn("total_entities", F.lit(index.total()).cast("long"))


@query("SELECT event_id AS id, user_id AS case_id, event_type AS decision FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def latest_decisions(spark, d):
    return tables.latest_decisions(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.col("event_type").alias("decision")))


@query("SELECT e.event_id, e.event_type, a.n FROM events e LEFT JOIN (SELECT event_id, value*2 AS n FROM events WHERE event_id % 2 = 0) a USING (event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 50")
def recent_events(spark, d):
    e = table(spark, d, "events")
    return tables.recent_events(e.select("event_id", "event_type", F.col("ts").alias("received_at")), e.where("event_id % 2 = 0").select("event_id", (F.col("value") * 2).alias("n"))).select("event_id", "event_type", "n")


@query("SELECT user_id AS event_id, max_by(event_type, ts) AS structural FROM (SELECT user_id, event_type, event_id AS ts FROM events) GROUP BY 1")
def latest_analysis(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("structural"), F.col("event_id").alias("analysed_at"))
    return tables.latest_analysis(e).select("event_id", "structural")


@query("SELECT user_id AS event_id, event_type AS structural FROM events WHERE event_id = (SELECT max(event_id) FROM events WHERE user_id = 3)")
def analysis_by_id(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("structural"), F.col("event_id").alias("analysed_at"))
    return tables.get_analysis(e, 3).select("event_id", "structural")


PAYMENT = """'{"payload":{"payment":{"entity":{"id":"pay_' || c_custkey || '","amount":' || (c_custkey * 37 % 90000) || ',"created_at":' || (c_custkey * 86399) || ',"email":"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || '@Mail' || (c_custkey % 7) || '.Example.COM' END || '","contact":" ' || (CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '+91' || c_custkey END) || ' ","vpa":"U' || c_custkey || '@UPI","card":{"last4":"' || (CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(1000 + c_custkey % 9000 AS VARCHAR(9)) END) || '","network":"Visa","issuer":"' || c_mktsegment || '"}}}}}'"""


def payments(spark, d):
    # spread, as a table of one row group comes in one part
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return rows.select("c_custkey", F.expr(PAYMENT.replace("VARCHAR(9)", "string")).alias("body"))


@query(f"""SELECT c_custkey, coalesce(nullif(lower(email), ''), nullif(trim(contact), ''), nullif(lower(vpa), ''), id) AS payer_key, CASE WHEN last4 <> '' THEN lower(last4 || '|' || network || '|' || issuer) END AS card_fingerprint,
  CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 2)) END AS email_domain, trim(contact) AS contact, lower(vpa) AS vpa FROM (SELECT c_custkey, json_extract_string(b, '$.email') AS email, json_extract_string(b, '$.contact') AS contact, json_extract_string(b, '$.vpa') AS vpa,
  json_extract_string(b, '$.id') AS id, json_extract_string(b, '$.card.last4') AS last4, json_extract_string(b, '$.card.network') AS network, json_extract_string(b, '$.card.issuer') AS issuer FROM (SELECT c_custkey, json_extract({PAYMENT}, '$.payload.payment.entity') AS b FROM customer))""")
def payer_extract(spark, d):
    return payments(spark, d).select("c_custkey", tables.extract_event(tables.payment_json(F.col("body")), F.lit("none")).alias("e")).select("c_custkey", "e.*")


@query("""SELECT c_custkey, round(CASE WHEN c_custkey*37%90000 > 0 THEN (c_custkey*37%90000)/100.0::DOUBLE/88.0::DOUBLE END, 6) AS TransactionAmt, CASE WHEN c_custkey > 0 THEN (floor(c_custkey*86399/3600)%24)::DOUBLE END AS tx_hour, CASE WHEN c_custkey > 0 THEN (floor(c_custkey*86399/86400)%7)::DOUBLE END AS tx_dayofweek,
  round(100.0::DOUBLE*((c_custkey*37%90000 > 0)::INT + 2*(c_custkey > 0)::INT)/3, 4) AS coverage_pct FROM customer""")
def payment_features(spark, d):
    f = payments(spark, d).select("c_custkey", tables.payment_features(tables.payment_json(F.col("body"))).alias("f")).select("c_custkey", "f.*")
    present = sum((F.col(c).isNotNull().cast("int") for c in ("TransactionAmt", "tx_hour", "tx_dayofweek")), F.lit(0))
    return f.withColumn("coverage_pct", F.round(tables.coverage_pct(present, F.lit(3)), 4)).withColumn("TransactionAmt", F.round("TransactionAmt", 6))


@query(f"SELECT c_custkey AS event_id, json_extract_string({PAYMENT}, '$.payload.payment.entity.id') AS payment_id FROM customer")
def all_payments(spark, d):
    stored = payments(spark, d).select(F.col("c_custkey").alias("event_id"), F.col("body").alias("payload"), F.col("c_custkey").alias("received_at"))
    more = stored.limit(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit('{"payload":{}}').alias("payload"), F.lit(0).cast("bigint").alias("received_at"))
    return tables.all_payments(stored.union(more)).select("event_id", F.get_json_object("payment", "$.id").alias("payment_id"))


MODEL_INPUTS = ["TransactionAmt", "card3", "addr1", "tx_hour", "tx_dayofweek"]


@query()
def score_payments(spark, d):
    """Payments scored by a model of the transactions; what a payment does not tell is missing."""
    trained = model.train(split.add_time_features(txn(spark, d)), MODEL_INPUTS)
    rows = payments(spark, d).select("c_custkey", tables.payment_json(F.col("body")).alias("payment"))
    return model.score_payments(trained, rows, tables.payment_features(F.col("payment"))).drop("payment")


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey <> o_custkey AND o_orderkey IN (SELECT c_custkey FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer)")
def resolve_edges(spark, d):
    return tables.resolve_edges(table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT c_custkey % 4 <> 0 AS valid, count(*) AS n FROM customer GROUP BY 1")
def signature_check(spark, d):
    body = payments(spark, d)
    signed = body.withColumn("signature", F.when(F.col("c_custkey") % 4 != 0, text.hmac_sha256(F.col("body"), b"secret")).otherwise(F.lit("00")))
    return signed.groupBy(text.verify_signature(F.col("body"), F.col("signature"), b"secret").alias("valid")).agg(F.count("*").alias("n"))


@query(f"""SELECT CASE event_id % 6 WHEN 1 THEN '{ingest.BAD_SIGNATURE}' WHEN 2 THEN '{ingest.MALFORMED}' WHEN 3 THEN '{ingest.NO_ID}' WHEN 4 THEN '{ingest.BAD_SIGNATURE}' WHEN 5 THEN '{ingest.MALFORMED}'
  ELSE '{ingest.ACCEPTED}' END AS status, count(*) AS n, count(DISTINCT CASE WHEN event_id % 6 IN (0, 1, 3) THEN event_type END) AS types FROM events GROUP BY 1""")
def delivery_verdicts(spark, d):
    """Deliveries of events in raw bytes: good, wrongly signed, no object, without an id, written anew after signing, not UTF-8."""
    e = table(spark, d, "events").withColumn("i", F.col("event_id") % 6)
    sent = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").alias("id")))
    sent = F.when(F.col("i") == 2, F.concat(F.lit("["), sent, F.lit("]"))).otherwise(sent).cast("binary")
    sent = F.when(F.col("i") == 5, F.concat(sent, F.unhex(F.lit("C328")))).otherwise(sent)
    e = e.withColumn("sent", sent).withColumn("signature", text.hmac_sha256(F.col("sent"), b"secret"))
    came = F.when(F.col("i") == 4, F.concat(F.col("sent"), F.lit(" ").cast("binary"))).otherwise(F.col("sent"))
    raw = e.select(F.when(F.col("i") != 3, F.col("event_id").cast("string")).alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("timestamp").alias("received_at"),
                   F.when(F.col("i") == 1, F.reverse("signature")).otherwise(F.col("signature")).alias("signature"), F.lit(None).cast("string").alias("body"), F.base64(came).alias("body64"))
    return ingest.judged(raw, b"secret").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("body").isNotNull() & (F.col("event_type") != "unknown") & (F.col("status") != ingest.MALFORMED), F.col("event_type"))).alias("types"))


# --- text

NORM = "CASE WHEN x = '' THEN '0' ELSE x END"


def numbers_sql(t: str) -> str:
    bare = "replace(x, ',', '')"
    cut = f"CASE WHEN contains({bare}, '.') THEN rtrim(rtrim({bare}, '0'), '.') ELSE {bare} END"
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '\\d[\\d,]*\\.?\\d*'), lambda x: CASE WHEN ({cut}) = '' THEN '0' ELSE {cut} END)))"


@query(f"SELECT doc_id, array_to_string({numbers_sql('text')}, ' ') AS numbers FROM documents")
def extract_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.extract_numbers(F.col("text")), " ").alias("numbers"))


SMALL = "['0','1','2','3','4','5','6','7','8','9','10','12','40.5']"


@query(f"SELECT conv_id, turn, array_to_string(list_filter({numbers_sql('text')}, lambda x: NOT list_contains({SMALL}, x)), ' ') AS invented FROM conversations")
def invented_numbers(spark, d):
    allowed = F.array(*[F.lit(x) for x in (*map(str, range(11)), "12", "40.5")])
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.invented_numbers(F.col("text"), allowed), " ").alias("invented"))


SHOWN = [f"'{n}'" for n in range(11)] + [f"CAST({c} AS VARCHAR)" for c in text.INTEGERS] + [x for c in text.DECIMALS for x in (f"rtrim(printf('%.4f', {c}), '0')", f"CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR)", f"printf('%.2f', {c})", f"printf('%.1f', {c})", f"printf('%.0f', {c})")]


@query(sql(f"""SELECT cluster_id, array_to_string(list_sort(list_distinct(list_transform([{', '.join(SHOWN)}], lambda x: CASE WHEN contains(x, '.') THEN CASE WHEN rtrim(rtrim(x, '0'), '.') = '' THEN '0' ELSE rtrim(rtrim(x, '0'), '.') END ELSE x END))), ' ') AS allowed FROM ev""", TEST, CLUSTERS))
def allowed_numbers(spark, d):
    return evidence(spark, d).select("cluster_id", F.array_join(text.allowed_numbers(), " ").alias("allowed"))


OF_CASE = ("risk_percentile", "transactions_per_entity", "flagged_share", "population_mean_risk")
SHOWN_CASE = SHOWN + [f"CAST({c} AS VARCHAR)" for c in ("rank", "total_flagged_clusters", "entities_in_other_clusters")] + [
    x for c in OF_CASE for x in (f"rtrim(printf('%.4f', {c}), '0')", f"CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR)", f"printf('%.2f', {c})", f"printf('%.1f', {c})", f"printf('%.0f', {c})")]


@query(sql(f"""SELECT case_id, array_to_string(list_sort(list_distinct(list_concat(list_transform([{', '.join(SHOWN_CASE)}], lambda x: CASE WHEN contains(x, '.') THEN CASE WHEN rtrim(rtrim(x, '0'), '.') = '' THEN '0' ELSE rtrim(rtrim(x, '0'), '.') END ELSE x END),
  {numbers_sql('corroborating')}, {numbers_sql('contradicting')}))), ' ') AS allowed FROM cf JOIN fi USING (case_id)""", TEST, CLUSTERS, CASES, f"fi AS ({FINDINGS})"))
def allowed_case_numbers(spark, d):
    return whole_cases(spark, d).select("case_id", F.array_join(text.allowed_numbers(case=True), " ").alias("allowed"))


def whole_cases(spark, d):
    """Case files with their findings."""
    cases = Scratch(spark, "cases").table(clusters.case_files(evidence(spark, d)), "cases")
    return cases.join(clusters.case_findings(cases), "case_id")


def lines_sql(*more: str) -> str:
    facts = [f"'{c}: ' || CAST({c} AS VARCHAR)" for c in text.INTEGERS] + [f"'{c}: ' || printf('%.4f', {c})" for c in text.DECIMALS] + ["'shared_attributes: ' || array_to_string(shared_attributes, ', ')"]
    return " || chr(10) || ".join([*more[:1], *facts, *more[1:]])


def listed_sql(title: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN chr(10) || '{title}:' || chr(10) || '  - ' || replace({c}, '; ', chr(10) || '  - ') ELSE '' END"


CASE_PROMPT = lines_sql("'case_id: ' || case_id", "'rank_by_risk: ' || rank || ' of ' || total_flagged_clusters", "printf('risk_percentile: %.2f', risk_percentile)", "'entities_also_in_other_flagged_clusters: ' || entities_in_other_clusters",
                        "printf('transactions_per_entity: %.2f', transactions_per_entity)", "printf('share_of_transactions_flagged: %.2f', flagged_share)", "printf('population_mean_risk_score: %.4f', population_mean_risk)"
                        ) + " || " + listed_sql("findings_supporting_concern", "corroborating") + " || " + listed_sql("findings_arguing_against_concern", "contradicting")


@query(sql(f"SELECT case_id, {CASE_PROMPT} AS prompt FROM cf JOIN fi USING (case_id)", TEST, CLUSTERS, CASES, f"fi AS ({FINDINGS})"))
def case_prompts(spark, d):
    return whole_cases(spark, d).select("case_id", text.case_facts().alias("prompt"))


RAW = """CASE c_custkey % 8 WHEN 0 THEN 'not json' WHEN 1 THEN '{"probable_cause":"CARD_TESTING","confidence":"high","human_summary":"few"}'
  WHEN 2 THEN '{"probable_cause":"NOTHING","confidence":"high","human_summary":"a","suggested_action":"b"}' WHEN 3 THEN '{"probable_cause":"UNEXPLAINED","confidence":"sure","human_summary":"a","suggested_action":"b"}'
  WHEN 4 THEN '{"probable_cause":"UNEXPLAINED","confidence":"low","human_summary":" ","suggested_action":"b"}' WHEN 5 THEN '{"probable_cause":"UNEXPLAINED","confidence":"low","human_summary":"a","suggested_action":"b","more":1}'
  ELSE CASE WHEN c_custkey % 8 = 7 THEN '```json' || char(10) ELSE '' END || '{"probable_cause":"COORDINATED_RING","confidence":"medium","human_summary":"' || (c_custkey % 30) || ' entities","suggested_action":"look at 1,2' || (c_custkey % 3) || '.50"}' || CASE WHEN c_custkey % 8 = 7 THEN char(10) || '```' ELSE '' END END"""


@query(f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN 'missing field: suggested_action' WHEN 2 THEN 'probable_cause is not allowed' WHEN 3 THEN 'confidence is not allowed' WHEN 4 THEN 'human_summary is empty' WHEN 5 THEN 'unexpected field: more'
  ELSE CASE WHEN len(bad) > 0 THEN 'invented number: ' || array_to_string(bad, ', ') END END AS reason FROM (SELECT c_custkey, list_filter(list_sort(list_distinct([CAST(c_custkey % 30 AS VARCHAR), '12' || (c_custkey % 3) || '.5'])), lambda x: NOT list_contains(['0','1','2','3','4','5','6','7','8','9','10','12','121.5'], x)) AS bad FROM customer)""")
def narrative_validation(spark, d):
    allowed = F.array(*[F.lit(x) for x in (*map(str, range(11)), "12", "121.5")])
    return table(spark, d, "customer").select("c_custkey", text.rejection(F.expr(RAW), allowed).alias("reason"))


@query("""SELECT CASE c_custkey % 4 WHEN 1 THEN 'invented number: 77' WHEN 2 THEN 'key_factors is empty' WHEN 3 THEN 'recommendation is not allowed' END AS reason, count(*) AS n FROM customer GROUP BY 1""")
def disposition_validation(spark, d):
    raw = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '{"recommendation":"confirm","confidence":"high","rationale":"seen 3 times","key_factors":["one card"]}' WHEN 1 THEN '{"recommendation":"confirm","confidence":"high","rationale":"seen 77 times","key_factors":["one card"]}'
      WHEN 2 THEN '{"recommendation":"confirm","confidence":"high","rationale":"r","key_factors":[]}' ELSE '{"recommendation":"wait","confidence":"high","rationale":"r","key_factors":["x"]}' END""")
    return table(spark, d, "customer").groupBy(text.disposition_rejection(raw, F.array(*[F.lit(str(n)) for n in range(11)])).alias("reason")).agg(F.count("*").alias("n"))


@query(sql("SELECT cluster_id, sha256(" + " || chr(10) || ".join([f"'{c}: ' || CAST({c} AS VARCHAR)" for c in text.INTEGERS] + [f"'{c}: ' || printf('%.4f', {c})" for c in text.DECIMALS]) + " || chr(10) || 'shared_attributes: ' || array_to_string(shared_attributes, ', ')) AS prompt_key FROM ev", TEST, CLUSTERS))
def prompt_keys(spark, d):
    return evidence(spark, d).select("cluster_id", text.prompt_key(text.facts()).alias("prompt_key"))


@query()
def traced_narratives(spark, d):
    e = evidence(spark, d).withColumn("text", F.format_string("%d entities made %d transactions over %d days worth %.2f in cluster %d", "entity_count", "transaction_count", "span_days", "total_amount_inr", "cluster_id"))
    return text.annotate(e).select("cluster_id", "text", F.to_json("segments").alias("segments"))


@query(sql("""SELECT cluster_id, true AS accepted, '{"probable_cause": "UNEXPLAINED", "confidence": "low", "human_summary": "' || entity_count || ' entities", "suggested_action": "review"}' AS narrative FROM ev""", TEST, CLUSTERS))
def drafted_narratives(spark, d):
    e = evidence(spark, d).select("cluster_id", text.facts().alias("prompt"), text.allowed_numbers().alias("allowed"))

    def stub(prompt: str) -> str:
        count = next(x for x in prompt.split("\n") if x.startswith("entity_count"))[14:]
        return '{"probable_cause": "UNEXPLAINED", "confidence": "low", "human_summary": "%s entities", "suggested_action": "review"}' % count

    return text.narrate(e, stub).select("cluster_id", "accepted", "narrative")


@query("""SELECT o_orderkey, CASE WHEN len(d) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(substr(d, 1, len(d) - 3)), '(\\d\\d)', '\\1,', 'g')), '^,', '') || ',' || right(d, 3) ELSE d END AS grouped FROM (SELECT o_orderkey, CAST(CAST(round_even(o_totalprice*100, 0) AS BIGINT) AS VARCHAR) AS d FROM orders)""")
def indian_grouping(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.indian_grouping(F.col("o_totalprice") * 100).alias("grouped"))


@query("SELECT c_custkey, CAST(round(CAST(CAST(round(c_acctbal, 2) AS VARCHAR) AS DECIMAL(30,8))*100, 0) AS BIGINT) AS paise FROM customer")
def to_paise(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.to_paise(F.round("c_acctbal", 2).cast("string")).alias("paise"))


@query(sql("""SELECT name, count(*) FILTER (WHERE x IS NOT NULL) AS present FROM (UNPIVOT (SELECT TransactionAmt::VARCHAR AS TransactionAmt, card1::VARCHAR AS card1, addr1::VARCHAR AS addr1, P_emaildomain::VARCHAR AS P_emaildomain, card3::VARCHAR AS card3, card5::VARCHAR AS card5, card6::VARCHAR AS card6, D1::VARCHAR AS D1,
  (floor(TransactionDT/3600) % 24)::VARCHAR AS tx_hour, (floor(TransactionDT/86400) % 7)::VARCHAR AS tx_dayofweek FROM txn) ON COLUMNS(*) INTO NAME name VALUE x) GROUP BY 1"""))
def feature_names(spark, d):
    """The model's inputs, with how many rows have each."""
    rows = entity.build_uid(split.add_time_features(txn(spark, d)))
    names = split.feature_columns(rows)
    one = rows.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("present")) for c in names]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


@query(sql("SELECT cluster_id, CASE WHEN entity_count <= 10 THEN 'confirm' END AS recommendation, entity_count <= 10 AS accepted FROM ev", TEST, CLUSTERS))
def drafted_dispositions(spark, d):
    """A drafter that quotes the number of entities, where only 0 to 10 may be quoted."""
    e = evidence(spark, d).select("cluster_id", text.facts().alias("prompt"), F.array(*[F.lit(str(n)) for n in range(11)]).alias("allowed"))

    def stub(prompt: str) -> str:
        count = next(x for x in prompt.split("\n") if x.startswith("entity_count"))[14:]
        return '{"recommendation": "confirm", "confidence": "low", "rationale": "%s entities", "key_factors": ["shared"]}' % count

    return text.draft_dispositions(e, stub).select("cluster_id", F.get_json_object("disposition", "$.recommendation").alias("recommendation"), "accepted")


def value_interval_sql(measure: str, comparisons: int, deltas: str) -> str:
    q = lambda p: f"round(quantile_cont(delta, {p}), 6)"
    tail = 0.025 / comparisons
    return f"SELECT '{measure}' AS measure, round(avg(delta), 6) AS delta, {q(0.025)} AS low, {q(0.975)} AS high, {q(tail)} AS corrected_low, {q(1 - tail)} AS corrected_high FROM ({deltas})"


def draw_ap_sql(w: str) -> str:
    """Change of average precision by draw, of rows weighed by ``w``."""
    return f"""SELECT b, coalesce(max(ap) FILTER (WHERE m = 1), 0) - coalesce(max(ap) FILTER (WHERE m = 0), 0) AS delta FROM (SELECT b, m, sum(tp*ctp/cn)/sum(tp) AS ap FROM (
  SELECT b, m, tp, sum(tp) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS ctp, sum(n) OVER (PARTITION BY b, m ORDER BY x DESC)::DOUBLE AS cn
  FROM (SELECT b, m, x, sum(w*y*{w})::DOUBLE AS tp, sum(w*{w})::DOUBLE AS n FROM (SELECT b, 0 AS m, s AS x, w, y, amount_inr FROM dr UNION ALL SELECT b, 1, v, w, y, amount_inr FROM dr) GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY b"""


CAUGHT = "sum(CASE WHEN {0} >= (SELECT threshold FROM pt WHERE name = '{0}') THEN w*amount_inr ELSE 0 END)"
DRAW_VDR = f"SELECT b, ({CAUGHT.format('v')} - {CAUGHT.format('s')})/sum(w*amount_inr) AS delta FROM dr WHERE y = 1 GROUP BY b"


@query(sql("""SELECT name, measure, round(observed, 6) AS observed, threshold AS cap_threshold, recall AS cap_recall, insult_rate AS cap_insult_rate, total_cost_inr AS cap_total_inr,
  round(total_cost_inr - (SELECT total_cost_inr FROM pt WHERE name = 's'), 2) AS cap_more_inr, delta, low, high, corrected_low, corrected_high, corrected_low > 0 OR corrected_high < 0 AS significant
  FROM seen JOIN pt USING (name) LEFT JOIN ci USING (name, measure)""", DRAWN, "scored_v AS (SELECT * REPLACE (v AS s) FROM scored)",
           f"pt AS (SELECT 's' AS name, * FROM ({BY_CAP}) UNION ALL SELECT 'v', * FROM ({BY_CAP.replace('scored', 'scored_v')}))",
           f"""seen AS (SELECT 's' AS name, 'count' AS measure, {ap_sql('scored')} AS observed UNION ALL SELECT 'v', 'count', {ap_sql('scored_v')} UNION ALL SELECT 's', 'value', {ap_sql('scored', 'amount_inr')}
  UNION ALL SELECT 'v', 'value', {ap_sql('scored_v', 'amount_inr')} UNION ALL SELECT name, 'vdr', sum(CASE WHEN (CASE WHEN name = 's' THEN s ELSE v END) >= threshold THEN amount_inr ELSE 0 END)/sum(amount_inr) FROM scored, pt WHERE y = 1 GROUP BY name)""",
           f"ci AS (SELECT 'v' AS name, * FROM ({value_interval_sql('count', 2, draw_ap_sql('1.0'))} UNION ALL {value_interval_sql('value', 2, draw_ap_sql('amount_inr'))} UNION ALL {value_interval_sql('vdr', 1, DRAW_VDR)}))"))
def value_comparison(spark, d):
    """Two scores by count, by value and by what each detects and costs under the insult cap."""
    return values.compare_values(scored(spark, d), "id", {"s": "s", "v": "v"}, "s", DRAWS)


# --- model, maintained cores

def feature_sets(spark, d):
    """Train and test rows with graph features of their own graphs, and the columns of each variant."""
    a, b = split.temporal_split(split.add_time_features(entity.build_uid(txn(spark, d))))
    a, b = graph.features_for_split(a, b, views.COLUMNS, KEYS, CAP)
    s = Scratch(spark, "ablation")
    return s.table(a, "train"), s.table(b, "test"), {
        "tabular": MODEL_INPUTS, "components": [*MODEL_INPUTS, "g_component_size", "g_component_size_total", "g_is_linked"],
        "kcore": [*MODEL_INPUTS, "g_core_number", "g_degree"], "graph": [*MODEL_INPUTS, "g_component_size", "g_component_size_total", "g_is_linked", "g_core_number", "g_degree"]}


@query()
def gbt_scores(spark, d):
    a, b, sets = feature_sets(spark, d)
    return model.variants(a, b, {"tabular": sets["tabular"]})


@query()
def top_features(spark, d):
    """The inputs of greatest gain, of a model that was saved and loaded again."""
    path = Scratch(spark, "model").path("tabular")
    model.train(split.add_time_features(txn(spark, d)), MODEL_INPUTS).save(path)
    return spark.createDataFrame(model.importances(model.Trained.load(spark, path)), "feature string, gain double")


@query()
def ablation(spark, d):
    """Every feature set's metrics on the same test rows, with the change from the tabular one and its interval."""
    a, b, sets = feature_sets(spark, d)
    return model.compare(model.variants(a, b, sets), b, "tabular", DRAWS)


def value_sets(spark, d):
    """As feature_sets(), with centrality of the same graphs beside the other features of a graph."""
    a, b, sets = feature_sets(spark, d)
    a, b = graph.centrality_for_split(a, b, views.COLUMNS, KEYS, CAP)
    s = Scratch(spark, "values")
    return s.table(a, "train"), s.table(b, "test"), {**sets, "centrality": [*sets["graph"], "g_pagerank", "g_betweenness"]}


@query()
def value_ablation(spark, d):
    """Every feature set, centrality included, by count, by value and under the insult cap, against the tabular one."""
    a, b, sets = value_sets(spark, d)
    return model.compare_by_value(model.variants(a, b, sets), b, "tabular", DRAWS)


@query()
def cost_training(spark, d):
    """The tabular inputs with rows weighed by what an error on them costs, against the same inputs unweighed."""
    a, b = split.temporal_split(split.add_time_features(txn(spark, d)))
    a = Scratch(spark, "weighed").table(metrics.cost_weights(a, split.TARGET, "TransactionAmt"), "train")
    sets = {"tabular": MODEL_INPUTS, "cost": MODEL_INPUTS}
    return model.compare_by_value(model.variants(a, b, sets, weights={"cost": "weight"}), b, "tabular", DRAWS)


@query()
def results_document(spark, d):
    """One JSON document of the dataset, the models' figures, the graph, the clusters and what is said of them, as served to readers."""
    s = Scratch(spark, "results")
    rows, late = s.table(scored(spark, d), "rows"), s.table(test_rows(spark, d), "late")
    report, points, _ = metrics.evaluate("base", rows)
    linked = F.col("g_is_linked") == 1
    held = clusters.case_files(clusters.cluster_evidence(late, FLAG))
    facts = spark.range(1).select(F.lit(metrics.USD_TO_INR).alias("usd_to_inr"), F.lit(metrics.MARGIN).alias("gross_margin"), F.lit(metrics.CHARGEBACK).alias("chargeback_inr"), F.lit(CAP).alias("hub_cap"))
    # at most a few hundred rows each
    sections = {
        "dataset": split.dataset_summary(rows), "report": report, "operating_points": points, "sweep": metrics.threshold_sweep(rows, (FLAG,)),
        "calibration": metrics.calibration_report("base", rows).union(metrics.calibration_report("variant", rows, s="v")), "concentration": metrics.value_concentration(rows, F.col("s") >= FLAG),
        "ablation": value_comparison(spark, d), "ring_evidence": ring_permutation_hash(spark, d), "graph": graph_summary(spark, d),
        "linked": late.agg(F.count_if(linked).alias("test_rows_linked"), F.round(F.try_divide(100 * F.count_if(linked), F.count("*")), 4).alias("test_rows_linked_pct")),
        "drift": drift_report(spark, d), "clusters": held, "findings": clusters.case_findings(held), "cluster_outcomes": outcomes(late), "narratives": drafted_narratives(spark, d), "assumptions": facts,
    }
    out = None
    for name, df in sections.items():
        one = s.table(df, name).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("document"))


@query(sql("SELECT node, core FROM core", G))
def incremental_core_replay(spark, d):
    e = Scratch(spark, "replay").table(graph.bipartite(edges(txn(spark, d))), "e")
    kept = core_tables.IncrementalCore(spark, buckets=16)
    part = F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    for i in range(3):
        kept.insert(e.where(part == i), i)
    return kept.state.select("node", "core")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.flagged_clusters(test_rows(spark, sf_dir), FLAG)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
