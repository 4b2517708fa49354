"""The tables that queries run over, as DataFrames and as common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entity, graph, metrics, split

KEYS = {"card6": ("card6",), "addr1_pemail_card5": ("addr1", "P_emaildomain", "card5"), "card3_addr1": ("addr1", "card3")}
COLUMNS = ["card1", "addr1", "P_emaildomain", "card3", "card5", "card6"]
CAP = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order: label, seconds, amount and card attributes."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    dt = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)")
    part = lambda n: F.floor(F.col("c_acctbal") / n).cast("int")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("TransactionID"), F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), 1).otherwise(0).alias("isFraud"),
        dt.alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.col("o_custkey").alias("card1"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("c_nationkey")).alias("addr1"), F.col("c_mktsegment").alias("P_emaildomain"),
        part(50).alias("card3"), part(500).alias("card5"), part(10).alias("card6"), (F.floor(dt / 86400) - F.col("o_custkey") % 365).alias("D1"))


def score_columns(df: DataFrame) -> DataFrame:
    """id, y, s, v, amounts: two made-up scores in hundredths, so that ties are many and equal everywhere."""
    k, y = F.col("TransactionID"), F.col("isFraud")
    made = lambda p, q, r, a, b: F.floor((a * ((k * p + q) % 1000) + b * y * ((k * r) % 1000)) / 100) / 100.0
    return df.withColumns({"id": k, "y": y, "s": made(7919, 13, 104729, 7, 3), "v": made(6007, 29, 15485863, 6, 4), "amount": F.col("TransactionAmt"), "amount_inr": metrics.inr(F.col("TransactionAmt"))})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_columns(txn(spark, sf_dir))


def entities(rows: DataFrame) -> DataFrame:
    return entity.entity_frame(entity.build_uid(rows), COLUMNS)


def edges(rows: DataFrame, cap: int = CAP) -> DataFrame:
    return entity.suppressed_edges(entity.links_long(entities(rows), KEYS), cap)


def features(rows: DataFrame, cap: int = CAP) -> DataFrame:
    return graph.graph_features(entities(rows), edges(rows, cap))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows from the cutoff on, with features of the graph over all rows."""
    rows = scored(spark, sf_dir)
    late = entity.build_uid(rows).where(F.col("TransactionDT") >= split.cutoff(rows))
    return graph.attach(late, features(rows))


TXN = """
txn AS (
  SELECT o_orderkey AS TransactionID, CASE WHEN o_orderpriority='1-URGENT' AND o_orderstatus='P' THEN 1 ELSE 0 END AS isFraud,
    date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS TransactionDT, o_totalprice AS TransactionAmt, o_custkey AS card1,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE c_nationkey END AS addr1, c_mktsegment AS P_emaildomain,
    CAST(floor(c_acctbal/50) AS INT) AS card3, CAST(floor(c_acctbal/500) AS INT) AS card5, CAST(floor(c_acctbal/10) AS INT) AS card6,
    CAST(floor(date_diff('second', TIMESTAMP '1995-01-01', o_orderdate)/86400) AS BIGINT) - (o_custkey % 365) AS D1
  FROM orders JOIN customer ON o_custkey = c_custkey),
scored AS (
  SELECT *, TransactionID AS id, isFraud AS y, floor((7*((TransactionID*7919+13)%1000) + 3*isFraud*((TransactionID*104729)%1000))/100)/100.0::DOUBLE AS s,
    floor((6*((TransactionID*6007+29)%1000) + 4*isFraud*((TransactionID*15485863)%1000))/100)/100.0::DOUBLE AS v, TransactionAmt AS amount, TransactionAmt*88.0::DOUBLE AS amount_inr,
    CASE WHEN card1 IS NULL OR addr1 IS NULL OR D1 IS NULL THEN NULL ELSE concat_ws('_', card1, addr1, CAST(floor(TransactionDT/86400) AS BIGINT) - D1) END AS uid
  FROM txn),
cut AS (SELECT quantile_cont(TransactionDT, 0.8) AS c FROM txn)"""


def graph_sql(source: str, p: str = "", cap: int = CAP) -> str:
    """Entity frame, links, edges, components, cores and features of a source's rows under a hub cap; names take the prefix."""
    first = ", ".join(f"first({c} ORDER BY TransactionDT, TransactionID) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in COLUMNS)
    links = " UNION ".join(f"SELECT uid, '{k}' AS key_name, {chr(39) + '|' + chr(39)} AS sep, {' || ' .join(x for i, c in enumerate(parts) for x in ([chr(39) + '|' + chr(39)] if i else []) + [f'CAST({c} AS VARCHAR)'])} AS value FROM {p}ent" for k, parts in KEYS.items())
    return f"""
{p}ent AS (SELECT uid, {first} FROM {source} WHERE uid IS NOT NULL GROUP BY uid),
{p}links AS (SELECT uid, key_name, value FROM ({links}) WHERE value IS NOT NULL),
{p}grp AS (SELECT key_name, value, count(*) AS members FROM {p}links GROUP BY 1, 2),
{p}edges AS (SELECT l.* FROM {p}links l JOIN {p}grp g USING (key_name, value) WHERE members BETWEEN 2 AND {cap}),
{p}reach(a, b) AS (
  SELECT e1.uid, e2.uid FROM {p}edges e1 JOIN {p}edges e2 USING (key_name, value)
  UNION SELECT r.a, e2.uid FROM {p}reach r JOIN {p}edges e1 ON r.b = e1.uid JOIN {p}edges e2 ON e1.key_name = e2.key_name AND e1.value = e2.value),
{p}comp AS (SELECT a AS uid, min(b) AS component FROM {p}reach GROUP BY a),
{p}adj AS (
  SELECT '0|' || uid AS src, '1|' || key_name || '|' || value AS dst FROM {p}edges
  UNION ALL SELECT '1|' || key_name || '|' || value, '0|' || uid FROM {p}edges),
{p}kc(i, v, h) AS (
  SELECT 0, src, count(*) FROM {p}adj GROUP BY src
  UNION ALL SELECT i + 1, v, CAST(max(least(h, rn)) AS BIGINT) FROM (
    SELECT k.i, a.src AS v, k.h, row_number() OVER (PARTITION BY a.src ORDER BY k.h DESC) AS rn FROM {p}kc k JOIN {p}adj a ON a.dst = k.v WHERE k.i < 80) GROUP BY i, v),
{p}core AS (SELECT v AS node, h AS core FROM {p}kc WHERE i = 80),
{p}size AS (SELECT component, count(*) AS n FROM {p}comp GROUP BY 1),
{p}attr AS (SELECT component, count(DISTINCT key_name || '|' || value) AS n FROM {p}edges JOIN {p}comp USING (uid) GROUP BY 1),
{p}deg AS (SELECT uid, count(*) AS d FROM {p}edges GROUP BY 1),
{p}feat AS (
  SELECT e.uid, coalesce(c.component, e.uid) AS g_component, coalesce(s.n, 1) AS g_component_size, coalesce(s.n + t.n, 1) AS g_component_size_total,
    coalesce(k.core, 0) AS g_core_number, coalesce(d.d, 0) AS g_degree, CASE WHEN d.d > 0 THEN 1 ELSE 0 END AS g_is_linked
  FROM {p}ent e LEFT JOIN {p}comp c USING (uid) LEFT JOIN {p}size s ON s.component = c.component LEFT JOIN {p}attr t ON t.component = c.component
  LEFT JOIN {p}core k ON k.node = '0|' || e.uid LEFT JOIN {p}deg d ON d.uid = e.uid)"""


TEST = f"{graph_sql('scored')},\ntest AS (SELECT r.*, f.* EXCLUDE (uid) FROM scored r LEFT JOIN feat f USING (uid) WHERE TransactionDT >= (SELECT c FROM cut))"


def sql(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {','.join([TXN, *ctes])}\n{body}"
