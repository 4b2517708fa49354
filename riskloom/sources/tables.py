"""Readers and writers: transactions, the observed graph, payment events, results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([T.StructField("event_id", T.StringType(), False), T.StructField("event_type", T.StringType()), T.StructField("received_at", T.TimestampType()), T.StructField("payload", T.StringType())])
ANALYSIS = T.StructType([T.StructField("event_id", T.StringType(), False), T.StructField("analysed_at", T.TimestampType()), T.StructField("structural", T.StringType()), T.StructField("demo_score", T.StringType())])
DISPOSITIONS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("case_id", T.StringType()), T.StructField("decided_at", T.TimestampType()), T.StructField("decision", T.StringType()),
                             T.StructField("reviewer", T.StringType()), T.StructField("note", T.StringType()), T.StructField("drafted", T.StringType()), T.StructField("evidence_seen", T.StringType())])
#: Fields of which a payment has at least one, and decisions that may be recorded. Fixed values.
PAYMENT_FIELDS = ("id", "amount", "email", "contact", "card", "vpa", "created_at", "method")
VERBS = ("approved", "rejected")


def downcast(df: DataFrame, floats: bool = True) -> DataFrame:
    """Numbers in the smallest type that holds them: whole ones by their observed range (one pass), others in single precision.

    Without ``floats`` doubles stay, for sums that single precision would lose. Text is left as it is.
    """
    whole = [c for c, k in df.dtypes if k in ("bigint", "int", "smallint")]
    to = {c: "float" for c, k in df.dtypes if floats and (k == "double" or k.startswith("decimal"))}
    if whole:
        r = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(whole) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, c in enumerate(whole):
            a, b = r[f"a{i}"], r[f"b{i}"]
            if a is not None:
                to[c] = next(k for k, n in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << n) <= a and b < 1 << n)
    return df.select(*[F.col(f"`{c}`").cast(to.get(c, k)).alias(c) for c, k in df.dtypes])


def load_merged(spark: SparkSession, transactions: str, identity: str, cache: str | None = None, schemas: tuple | None = None) -> DataFrame:
    """Transactions left-joined with identity by TransactionID; read from ``cache`` if it is there, else written to it."""
    if cache:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return spark.read.parquet(cache)
    reader = lambda p, s: spark.read.csv(p, header=True, schema=s) if s else spark.read.csv(p, header=True, inferSchema=True)
    a, b = schemas or (None, None)
    df = downcast(reader(transactions, a).join(reader(identity, b), "TransactionID", "left"))
    if cache:
        df.write.mode("overwrite").parquet(cache)
        df = spark.read.parquet(cache)
    return df


def load_observed_graph(spark: SparkSession, classes: str, edges: str, counts: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels: id, class; edges: src, dst) from two CSV files; edges with an unknown end and loops go, counts are checked."""
    labels = spark.read.csv(classes, header=True, schema="txId long, class string").select(F.col("txId").alias("id"), "class")
    pairs = spark.read.csv(edges, header=True, schema="txId1 long, txId2 long").select(F.col("txId1").alias("src"), F.col("txId2").alias("dst"))
    if counts and (labels.count(), pairs.count()) != counts:
        raise AssertionError("the graph's files do not have the expected rows")
    return labels, resolve_edges(pairs, labels.select("id"))


def resolve_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both known and differ; parallel edges stay."""
    return edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def is_labelled(label: Column) -> Column:
    return label.isin("1", "2")


def is_illicit(label: Column) -> Column:
    return label == "1"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, through an array of one, so that the value is made once and not wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def payment_json(body: Column) -> Column:
    """The payment object of an event, of a payment envelope or bare; null if none of its known fields is there."""
    at = F.coalesce(F.get_json_object(body, "$.payload.payment.entity"), F.get_json_object(body, "$.payment.entity"), F.when(F.json_object_keys(body).isNotNull(), body))
    return once(at, lambda x: F.when(F.arrays_overlap(F.json_object_keys(x), F.array(*[F.lit(f) for f in PAYMENT_FIELDS])), x))


def extract_event(payment: Column, event_id: Column) -> Column:
    """struct(payer_key, card_fingerprint, email_domain, contact, vpa) of a payment object."""

    def told(p: Column) -> Column:
        get = lambda path: F.nullif(F.get_json_object(p, path), F.lit(""))
        email = get("$.email")
        card = F.when(get("$.card.last4").isNotNull(), F.concat_ws("|", *[F.lower(get(f"$.card.{k}")) for k in ("last4", "network", "issuer")]))
        contact, vpa = F.trim(get("$.contact")), F.lower(get("$.vpa"))
        return F.struct(
            F.coalesce(F.lower(email), F.nullif(contact, F.lit("")), vpa, get("$.id"), event_id).alias("payer_key"), card.alias("card_fingerprint"),
            F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", -1))).alias("email_domain"), contact.alias("contact"), vpa.alias("vpa"))

    return once(payment, told)


def payment_features(payment: Column) -> Column:
    """struct(TransactionAmt, tx_hour, tx_dayofweek) that a payment maps to; null where it does not tell."""

    def told(p: Column) -> Column:
        amount, at = F.get_json_object(p, "$.amount").cast("double"), F.get_json_object(p, "$.created_at").cast("double")
        return F.struct(F.when(amount > 0, amount / 100 / 88.0).alias("TransactionAmt"), F.when(at > 0, F.pmod(F.floor(at / 3600), F.lit(24)).cast("double")).alias("tx_hour"),
                        F.when(at > 0, F.pmod(F.floor(at / 86400), F.lit(7)).cast("double")).alias("tx_dayofweek"))

    return once(payment, told)


def coverage_pct(present: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * present, total), F.lit(0.0))


def recent_events(events: DataFrame, analysis: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events with their analysis, if any."""
    return events.join(analysis, "event_id", "left").orderBy(F.desc("received_at"), F.desc("event_id")).limit(limit)


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def all_payments(events: DataFrame) -> DataFrame:
    """(event_id, payment) of every stored payment, oldest first; events without the payment envelope are left out."""
    at = F.get_json_object("payload", "$.payload.payment.entity")
    return events.select("event_id", at.alias("payment"), "received_at").where(F.json_object_keys("payment").isNotNull()).orderBy("received_at", "event_id").select("event_id", "payment")


def get_analysis(analysis: DataFrame, event_id: str) -> DataFrame:
    """The last analysis of one event; no row if there is none."""
    return latest_analysis(analysis.where(F.col("event_id") == event_id))


def audit_trail(decisions: DataFrame, case_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest decisions first, of one case or of all, at most ``limit`` (1 to 200)."""
    rows = decisions if case_id is None else decisions.where(F.col("case_id") == case_id)
    return rows.orderBy(F.desc("id")).limit(max(1, min(limit, 200)))


def case_by_id(cases: DataFrame, case_id: str) -> DataFrame:
    """The first case of that id by rank; no row if there is none."""
    return cases.where(F.col("case_id") == case_id).orderBy("rank").limit(1)


def health(events: DataFrame | None, results: DataFrame | None, model=None) -> DataFrame:
    """One row: whether events, results and a model are at hand, the number of events, and whether all that requests need is ready."""
    some = events if events is not None else results
    if some is None:
        raise ValueError("nothing to report on")
    n = events.count() if events is not None else 0
    has = results is not None and not results.isEmpty()
    return some.sparkSession.range(1).select(F.lit("ok").alias("status"), F.lit(n).cast("long").alias("events"), F.lit(has).alias("results"), F.lit(model is not None).alias("model"), F.lit(events is not None and has).alias("ready"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Of each case the decision with the greatest id."""
    rest = F.struct(*decisions.columns)
    return decisions.groupBy("case_id").agg(F.max_by(rest, "id").alias("d")).select("d.*")


def latest_analysis(analysis: DataFrame) -> DataFrame:
    """The last analysis of each event wins."""
    return analysis.groupBy("event_id").agg(F.max_by(F.struct(*analysis.columns), "analysed_at").alias("a")).select("a.*")


def record_decision(spark: SparkSession, path: str, case_id: str, decision: str, reviewer: str = "unattributed", note: str = "", drafted: str | None = None, evidence: str | None = None) -> None:
    """Append one decision; nothing is ever changed. Ids order decisions by time."""
    import datetime
    import time

    if decision not in VERBS:
        raise ValueError(f"decision must be one of {VERBS}")
    if not case_id:
        raise ValueError("a case is required")
    row = (time.time_ns(), case_id, datetime.datetime.now(datetime.timezone.utc), decision, (reviewer or "").strip() or "unattributed", note, drafted, evidence)
    spark.createDataFrame([row], DISPOSITIONS).coalesce(1).write.mode("append").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON document of a one-row table of nested structs."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores keyed by TransactionID, a folder to each variant."""
    scores.write.mode("overwrite").partitionBy("variant").parquet(path)
