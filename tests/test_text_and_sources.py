import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.plans import catalogue
from riskloom.sources import tables
from riskloom.streaming import ingest


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_numbers(spark):
    assert one(spark, text.extract_numbers, "1,200.00 and 1200, 0.50 7.", None) == [["0.5", "1200", "7"], []]


def test_indian_grouping(spark):
    assert one(spark, text.indian_grouping, "1234567", "-999", "100000", "12", None) == ["12,34,567", "-999", "1,00,000", "12", "-"]


def test_to_paise(spark):
    assert one(spark, text.to_paise, "10.005", "0.1", "-2.675", None) == [1001, 10, -268, None]


def test_hmac(spark):
    want = hmac.new(b"k" * 80, b"body", hashlib.sha256).hexdigest()
    assert one(spark, lambda c: text.hmac_sha256(c, b"k" * 80), "body") == [want]
    assert one(spark, lambda c: text.verify_signature(F.lit("body"), c, b"k" * 80), want, "0" * 64, None) == [True, False, False]
    with pytest.raises(ValueError):
        text.verify_signature(F.lit("a"), F.lit("b"), b"")


GOOD = {"probable_cause": "UNEXPLAINED", "confidence": "low", "human_summary": "3 entities", "suggested_action": "look"}


def test_rejections(spark):
    allowed = F.array(*[F.lit(str(i)) for i in range(11)])
    cases = [json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", "[1]", "nope", json.dumps(GOOD | {"confidence": 3}), json.dumps(GOOD | {"human_summary": "99 seen"}), json.dumps(GOOD | {"human_summary": "x" * 1300})]
    assert one(spark, lambda c: text.rejection(c, allowed), *cases) == [None, None, "not a JSON object", "not valid JSON", "field is not a string: confidence", "invented number: 99", "human_summary is too long"]


def test_disposition(spark):
    allowed = F.array(*[F.lit(str(i)) for i in range(11)])
    good = {"recommendation": "dismiss", "confidence": "high", "rationale": "few", "key_factors": ["a"]}
    cases = [json.dumps(x) for x in (good, good | {"key_factors": ["a"] * 7}, good | {"key_factors": [1]}, good | {"rationale": 3}, good | {"key_factors": ["seen 55"]}, good | {"recommendation": "x"})]
    assert one(spark, lambda c: text.disposition_rejection(c, allowed), *cases) == [None, "too many key_factors", "a key_factor is empty", "rationale is empty", "invented number: 55", "recommendation is not allowed"]


def test_segments_join_back(spark):
    row = {c: 12 if c == "entity_count" else 1 for c in text.INTEGERS} | {c: 0.5 for c in text.DECIMALS} | {"total_amount_inr": 1234.5, "shared_attributes": ["card1"], "text": "12 entities, 1,234.50 on card1; 112 no"}
    got = text.annotate(spark.createDataFrame([row])).first().segments
    assert "".join(s.text for s in got) == row["text"]
    assert [(s.text, s.field, s.target) for s in got if s.field] == [("12", "entity_count", "entities"), ("1,234.50", "total_amount_inr", "all"), ("card1", "attribute:card1", "attr:card1")]


def test_payments(spark):
    bodies = ['{"payload":{"payment":{"entity":{"id":"p1","email":"A@B.com","card":{"last4":"1234","network":"Visa","issuer":""}}}}}', '{"payment":{"entity":{"id":"p2"}}}', '{"id":"p3","contact":" 5 "}', '{"other":1}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select(tables.payment_json(F.col("b")).alias("p"))
    got = df.select(F.col("p").isNotNull().alias("ok"), tables.extract_event(F.col("p"), F.lit("ev")).alias("e")).collect()
    assert [r.ok for r in got] == [True, True, True, False]
    assert [r.e.payer_key for r in got] == ["a@b.com", "p2", "5", "ev"]
    assert (got[0].e.card_fingerprint, got[0].e.email_domain) == ("1234|visa", "b.com")


def test_merged_tables_and_cache(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,TransactionAmt\n1,2.5\n2,3.5\n")
    (tmp_path / "i.csv").write_text("TransactionID,DeviceType\n2,mobile\n")
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        df = tables.load_merged(spark, f"file://{tmp_path}/t.csv", f"file://{tmp_path}/i.csv", cache)
        assert sorted((r.TransactionID, r.DeviceType) for r in df.collect()) == [(1, None), (2, "mobile")]


def test_observed_graph(spark, tmp_path):
    (tmp_path / "c.csv").write_text("txId,class\n1,1\n2,2\n3,unknown\n")
    (tmp_path / "e.csv").write_text("txId1,txId2\n1,2\n2,2\n1,9\n3,1\n")
    labels, edges = tables.load_observed_graph(spark, f"file://{tmp_path}/c.csv", f"file://{tmp_path}/e.csv", (3, 4))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (3, 1)]
    assert labels.where(tables.is_labelled(F.col("class"))).count() == 2


def test_decisions_are_appended(spark, tmp_path):
    path = f"file://{tmp_path}/decisions"
    tables.record_decision(spark, path, "case-1", "approved", " ")
    tables.record_decision(spark, path, "case-1", "rejected", "me")
    df = spark.read.parquet(path)
    assert df.count() == 2 and tables.latest_decisions(df).first().decision == "rejected"
    assert df.where("reviewer = 'unattributed'").count() == 1
    with pytest.raises(ValueError):
        tables.record_decision(spark, path, "c", "maybe")
    with pytest.raises(ValueError):
        tables.record_decision(spark, path, "", "approved")
    assert [r.decision for r in tables.audit_trail(df, "case-1", 1).collect()] == ["rejected"] and tables.audit_trail(df, "none").count() == 0


def test_stored_payments_and_lookups(spark):
    rows = [("b", "payment.captured", 2, '{"payload":{"payment":{"entity":{"id":"p2"}}}}'), ("a", "payment.captured", 1, '{"payload":{"payment":{"entity":{"id":"p1"}}}}'), ("c", "x", 3, '{"payload":{}}'), ("d", "x", 4, None)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, received_at int, payload string")
    assert [r.event_id for r in tables.all_payments(events).collect()] == ["a", "b"] and tables.event_count(events).first().n == 4
    analysis = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "event_id string, analysed_at int, structural string")
    assert tables.get_analysis(analysis, "a").first().structural == "new" and tables.get_analysis(analysis, "z").count() == 0
    r = tables.health(events, None).first()
    assert (r.events, r.results, r.ready) == (4, False, False)


def test_numbers_take_the_smallest_type(spark):
    df = tables.downcast(spark.createDataFrame([(1, 300, 1 << 40, 2.5, "x"), (-5, None, 0, None, None)], "a long, b long, c long, d double, e string"))
    assert [k for _, k in df.dtypes] == ["tinyint", "smallint", "bigint", "float", "string"] and tuple(df.first()) == (1, 300, 1 << 40, 2.5, "x")
    assert dict(tables.downcast(df.withColumn("d", F.col("d").cast("double")), floats=False).dtypes)["d"] == "double"


def test_completions_are_asked_once_and_kept(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def broken(prompt):
        (log / f"broken{len(list(log.iterdir()))}").write_text(prompt)
        raise OSError("down")

    def works(prompt):
        (log / f"works{len(list(log.iterdir()))}").write_text(prompt)
        return json.dumps(GOOD | {"human_summary": "77 seen" if prompt == "bad" else "ok" if "refused" in prompt else "3"})

    df = spark.createDataFrame([("one",), ("one",), ("bad",), (None,)], "prompt string").coalesce(1).withColumn("allowed", F.array(*[F.lit(str(i)) for i in range(11)]))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = text.narrate(df, [broken, works], cache).collect()
        assert sorted((r.prompt or "-", r.accepted) for r in got) == [("-", False), ("bad", True), ("one", True), ("one", True)]
        # three prompts, each two tries of the first provider and one of the second
        assert len(list(log.iterdir())) == 9
    assert text.narrate(df, broken, f"file://{tmp_path}/other", fallback="none").where("narrative = 'none' and not accepted").count() == 4


def test_case_facts(spark):
    row = {c: 3 for c in text.INTEGERS} | {c: 0.5 for c in text.DECIMALS} | {"shared_attributes": ["card1"], "case_id": "case-3", "rank": 1, "total_flagged_clusters": 2, "risk_percentile": 50.0,
           "entities_in_other_clusters": 0, "transactions_per_entity": 1.5, "flagged_share": 0.25, "population_mean_risk": 0.125, "corroborating": "a; b", "contradicting": ""}
    lines = spark.createDataFrame([row]).select(text.case_facts()).first()[0].split("\n")
    assert lines[0] == "case_id: case-3" and lines[-3:] == ["findings_supporting_concern:", "  - a", "  - b"] and "risk_percentile: 50.00" in lines


def test_results_document(spark, tmp_path):
    tables.write_results(spark.createDataFrame([(1, [2.5])], "a long, b array<double>"), f"file://{tmp_path}/r")
    assert tables.load_results(spark, f"file://{tmp_path}/r").first().a == 1


def test_stream_takes_each_signed_event_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = json.dumps({"payload": {"payment": {"entity": {"id": "p", "email": "a@b.c"}}}})
    sign = hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    row = lambda i, g=sign: json.dumps({"event_id": i, "event_type": "payment.captured", "received_at": "2024-01-01T00:00:00Z", "signature": g, "body": body})
    (tmp_path / "in" / "1.json").write_text("\n".join([row("e1"), row("e1"), row("e2", "bad"), row("e3")]))
    base = f"file://{tmp_path}"
    ingest.store(ingest.signed_events(spark, f"{base}/in", b"s"), f"{base}/events", f"{base}/c1").awaitTermination(60)
    assert sorted(r.event_id for r in spark.read.parquet(f"{base}/events").collect()) == ["e1", "e3"]
    ingest.analyse_batches(ingest.signed_events(spark, f"{base}/in", b"s"), f"{base}/history", f"{base}/analysis", f"{base}/c2").awaitTermination(60)
    assert [r.payer_key for r in spark.read.parquet(f"{base}/analysis").collect()] == ["a@b.c"]
    # a second batch: a payer who shares a card with the first, one apart, and an event that is no payment
    def more(i, mail, kind="payment.captured"):
        b = json.dumps({"payload": {"payment": {"entity": {"id": i, "email": mail, "contact": "77" if i != "p9" else "88"}}}})
        return json.dumps({"event_id": i, "event_type": kind, "received_at": "2024-01-02T00:00:00Z", "signature": hmac.new(b"s", b.encode(), hashlib.sha256).hexdigest(), "body": b})
    (tmp_path / "in" / "2.json").write_text("\n".join([more("p7", "x@b.c"), more("p8", "y@z.c"), more("p9", "q@q.q"), more("p10", "no@no.no", "refund.created")]))
    ingest.analyse_batches(ingest.signed_events(spark, f"{base}/in", b"s"), f"{base}/history", f"{base}/analysis", f"{base}/c2").awaitTermination(60)
    got = {r.payer_key: r for r in spark.read.parquet(f"{base}/analysis").where("batch = 1").collect()}
    assert set(got) == {"x@b.c", "y@z.c", "q@q.q"} and got["x@b.c"].linked_payers == ["a@b.c", "y@z.c"] and got["y@z.c"].component_size == 3 and got["q@q.q"].component_size == 1


def test_figures_are_shown_as_printf_rounds_them(spark):
    row = {c: 1 for c in text.INTEGERS} | {c: 0.5 for c in text.DECIMALS} | {"shared_attributes": ["card1"], "case_id": "case-0", "rank": 1, "total_flagged_clusters": 2, "risk_percentile": 0.125,
           "entities_in_other_clusters": 0, "transactions_per_entity": 2.125, "flagged_share": 0.375, "population_mean_risk": 0.03125, "corroborating": "", "contradicting": ""}
    lines = spark.createDataFrame([row]).select(text.case_facts()).first()[0].split("\n")
    assert {"risk_percentile: 0.12", "transactions_per_entity: 2.12", "share_of_transactions_flagged: 0.38", "population_mean_risk_score: 0.0312"} <= set(lines)
    got = spark.createDataFrame([(1.625,), (2.675,), (-0.001,), (None,)], "x double").select(text.fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == ["1.62", "2.67", "-0.00", None]


def test_every_section_of_the_document(spark, sf):
    """Sections hold what the queries of their parts give."""
    doc = json.loads(catalogue.results_document(spark, sf).first().document)
    assert set(doc) == {"dataset", "report", "operating_points", "sweep", "calibration", "concentration", "ablation", "ring_evidence", "graph", "linked", "drift", "clusters", "findings", "cluster_outcomes", "narratives", "assumptions"}
    assert {x["name"] for x in doc["calibration"]} == {"base", "variant"} and {(x["name"], x["measure"]) for x in doc["ablation"]} == {(a, b) for a in "sv" for b in ("count", "value", "vdr")}
    assert {x["cluster_id"] for x in doc["clusters"]} == {x["cluster_id"] for x in doc["cluster_outcomes"]} and len(doc["findings"]) == len(doc["clusters"]) == len(doc["narratives"]) > 0
    assert all(len(doc[x]) == 1 for x in ("dataset", "ring_evidence", "graph", "linked", "concentration", "assumptions"))
    want = catalogue.ring_permutation_hash(spark, sf).first().asDict()
    assert doc["ring_evidence"][0] == {k: v for k, v in want.items() if v is not None}


def test_deliveries_are_judged_by_their_bytes(spark):
    sign = lambda b: hmac.new(b"s", b, hashlib.sha256).hexdigest()
    good, bad = b'{"event": "payment.captured",  "id": 1}', b'{"event": "\xff"}'
    b64 = lambda b: base64.b64encode(b).decode()
    rows = [("1", None, sign(good), None, b64(good)), ("2", "own", sign(good), good.decode(), None), ("3", None, sign(good), json.dumps(json.loads(good)), None), ("4", None, sign(bad), None, b64(bad)),
            (None, None, sign(good), None, b64(good)), (" ", None, sign(good), None, b64(good)), ("7", None, sign(b"[1]"), "[1]", None), ("8", None, None, None, None), ("9", None, sign(good), None, "%%"), ("10", None, sign(b"{}"), "{}", None)]
    raw = spark.createDataFrame(rows, "event_id string, event_type string, signature string, body string, body64 string").withColumn("received_at", F.lit(None).cast("timestamp"))
    got = [(r.status, r.event_type) for r in ingest.judged(raw, b"s").collect()]
    assert got == [(ingest.ACCEPTED, "payment.captured"), (ingest.ACCEPTED, "own"), (ingest.BAD_SIGNATURE, "payment.captured"), (ingest.MALFORMED, "unknown"), (ingest.NO_ID, "payment.captured"), (ingest.NO_ID, "payment.captured"),
                   (ingest.MALFORMED, "unknown"), (ingest.BAD_SIGNATURE, "unknown"), (ingest.BAD_SIGNATURE, "unknown"), (ingest.ACCEPTED, "unknown")]


def test_payments_are_spread_and_parsed_once(spark, sf):
    """The customers of one file are dealt over tasks, and no field parses the event anew."""
    from riskloom.plans import catalogue

    assert catalogue.payments(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = catalogue.payer_extract(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.payload.payment.entity") == 1
