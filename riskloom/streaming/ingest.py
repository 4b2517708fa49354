"""Streams of signed payment events: exact ingest and analysis per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import verify_signature
from ..sources.tables import extract_event, payment_json
from .live_index import LiveIndex


#: What may become of a delivery. Fixed values.
ACCEPTED, BAD_SIGNATURE, MALFORMED, NO_ID = "accepted", "bad signature", "malformed payload", "missing event id"


def judged(raw: DataFrame, secret: bytes) -> DataFrame:
    """event_id, event_type, received_at, body, status of deliveries, in the order of the checks: signature, payload, id.

    The signature is held against the bytes as they came: ``body64`` in base64 or, where that is null, ``body`` in UTF-8, so a
    payload that was parsed and written anew fails. A payload is an object in valid UTF-8, or its body is null. An empty
    id counts as missing. The type is the delivery's or else the payload's, ``unknown`` without either.
    """
    plain = F.encode("body", "UTF-8")
    got = F.when(F.col("body64").isNull(), plain).otherwise(F.try_to_binary("body64", F.lit("base64"))) if "body64" in raw.columns else plain
    text = F.col("_bytes").cast("string")
    payload = F.when(F.is_valid_utf8(text), text)
    payload = F.when(F.json_object_keys(payload).isNotNull(), payload)
    status = F.when(~verify_signature(F.col("_bytes"), F.col("signature"), secret), BAD_SIGNATURE).when(F.col("_body").isNull(), MALFORMED).when(
        F.coalesce(F.trim("event_id"), F.lit("")) == "", NO_ID).otherwise(ACCEPTED)
    return raw.withColumn("_bytes", got).withColumn("_body", payload).select(
        "event_id", F.coalesce("event_type", F.get_json_object("_body", "$.event"), F.lit("unknown")).alias("event_type"), "received_at", F.col("_body").alias("body"), status.alias("status"))


def signed_events(spark: SparkSession, folder: str, secret: bytes) -> DataFrame:
    """A stream of JSON lines (event_id, signature, body or body64) with only what judged() accepts."""
    raw = spark.readStream.schema("event_id string, event_type string, received_at timestamp, signature string, body string, body64 string").json(folder)
    return judged(raw, secret).where(F.col("status") == ACCEPTED).drop("status")


def deduplicated(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each event_id once: exact with state for every id, or within a watermark with bounded state."""
    if watermark is None:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["event_id"])


def store(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append once-only events to a table; ends when what is there has been read."""
    return deduplicated(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def analyse_batches(events: DataFrame, state: str, out: str, checkpoint: str) -> StreamingQuery:
    """Per batch of payment events: add what links their payers to the state, analyse the components of the payers, write their rows.

    The state is bucketed, so a batch costs what it touches, whatever came before. A batch
    that runs again is known by its number, adds nothing and overwrites its own folder. A
    batch without payments writes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = batch.where(F.col("event_type").startswith("payment.")).select(extract_event(payment_json(F.col("body")), F.col("event_id")).alias("e")).select("e.*")
        rows = LiveIndex(batch.sparkSession, state).take(own, number)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return deduplicated(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
