"""Decisions on cases, in numbered batches that count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ids import numbered
from ..scratch import Scratch
from ..sources.tables import VERBS
from .buckets import Store

COLUMNS = {"case_id": "string", "id": "long", "decided_at": "timestamp", "decision": "string", "reviewer": "string", "note": "string", "drafted": "string", "evidence_seen": "string"}


class DecisionLog:
    """An append-only log of decisions whose ids rise without gaps, whoever writes.

    A batch is there as a whole or not at all; one that is sent again under its number adds
    nothing, and of two writers of one number the later fails and has written nothing. So the
    greatest id of a case is its latest decision, without any clock.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.s = spark, Scratch(spark, "decisions")
        schema = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
        self.store = Store(spark, path or self.s.path("log"), {"decisions": schema, "sizes": "number long, n long"}, buckets)

    def record(self, rows: DataFrame, order: list[str | Column], number: int | None = None) -> int:
        """Takes decisions (case_id, decision and what else a decision has) in the given order; returns how many were added.

        A row without a case, or whose decision is none, fails the batch. An empty reviewer is "unattributed".
        """
        if number is not None and number <= self.store.number:
            return 0
        self.store.forget()
        sound = F.col("case_id").isNotNull() & (F.col("case_id") != "") & F.col("decision").isin(*VERBS)
        checked = rows.where(F.assert_true(F.coalesce(sound, F.lit(False)), f"a case and a decision of {VERBS} are required").isNull())
        reviewer = F.trim(F.col("reviewer")) if "reviewer" in rows.columns else F.lit(None).cast("string")
        have = {c: F.col(c) if c in rows.columns else F.lit(None) for c in COLUMNS} | {
            "reviewer": F.coalesce(F.nullif(reviewer, F.lit("")), F.lit("unattributed")), "decided_at": F.coalesce(F.col("decided_at"), F.current_timestamp()) if "decided_at" in rows.columns else F.current_timestamp(), "id": F.lit(None)}
        start = self.store.read("sizes").agg(F.sum("n")).first()[0] or 0
        given = numbered(checked, order, "_id", start + 1)
        new = self.s.table(given.select(*[(F.col("_id") if c == "id" else have[c]).cast(k).alias(c) for c, k in COLUMNS.items()]), f"new{self.store.number + 1}-{start}")
        n = new.count()
        if n:
            self.store.append("decisions", new)
            self.store.append("sizes", self.spark.createDataFrame([(self.store.number + 1, n)], "number long, n long"))
        self.store.commit(number)
        return n

    def rows(self, case_ids: DataFrame | None = None) -> DataFrame:
        """All decisions, or those on some cases (case_id), from the buckets they lie in."""
        if case_ids is None:
            return self.store.read("decisions")
        return self.store.read("decisions", self.store.buckets_of(case_ids)).join(case_ids, "case_id", "left_semi")
