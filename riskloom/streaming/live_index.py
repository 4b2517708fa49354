"""Payers and what links them, on shared state that grows with every batch of payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.entity import CAP
from ..operators.live import ATTRIBUTES, described, payer_links
from ..scratch import Scratch
from .buckets import Store


class LiveIndex:
    """The hub-suppressed graph over payers, analysed near the payers of each batch.

    Links are kept twice, in buckets by payer and by attribute value, so both steps of the
    search, from payers to values and from values to their holders, read only the buckets
    they reach. All holders of a value lie in one bucket: the cap is applied to what is read,
    and a value that passes it stops linking from that batch on. ``path`` names a folder on
    shared storage; the state there outlives the process.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, attributes: tuple[str, ...] = ATTRIBUTES, cap: int = CAP, buckets: int = 64):
        self.spark, self.s, self.attributes, self.cap, self.n = spark, Scratch(spark, "live"), attributes, cap, 0
        self.store = Store(spark, path or self.s.path("state"), {"payers": "uid string", "held": "uid string, mark string", "holders": "mark string, uid string"}, buckets)

    def _table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.s.table(df, f"t{self.n}")

    def take(self, events: DataFrame, number: int | None = None) -> DataFrame | None:
        """Takes a batch (payer_key and the attributes) and returns the analysis of its payers, as of now; None without payers.

        ``number``: of the batch in its stream; one that was committed before is analysed again and adds nothing.
        """
        self.store.forget()
        payers = self._table(events.where("payer_key is not null").select(F.col("payer_key").alias("uid")).distinct())
        if payers.isEmpty():
            return None
        if number is None or number > self.store.number:
            own = self.store.buckets_of(payers)
            self.store.append("payers", payers.join(self.store.read("payers", own), "uid", "left_anti"))
            links = payer_links(events, self.attributes).select("uid", F.concat_ws("|", "key_name", "value").alias("mark"))
            new = self._table(links.join(self.store.read("held", own), ["uid", "mark"], "left_anti"))
            if not new.isEmpty():
                self.store.append("held", new)
                self.store.append("holders", new.select("mark", "uid"))
            self.store.commit(number)
        return self.near(payers)

    def near(self, payers: DataFrame) -> DataFrame:
        """As live.analyse_all(), of some payers (uid), from their own components alone."""
        seen, front, found = payers, payers, None
        known = self._table(self.spark.createDataFrame([], "mark string"))
        while not front.isEmpty():
            marks = front.join(self.store.read("held", self.store.buckets_of(front)), "uid").select("mark").distinct()
            marks = self._table(marks.join(known, "mark", "left_anti"))
            known = known.union(marks)
            holders = self._table(marks.join(self.store.read("holders", self.store.buckets_of(marks)), "mark"))
            fit = holders.groupBy("mark").count().where(F.col("count").between(2, self.cap)).select("mark")
            edges = self._table(holders.join(fit, "mark", "left_semi"))
            found = edges if found is None else found.union(edges)
            front = self._table(edges.select("uid").distinct().join(seen, "uid", "left_anti"))
            seen = seen.union(front)
        seen = self._table(seen)
        key = F.substring_index("mark", "|", 1)
        edges = self._table(found.select("uid", key.alias("key_name"), F.expr("substring(mark, instr(mark, '|') + 1)").alias("value")))
        return described(seen, edges).join(payers.withColumnRenamed("uid", "payer_key"), "payer_key", "left_semi")

    def total(self) -> int:
        """Payers taken so far."""
        return self.store.read("payers").count()
