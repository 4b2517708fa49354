"""Live entities: the graph over payers of stored payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .entity import CAP, suppressed_edges
from .graph import LOCAL, graph_features

#: Fixed values.
ATTRIBUTES = ("card_fingerprint", "email_domain", "contact", "vpa")


def payer_links(events: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(uid, key_name, value) of payers and what they were seen with; nulls link nothing."""
    rows = F.array(*[F.struct(F.lit(a).alias("key_name"), F.col(a).cast("string").alias("value")) for a in attributes])
    return events.select(F.col("payer_key").alias("uid"), F.explode(rows).alias("l")).select("uid", "l.key_name", "l.value").where("uid is not null and value is not null").distinct()


def analyse_all(events: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, cap: int = CAP, local: int = LOCAL) -> DataFrame:
    """Per payer: component size, core number, degree, payers linked directly and the attributes that link them."""
    payers = events.where("payer_key is not null").select(F.col("payer_key").alias("uid")).distinct()
    return described(payers, suppressed_edges(payer_links(events, attributes), cap), local)


def described(payers: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """As analyse_all(), of payers (uid) and their links that hub suppression has left."""
    both = edges.join(edges.withColumnRenamed("uid", "other"), ["key_name", "value"]).where("uid <> other")  # groups hold at most the cap
    near = both.groupBy("uid").agg(F.array_sort(F.collect_set("other")).alias("linked_payers"), F.array_sort(F.collect_set("key_name")).alias("shared_attributes"))
    empty = F.array().cast("array<string>")
    return graph_features(payers, edges, local).join(near, "uid", "left").select(
        F.col("uid").alias("payer_key"), F.col("g_component_size").alias("component_size"), F.col("g_core_number").alias("core_number"), F.col("g_degree").alias("degree"),
        F.coalesce("linked_payers", empty).alias("linked_payers"), F.coalesce("shared_attributes", empty).alias("shared_attributes"))


def analyse_near(events: DataFrame, payers: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, cap: int = CAP, local: int = LOCAL) -> DataFrame:
    """The rows of analyse_all() of some payers (payer_key), from their own components alone.

    Groups are counted over all events, as hub suppression needs; then links are followed
    outwards from the payers, a join a step, and only what is reached is analysed.
    """
    s = Scratch(events.sparkSession, "near")
    edges = s.table(suppressed_edges(payer_links(events, attributes), cap), "edges")
    asked = s.table(payers.where("payer_key is not null").select(F.col("payer_key").alias("uid")).distinct(), "asked")
    reached, front, step = asked, asked, 0
    while not front.isEmpty():
        groups = edges.join(front, "uid", "left_semi").select("key_name", "value").distinct()
        front = s.table(edges.join(groups, ["key_name", "value"], "left_semi").select("uid").distinct().join(reached, "uid", "left_anti"), f"front{step}")
        reached, step = s.table(reached.union(front), f"reached{step}"), step + 1
    return described(reached, edges.join(reached, "uid", "left_semi"), local).join(asked.withColumnRenamed("uid", "payer_key"), "payer_key", "left_semi")


def analyse(events: DataFrame, target: str, **options) -> DataFrame:
    """The row of one payer, with the number of all payers."""
    total = events.where("payer_key is not null").select("payer_key").distinct().count()
    return analyse_all(events, **options).where(F.col("payer_key") == target).withColumn("total_entities", F.lit(total))
