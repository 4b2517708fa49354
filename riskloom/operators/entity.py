"""Entities by fingerprint and the hub-suppressed bipartite entity-attribute graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .split import ID, TIME

CAP = 5
#: Attribute combinations that link entities. Fixed values.
LINK_KEYS = {
    "card1": ("card1",),
    "addr1_pemail": ("addr1", "P_emaildomain"),
    "card3_card5_addr1": ("card3", "card5", "addr1"),
    "card1_card3_card5": ("card1", "card3", "card5"),
}


def build_uid(df: DataFrame) -> DataFrame:
    """Adds uid = card1_addr1_(start day); null if a part is null. The start day may be negative and must be whole."""
    whole = F.col("D1").isNull() | (F.col("D1") == F.floor("D1"))
    d1 = F.when(F.assert_true(whole, "D1 is not whole").isNull(), F.col("D1"))
    start = F.floor(F.col(TIME) / 86400) - d1
    parts = [F.col("card1"), F.col("addr1"), start]
    sound = F.lit(True)
    for p in parts:
        sound &= p.isNotNull()
    return df.withColumn("uid", F.when(sound, F.concat_ws("_", *[p.cast("long").cast("string") for p in parts])))


def entity_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per uid and column on its own, the earliest value that is not null (ties by id)."""
    when = F.struct(F.col(TIME), F.col(ID))
    return df.where("uid is not null").groupBy("uid").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns])


def links_long(entities: DataFrame, link_keys: dict[str, tuple[str, ...]] = LINK_KEYS) -> DataFrame:
    """(uid, key_name, value): one row per entity and key; parts joined by ``|``, no row if a part is null."""
    rows = [F.struct(F.lit(k).alias("key_name"), F.concat(*[x for i, c in enumerate(parts) for x in ([F.lit("|")] if i else []) + [F.col(c).cast("string")]]).alias("value"))
            for k, parts in link_keys.items()]
    return entities.select("uid", F.explode(F.array(*rows)).alias("l")).select("uid", "l.key_name", "l.value").where("value is not null").distinct()


def attribute_groups(links: DataFrame) -> DataFrame:
    return links.groupBy("key_name", "value").agg(F.count("*").alias("members"))


def suppressed_edges(links: DataFrame, cap: int = CAP) -> DataFrame:
    """Links of values held by 2 to ``cap`` entities. The cap is applied before anything expands, so it bounds skew too."""
    kept = attribute_groups(links).where(F.col("members").between(2, cap)).select("key_name", "value")
    return links.join(kept, ["key_name", "value"], "left_semi").select("uid", "key_name", "value")


def hub_drops(links: DataFrame, cap: int = CAP) -> DataFrame:
    return attribute_groups(links).where(F.col("members") > cap).agg(
        F.count("*").alias("dropped_hub_values"), F.coalesce(F.sum("members"), F.lit(0)).alias("dropped_hub_members"))


def coverage(rows: DataFrame, entities: DataFrame, link_keys: dict[str, tuple[str, ...]], caps: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """cap, n_edges, linked entities and share of ``rows`` on linked entities, all caps in one pass over the links."""
    links = links_long(entities, link_keys)
    sized = links.join(attribute_groups(links).where(f"members between 2 and {max(caps)}"), ["key_name", "value"])
    per = sized.groupBy("uid").agg(*[F.count_if(F.col("members") <= c).alias(f"d{c}") for c in caps])
    whole = per.agg(*[F.sum(f"d{c}").alias(f"e{c}") for c in caps], *[F.count_if(F.col(f"d{c}") > 0).alias(f"l{c}") for c in caps])
    covered = rows.join(per, "uid", "left").agg(*[F.avg(F.when(F.col(f"d{c}") > 0, 1.0).otherwise(0.0)).alias(f"s{c}") for c in caps])
    one = whole.crossJoin(F.broadcast(covered))  # one row by one row
    stacked = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"e{c}").alias("n_edges"), F.col(f"l{c}").alias("linked_entities"), F.round(f"s{c}", 6).alias("row_coverage")) for c in caps])
    return one.select(F.explode(stacked).alias("x")).select("x.*")
