"""Text services: numbers in prose and what may be quoted, narrative checks, money, signatures, tracing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import Scratch

#: Fixed values.
NUMBER = r"\d[\d,]*\.?\d*"
PROBABLE_CAUSES = ("CARD_TESTING", "COORDINATED_RING", "SHARED_CREDENTIAL_REUSE", "SYNTHETIC_IDENTITY", "BENIGN_COINCIDENCE", "UNEXPLAINED")
CONFIDENCE = ("high", "medium", "low")
DISPOSITIONS = ("confirm", "dismiss", "escalate")
NARRATIVE = ("probable_cause", "confidence", "human_summary", "suggested_action")
DISPOSITION = ("recommendation", "confidence", "rationale", "key_factors")
SUMMARY_CHARS, ACTION_CHARS, RATIONALE_CHARS, FACTOR_CHARS, FACTORS = 1200, 300, 1500, 160, 6
INTEGERS = ("cluster_id", "entity_count", "transaction_count", "flagged_transaction_count", "component_size", "core_number", "max_degree", "distinct_cards", "distinct_addresses", "distinct_email_domains", "span_days")
DECIMALS = ("total_amount_inr", "max_risk_score", "mean_risk_score")


def normalise_number(token: Column) -> Column:
    """Without commas; without trailing zeros and point where there is a point; nothing left is 0."""
    bare = F.replace(token, F.lit(","), F.lit(""))
    cut = F.when(F.contains(bare, F.lit(".")), F.rtrim(F.rtrim(bare, F.lit("0")), F.lit("."))).otherwise(bare)
    return F.when(cut == "", "0").otherwise(cut)


def extract_numbers(text: Column) -> Column:
    """Distinct normalised numbers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), normalise_number)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def renderings(values: pd.Series) -> pd.Series:
    """A number as prose may show it. The binary value decides the rounding, which format_string's decimal one does not."""
    return values.map(lambda x: [] if x != x else [repr(float(x)), str(int(x)), *[f"{x:.{k}f}" for k in (4, 2, 1, 0)]])


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals as printf shows it: its binary value decides the rounding, halves go to even. Null stays null."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda x: f"{x:.{places}f}")

    return F.when(value.isNotNull(), shown(value.cast("double")))


def allowed_numbers(case: bool = False) -> Column:
    """Every rendering of a cluster's figures that prose may quote, and 0 to 10; of a case also its own figures and those in its findings.

    Decimals have at most four places, so the rendering with four adds no other number.
    """
    whole = INTEGERS + (("rank", "total_flagged_clusters", "entities_in_other_clusters") if case else ())
    decimals = DECIMALS + (("risk_percentile", "transactions_per_entity", "flagged_share", "population_mean_risk") if case else ())
    parts = [F.array(*[F.lit(str(n)) for n in range(11)], *[F.col(c).cast("long").cast("string") for c in whole]), *[renderings(F.col(c).cast("double")) for c in decimals]]
    if case:
        parts += [extract_numbers(F.col(c)) for c in ("corroborating", "contradicting")]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*parts)), normalise_number)))


def invented_numbers(text: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(extract_numbers(text), allowed))


def strip_code_fence(raw: Column) -> Column:
    """Without the leading and trailing fence lines, if the text starts with one."""
    t = F.trim(raw)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(t)


def rejection(raw: Column, allowed: Column) -> Column:
    """Why a narrative is refused, the first failure in a fixed order; null if it is accepted."""
    t = strip_code_fence(raw)
    keys = F.json_object_keys(t)
    field = lambda k: F.get_json_object(t, f"$.{k}")
    needed = F.array(*[F.lit(k) for k in NARRATIVE])
    kinds = F.try_parse_json(t)
    string = lambda k: F.schema_of_variant(F.try_variant_get(kinds, f"$.{k}", "variant")) == "STRING"
    missing = F.array_except(needed, keys)
    extra = F.array_sort(F.array_except(keys, needed))
    summary, action = F.trim(field("human_summary")), F.trim(field("suggested_action"))
    used = F.array_sort(F.array_except(F.array_union(extract_numbers(summary), extract_numbers(action)), allowed))
    ladder = F.when(kinds.isNull(), "not valid JSON").when(keys.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing field: "), F.array_join(missing, ", "))).when(
        F.size(extra) > 0, F.concat(F.lit("unexpected field: "), F.array_join(extra, ", ")))
    for k in NARRATIVE:
        ladder = ladder.when(~F.coalesce(string(k), F.lit(False)), f"field is not a string: {k}")
    return ladder.when(~field("probable_cause").isin(*PROBABLE_CAUSES), "probable_cause is not allowed").when(~field("confidence").isin(*CONFIDENCE), "confidence is not allowed").when(
        summary == "", "human_summary is empty").when(action == "", "suggested_action is empty").when(F.length(summary) > SUMMARY_CHARS, "human_summary is too long").when(
        F.length(action) > ACTION_CHARS, "suggested_action is too long").when(F.size(used) > 0, F.concat(F.lit("invented number: "), F.array_join(used, ", ")))


def disposition_rejection(raw: Column, allowed: Column) -> Column:
    """As rejection(), for a drafted disposition."""
    t = strip_code_fence(raw)
    keys, kinds = F.json_object_keys(t), F.try_parse_json(t)
    needed = F.array(*[F.lit(k) for k in DISPOSITION])
    missing, extra = F.array_except(needed, keys), F.array_sort(F.array_except(keys, needed))
    rationale = F.trim(F.try_variant_get(kinds, "$.rationale", "string"))
    text = F.schema_of_variant(F.try_variant_get(kinds, "$.rationale", "variant")) == "STRING"
    list_kind = F.schema_of_variant(F.try_variant_get(kinds, "$.key_factors", "variant"))
    factors = F.try_variant_get(kinds, "$.key_factors", "array<string>")
    used = F.array_sort(F.array_distinct(F.array_except(F.flatten(F.transform(F.concat(F.array(rationale), factors), extract_numbers)), allowed)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(kinds.isNull(), "not valid JSON").when(keys.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing field: "), F.array_join(missing, ", "))).when(
        F.size(extra) > 0, F.concat(F.lit("unexpected field: "), F.array_join(extra, ", "))).when(
        no(F.get_json_object(t, "$.recommendation").isin(*DISPOSITIONS)), "recommendation is not allowed").when(no(F.get_json_object(t, "$.confidence").isin(*CONFIDENCE)), "confidence is not allowed").when(
        no(text & (rationale != "")), "rationale is empty").when(F.length(rationale) > RATIONALE_CHARS, "rationale is too long").when(
        no((F.substring(list_kind, 1, 5) == "ARRAY") & (F.size(factors) > 0)), "key_factors is empty").when(F.size(factors) > FACTORS, "too many key_factors").when(
        no((list_kind == "ARRAY<STRING>") & F.forall(factors, lambda f: F.trim(f) != "")), "a key_factor is empty").when(
        F.exists(factors, lambda f: F.length(f) > FACTOR_CHARS), "a key_factor is too long").when(F.size(used) > 0, F.concat(F.lit("invented number: "), F.array_join(used, ", ")))


def indian_grouping(value: Column) -> Column:
    """Whole number with a comma before the last three digits and before every two further on."""
    whole = F.rint(value.cast("double")).cast("long")
    digits = F.abs(whole).cast("string")
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - 3), F.right(digits, F.lit(3))
    grouped = F.when(F.length(digits) > 3, F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), tail)).otherwise(digits)
    return F.when(value.isNull(), "-").otherwise(F.concat(F.when(whole < 0, "-").otherwise(""), grouped))


def to_paise(rupees: Column) -> Column:
    """Whole paise of decimal rupees given as text or decimal, halves away from zero; never by way of a float."""
    return F.round(rupees.cast("decimal(30,8)") * 100, 0).cast("long")


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of bytes, from SHA-256 alone."""
    import hashlib

    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def verify_signature(message: Column, signature: Column, secret: bytes) -> Column:
    """Whether the signature is the message's; equal-length digests of both are compared, so time tells nothing of the match."""
    if not secret:
        raise ValueError("the secret is not configured")
    return F.coalesce(F.sha2(hmac_sha256(message, secret), 256) == F.sha2(F.lower(F.trim(signature)), 256), F.lit(False))


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def facts() -> Column:
    """A cluster's figures as lines of text."""
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in INTEGERS] + [F.concat(F.lit(f"{c}: "), fixed(F.col(c), 4)) for c in DECIMALS]
    return F.concat_ws("\n", *lines, F.concat(F.lit("shared_attributes: "), F.array_join("shared_attributes", ", ")))


def case_facts() -> Column:
    """A case file as lines of text: its cluster's figures, its own, and its findings."""
    own = [F.concat(F.lit("rank_by_risk: "), F.col("rank").cast("string"), F.lit(" of "), F.col("total_flagged_clusters").cast("string")), F.concat(F.lit("risk_percentile: "), fixed(F.col("risk_percentile"), 2)),
           F.concat(F.lit("entities_also_in_other_flagged_clusters: "), F.col("entities_in_other_clusters").cast("string")), F.concat(F.lit("transactions_per_entity: "), fixed(F.col("transactions_per_entity"), 2)),
           F.concat(F.lit("share_of_transactions_flagged: "), fixed(F.col("flagged_share"), 2)), F.concat(F.lit("population_mean_risk_score: "), fixed(F.col("population_mean_risk"), 4))]
    listed = [F.when(F.col(c) != "", F.concat(F.lit(f"{title}:\n  - "), F.replace(F.col(c), F.lit("; "), F.lit("\n  - "))))
              for c, title in (("corroborating", "findings_supporting_concern"), ("contradicting", "findings_arguing_against_concern"))]
    return F.concat_ws("\n", F.concat(F.lit("case_id: "), F.col("case_id")), facts(), *own, *listed)


#: What a figure points at in a cluster's graph. Fixed values.
TARGETS = {"entity_count": "entities", "component_size": "entities", "distinct_cards": "attributes", "distinct_addresses": "attributes", "distinct_email_domains": "attributes", **dict.fromkeys(
    ("transaction_count", "flagged_transaction_count", "core_number", "max_degree", "span_days", "total_amount_inr", "max_risk_score", "mean_risk_score"), "all")}


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``segments``: runs of the text, each with the figure it quotes and what that points at, if any; together they are the text again."""
    decimals, whole = [c for c in TARGETS if c in DECIMALS], [c for c in TARGETS if c in INTEGERS]

    def literals(row: dict) -> dict[str, tuple[str, str]]:
        found: dict[str, tuple[str, str]] = {}
        for c in whole:
            if (x := row[c]) is not None and x == x and x >= 3:
                for shape in {f"{int(x)}", f"{int(x):,}"}:
                    found.setdefault(shape, (c, TARGETS[c]))
        for c in decimals:
            if (x := row[c]) is not None and x == x:
                shapes = [f"{x:.4f}", f"{x:.2f}", f"{x:,.2f}"] + ([f"{int(x)}", f"{int(x):,}"] if float(x).is_integer() else [])
                for shape in shapes:
                    found.setdefault(shape, (c, TARGETS[c]))
        for a in row["shared_attributes"] if row["shared_attributes"] is not None else []:
            if a and a != "indirect_attribute_chain":
                found.setdefault(a, (f"attribute:{a}", f"attr:{a}"))
        return found

    @F.pandas_udf("array<struct<text:string,field:string,target:string>>")
    def segments(t: pd.Series, rows: pd.DataFrame) -> pd.Series:
        names, out = list(rows.columns), []
        for value, *figures in zip(t, *(rows[c] for c in names)):
            value = value or ""
            known = literals(dict(zip(names, figures)))
            parts, at = [], 0
            if known:
                pattern = r"(?<![\w.])(?:" + "|".join(map(re.escape, sorted(known, key=lambda x: (-len(x), x)))) + r")(?![\w.])"
                for m in re.finditer(pattern, value):
                    if m.start() > at:
                        parts.append({"text": value[at:m.start()], "field": None, "target": None})
                    parts.append({"text": m[0], "field": known[m[0]][0], "target": known[m[0]][1]})
                    at = m.end()
            if at < len(value):
                parts.append({"text": value[at:], "field": None, "target": None})
            out.append(parts)
        return pd.Series(out)

    return df.withColumn("segments", segments(F.col(text), F.struct(*whole, *decimals, "shared_attributes")))


ATTEMPTS = 2


def completed(df: DataFrame, providers, cache: str, prompt: str = "prompt") -> DataFrame:
    """Adds ``answer``: what the first provider that answers says to the prompt, null if none does.

    ``providers``: callables (or one), each tried ATTEMPTS times before the next. Prompts are
    asked once, by the SHA-256 of their text, and kept in the Parquet folder ``cache``; a
    prompt that is there is not asked again, and one that got no answer is not kept.
    """
    spark, providers = df.sparkSession, list(providers) if isinstance(providers, (list, tuple)) else [providers]
    s, schema = Scratch(spark, "prompts"), "key string, answer string"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    known = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    keyed = df.withColumn("_key", prompt_key(F.col(prompt)))
    asked = keyed.select(F.col("_key").alias("key"), F.col(prompt).alias("p")).where("key is not null").dropDuplicates(["key"]).join(known, "key", "left_anti")

    def ask(batches):
        for pdf in batches:
            answers = []
            for p in pdf["p"]:
                answer = None
                for call in providers:
                    for _ in range(ATTEMPTS):
                        try:
                            answer = call(p)
                        except Exception:  # any failure means the next attempt
                            continue
                        break
                    if answer is not None:
                        break
                answers.append(answer)
            yield pd.DataFrame({"key": pdf["key"], "answer": answers})

    fresh = s.table(asked.mapInPandas(ask, schema), "fresh").where("answer is not null")
    fresh.write.mode("append").parquet(cache)
    # of a prompt that two runs asked at once, one answer
    answers = spark.read.schema(schema).parquet(cache).groupBy("key").agg(F.min("answer").alias("answer"))
    return keyed.join(answers.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def drafted(df: DataFrame, providers, cache: str, refused=rejection, allowed: str = "allowed", prompt: str = "prompt", fallback: str = "no narrative") -> DataFrame:
    """Adds answer, accepted and why: a completion, once more with the reason if it is refused, then the fallback.

    ``refused(raw, allowed)`` gives the reason or null: ``rejection`` for narratives,
    ``disposition_rejection`` for dispositions. One row per input row; every branch reads
    the same kept answers.
    """
    first = completed(df, providers, cache, prompt)
    first = first.withColumn("why", F.when(F.col("answer").isNull(), "no provider answered").otherwise(refused(F.col("answer"), F.col(allowed))))
    first = Scratch(df.sparkSession, "drafts").table(first, "first")
    good, bad = first.where("why is null"), first.where("why is not null")
    again = completed(bad.withColumn("_again", F.concat(prompt, F.lit("\nrefused: "), "why")).drop("answer", "why"), providers, cache, "_again")
    again = again.withColumn("why", F.when(F.col("answer").isNull(), "no provider answered").otherwise(refused(F.col("answer"), F.col(allowed)))).drop("_again")
    out = good.unionByName(again).withColumn("accepted", F.col("why").isNull())
    return out.withColumn("answer", F.when(F.col("accepted"), F.col("answer")).otherwise(fallback))


def narrate(df: DataFrame, providers, cache: str | None = None, **options) -> DataFrame:
    """Adds narrative and accepted; without ``cache`` answers are kept in the session's shared folder."""
    cache = cache or Scratch(df.sparkSession, "narratives").path("cache")
    return drafted(df, providers, cache, rejection, **options).drop("why").withColumnRenamed("answer", "narrative")


def draft_dispositions(cases: DataFrame, providers, cache: str | None = None, fallback: str = "no recommendation", **options) -> DataFrame:
    """Adds disposition and accepted to case files with prompt and allowed numbers."""
    cache = cache or Scratch(cases.sparkSession, "dispositions").path("cache")
    return drafted(cases, providers, cache, disposition_rejection, fallback=fallback, **options).drop("why").withColumnRenamed("answer", "disposition")
