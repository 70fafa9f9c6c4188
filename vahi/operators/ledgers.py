"""Which ledger a party or an item belongs to: rules, then memory, then similar names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.operators.matching import contains_join, nearest, subset_join
from vahi.storage import stored

# Thresholds of similarity, and the confidence of each step.
SURE, LIKELY, LENIENT, SUBSET_FLOOR = 0.86, 0.72, 0.70, 0.75
GSTIN_RULE, NAME_RULE, CONTAINS_RULE, GSTIN_MEMORY, NAME_MEMORY = 1.0, 0.98, 0.95, 0.92, 0.85


def _best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def fuzzy_confidence(score: Column) -> Column:
    return F.when(score >= SURE, 0.6 + 0.3 * score).when(score >= LIKELY, 0.4 + 0.2 * (score - LIKELY) / 0.14)


def similar_names(names: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """The best candidate of each (client_id, name_key) by Dice similarity, then hits, then order; only names that have enough bigrams in common with a block of names meet it."""
    ranked = candidates.groupBy("client_id", "norm").agg(F.min(F.struct((-F.col("hit_count")).alias("h"), "seq.k", "seq.i", "seq.m")).alias("r")).select("client_id", "norm", "r.*")
    return nearest(names, ranked, "name_key", "norm", ["client_id"], least, ["h", "k", "i", "m"]).withColumnRenamed("i", "ledger_id").drop("h", "k", "m")


def candidates_of(memory: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Names that parties are compared with: remembered names first, then party ledgers."""
    known = memory.where("match_type = 'VENDOR_NAME'").select("client_id", "ledger_id", F.col("match_key").alias("norm"), "hit_count", F.struct(F.lit(0).alias("k"), F.col("ledger_id").alias("i"), F.col("match_key").alias("m")).alias("seq"))
    named = ledgers.where("ledger_type = 'PARTY'").select("client_id", "ledger_id", T.norm_name(F.col("name")).alias("norm"), F.lit(0).alias("hit_count"), F.struct(F.lit(1).alias("k"), F.col("ledger_id").alias("i"), F.col("name").alias("m")).alias("seq"))
    return stored(known.unionByName(named), "candidates").where("norm IS NOT NULL")  # its names are asked several times; a filter before would make each twice


def party_keys(rows: DataFrame) -> DataFrame:
    """The distinct (client_id, gstin_key, name_key) of rows with vendor and vendor_gstin; each spelling is normalised once."""
    spelt = rows.select("client_id", "vendor", "vendor_gstin").distinct()
    return spelt.select("client_id", T.norm_gstin(F.col("vendor_gstin")).alias("gstin_key"), T.norm_name(F.col("vendor")).alias("name_key")).distinct()


def resolve_parties(parties: DataFrame, rules: DataFrame, memory: DataFrame, ledgers: DataFrame) -> DataFrame:
    """V4: ledger_id, confidence, via, needs_review for distinct (client_id, gstin_key, name_key); nulls where no step applies.

    Rules compete by priority whatever their type; then the registration's memory, the name's memory, and last the most similar name, which is looked for
    only where the earlier steps found nothing.
    """
    parties = stored(parties.select("client_id", "gstin_key", "name_key").distinct(), "parties")
    key = ["client_id", "gstin_key", "name_key"]
    active = rules.where("enabled AND rule_type <> 'HSN_EQUALS'").select("client_id", "rule_type", "rule_id", "priority", F.col("ledger_id").alias("rule_ledger"), T.norm_pattern(F.col("rule_type"), F.col("pattern")).alias("norm"))
    first = F.min(F.struct("priority", "rule_id", "rule_ledger")).alias("r")  # of the rules that ask the same only the first can win, so a party does not meet them all
    active = stored(active.groupBy("client_id", "rule_type", "norm").agg(first).select("client_id", "rule_type", "norm", "r.*"), "rules").where("norm <> ''")  # its keys are asked several times
    of = lambda kind, name: active.where(F.col("rule_type") == kind).withColumnRenamed("norm", name)
    inside = contains_join(parties, of("VENDOR_NAME_CONTAINS", "norm"), "name_key", "norm", ["client_id"])
    hits = [
        parties.join(of("GSTIN_EQUALS", "gstin_key"), ["client_id", "gstin_key"]), parties.join(of("VENDOR_NAME_EQUALS", "name_key"), ["client_id", "name_key"]),
        parties.join(inside, ["client_id", "name_key"]).join(of("VENDOR_NAME_CONTAINS", "norm"), ["client_id", "norm"]),
    ]
    met = reduce(DataFrame.unionByName, [h.select(*key, "rule_type", "rule_id", "priority", "rule_ledger") for h in hits])
    ruled = _best(met, key, F.asc("priority"), F.asc("rule_id")).select(
        *key, "rule_ledger", F.when(F.col("rule_type") == "GSTIN_EQUALS", GSTIN_RULE).when(F.col("rule_type") == "VENDOR_NAME_EQUALS", NAME_RULE).otherwise(CONTAINS_RULE).alias("rule_confidence")
    )

    def remembered(kind: str, column: str, name: str) -> DataFrame:
        rows = memory.where(F.col("match_type") == kind).where("match_key IS NOT NULL")
        return _best(rows, ["client_id", "match_key"], F.desc("hit_count"), F.desc("ledger_id")).select("client_id", F.col("match_key").alias(column), F.col("ledger_id").alias(name))

    found = null_safe_left(parties, ruled, key)
    found = found.join(remembered("GSTIN", "gstin_key", "gstin_ledger"), ["client_id", "gstin_key"], "left").join(remembered("VENDOR_NAME", "name_key", "name_ledger"), ["client_id", "name_key"], "left")
    found = stored(found, "parties")
    open_names = found.where("rule_ledger IS NULL AND gstin_ledger IS NULL AND name_ledger IS NULL AND name_key IS NOT NULL").select("client_id", "name_key").distinct()
    near = similar_names(open_names, candidates_of(memory, ledgers), LIKELY).select("client_id", "name_key", F.col("ledger_id").alias("near_ledger"), "score")
    found = found.join(near, ["client_id", "name_key"], "left")
    step = F.when(F.col("rule_ledger").isNotNull(), "RULE").when(F.col("gstin_ledger").isNotNull(), "GSTIN_MEMORY").when(F.col("name_ledger").isNotNull(), "NAME_MEMORY").when(F.col("near_ledger").isNotNull(), "FUZZY")
    found = found.withColumn("via", step)
    by = lambda rule, gstin, name, near: F.when(F.col("via") == "RULE", rule).when(F.col("via") == "GSTIN_MEMORY", gstin).when(F.col("via") == "NAME_MEMORY", name).when(F.col("via") == "FUZZY", near)
    return found.select(
        *key, by(*(F.col(x) for x in ("rule_ledger", "gstin_ledger", "name_ledger", "near_ledger"))).alias("ledger_id"),
        by(F.col("rule_confidence"), F.lit(GSTIN_MEMORY), F.lit(NAME_MEMORY), fuzzy_confidence(F.col("score"))).alias("confidence"),
        "via", F.when(F.col("via").isNotNull(), (F.col("via") == "FUZZY") & (F.col("score") < SURE)).alias("needs_review"),
    )


def null_safe_left(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    x, y = left.alias("x"), right.alias("y")
    same = F.col(f"x.{key[0]}") == F.col(f"y.{key[0]}")
    for k in key[1:]:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return x.join(y, same, "left").select("x.*", *[F.col(f"y.{c}") for c in right.columns if c not in key])


def suggest_parties(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """The lenient suggestion: similarity, lifted to SUBSET_FLOOR where one name's words are among the other's; names that are equal are passed over.

    Names meet by bigrams in common, or at the rarest word of the one with fewer words.
    """
    rank = ["k", "i", "m"]
    ranked = stored(candidates.groupBy("client_id", "norm").agg(F.min("seq").alias("r")).select("client_id", "norm", "r.*"), "candidates")
    near = nearest(names, ranked, "name_key", "norm", ["client_id"], LENIENT, rank, equal=False)
    inside = subset_join(names, ranked, "name_key", "norm", ["client_id"]).join(ranked, ["client_id", "norm"]).select("client_id", "name_key", F.lit(SUBSET_FLOOR).alias("score"), *rank)
    first = F.min(F.struct((-F.col("score")).alias("s"), *rank)).alias("r")  # a pair that is both counts by the larger score
    return near.unionByName(inside).groupBy("client_id", "name_key").agg(first).select("client_id", "name_key", F.col("r.i").alias("ledger_id"), (-F.col("r.s")).alias("score"))


def suggested(resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """V4 with V4b behind it: resolved parties, and for those without a ledger the lenient suggestion in suggested_ledger and suggested_score; nameless ones get none."""
    resolved = stored(resolved, "resolved")  # read three times; its similar names are looked for once
    open_names = resolved.where("ledger_id IS NULL AND name_key IS NOT NULL").select("client_id", "name_key").distinct()
    found = suggest_parties(open_names, candidates).select("client_id", "name_key", F.col("ledger_id").alias("_l"), F.col("score").alias("_s"))
    out = resolved.join(found, ["client_id", "name_key"], "left")
    free = F.col("ledger_id").isNull()
    return out.withColumns({"suggested_ledger": F.when(free, F.col("_l")), "suggested_score": F.when(free, F.col("_s"))}).drop("_l", "_s")


def resolve_items(items: DataFrame, rules: DataFrame, ledgers: DataFrame, side: str = "PURCHASE") -> DataFrame:
    """Item rows (client_id, hsn_code, gst_rate, ...) with item_ledger, item_confidence, item_via: a goods-code rule, a ledger of the rate, a default."""
    active = rules.where("enabled AND rule_type = 'HSN_EQUALS'").select("client_id", F.regexp_replace("pattern", r"\s+", "").alias("code"), "priority", "rule_id", F.col("ledger_id").alias("rule_ledger"))
    code = _best(active, ["client_id", "code"], F.asc("priority"), F.asc("rule_id")).select("client_id", "code", "rule_ledger")
    own = ledgers.where(F.col("ledger_type") == side)
    rate = _best(own.where("gst_rate IS NOT NULL"), ["client_id", "gst_rate"], F.desc("ledger_id")).select("client_id", "gst_rate", F.col("ledger_id").alias("rate_ledger"))
    default = _best(own, ["client_id"], F.desc(F.col("gst_rate").isNull()), F.asc("ledger_id")).select("client_id", F.col("ledger_id").alias("default_ledger"))
    out = items.withColumn("code", F.regexp_replace("hsn_code", r"\s+", "")).join(code, ["client_id", "code"], "left").join(rate, ["client_id", "gst_rate"], "left").join(default, "client_id", "left")
    out = out.withColumn("item_via", F.when(F.col("rule_ledger").isNotNull(), "RULE").when(F.coalesce("rate_ledger", "default_ledger").isNotNull(), "DEFAULT"))
    out = out.withColumn("item_confidence", F.when(F.col("rule_ledger").isNotNull(), 1.0).when(F.col("rate_ledger").isNotNull(), 0.6).when(F.col("default_ledger").isNotNull(), 0.5))
    return out.withColumn("item_ledger", F.coalesce("rule_ledger", "rate_ledger", "default_ledger")).drop("code", "rule_ledger", "rate_ledger", "default_ledger")


def learned(memory: DataFrame, events: DataFrame) -> DataFrame:
    """The memory after these approvals (client_id, match_type, match_key, ledger_id, at): hits add up, the latest ledger wins. A fold that can be replayed."""
    news = events.where("match_key <> ''").select("client_id", "match_type", "match_key", "ledger_id", F.lit(1).alias("hit_count"), F.col("at").cast("long").alias("at"))
    past = memory.where("match_key <> ''").select("client_id", "match_type", "match_key", "ledger_id", "hit_count", F.lit(-1).cast("long").alias("at"))
    latest = F.max_by("ledger_id", F.struct("at", "hit_count", "ledger_id"))
    return news.unionByName(past).groupBy("client_id", "match_type", "match_key").agg(latest.alias("ledger_id"), F.sum("hit_count").cast("long").alias("hit_count"))
