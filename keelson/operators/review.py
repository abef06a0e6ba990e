"""Review sheets of family names: what merged too much, what split, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .entity import prefix_pairs

# Words that mark a vehicle beside a family's main sequence, and the flags of the sheet.
SIDECAR_TOKENS = (
    "CO-INVEST",
    "COINVEST",
    "ANNEX",
    "SEED",
    "GROWTH",
    "OPPORTUNIT",
    "SURGE",
    "SELECT",
    "ENCORE",
    "OVERAGE",
    "CONTINUATION",
)
OVERMERGE = "overmerge:members disagree after removing fund number"
SIDECAR = "overmerge:sidecar pooled with flagship"
STRANDED = "split:fund number '%s' stranded in the stem"
DANGLING = "split:stem ends in a dangling separator"
SIBLING = "split:sibling stem carries the same series name"
CLASH = "sequence:two funds share a vintage"
DUPLICATE = "duplicate:same fund reported by both plans"


def family_review(funds: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row for each raw stem: its funds, what speaks against it, and what was decided.

    ``funds`` has fund_name, vintage, source, firm_id_raw and firm_id (the
    family after overrides); ``overrides`` has firm_id_raw, decision, reason.
    Two funds of a vintage clash unless they are one fund that both plans report.
    """
    raw = "firm_id_raw"
    rows = funds.select(raw, "firm_id", "fund_name", "vintage", "source", N.fund_number(F.col("fund_name")).alias("_number"), N.family_stem(F.col("fund_name")).alias("_stem"), N.any_word(F.col("fund_name"), SIDECAR_TOKENS).alias("_sidecar"))
    tied = rows.filter("vintage is not null").groupBy(raw, "vintage").agg(F.count("*").alias("_n"), (F.countDistinct("_number") + F.max(F.col("_number").isNull().cast("int"))).alias("_numbers"), F.countDistinct("source").alias("_plans")).filter("_n > 1")
    clash = tied.groupBy(raw).agg(F.bool_or((F.col("_plans") == 1) | (F.col("_numbers") > 1)).alias("_clash"))
    ordered = F.array_sort(F.collect_list(F.struct("vintage", "fund_name")))
    sheet = rows.groupBy(raw).agg(F.count("*").alias("n_funds_raw"), F.countDistinct("_stem").alias("_stems"), F.countDistinct("_sidecar").alias("_sidecars"), ordered.alias("_funds"), F.array_join(F.array_sort(F.collect_set("firm_id")), "|").alias("firm_id_final"))
    pairs = prefix_pairs(rows.select(F.col(raw).alias("stem")))
    near = pairs.select(F.col("stem").alias(raw), F.col("longer").alias("_near")).union(pairs.select("longer", "stem")).groupBy(raw).agg(F.array_join(F.array_sort(F.collect_set("_near")), " | ").alias("neighbour_stems"))
    sizes = rows.groupBy(F.col("firm_id").alias("firm_id_final")).agg(F.count("*").alias("n_funds_final"))
    decided = overrides.groupBy(raw).agg(F.max_by(F.struct("decision", "reason"), "decision").alias("_d"))
    out = sheet.join(clash, raw, "left").join(near, raw, "left").join(sizes, "firm_id_final", "left").join(decided, raw, "left")
    out = out.withColumn("orphan_number", N.orphan_number(F.col(raw))).withColumn("neighbour_stems", F.coalesce("neighbour_stems", F.lit("")))
    orphan = F.col("orphan_number") != ""
    flags = F.array_compact(
        F.array(
            F.when(F.col("_stems") > 1, OVERMERGE),
            F.when(F.col("_sidecars") > 1, SIDECAR),
            F.when(orphan, F.format_string(STRANDED, "orphan_number")),
            F.when(N.dangling(F.col(raw)), DANGLING),
            F.when(orphan & (F.col("neighbour_stems") != ""), SIBLING),
            F.when(F.col("_clash"), CLASH).when(F.col("_clash").isNotNull(), DUPLICATE),
        )
    )
    out = out.withColumn("flags", F.array_join(flags, " ; ")).withColumn("decision", F.coalesce("_d.decision", F.lit("unreviewed")))
    return out.select(
        raw,
        "firm_id_final",
        "n_funds_raw",
        F.array_join(F.transform(F.filter("_funds", lambda f: f["vintage"].isNotNull()), lambda f: f["vintage"].cast("string")), ";").alias("vintages"),
        F.array_join(F.transform("_funds", lambda f: f["fund_name"]), " | ").alias("fund_names"),
        "orphan_number",
        "neighbour_stems",
        "flags",
        "decision",
        F.coalesce("_d.reason", F.lit("")).alias("reason"),
        F.coalesce("n_funds_final", F.lit(0)).alias("n_funds_final"),
        ((F.col("decision") == "unreviewed") & (F.col("flags") != "")).alias("needs_review"),
    )


def diagnose_names(funds: DataFrame) -> DataFrame:
    """(source, fund_name, stem, removed_tail, stranded_number, failure) of names whose number the stem rule left in.

    CONSUMED+STRANDED where the rule took a share-class letter for the numeral.
    """
    stem, name = N.family_stem(F.col("fund_name")), F.col("fund_name")
    rows = funds.select("source", "fund_name", stem.alias("stem"), N.removed_tail(name).alias("removed_tail"), N.orphan_number(stem).alias("stranded_number")).filter("stranded_number <> ''")
    token = F.trim(F.regexp_replace("removed_tail", r"\b(?:LP|LLC|LTD)\b", ""))
    return rows.withColumn("failure", F.when(token.isin(*"IVXLC"), "CONSUMED+STRANDED").otherwise("STRANDED"))


def load_universe(plans: list[DataFrame]) -> DataFrame:
    """Every fund that any plan reports, stacked before any matching, with its raw stem."""
    stacked = plans[0]
    for plan in plans[1:]:
        stacked = stacked.unionByName(plan, allowMissingColumns=True)
    return stacked.withColumn("firm_id_raw", N.family_stem(F.col("fund_name")))
