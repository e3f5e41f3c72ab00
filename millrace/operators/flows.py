"""Origin-destination flows: audits of raw rows, totals by origin, mass by destination.

Raw rows are text (origin, destination, indicator, people); indicators say where a
person works: 1 at home, 2 elsewhere, 3 at a fixed place. Audits count what is
wrong; the other operators expect rows that pass them. The list of codes carries no
broadcast hint: Spark broadcasts it where its size allows, so that facts are filtered
before any shuffle, and joins it by a shuffle, with skewed keys split, where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import flag, ratio, whole_match

HOME, OTHER, FIXED = 1, 2, 3
KEY = ["origin", "destination", "indicator"]


def invalid_row(rows: DataFrame) -> dict[str, Column]:
    """What can be wrong with a raw row, by name."""
    return {
        "null_origin": F.col("origin").isNull(),
        "null_destination": F.col("destination").isNull(),
        "bad_indicator": F.expr("try_cast(indicator as int)").isNull(),
        "bad_people": F.col("people").isNull() | ~whole_match(F.col("people"), "[0-9]+"),
    }


def invalid_rows(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are, how many break each rule, and how many break any."""
    rules = invalid_row(rows)
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | rule
    return rows.agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.sum(flag(rule)), F.lit(0)).alias(name) for name, rule in rules.items()],
        F.coalesce(F.sum(flag(broken)), F.lit(0)).alias("n_invalid"),
    )


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def inconsistent_origins(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Listed origins that have not exactly one label, or lack one of the three indicators."""
    has = lambda i: F.max(flag(F.expr("try_cast(indicator as int)") == i))
    return (
        rows.join(codes, rows["origin"] == codes["code"], "left_semi")
        .groupBy("origin")
        .agg(F.countDistinct("origin_label").alias("n_labels"), (has(HOME) + has(OTHER) + has(FIXED)).alias("n_indicators"))
        .where((F.col("n_labels") != 1) | (F.col("n_indicators") != 3))
    )


def origin_aggregates(flows: DataFrame, codes: DataFrame) -> DataFrame:
    """Six totals of each listed origin in one pass.

    Whether a destination is listed is a flag of a left join, since flows to
    unlisted destinations count as well.
    """
    inside = codes.select(F.col("code").alias("destination"), F.lit(True).alias("listed"))
    people = lambda c: F.sum(F.when(c, F.col("people")).otherwise(F.lit(0)))
    at = F.col("indicator")
    local = F.col("listed").isNotNull()
    return (
        flows.join(codes, flows["origin"] == codes["code"], "left_semi")
        .join(inside, "destination", "left")
        .groupBy("origin")
        .agg(
            F.min("origin_label").alias("label"),
            people(at.isin(HOME, OTHER, FIXED)).alias("employed"),
            people(at == HOME).alias("home"),
            people(at == OTHER).alias("elsewhere"),
            people(at == FIXED).alias("fixed"),
            people((at == FIXED) & local).alias("fixed_local"),
            people((at == FIXED) & (F.col("destination") == F.col("origin"))).alias("fixed_same"),
        )
    )


def destination_mass(flows: DataFrame, codes: DataFrame) -> DataFrame:
    """People with a fixed workplace in each listed destination, from all origins; 0 where there are none."""
    inbound = flows.where(F.col("indicator") == FIXED).groupBy("destination").agg(F.sum("people").alias("mass"))
    return codes.join(inbound, codes["code"] == inbound["destination"], "left").select(
        "code", F.coalesce("mass", F.lit(0)).cast("long").alias("mass")
    )


def local_pairs(flows: DataFrame, codes: DataFrame) -> DataFrame:
    """Flows to fixed workplaces between two listed areas."""
    origins = codes.select(F.col("code").alias("origin"))
    destinations = codes.select(F.col("code").alias("destination"))
    return (
        flows.where(F.col("indicator") == FIXED)
        .join(origins, "origin", "left_semi")
        .join(destinations, "destination", "left_semi")
        .select("origin", "destination", "people")
    )


def retention(aggregates: DataFrame) -> DataFrame:
    """What leaves an area, and the shares that stay and that work at home."""
    return aggregates.select(
        "origin",
        (F.col("fixed") - F.col("fixed_local")).alias("fixed_outside"),
        ratio(F.col("fixed_local"), F.col("fixed"), 9).alias("retention"),
        ratio(F.col("home"), F.col("employed"), 9).alias("home_share"),
    )


def totals(aggregates: DataFrame) -> DataFrame:
    """Totals of all areas, and the ratio of totals."""
    return aggregates.agg(
        F.count("*").alias("areas"),
        F.sum("employed").alias("employed"),
        F.sum("fixed").alias("fixed"),
        F.sum("fixed_local").alias("fixed_local"),
        ratio(F.sum("fixed_local"), F.sum("fixed"), 9).alias("retention"),
    )


def contract_violations(aggregates: DataFrame, codes: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: how many areas break each rule that totals must keep."""
    joined = codes.join(aggregates, codes["code"] == aggregates["origin"], "left")
    share = ratio(F.col("fixed_local"), F.col("fixed"))
    rules = {
        "missing": F.col("origin").isNull(),
        "negative": F.least("employed", "home", "elsewhere", "fixed", "fixed_local", "fixed_same") < 0,
        "parts_differ": F.col("home") + F.col("elsewhere") + F.col("fixed") != F.col("employed"),
        "local_over_fixed": F.col("fixed_local") > F.col("fixed"),
        "same_over_local": F.col("fixed_same") > F.col("fixed_local"),
        "share_out_of_range": (share < -tolerance) | (share > 1 + tolerance),
    }
    return joined.agg(F.count("*").alias("areas"), *[F.coalesce(F.sum(flag(r)), F.lit(0)).alias(n) for n, r in rules.items()])
