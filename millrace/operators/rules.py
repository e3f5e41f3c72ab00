"""Catalogues of rules: what must hold of a table's rows, of its keys, and of its totals, checked in one pass.

A rule names what breaks it. Rules of rows are conditions; all of a catalogue are counted
by one aggregation over the table, whatever their number. Rules of keys count keys that
are null or come twice, by one aggregation on the key. Expected values come as a table
(rule, expected), such as a manifest read from a file, and are met with the observed ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import finite, flag, whole_match


@dataclass(frozen=True)
class Rule:
    """A row breaks it where `broken` is true; a condition that is null is broken too unless `null_holds`."""

    name: str
    broken: Column
    null_holds: bool = False

    def count(self) -> Column:
        condition = F.coalesce(self.broken, F.lit(not self.null_holds))
        return F.coalesce(F.sum(flag(condition)), F.lit(0)).alias(self.name)


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def checked(df: DataFrame, rules: list[Rule], key: list[str] | None = None) -> DataFrame:
    """(rule, broken): how many rows break each rule; with a key also `repeated_key` (rows beyond the first of a key), and `empty` (1 for a table without rows)."""
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("a rule's name occurs twice")
    row = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty"), *[r.count() for r in rules])
    found = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n in ["empty", *names]])).alias("r")).select("r.*")
    if key:
        twice = df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.lit("repeated_key").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("broken"))
        found = found.unionByName(twice)
    return found


def against(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, expected, observed, agrees): observed and expected values met from both sides; what one side lacks does not agree."""
    met = observed.join(expected, "rule", "full")
    return met.select("rule", "expected", "observed", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)).alias("agrees"))


def numbers(columns: list[str], least: float | None = 0.0) -> list[Rule]:
    """Each column must be a finite number, and not under `least`."""
    rules = [Rule(f"{c}_not_finite", ~finite(F.col(c).cast("double"))) for c in columns]
    if least is not None:
        rules += [Rule(f"{c}_negative", F.col(c) < least, null_holds=True) for c in columns]
    return rules


def positive(columns: list[str]) -> list[Rule]:
    return [Rule(f"{c}_not_positive", ~(F.col(c) > 0)) for c in columns]


def coded(column: str, pattern: str) -> Rule:
    """A code must match a pattern as a whole."""
    return Rule(f"{column}_malformed", ~whole_match(F.col(column), pattern))


def sums_to(name: str, whole: str, parts: list[str]) -> Rule:
    return Rule(name, F.col(whole) != sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def at_most(name: str, smaller: str, greater: str) -> Rule:
    return Rule(name, F.col(smaller) > F.col(greater))


def is_ratio(name: str, share: str, part: str, whole: str, tolerance: float = 1e-10) -> Rule:
    quotient = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    return Rule(name, ~(F.abs(F.col(share) - quotient) <= tolerance))


#: The columns of the area table, by kind.
COUNTS = ["employed", "home", "other", "fixed", "local", "same_area", "outside", "inbound"]
SHARES = ["retention", "home_share"]
REACH = ["access_3km", "access_5km", "access_10km", "mean_km"]


def area_contract(pattern: str) -> list[Rule]:
    """What must hold of a table of areas with people by kind of workplace, shares of them, and accessibility."""
    return [
        coded("code", pattern),
        *numbers([*COUNTS, *SHARES, *REACH]),
        *positive(["employed", "fixed"]),
        sums_to("employed_not_reconciled", "employed", ["home", "other", "fixed"]),
        at_most("local_above_fixed", "local", "fixed"),
        at_most("same_area_above_local", "same_area", "local"),
        sums_to("flows_not_conserved", "fixed", ["local", "outside"]),
        is_ratio("retention_not_a_ratio", "retention", "local", "fixed"),
        is_ratio("home_share_not_a_ratio", "home_share", "home", "employed"),
        at_most("access_3km_above_5km", "access_3km", "access_5km"),
        at_most("access_5km_above_10km", "access_5km", "access_10km"),
    ]
