"""Contracts between tables: merges, alignments and audits that fail closed."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import flag
from millrace.sources.readers import ContractError


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of two tables that each have a key once; else an error."""
    for side, df in (("left", left), ("right", right)):
        if repeated(df, key).limit(1).count():
            raise ContractError(f"the {side} table repeats a key")
    return left.join(right, key)


def aligned(keys: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """A row for each of the keys with its values; an error where one has none."""
    joined = keys.select(key).join(values.withColumn("_there", F.lit(True)), key, "left")
    missing = joined.where(F.col("_there").isNull()).count()
    if missing:
        raise ContractError(f"{missing} keys have no values")
    return joined.drop("_there")


def sequence_contract(panel: DataFrame, coverage: float = 0.9) -> DataFrame:
    """The panel as it is if its periods follow each other and neighbouring ones share enough entities; else an error."""
    from millrace.operators.panel import adjacent_coverage, period_gaps

    if period_gaps(panel).limit(1).count():
        raise ContractError("periods are missing")
    if low := adjacent_coverage(panel).where(F.col("coverage") < coverage).count():
        raise ContractError(f"{low} neighbouring periods share too few entities")
    return panel


def import_filtered(rows: DataFrame, entity: list[str], kind: str, allowed: list[str], measures: list[str], excluded: list | None = None) -> DataFrame:
    """Sums of the measures by entity over rows of the allowed kinds, without excluded entities."""
    kept = rows.where(F.col(kind).isin(*allowed))
    if excluded:
        kept = kept.where(~F.col(entity[0]).isin(*excluded))
    return kept.groupBy(*entity).agg(*[F.sum(m).alias(m) for m in measures])


def import_audit(rows: DataFrame, source: str, entity: list[str], kind: str, allowed: list[str]) -> DataFrame:
    """By source: rows, rows kept, entities, rows beyond an entity's first, and rows left out."""
    kept = F.col(kind).isin(*allowed)
    each = rows.groupBy(source, *entity).agg(F.count("*").alias("_n"), F.sum(flag(kept)).alias("_k"))
    return each.groupBy(source).agg(
        F.sum("_n").alias("n_rows"), F.sum("_k").alias("kept"), F.sum(flag(F.col("_k") > 0)).alias("entities"),
        F.sum(F.greatest(F.col("_k") - 1, F.lit(0))).alias("duplicates"), F.sum(F.col("_n") - F.col("_k")).alias("excluded"),
    )


def identity_audit(rows: DataFrame, inventory: DataFrame, key: list[str]) -> DataFrame:
    """One row: identities that are missing, not expected, or repeated."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    missing = count(inventory.select(*key).join(rows.select(*key).distinct(), key, "left_anti"), "missing")
    strange = count(rows.select(*key).distinct().join(inventory.select(*key), key, "left_anti"), "unexpected")
    return missing.crossJoin(F.broadcast(strange)).crossJoin(F.broadcast(count(repeated(rows, key), "repeated")))


def apart(stored: DataFrame, made: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys of one side only, or whose values differ by more than the tolerance, with the largest difference."""
    other = made.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_m"))
    both = stored.select(*key, *values, F.lit(True).alias("_s")).join(other, key, "full")
    gap = F.greatest(*[F.abs(F.col(v) - F.col(f"_{v}")) for v in values], F.lit(0.0))
    return both.withColumn("difference", F.when(F.col("_m").isNull() | F.col("_s").isNull(), F.lit(None)).otherwise(gap)).where(
        F.col("difference").isNull() | (F.col("difference") > tolerance)
    ).select(*key, "difference")


def agrees(artifact: dict, expected: dict) -> None:
    """A model's season, settings, schema and last training period against those of a run."""
    if differ := sorted(k for k in expected if artifact.get(k) != expected[k]):
        raise ContractError(f"the model disagrees in {differ}")


def fixed_protocol(name: str, given: dict, protocol: str, settings: dict) -> None:
    """Settings may not be changed under the protocol's own name."""
    if name == protocol and (differ := sorted(k for k in given if given[k] != settings.get(k))):
        raise ContractError(f"{protocol} fixes {differ}")


def contained(root: str, path: str) -> str:
    """`path` below `root`, normalised; one that leads out of it is refused."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if posixpath.isabs(path) or not (whole + "/").startswith(posixpath.normpath(root) + "/"):
        raise ContractError(f"{path} leads out of {root}")
    return whole
