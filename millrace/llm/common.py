"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

#: At most so many keys are joined by broadcast in join_unique(); see there.
MAX_HOT_KEYS = 1000


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 by 5; also for a null id, which is never learned from."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(True))


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, by the name that Spark resolves; an error if there is none, or more than one."""
    found = df.select(name).columns[0]
    return df.columns.index(found) if found in df.columns else [c.lower() for c in df.columns].index(name.lower())


def map_text(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
) -> DataFrame:
    """Runs a function over the Arrow batches of `df`; `make` builds it once in each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of many rows to a table with one row a key, where one key may hold a third of all rows.

    `right` has the columns `key`, `count` (how many rows of `left` have the key)
    and others, which the result gets. Keys with more than total / MAX_HOT_KEYS
    rows, of which there are fewer than MAX_HOT_KEYS, are joined by broadcast and
    dealt out by a hash of the whole left row; the others meet in a shuffle, where
    no key has more rows than that. Null keys match nothing.
    """
    others = [c for c in right.columns if c not in (key, count)]
    limit = max(1000, total // MAX_HOT_KEYS)
    hot = right.where(F.col(count) > limit).select(
        F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot")
    )
    cold = right.where(F.col(count) <= limit).select(
        F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*others).alias("_cold")
    )
    narrow = [c for c in left.columns if left.schema[c].dataType.typeName() not in ("string", "binary", "array", "map", "struct")]
    salt = F.pmod(F.xxhash64(*narrow), F.lit(1 << 20)) + 1 if narrow else F.lit(1)
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0))
    )
    met = dealt.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return met.select(
        *left.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in others]
    )


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies.

    Bytes that print as they are stand for themselves; the others get the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
