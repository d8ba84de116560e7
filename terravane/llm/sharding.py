"""Deterministic sharding by a permutation-filled lookup table, with DataFrame functions only.

Eisenbud et al., "Maglev" (NSDI 2016): every shard has its own permutation of the slots of a prime-sized
table, and the shards take turns claiming their next free slot, so each gets the same number of slots give
or take one, and a changed shard list moves few keys. The table has ``slots`` entries, whatever the data;
it travels as a literal, and a row finds its shard by one hash and one array access, without a shuffle.

Rows: a null key has the slot of the empty string. Equal keys get equal shards; no row is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot; ``slots`` must be a prime above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots <= len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    at = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """First 60 bits of the key's MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with its slot and the name of its shard (columns slot, shard replace columns of these names)."""
    numbers = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    names = F.array(*map(F.lit, shards))
    slot = slot_of(F.col(key), slots)
    keep = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*keep, slot.alias("slot")).withColumn("shard", F.get(names, F.get(numbers, F.col("slot"))))


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, pieces: int = 8, slots: int = SLOTS) -> None:
    """Write ``df`` as path/shard=.../; each shard's rows are dealt to ``pieces`` tasks by their content and the partition they
    come from, so that a key or a row that is there very often fills no task."""
    placed = assign(df, key, shards, slots)
    piece = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(pieces))
    placed.repartition(F.col("shard"), piece).drop("slot").write.partitionBy("shard").parquet(path)
