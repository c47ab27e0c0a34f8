"""Sharding by a permutation-filled lookup table.

Every shard owns a permutation of the slots of a prime-sized table. Shards
take turns, each claiming its first slot that is still free, until the table
is full. A row's key hashes to a slot, so placement is one lookup in a table
of fixed size (``table_size`` rows, about 1 MB), and adding or losing a shard
moves little more than that shard's share of the keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """Shard index of each slot. ``weights``: slots a shard claims in one turn (1 each by default)."""
    if not shards:
        raise ValueError("no shards")
    if not is_prime(table_size) or table_size < len(shards):
        raise ValueError("table_size must be a prime not below the number of shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights must be one non-negative number a shard, not all zero")
    order = []
    for s in shards:
        offset, skip = _number(f"{s}|offset") % table_size, _number(f"{s}|skip") % (table_size - 1) + 1
        order.append((offset + skip * np.arange(table_size)) % table_size)
    table = np.full(table_size, -1, np.int32)
    at, left = [0] * len(shards), table_size
    while left:
        for i, preferred in enumerate(order):
            for _ in range(turns[i]):
                while at[i] < table_size and table[preferred[at[i]]] >= 0:
                    at[i] += 1
                if not left or at[i] == table_size:
                    break
                table[preferred[at[i]]] = i
                left -= 1
    return table


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text, modulo the table size. A null key has the slot of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; existing columns of these names are replaced, all others stay whatever they are called.

    The broadcast side has exactly ``table_size`` rows whatever the input.
    Repeated keys share a shard, null keys count as the empty text, an empty
    table gives an empty result. Only the key decides; all other columns, texts
    too, go along.
    """
    spark: SparkSession = docs.sparkSession
    names = shards or [f"shard-{i:03d}" for i in range(SHARDS)]
    table = lookup_table(names, table_size)
    slots = spark.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")
    kept = docs.drop("slot", "shard")
    return kept.withColumn("slot", slot_of(F.col(f"`{key}`"), table_size)).join(F.broadcast(slots), "slot").select(*(F.col(f"`{c}`") for c in kept.columns), "slot", "shard")


def oracle(shards: int = SHARDS, table_size: int = TABLE_SIZE) -> str:
    """SQL that places documents: the slot from the key, the shard from the table written out, filled by plain turns."""
    prefer = []
    for i in range(shards):
        name = f"shard-{i:03d}"
        prefer.append((_number(f"{name}|offset") % table_size, _number(f"{name}|skip") % (table_size - 1) + 1))
    slots, at, turn = [-1] * table_size, [0] * shards, 0
    for _ in range(table_size):
        i = turn % shards
        offset, skip = prefer[i]
        while slots[(offset + at[i] * skip) % table_size] >= 0:
            at[i] += 1
        slots[(offset + at[i] * skip) % table_size] = i
        turn += 1
    hex_slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {table_size})"
    return f"WITH t AS (SELECT [{','.join(map(str, slots))}] AS shards) SELECT d.*, {hex_slot}::INT AS slot, 'shard-' || lpad(shards[{hex_slot} + 1]::VARCHAR, 3, '0') AS shard FROM documents d, t"


def write_sharded(docs: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, parts_per_shard: int | None = None) -> None:
    """Write ``docs`` as Parquet, one folder a shard; each shard is dealt over ``parts_per_shard`` tasks by a hash of the row, so that no task holds a whole one and a hot key doesn't land in one; by default as many as make up the session's shuffle partitions, 8 at least."""
    placed = place(docs, key, shards)
    many = parts_per_shard or max(8, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(shards or range(SHARDS))))
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map"))), F.lit(many))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
