"""Sharding by a permutation-filled lookup table (operator 6).

Every shard has its own permutation of the slots of a prime-sized table, fixed by two hashes of its name: slots offset, offset
+ skip, ... Shards take turns and each claims its first free slot, until the table is full. Shards so hold equal
shares within one slot, and when a shard leaves, few slots of the others change hands. Placing a row
is one hash and one look-up: the table, of ``slots`` rows whatever the data, is broadcast.

Cases: a null key is placed as the text ``null``; equal keys share a shard, repeated rows stay; an
empty table stays empty; the columns ``slot`` and ``shard`` of the input, if any, are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.llm.common import table

SLOTS = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
HEX_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """Slot -> number of the shard. ``slots`` must be a prime of more than the number of shards."""
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be some different names")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint") % slots


def assign(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard`` (its number in ``shards``)."""
    rows = list(enumerate(fill(shards, slots)))
    lookup = df.sparkSession.createDataFrame(rows, "__slot bigint, shard int")
    placed = df.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    placed = placed.join(F.broadcast(lookup), placed["slot"] == lookup["__slot"]).drop("__slot")
    return placed


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id"))


def _oracle() -> str:
    """Slots are claimed in rounds here by rank: an own reckoning of the same table."""
    prefer = [[(_number(f"offset:{s}") + j * (_number(f"skip:{s}") % (SLOTS - 1) + 1)) % SLOTS for j in range(SLOTS)] for s in SHARDS]
    owner: dict[int, int] = {}
    turn = 0
    heads = [iter(p) for p in prefer]
    while len(owner) < SLOTS:
        k = turn % len(SHARDS)
        slot = next(x for x in heads[k] if x not in owner)
        owner[slot] = k
        turn += 1
    listed = ", ".join(str(owner[i]) for i in range(SLOTS))
    return f"""
WITH t AS (SELECT [{listed}] AS owner)
SELECT doc_id, slot, owner[slot + 1]::INT AS shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {HEX_DIGITS}))::BIGINT % {SLOTS} AS slot FROM documents), t
"""


QUERIES = {"op6_sharding": op6_sharding}
ORACLES = {"op6_sharding": _oracle}
