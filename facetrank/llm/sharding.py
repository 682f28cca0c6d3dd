"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a permutation given by an offset and a
step. The shards take turns, each claiming the next free slot in its own order, until the table is full. So shares
differ by at most one slot, and when shards are added or removed, few slots change hands. A key's slot is a hash of the
key, and its shard is read from the table, which has a fixed size and is sent to all tasks.

Defined cases: a null key goes by the hash of null, so to one slot; equal keys go to the same shard; an empty table of
rows gives an empty result; columns named slot or shard are replaced. Where one key may have a great part of all rows,
``spread`` deals its rows over several neighbouring slots by a hash of the other columns named.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, about 1000 times the number of shards expected, so that shares differ by about 0.1 %.
SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that has each slot."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and at most one a slot")

    def number(name: str, use: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8])

    place = [number(s, "offset") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, slots: int = SLOTS, salt: Column | None = None, spread: int = 1) -> Column:
    """The slot of a key; with ``spread``, one of so many slots, by a hash of ``salt``."""
    base = F.pmod(F.xxhash64(key), F.lit(slots))
    if spread > 1 and salt is not None:
        base = F.pmod(base + F.pmod(F.xxhash64(salt), F.lit(spread)), F.lit(slots))
    return base.cast("int")


def assign(rows: DataFrame, key: str, shards: list[str], *, slots: int = SLOTS, salt: str | None = None, spread: int = 1) -> DataFrame:
    """``rows`` with slot (int) and shard (string)."""
    names = rows.drop("slot", "shard")
    where = slot(F.col(key), slots, None if salt is None else F.col(salt), spread)
    table = rows.sparkSession.createDataFrame([(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    return names.withColumn("slot", where).join(F.broadcast(table), "slot").select(*names.columns, "slot", "shard")


def moved(before: list[str], after: list[str], slots: int = SLOTS) -> int:
    """How many slots change hands between two lists of shards."""
    one, two = lookup_table(before, slots), lookup_table(after, slots)
    return sum(before[a] != after[b] for a, b in zip(one, two, strict=True))


def balance(assigned: DataFrame) -> DataFrame:
    """(shard, n_rows), one row per shard that has rows."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


def write_shards(assigned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per shard; tasks write what they have, so no shard is gathered in one task."""
    assigned.write.mode(mode).partitionBy("shard").parquet(path)
