"""Approximate membership ahead of an exact join: a blocked Bloom filter kept as a table.

A key belongs to one block of 256 bits, chosen by a hash, and sets eight bits in it.  The blocks are
made by a distributed aggregate of bit masks and take a tenth of the room of the keys, so they can be broadcast where
the keys themselves cannot.  A row whose key finds all eight bits may have a member; any other row has none and
need not be shuffled.
"""

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspan.operators.sizing import BROADCAST_BYTES, written

BITS_PER_KEY = 12
BLOCK_BITS = 256
_LONGS = 4
# Room of a block in the hash table that every executor holds.
BLOCK_BYTES = 96


@dataclass
class KeyFilter:
    """Blocks by number; `table` has block and the four longs of each block that is not empty."""

    table: DataFrame
    blocks: int


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(hashed: str) -> list[Column]:
    """Two bits in each of the longs, by the bits of a second hash."""

    def bit(shift: int) -> str:
        return f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {shift}) & 63 as int))"

    return [F.expr(f"{bit(12 * k)} | {bit(12 * k + 6)}") for k in range(_LONGS)]


def _second(key: Column) -> Column:
    return F.xxhash64(F.lit("second"), key)


def key_filter(keys: DataFrame, column: str, most_bytes: int = BROADCAST_BYTES) -> KeyFilter:
    """Filter of the values of a column of a written table.

    It grows with the number of keys up to `most_bytes`; beyond that it stays as large as it is and
    lets more rows pass that have no member, which the exact join then drops.
    """
    wanted = -(-keys.count() * BITS_PER_KEY // BLOCK_BITS)
    blocks = max(1, min(wanted, most_bytes // BLOCK_BYTES))
    key = F.col(f"`{column}`")
    hashed = keys.where(key.isNotNull()).select(_block(key, blocks).alias("block"), _second(key).alias("h"))
    masked = hashed.select("block", *[mask.alias(f"bits_{k}") for k, mask in enumerate(_masks("h"))])
    table = masked.groupBy("block").agg(*[F.bit_or(f"bits_{k}").alias(f"bits_{k}") for k in range(_LONGS)])
    return KeyFilter(written(table, "key-filter"), blocks)


def possible_members(df: DataFrame, columns: list[str], members: KeyFilter) -> DataFrame:
    """Rows of which one of the columns may be a member; its only joins are with the broadcast blocks."""
    found = df
    for k, column in enumerate(columns):
        key = F.col(f"`{column}`")
        found = found.withColumns({f"_block_{k}": F.when(key.isNotNull(), _block(key, members.blocks)), f"_hash_{k}": _second(key)})
    passed = []
    for k in range(len(columns)):
        names = [f"_bits_{k}_{j}" for j in range(_LONGS)]
        own = F.broadcast(members.table.toDF(f"_own_{k}", *names))
        found = found.join(own, F.col(f"_block_{k}") == F.col(f"_own_{k}"), "left")
        held = reduce(and_, [F.col(n).bitwiseAND(mask) == mask for n, mask in zip(names, _masks(f"_hash_{k}"))])
        passed.append(F.coalesce(held, F.lit(False)))
    return found.where(reduce(or_, passed)).select(*[F.col(f"`{c}`") for c in df.columns])
