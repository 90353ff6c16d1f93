"""Blocked Bloom filter in DataFrame operations: one 64-bit word a block, BITS_SET bits a key, one block read for each key.

A filter never says no to a key that it holds.  It has 16 bits a key up to MAX_BLOCKS; beyond
that its answers stay right and only pass more, so whatever it passes is joined exactly later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_name

BITS_SET = 4
KEYS_A_BLOCK = 4
#: A filter is broadcast; it never holds more blocks than this (16 bytes each).
MAX_BLOCKS = 1 << 19


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """The key's bits inside its block: six-bit slices of a second hash."""
    second = F.xxhash64(key, F.lit("block"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_SET)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def build(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """(block, word) rows of the filter of ``keys``, and the number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, count // KEYS_A_BLOCK + 1))
    return keys.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word")), blocks


def marked(rows: DataFrame, key: str, keys: DataFrame, own: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only if the row's key is not among ``keys``.  The count of keys reaches the driver."""
    words, blocks = build(keys, own, keys.count())
    block, word = field_name(rows, "bloom_block"), field_name(rows, "bloom_word")
    words = words.select(F.col("block").alias(block), F.col("word").alias(word))
    mask = mask_of(F.col(f"`{key}`"))
    joined = rows.withColumn(block, block_of(F.col(f"`{key}`"), blocks)).join(F.broadcast(words), block, "left")
    return joined.withColumn(flag, F.coalesce(F.col(word).bitwiseAND(mask) == mask, F.lit(False))).drop(block, word)


def possible(rows: DataFrame, key: str, keys: DataFrame, own: str) -> DataFrame:
    """The rows whose key may be among ``keys``."""
    flag = field_name(rows, "bloom_flag")
    return marked(rows, key, keys, own, flag).where(F.col(flag)).drop(flag)
