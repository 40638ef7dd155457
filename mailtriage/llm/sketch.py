"""Key sketches: which rows may have a key of a set, told without moving the rows.

A sketch is a table of bit maps: a key's hash names one of BUCKETS buckets and one of its 32,768 bits.
All buckets together take 8 MB at most, whatever the number of keys, so they may be broadcast at any
size of the data. A row whose bit is not set surely has no key of the set; one whose bit is set
may have none either (a chance of about keys / 2**26), so an exact step has to follow for the rows
that pass. A full sketch lets every row pass: results stay the same, only the saving is lost.

Only DataFrame functions are used. Null keys hash like any other value. An empty set lets no row pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

BUCKETS = 2048
BITS = 32_768


def _bucket(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 32), F.lit(BUCKETS)).cast("int")


def _bit(key: Column, detail: Column | None) -> Column:
    return F.pmod(key if detail is None else F.xxhash64(key, detail), F.lit(BITS)).cast("long")


def build(keys: DataFrame, key: Column, detail: Column | None = None) -> DataFrame:
    """The sketch of a table of keys (best without repeats): bucket, bits.

    key is a 64-bit hash. With detail, pairs of key and detail are held, and one sketch answers for
    several details of a row.
    """
    rows = keys.select(_bucket(key).alias("bucket"), _bit(key, detail).alias("bit"))
    # Keys travel as two numbers and meet in their bucket; maps of partial sums would be larger.
    return staged(rows.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "sketch")


def attach(rows: DataFrame, sketch: DataFrame, key: Column) -> tuple[DataFrame, str]:
    """rows with the bits of their key's bucket, and the name of that column."""
    bits, bucket = free_name(rows, "sketch_bits"), free_name(rows, "sketch_bucket")
    # BUCKETS rows of 4 KB at most: the code fixes the size of what is broadcast.
    maps = F.broadcast(sketch.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    return rows.join(maps, _bucket(key) == maps[bucket], "left").drop(bucket), bits


def may_hold(bits: str, key: Column, detail: Column | None = None) -> Column:
    """Whether a row's key (with detail) may be in the set."""
    at = _bit(key, detail)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def passing(rows: DataFrame, sketch: DataFrame, key: Column) -> DataFrame:
    """The rows whose key may be in the set, with their own columns."""
    held, bits = attach(rows, sketch, key)
    return held.where(may_hold(bits, key)).drop(bits)


def split(rows: DataFrame, key: Column, keys: DataFrame, of_keys: Column) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among those of keys, and rows whose key surely isn't; of_keys is the same
    hash over the columns of keys."""
    held, bits = attach(rows, build(keys, of_keys), key)
    may = may_hold(bits, key)
    return held.where(may).drop(bits), held.where(~may).drop(bits)


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """rows, all columns, whose column `name` isn't in gone, a table of one column of the same type
    (null is like any other value). Only rows that the sketch lets pass are ever shuffled."""
    gone = gone.toDF(free_name(rows, "gone"))
    met, stay = split(rows, F.xxhash64(name), gone, F.xxhash64(gone.columns[0]))
    return met.join(gone, met[name].eqNullSafe(gone[gone.columns[0]]), "left_anti").union(stay)
