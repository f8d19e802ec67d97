"""32-bit string hashes as folds, digests, shards and bloom probes, all inside the JVM.

The hashes run over UTF-16 units, so a character beyond the basic plane counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a's offset and prime, the other hash's seed and factor.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
SEED33, FACTOR33 = 5381, 33
#: Bits and probes of a shard's bloom filter.
BLOOM_BITS, BLOOM_HASHES = 131072, 4
SHARDS = 64
_LOW = (1 << 32) - 1


def _units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("bigint"))


def fnv1a(text: Column) -> Column:
    return F.aggregate(_units(text), F.lit(FNV_OFFSET).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_LOW)))


def times33(text: Column) -> Column:
    return F.aggregate(_units(text), F.lit(SEED33).cast("bigint"), lambda h, u: (h * FACTOR33).bitwiseAND(F.lit(_LOW)).bitwiseXOR(u))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def bloom_positions(token: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The bits of a token: h1 + i * h2 modulo 2^32, then modulo the filter's size; h2 is 1 where it would be 0."""
    first, second = fnv1a(token), times33(token)
    step = F.when(second == 0, F.lit(1).cast("bigint")).otherwise(second)
    return F.array(*(((first + (step * i).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW)) % bits).cast("int") for i in range(hashes)))


def shard_of(index: Column, shards: int = SHARDS) -> Column:
    return F.pmod(index, F.lit(shards)).cast("int")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
