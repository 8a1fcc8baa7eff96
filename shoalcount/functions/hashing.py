"""Portable hashes: the same value in any SQL engine, so draws and orders can be replayed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """Unsigned 32-bit integer from the MD5 of the parts joined with ':'."""
    cols = [F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts]
    text = F.concat_ws(":", *cols)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


#: Fixed value: the multiplier of a well-known 32-bit integer mixer.
MIXER = 0x45D9F3B


def mix32(x: Column) -> Column:
    """A well-mixed 32-bit number from a whole number of 0 to 2^32 - 1; products stay below 2^63."""

    def step(x: Column) -> Column:
        return (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIXER)).bitwiseAND(F.lit(2**32 - 1))

    return _named(_named(_named(x, step), step), lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def _named(x: Column, fn) -> Column:
    """fn(x), with x written once however often fn uses it."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def mix32_array(x: np.ndarray) -> np.ndarray:
    """:func:`mix32` of an array of unsigned 32-bit numbers, which it overwrites."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIXER)
    x ^= x >> np.uint32(16)
    return x


def draw_key(stream: Column, draw: Column) -> Column:
    """The key of a numbered draw (0 to 2^63 - 1) of a stream (0 to 2^32 - 1)."""
    low = F.lit(2**32 - 1)
    return mix32((mix32((stream + draw.bitwiseAND(low)).bitwiseAND(low)) + F.shiftright(draw, 32)).bitwiseAND(low))


def drawn(stream: Column, draw: Column, slot: Column, n: Column) -> Column:
    """What a draw takes for a slot: a number below n."""
    return mix32(draw_key(stream, draw).bitwiseXOR(mix32(slot.bitwiseAND(F.lit(2**32 - 1))))) % n


def draw_keys(stream: int, draws: np.ndarray) -> np.ndarray:
    """:func:`draw_key` of an array of draws."""
    draws = draws.astype(np.uint64)
    inner = mix32_array((draws + np.uint64(stream)).astype(np.uint32))
    return mix32_array(inner + (draws >> np.uint64(32)).astype(np.uint32))


def hash_bucket(hashed: Column, spark: SparkSession) -> Column:
    """A bucket of a 32-bit hash that never decreases with it; as many as the session shuffles into.

    Positions taken over such buckets do not depend on how many there are.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return F.floor(hashed * parts / float(2**32))


def seed64(text: Column) -> Column:
    """First 8 bytes of the SHA-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_key(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON: cache keys and request hashes."""
    return F.sha2(canonical_json(**fields), 256)
