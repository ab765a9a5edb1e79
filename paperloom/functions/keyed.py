"""Keyed hashes and permutations in SQL functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(salt: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex; pads are computed here, the salt itself is never written out."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def number_at(h: Column, at: int, digits: int = 8) -> Column:
    """Hex digits of a hash from place `at` (from 1) as a number; at most 15 digits."""
    return F.conv(F.substring(h, at, digits), 16, 10).cast("long")


def permuted(index: Column, side: int, key: Column, rounds: int = 4) -> Column:
    """A permutation of the numbers below side * side, chosen by `key`.

    A Feistel network whose halves are numbers below `side`, added modulo `side` instead of by bits:
    it is one-to-one on exactly side * side numbers, so no result falls outside and none is tried again.
    """
    start = F.struct(F.floor(index / F.lit(side)).cast("long").alias("l"), (index % F.lit(side)).cast("long").alias("r"))

    def turn(x: Column, i: Column) -> Column:
        step = number_at(F.sha2(F.concat_ws(":", key, i.cast("string"), x["r"].cast("string")), 256), 1, 12)
        return F.struct(x["r"].alias("l"), ((x["l"] + step % side) % side).alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(rounds))), start, turn, lambda x: x["l"] * side + x["r"])
