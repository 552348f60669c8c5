"""Hashes as plain column expressions; all are replayable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How every suggestion id begins.
ID_PREFIX = "inj_"


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def md5_prefix_number(text: Column) -> Column:
    """The first 8 hex digits of the md5 as a number, 0 .. 2^32-1."""
    return _hex_number(F.substring(F.md5(text), 1, 8))


def md5_modulus(digest: Column, n: int) -> Column:
    """A 32-digit hex digest, read as one big-endian number, modulo n.

    The digest is cut into 2 + 15 + 15 digits, so that every piece fits a signed 64-bit long.
    """
    shift = pow(16, 15, n)
    high = _hex_number(F.substring(digest, 1, 2)) % n
    middle = (high * shift + _hex_number(F.substring(digest, 3, 15))) % n
    return ((middle * shift + _hex_number(F.substring(digest, 18, 15))) % n).cast("int")


def bucket(text: Column, n_features: int) -> Column:
    """Slot of one feature string in the hashed vector."""
    return md5_modulus(F.md5(text), n_features)


def bucket_set(features: Column, n_features: int) -> Column:
    """Sorted distinct slots of an array of feature strings; collisions merge."""
    digests = F.transform(features, lambda f: F.md5(f.cast("binary")))
    slots = F.transform(digests, lambda d: md5_modulus(d, n_features))
    return F.sort_array(F.array_distinct(slots))


def injection_id(session_id: Column, suggestion_no: Column) -> Column:
    """Id of a session's n-th suggestion. A retried batch emits the same id again."""
    digest = F.md5(F.concat(session_id, F.lit(":"), suggestion_no.cast("string")).cast("binary"))
    return F.concat(F.lit(ID_PREFIX), F.substring(digest, 1, 8))


def draw(session_id: Column, batch_id: Column, name: str) -> Column:
    """A replayable pseudo-random number per session and batch."""
    key = F.concat(session_id, F.lit(":"), batch_id.cast("string"), F.lit(":" + name))
    return md5_prefix_number(key.cast("binary"))
