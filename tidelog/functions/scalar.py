"""Scalar functions of the log as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes of the service, and those of them that a client may retry.
ERROR_CODES = {
    0: "UNKNOWN", 1: "TOPIC_NOT_FOUND", 3: "SCHEMA_NOT_FOUND", 4: "INCOMPATIBLE_SCHEMA", 5: "INVALID_OFFSET", 6: "GROUP_NOT_FOUND", 7: "NOT_MEMBER",
    9: "NOT_OWNER", 10: "RATE_LIMITED", 11: "INTERNAL_ERROR", 12: "UNAUTHENTICATED", 13: "UNAUTHORIZED", 14: "DUPLICATE_SEQUENCE", 15: "INVALID_SEQUENCE",
}
RETRYABLE = (10, 11)
#: Status codes on the wire.
WIRE_CODES = {
    0: "OK", 1001: "AUTHZ_DENIED", 1002: "DECODE_ERROR", 1003: "INVALID_MESSAGE_TYPE", 1004: "BACKPRESSURE", 1005: "INTERNAL_ERROR",
    1006: "NOT_OWNER", 1007: "STALE_SEQUENCE", 1008: "SEQUENCE_IN_FLIGHT", 1009: "MAX_INFLIGHT",
}


def record_size(key: Column, value: Column) -> Column:
    """Bytes of key and value; a null key has none."""
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.octet_length(value)).cast("long")


def varint_size(n: Column) -> Column:
    """Bytes of a zigzag varint of a non-negative length, or of -1."""
    z = F.when(n < 0, -2 * n - 1).otherwise(2 * n)
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(z < (1 << 7 * k), F.lit(k)).otherwise(out)
    return out.cast("long")


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of a record in a segment: length and bytes of key and value, length -1 for a null key."""
    k, v = F.octet_length(key), F.octet_length(value)
    return (varint_size(F.coalesce(k, F.lit(-1))) + F.coalesce(k, F.lit(0)) + varint_size(v) + v).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def is_admin(principal: Column) -> Column:
    return (principal == "admin") | principal.startswith("admin:")


def principal_kind(principal: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(principal.contains(":"), F.split_part(principal, F.lit(":"), F.lit(1)))


def object_key(prefix: str, micros_col: Column, counter: Column) -> Column:
    """prefix/YYYY-MM-DD/millis-counter.fl"""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros_col / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    return F.concat(F.lit(prefix + "/"), day, F.lit("/"), F.floor(micros_col / 1000).cast("string"), F.lit("-"), counter.cast("string"), F.lit(".fl"))
