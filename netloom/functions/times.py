"""Wall-clock helpers: truncation, ages and relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hour_of(c: Column | str) -> Column:
    """Start of the hour as a wall clock."""
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def trunc_to(unit: str, c: Column | str) -> Column:
    """Start of a calendar unit as a wall clock."""
    return F.date_trunc(unit, col(c)).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a UTC wall clock."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c: Column) -> Column:
    """Inverse of `micros`."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def bin_start(c: Column | str, length_us: int) -> Column:
    """Start of the epoch-aligned bin of a fixed length."""
    us = micros(c)
    return from_micros(us - F.pmod(us, F.lit(length_us)))


def now_literal(now) -> Column:
    """A moment given as text, datetime or column."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def minutes_since(c: Column | str, now) -> Column:
    """Whole minutes from `c` to `now`, rounded half away from zero."""
    seconds = (micros(now_literal(now)) - micros(c)) / F.lit(1_000_000)
    return F.round(seconds / 60, 0).cast("long")


def to_abs_time(received: Column, clock: Column, t: Column) -> Column:
    """Absolute time of a record stamped `t` ms on a sender whose clock reads `clock` ms.

    A stamp of zero means that the event did not happen.
    """
    age_us = (clock - t) * 1000
    return F.when(t != 0, from_micros(micros(received) - age_us))


def age_text(minutes: Column) -> Column:
    """Age for a board: days above 2880 minutes, hours above 240, else minutes."""
    return (
        F.when(minutes > 2880, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .when(minutes > 240, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )


def days_hours(seconds: Column) -> Column:
    """Duration as whole days and the remaining whole hours."""
    whole = F.floor(seconds)
    days = F.floor(whole / 86400)
    return F.struct(days.alias("days"), F.floor((whole - days * 86400) / 3600).alias("hours"))


def version_of(ts: Column | str, bits: int = 31) -> Column:
    """Version number of a change: half minutes since the epoch modulo 2**bits."""
    return F.pmod(F.floor(micros(ts) / 30_000_000), F.lit(2**bits)).cast("long")


def fresh(clock: Column, t: Column) -> Column:
    """Not older than a day (in ms) on the sender's clock; zero stamps are fresh."""
    return (t <= 0) | (clock - t <= 86_400_000)
