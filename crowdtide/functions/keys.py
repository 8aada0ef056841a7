"""Times as key text, deterministic ids and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdtide.functions.numbers import round_half_away


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def rfc3339(ts: Column) -> Column:
    """UTC text with the fraction trimmed of trailing zeros; assumes a UTC session time zone."""
    body = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(body, r"\.?0+$", ""), F.lit("Z"))


def hash_identity(salt: str, name: Column) -> Column:
    who = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    who = F.when(who == "", "unknown").otherwise(who)
    return F.sha2(F.concat(F.lit(salt + ":"), who), 256)


def overlap_micros(l_start: Column, l_end: Column, r_start: Column, r_end: Column) -> Column:
    return F.greatest(F.lit(0), micros(F.least(l_end, r_end)) - micros(F.greatest(l_start, r_start)))


def overlap_seconds(l_start: Column, l_end: Column, r_start: Column, r_end: Column) -> Column:
    return overlap_micros(l_start, l_end, r_start, r_end) / F.lit(1e6)


def window_key(session: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.trim(session), rfc3339(start), rfc3339(end))


def fixed_decimals(x: Column, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits, e.g. 0.500."""
    return F.format_string(f"%.{digits}f", x)


def insight_id(session: Column, channel: Column, kind: Column, start: Column, end: Column, severity: Column) -> Column:
    text = F.concat_ws(
        "|", session, channel, kind, rfc3339(start), rfc3339(end), fixed_decimals(round_half_away(severity, 3), 3)
    )
    return F.concat(F.lit("ins_"), F.left(F.sha1(text), F.lit(16)))
