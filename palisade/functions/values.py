"""Times, hashes and text forms of observed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import epoch_seconds, sha256


def duration_ms(text: Column) -> Column:
    """'12.5ms', '830µs' or '1.2s' in milliseconds."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(?:ms|µs|s)$", 1).try_cast("double")
    return (
        F.when(F.endswith(text, F.lit("ms")), number)
        .when(F.endswith(text, F.lit("µs")), number / 1000)
        .when(F.endswith(text, F.lit("s")), number * 1000)
    )


def expiry_days(not_after: Column, now: Column) -> Column:
    return (epoch_seconds(not_after) - epoch_seconds(now)) / 86400


def expiry_status(not_after: Column, now: Column) -> Column:
    days = expiry_days(not_after, now)
    return F.when(days.isNull(), None).when(days < 0, "expired").when(days <= K.EXPIRING_DAYS, "expiring").otherwise("valid")


def days_until_expiry(not_after: Column, now: Column) -> Column:
    return F.round(expiry_days(not_after, now), 1)


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of a canonical JSON object: keys sorted, NULLs kept, so that equal states hash equally."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return sha256(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


def text_value(c: Column, data_type: str) -> Column:
    """A change value as text: arrays element-wise, structs and maps as JSON, everything else cast."""
    if data_type.startswith("array"):
        return F.transform(c, lambda x: x.cast("string"))
    if data_type.startswith(("struct", "map")):
        return F.to_json(c)
    return c.cast("string")


def array_text(c: Column) -> Column:
    """Display form of a list value: '[a, b]'."""
    return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]")))


def content_id(*parts: Column) -> Column:
    """Deterministic id from a natural key."""
    return sha256(F.concat_ws("|", *parts))
