"""Timestamp texts of the ISO family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, non_blank

ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,9}))?(Z|[+-]\d{2}(?::?\d{2})?)?$"


def iso_text(c: Column | str) -> Column:
    """One spelling for ISO timestamps: T between date and time, seconds and six digits where there are any, Z for UTC.

    Texts that aren't of the family stay as they are, blank ones are NULL.
    """
    text = non_blank(c)
    part = lambda g: F.regexp_extract(text, ISO, g)
    frac = F.substring(F.rpad(part(4), 6, "0"), 1, 6)
    zone = F.regexp_replace(F.regexp_replace(part(5), r"^([+-]\d{2})(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00")
    iso = F.concat(part(1), F.lit("T"), part(2), F.when(part(3) == "", ":00").otherwise(part(3)), F.when(frac == "000000", "").otherwise(F.concat(F.lit("."), frac)), F.when(zone.isin("+00:00", "-00:00"), "Z").otherwise(zone))
    return F.when(text.rlike(ISO), iso).otherwise(text)


def iso_instant(c: Column | str) -> Column:
    """The instant of an ISO text (no zone: UTC), NULL if it isn't one."""
    text = non_blank(c)
    zoned = F.when(F.regexp_extract(text, ISO, 5) == "", F.concat(text, F.lit("Z"))).otherwise(text)
    return F.when(text.rlike(ISO), iso_text(zoned).try_cast("timestamp"))


def latency_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two ISO texts, cut towards zero; NULL unless both can be read."""
    micros = F.unix_micros(iso_instant(as_col(end))) - F.unix_micros(iso_instant(as_col(start)))
    return F.when(micros >= 0, F.floor(micros / 1000)).otherwise(F.ceil(micros / 1000)).cast("bigint")
