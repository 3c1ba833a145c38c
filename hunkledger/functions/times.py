"""Times as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
    r"(?:Z|[+-](?:[01][0-9]|2[0-4]):(?:[0-5][0-9]|60))\z"
)


def rfc3339(ts: Column) -> Column:
    """RFC 3339 text in UTC, whatever the session's time zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, NULL for anything else.

    The offset is subtracted by hand: Spark's cast accepts far looser texts and fewer
    offsets.
    """

    zulu = F.endswith(text, F.lit("Z"))
    local = F.left(text, F.length(text) - F.when(zulu, 1).otherwise(6))
    moment = F.concat(F.replace(local, F.lit(","), F.lit(".")), F.lit("Z")).try_cast("timestamp")
    sign = F.when(F.substring(text, -6, 1) == "-", 1).otherwise(-1)
    hours = F.substring(text, -5, 2).try_cast("int")
    minutes = F.substring(text, -2, 2).try_cast("int")
    shift = F.make_dt_interval(secs=sign * (hours * 3600 + minutes * 60))
    return F.when(
        F.rlike(text, F.lit(_RFC3339)), F.when(zulu, moment).otherwise(moment + shift)
    )
