"""Time stamps and durations in the notations found in logs, probes and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of textual durations, in seconds.
DURATION_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def srt_seconds(stamp: Column) -> Column:
    """`HH:MM:SS,mmm` to seconds; anything else is 0."""
    s = F.trim(stamp)
    ok = s.rlike(r"^\d+:\d+:\d+,\d+$")
    p = F.split(s, "[:,]")

    def n(i: int) -> Column:
        return F.get(p, i).try_cast("double")

    return F.when(ok, n(0) * 3600 + n(1) * 60 + n(2) + n(3) / 1000).otherwise(0.0)


def srt_stamp(seconds: Column) -> Column:
    total = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(total / 3_600_000), F.floor(total / 60_000) % 60,
                           F.floor(total / 1000) % 60, total % 1000)


def log_time(text: Column) -> Column:
    """RFC 3339 or `yyyy-MM-dd HH:mm:ss` in UTC; NULL otherwise."""
    t = F.trim(text)
    rfc = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    plain = t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    cut = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(rfc | plain, cut.try_cast("timestamp"))


def text_duration(text: Column) -> Column:
    """`1h2m3.5s` to seconds, NULL when malformed."""
    number = r"(\d+\.?\d*|\.\d+)"
    unit = r"(h|ms|m|s|us|µs|ns)"
    ok = text.rlike(rf"^[+-]?({number}{unit})+$")
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(number + unit), 1).alias("v"),
                         F.regexp_extract_all(text, F.lit(number + unit), 2).alias("u"))
    scale = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["v"].try_cast("double") * F.element_at(scale, p["u"]))
    return F.when(ok, F.when(text.startswith("-"), -total).otherwise(total))


def log_duration_seconds(text: Column) -> Column:
    """A stage duration: textual form, or plain nanoseconds from older files; missing or not positive is 0."""
    nanos = text.try_cast("double") / 1e9
    value = F.coalesce(F.when(text.rlike(r"^[+-]?[\d.]+([eE][+-]?\d+)?$"), nanos), text_duration(text))
    return F.when(value > 0, value).otherwise(0.0)


def media_duration_seconds(text: Column) -> Column:
    """Plain seconds or `H:M:S.fff`; NULL when neither."""
    t = F.trim(text)
    p = F.split(t, ":")
    clock = F.get(p, 0).try_cast("double") * 3600 + F.get(p, 1).try_cast("double") * 60 + F.get(p, 2).try_cast("double")
    return F.when(F.size(p) == 3, clock).when(F.size(p) == 1, t.try_cast("double"))
