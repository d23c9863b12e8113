"""Time as columns: localised instants, epoch seconds, cyclic calendar cells and their labels. No UDFs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMAT = "%d-%m-%Y %H:%M:%S"

#: strptime directives and their datetime patterns.
DIRECTIVES = {
    "%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%a": "EEE", "%A": "EEEE", "%%": "%",
}


def java_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern; literal letters are quoted."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] not in DIRECTIVES:
                raise ValueError(f"directive {fmt[i : i + 2]!r} isn't supported")
            out.append(DIRECTIVES[fmt[i : i + 2]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i])
            i += 1
    return "".join(out)


def localize(wall: Column, zone: Column | str) -> Column:
    """The instant (as UTC wall time) of a local wall time; a time that occurs twice is the later, in standard time."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    at = F.to_utc_timestamp(wall.cast("timestamp_ntz"), zone).cast("timestamp_ntz")
    out = at
    for minutes in (30, 60):
        later = at + F.expr(f"INTERVAL {minutes} MINUTES")
        again = F.from_utc_timestamp(later, zone).cast("timestamp_ntz") == wall.cast("timestamp_ntz")
        out = F.when(again, later).otherwise(out)
    return out


def standardize_time(text: Column, zone: Column | str, fmt: str = TIME_FORMAT) -> Column:
    """UTC wall time of a local time given as text; null if it can't be read."""
    return localize(F.try_to_timestamp(text, F.lit(java_pattern(fmt))).cast("timestamp_ntz"), zone)


def transform_time(utc: Column, zone: Column | str) -> Column:
    """The same instant as wall time of another zone, for display."""
    return F.from_utc_timestamp(utc, F.lit(zone) if isinstance(zone, str) else zone).cast("timestamp_ntz")


def as_seconds(utc: Column) -> Column:
    """Epoch seconds, with fractions, of UTC wall time."""
    return F.unix_micros(F.to_utc_timestamp(utc, F.current_timezone())) / F.lit(1e6)


def offset_text(utc: Column, zone: Column | str) -> Column:
    """ISO text with a blank separator and the zone's offset at that instant."""
    wall = transform_time(utc, zone)
    minutes = ((as_seconds(wall) - as_seconds(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    ahead = F.abs(minutes)
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(ahead / 60).cast("int"), (ahead % 60).cast("int")))


def time_fields(text: Column, zone: Column | str, duration: Column, fmt: str = TIME_FORMAT) -> dict[str, Column]:
    """standardStart, standardStop (text), absStart and absStop (epoch seconds) of a recording."""
    return span_fields(standardize_time(text, zone, fmt), zone, duration)


def span_fields(start: Column, zone: Column | str, duration: Column) -> dict[str, Column]:
    """:func:`time_fields` of a start that is known, as UTC wall time."""
    stop = start + F.make_dt_interval(secs=duration.cast("decimal(18,6)"))
    return {"standardStart": offset_text(start, zone), "standardStop": offset_text(stop, zone), "absStart": as_seconds(start), "absStop": as_seconds(start) + duration}


def start_seconds(start_date: str, zone: str, fmt: str = TIME_FORMAT) -> Column:
    """Epoch seconds of a start date, a constant of the plan."""
    datetime.strptime(start_date, fmt)  # a wrong date is an error here, not a null later
    return as_seconds(standardize_time(F.lit(start_date), zone, fmt))


def time_cell(seconds: Column, start: Column | float, unit: float = 3600, modulo: int | None = 24) -> Column:
    """Calendar cell of an instant: units since the start, rounded half to even, modulo a cycle.

    Time before the start counts back from the end of a cycle. Without a modulo cells don't wrap.
    """
    start = start if isinstance(start, Column) else F.lit(float(start))
    since = seconds - start
    if modulo is None:
        return F.bround(since / unit).cast("long")
    return F.pmod(F.bround(F.pmod(since, F.lit(float(unit) * modulo)) / unit), F.lit(float(modulo))).cast("long")


def cell_label(cell: Column, start: Column, unit: float = 3600, pattern: str = "HH:mm:ss") -> Column:
    """Text of the time at which a cell starts; ``start`` is a wall time."""
    return F.date_format(start + F.make_dt_interval(secs=(cell * unit).cast("decimal(18,6)")), pattern)


def axis_labels(spark: SparkSession, low: int, high: int, count: int, start: Column, unit: float = 3600, pattern: str = "HH:mm:ss") -> DataFrame:
    """(timeCell, label) of about ``count`` evenly spaced cells from low to high; ``start`` is the wall time of the lowest."""
    step = max((high - low + 1) // max(count, 1), 1)
    cells = spark.range(low, high + 1, step).withColumnRenamed("id", "timeCell")
    return cells.select("timeCell", cell_label(F.col("timeCell") - F.lit(low), start, unit, pattern).alias("label"))


def in_range(seconds: Column, limits: tuple[str, str], zone: str, fmt: str = TIME_FORMAT) -> Column:
    """Whether an instant lies between two local times, both included."""
    return seconds.between(start_seconds(limits[0], zone, fmt), start_seconds(limits[1], zone, fmt))
