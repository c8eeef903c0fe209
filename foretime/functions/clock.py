"""Wall clock and zones, session zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretime.functions.scalar import col

_UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def local_to_utc(wall: Column | str, zone: Column | str) -> Column:
    """Instant of a local wall-clock time.

    A time that occurs twice (clocks going back) is NULL; a time that does not
    exist (clocks going forward) moves to the first instant after the gap.
    """
    wall, zone = col(wall), col(zone)
    first = F.to_utc_timestamp(wall, zone)
    back = F.from_utc_timestamp(first, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = ((F.from_utc_timestamp(first + hour, zone) == wall)
             | (F.from_utc_timestamp(first - hour, zone) == wall))
    # in a gap the clock has already been pushed past it; gaps start and end on whole hours
    return (F.when(twice, F.lit(None).cast("timestamp"))
            .when(back == wall, first).otherwise(F.date_trunc("hour", first)))


def kickoff(day: Column | str, time: Column | str, zone: Column | str,
            default_time: str = "13:00") -> Column:
    """Date text plus time text in a zone, as a UTC instant; a missing time takes the default."""
    text = F.concat_ws(" ", col(day), F.coalesce(col(time), F.lit(default_time)))
    return local_to_utc(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), zone)


def utc_offset_hours(when: Column | str, zone: Column | str, repeated: str = "first") -> Column:
    """Hours ahead of UTC in ``zone`` when its wall clock shows ``when``.

    A time that occurs twice (clocks going back) counts as its ``repeated`` occurrence, ``first`` or
    ``last``; a time that does not exist (clocks going forward) as one by the clock before the change.
    """
    when, zone = col(when), col(zone)
    first = F.to_utc_timestamp(when, zone)
    if repeated == "first":
        return (F.unix_timestamp(when) - F.unix_timestamp(first)) / 3600.0
    day = F.expr("INTERVAL 24 HOURS")
    # the same wall time by the offset of a day later: an instant of its own only where it occurs twice
    later = first + day - (F.from_utc_timestamp(first + day, zone) - when)
    at = F.when(F.from_utc_timestamp(later, zone) == when, later).otherwise(first)
    return (F.unix_timestamp(when) - F.unix_timestamp(at)) / 3600.0


def iso_utc(when: Column | str) -> Column:
    return F.date_format(col(when), _UTC_TEXT)


def local_start(when: Column | str, zone: str) -> Column:
    """Text such as ``Sun 9/27 10:00 AM`` in a zone."""
    return F.date_format(F.from_utc_timestamp(col(when), zone), "EEE M/d h:mm a")


def broadcast_slot(when: Column | str, zone: str = "America/New_York") -> Column:
    """Slot of a start time: any Monday, Thursday or Sunday from 7 PM local, else NULL."""
    local = F.from_utc_timestamp(col(when), zone)
    day, late = F.dayofweek(local), F.hour(local) >= 19
    return (F.when(day == 2, "MNF").when((day == 5) & late, "TNF").when((day == 1) & late, "SNF"))
