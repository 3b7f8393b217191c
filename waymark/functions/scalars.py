"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation types in the order of their indicator columns, week days, and cyclic frequencies.
RELATION_TYPES = ("EURST", "EXTRA", "IC", "ICE", "INT", "L", "P", "TGV", "THAL", "S", "CHARTER", "nan")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
EVENT_TYPES = ("A", "D", "P")
FREQUENCIES = (1, 2, 4)


def finite(c: Column) -> Column:
    """NaN and infinities as NULL: the engine never holds them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean_text(c: Column) -> Column:
    """Without white space at the ends; the text ``nan`` and an empty text are NULL."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def wall_clock(day: Column, time: Column) -> Column:
    """``02JAN2024`` and ``08:15:00`` as a zone-free timestamp; NULL if either is bad."""
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.lower(clean_text(day))), clean_text(time)), F.lit("ddMMMyyyy HH:mm:ss")).cast("timestamp_ntz")


def service_day(day: Column) -> Column:
    """``02JAN2024`` as a date; NULL if bad."""
    return F.try_to_timestamp(F.initcap(F.lower(clean_text(day))), F.lit("ddMMMyyyy")).cast("date")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, for exact arithmetic."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def seconds_between(late: Column, early: Column) -> Column:
    return (micros(late) - micros(early)) / F.lit(1e6)


def last_known_delay(past_delay: Column, snapshot: Column, next_planned: Column) -> Column:
    """The last delay seen, or more where the next event is overdue by more than that."""
    return F.greatest(past_delay.cast("double"), seconds_between(snapshot, next_planned))


def event_code(kind: Column, placeholder: Column) -> Column:
    """-1 for a placeholder, 0 arrival, 1 departure, 2 passage."""
    return F.when(placeholder, -1).when(kind == "A", 0).when(kind == "D", 1).otherwise(2).cast("tinyint")


def signed_sqrt(c: Column) -> Column:
    return F.signum(c) * F.sqrt(F.abs(c))


def signed_square(c: Column) -> Column:
    return F.signum(c) * c * c


def z_score(c: Column, mean: Column, std: Column) -> Column:
    """Centred, and scaled where the deviation is a positive number."""
    return F.when((std > 0), (c - mean) / std).otherwise(c - mean)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1] and clipped; 0 where the range is empty."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low)))).otherwise(F.lit(0.0))


def un_min_max(c: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, c * (high - low) + low).otherwise(low)


def right_bin(value: Column, edges: list[float], clip: bool = True) -> Column:
    """Index of the left-closed bin of value; outside values go to the first or last bin, or are NULL without clip."""
    out = F.lit(0 if clip else None).cast("int")
    for k, edge in enumerate(edges[:-1]):
        out = F.when(value >= edge, k).otherwise(out)
    if not clip:
        out = F.when(value < edges[-1], out)
    return F.when(value.isNotNull(), out)


def bin_label(edges: list[float], unit: str) -> list[str]:
    show = lambda x: str(x) if x in (float("inf"), float("-inf")) else str(int(x))
    return [f"[{show(a)},{show(b)}){unit}" for a, b in zip(edges, edges[1:], strict=False)]


def histogram_bin(value: Column, edges: list[float]) -> Column:
    """Left-closed bins, the last one closed on both sides; NULL outside."""
    last = len(edges) - 2
    return F.when((value >= edges[last]) & (value <= edges[-1]), last).otherwise(right_bin(value, edges, clip=False))


def relation_type(relation: Column) -> Column:
    """First word; every ``S`` line is one type; NULL outside the list; a NULL relation is the type ``nan``."""
    name = F.upper(clean_text(relation))
    word = F.when(name.startswith("S"), "S").otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    return F.when(name.isNull(), "nan").when(word.isin(*RELATION_TYPES), word)


def indicators(c: Column, values, prefix: str) -> list[Column]:
    """0/1 columns, all 0 for NULL or a value outside the list."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def day_fraction(ts: Column) -> Column:
    return (F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0) / 24.0


def year_fraction(ts: Column) -> Column:
    """How far into a year of 365 days a date is, from its day number."""
    return F.dayofyear(ts) / F.lit(365.0)


def cyclic(fraction: Column, prefix: str, frequencies=FREQUENCIES) -> list[Column]:
    angle = lambda k: fraction * F.lit(6.283185307179586 * k)
    return [f(angle(k)).alias(f"{prefix}_{n}_{k}") for k in frequencies for n, f in (("sin", F.sin), ("cos", F.cos))]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def first_token(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
