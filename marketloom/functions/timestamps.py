"""Mixed timestamp texts to one UTC instant, inside the JVM.

All spellings are one regular expression: an alternation of named groups. One replace call extracts
every component of a text at once; ranges are checked on the components; the instant is put together
with integer day arithmetic. Only the offset of a wall time in a named zone asks the zone rules.
"""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number (Polish, English, German, Spanish), as prefixes that tell them apart.
MONTHS = {
    1: ("sty", "jan", "jän", "ene"),
    2: ("lut", "feb"),
    3: ("mar", "mär", "mrz"),
    4: ("kwi", "apr", "abr"),
    5: ("maj", "may", "mai"),
    6: ("cze", "jun"),
    7: ("lip", "jul"),
    8: ("sie", "aug", "ago"),
    9: ("wrz", "sep"),
    10: ("paź", "paz", "oct", "okt"),
    11: ("lis", "nov"),
    12: ("gru", "dec", "dez", "dic"),
}

# Minutes east of UTC of the zone abbreviations that feeds write.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "BRT": -180, "BRST": -120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_CLOCK = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"
_ZONE = r"(?:\s*(?<z>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\[(?<rg>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+){0,2})\])?)?"
_HALF = r"(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)"
_GODZ = r"(?:,?\s*(?:godz\.?|o|at|um|a las)?\s*)"

#: name -> pattern; the first that fits the whole text is taken. Group names mean the same in each.
FORMATS = {
    "dashed": rf"(?<y>\d{{4}})-(?<mo>\d{{1,2}})-(?<d>\d{{1,2}})(?:[Tt\s]\s*{_CLOCK}{_ZONE})?",
    "compact": r"(?<y>\d{4})(?<mo>\d{2})(?<d>\d{2})[Tt](?<h>\d{2})(?<mi>\d{2})(?:(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?" + _ZONE,
    "slashed": rf"(?<y>\d{{4}})/(?<mo>\d{{1,2}})/(?<d>\d{{1,2}})(?:\s+{_CLOCK}{_ZONE})?",
    "yeardots": rf"(?<y>\d{{4}})\.(?<mo>\d{{1,2}})\.(?<d>\d{{1,2}})(?:\s+{_CLOCK}{_ZONE})?",
    "monthfirst": rf"(?<mo>\d{{1,2}})/(?<d>\d{{1,2}})/(?<y>\d{{4}}|\d{{2}})(?:{_GODZ}{_CLOCK}{_HALF}?{_ZONE})?",
    "dayfirst": rf"(?<d>\d{{1,2}})(?:\.|-)(?<mo>\d{{1,2}})(?:\.|-)(?<y>\d{{4}}|\d{{2}})(?:{_GODZ}{_CLOCK}{_HALF}?{_ZONE})?",
    "named": rf"(?:[^\W\d_]{{2,12}}\.?,?\s+)?(?<d>\d{{1,2}})\.?[\s-]+(?<mn>[^\W\d_]{{3,12}})\.?,?[\s-]+(?<y>\d{{4}}|\d{{2}})(?:{_GODZ}{_CLOCK}{_HALF}?{_ZONE})?",
    "namefirst": rf"(?:[^\W\d_]{{2,12}}\.?,\s+)?(?<mn>[^\W\d_]{{3,12}})\.?\s+(?<d>\d{{1,2}}),?\s+(?<y>\d{{4}})(?:{_GODZ}{_CLOCK}{_HALF}?{_ZONE})?",
    "number": r"(?<e>[+-]?\d{1,17})(?:[.,](?<ef>\d{1,9}))?",
}
_SLOTS = ("y", "mo", "mn", "d", "h", "mi", "s", "f", "ap", "z", "rg", "e", "ef")


def _compiled() -> tuple[str, str]:
    """The alternation, its groups renamed apart, and the replacement that lists every slot."""
    parts, owners = [], {slot: [] for slot in _SLOTS}
    for name, pattern in FORMATS.items():
        for slot in dict.fromkeys(re.findall(r"\(\?<(\w+)>", pattern)):
            owners[slot].append(f"${{{slot}{name}}}")
        parts.append(re.sub(r"\(\?<(\w+)>", rf"(?<\g<1>{name}>", pattern))
    return r"(?U)^\s*(?:" + "|".join(parts) + r")\s*$", "\u0001".join("".join(owners[s]) for s in _SLOTS)


PATTERN, SLOTS_OUT = _compiled()
_ZONES = sorted(available_timezones() | {"UTC"})


def _days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers (years are positive here)."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(shifted / 400).cast("bigint")
    of_era = shifted - era * 400
    day_of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5).cast("bigint") + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4).cast("bigint") - F.floor(of_era / 100).cast("bigint") + day_of_year - 719468


def _month_of_name(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("bigint")
    for number, prefixes in MONTHS.items():
        out = F.when(F.substring(low, 1, 3).isin(*prefixes), F.lit(number).cast("bigint")).otherwise(out)
    return out


def _zone_minutes(zone: Column) -> Column:
    upper = F.upper(zone)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("bigint"), F.coalesce(F.substring(digits, 3, 2).try_cast("bigint"), F.lit(0))
    signed = F.when((hours <= 18) & (minutes < 60), F.when(zone.startswith("-"), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes))
    out = F.when(zone.rlike("^[+-]"), signed)
    for name, value in ZONE_MINUTES.items():
        out = out.when(upper == name, F.lit(value).cast("bigint"))
    return out


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: a bound variable, which the optimizer does not inline."""
    return F.get(F.transform(F.array(value), then), 0)


def utc_micros(text: Column, feed_zone: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp text, or null.

    Null for: null, blank or unreadable text; a date, a time of day or a zone that does not exist; a wall
    time that the clocks skip; a text without a zone where ``feed_zone`` is null or unknown. A wall time
    shown twice is its first occurrence. Parts that are not written are zero. Bare numbers are seconds
    below 1e11, milliseconds below 1e14, else microseconds. The session's time zone has no part in it.
    """
    flat = F.regexp_replace(text, PATTERN, "\u0002" + SLOTS_OUT)
    slots = _let(flat, lambda x: F.when(x.startswith("\u0002"), F.split(F.substr(x, F.lit(2)), "\u0001")))
    return _let(_let(_let(_let(F.struct(slots.alias("p"), feed_zone.alias("tz")), _components), _calendar), _zones), _instant)


def _components(x: Column) -> Column:
    raw = {name: F.get(x["p"], i) for i, name in enumerate(_SLOTS)}
    num = lambda k: raw[k].try_cast("bigint")
    return F.struct(
        (num("y") + F.when(F.length(raw["y"]) == 2, 2000).otherwise(0)).alias("y"),
        F.coalesce(num("mo"), _month_of_name(raw["mn"])).alias("m"),
        num("d").alias("d"),
        F.coalesce(num("h"), F.lit(0)).alias("h"),
        F.coalesce(num("mi"), F.lit(0)).alias("mi"),
        F.coalesce(num("s"), F.lit(0)).alias("s"),
        F.coalesce(F.rpad(F.substring(raw["f"], 1, 6), 6, "0").try_cast("bigint"), F.lit(0)).alias("f"),
        F.lower(raw["ap"]).alias("ap"),
        raw["z"].alias("z"),
        F.when(raw["rg"] != "", raw["rg"]).otherwise(x["tz"]).alias("rg"),
        num("e").alias("e"),
        raw["e"].startswith("-").alias("minus"),
        F.coalesce(F.rpad(F.substring(raw["ef"], 1, 9), 9, "0").try_cast("bigint"), F.lit(0)).alias("ef"),
    )


def _calendar(x: Column) -> Column:
    y, m, d, h = x["y"], x["m"], x["d"], x["h"]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when(x["ap"] == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(x["ap"] == "p", 12).otherwise(0))
    day = F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest), _days_from_civil(y, m, d))
    clock = x["mi"].between(0, 59) & x["s"].between(0, 59)
    known = F.when(x["rg"].isin(*_ZONES), x["rg"])
    return F.struct(hour.alias("hour"), day.alias("day"), clock.alias("clock"), known.alias("known"), *[x[k].alias(k) for k in ("mi", "s", "f", "z", "e", "minus", "ef")])


def _zones(x: Column) -> Column:
    real = x["hour"].between(0, 23) & x["clock"]
    wall = F.when(real, (((x["day"] * 24 + x["hour"]) * 60 + x["mi"]) * 60 + x["s"]) * 1_000_000 + x["f"])
    utc = _let(F.struct(F.timestamp_micros(wall).alias("w"), x["known"].alias("k")), lambda v: F.struct(v["w"], v["k"], F.to_utc_timestamp(v["w"], v["k"]).alias("u")))
    in_zone = _let(utc, lambda v: F.when(F.from_utc_timestamp(v["u"], v["k"]) == v["w"], F.unix_micros(v["u"])))
    return F.struct(wall.alias("wall"), F.when(x["z"] == "", in_zone).alias("in_zone"), *[x[k].alias(k) for k in ("z", "e", "minus", "ef")])


def _instant(x: Column) -> Column:
    zoned = F.when(x["z"] != "", x["wall"] - _zone_minutes(x["z"]) * 60_000_000).otherwise(x["in_zone"])
    count = x["e"]
    unit = F.when(F.abs(count) < 10**11, 1_000_000).when(F.abs(count) < 10**14, 1_000).otherwise(1)
    rest = F.floor(x["ef"] * unit / 1_000_000_000).cast("bigint")
    counted = count * unit + F.when(x["minus"], -rest).otherwise(rest)
    return F.when(count.isNotNull(), counted).otherwise(zoned)
