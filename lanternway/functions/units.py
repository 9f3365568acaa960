"""Reading quantities of speed written by hand: the number, and the unit as it is spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h in one of each unit.
KMH_PER_UNIT = {"km/h": "1", "mph": "1.609344", "knot": "1.852", "m/s": "3.6", "m/min": "0.06", "0.1 km/h": "0.1", "ft/s": "1.09728", "cm/s": "0.036"}

_PER = r"(?:\s*/\s*|\s+(?:per|a|an|each|in|in a|in an|in one|je|pro|par|por|the)\s+)"
_HOUR = r"(?:hours?|hrs?|h|std|stunden?|heures?|horas?|час|ч|घंटा|घंटे)"
_MIN = r"(?:minutes?|mins?|minuten?|minutos?|min|минуту|мин)"
_SEC = r"(?:seconds?|secs?|sekunden?|secondes?|segundos?|sek|sec|s|секунду|сек|с)"
_METRE = r"(?:met(?:re|er)s?|meter[n]?|mètres?|metros?|m|метров|метр|м)"
_KM = r"(?:kilomet(?:re|er)s?|kilometern?|kilomètres?|kilómetros?|kms?|км|километров)"
_MILE = r"(?:statute\s+miles?|miles?|meilen?|milles?|millas?|mi|миль|миля)"
_NMILE = r"(?:nautical\s+miles?|sea\s+miles?|seemeilen?|milles?\s+(?:marins?|nautiques?)|millas?\s+náuticas?|nmi|sm|морск\w+\s+мил\w+)"
_END = r"(?![\p{L}])"
_BEGIN = r"(?<![\p{L}])"

#: Spellings by unit, tried in this order: the more special before those they contain. Fixed patterns.
SPELLINGS = (
    ("0.1 km/h", rf"(?:{_BEGIN}tenths?(?:\s+of)?(?:\s+(?:a|one))?\s*(?:{_KM}{_PER}{_HOUR}|km/?h|kmh|kph)|0[.,]1\s*(?:km/?h|kmh|kph)|{_BEGIN}d(?:eci)?km/?h|zehntel\s+km/?h){_END}"),
    ("knot", rf"{_BEGIN}(?:knots?|kts?|kns?|n[œo]e?uds?|noeuds?|knoten|nudos?|узл\w*|узел|уз|nós|नॉट|ノット|{_NMILE}{_PER}{_HOUR}){_END}"),
    ("mph", rf"{_BEGIN}(?:mph|m\.\s?p\.\s?h\.?|mi\.?/h|mi\s?/\s?hr?|{_MILE}{_PER}{_HOUR}|miles\s+hourly|मील/घंटा){_END}"),
    ("km/h", rf"{_BEGIN}(?:km\s?/\s?hr?|kmh|kmph|kph|km\s?-?\s?h|km\s?h\s?[-−]\s?1|{_KM}{_PER}{_HOUR}|кмч|किमी/घंटा){_END}"),
    ("m/min", rf"{_BEGIN}(?:m\s*min\s*[-−]\s*1|{_METRE}{_PER}{_MIN}|{_METRE}\s+(?:\w+\s+)?(?:in|per|each|every)\s+(?:one|a|each|every)?\s*{_MIN}){_END}"),
    ("m/s", rf"{_BEGIN}(?:mps|m\s*s\s*[-−]\s*1|m\.s[-−]1|{_METRE}{_PER}{_SEC}){_END}"),
    ("ft/s", rf"{_BEGIN}(?:fps|ft\s?/\s?s|feet\s+(?:per|a)\s+second){_END}"),
    ("cm/s", rf"{_BEGIN}(?:cm\s?/\s?s|centimet(?:re|er)s?\s+(?:per|a)\s+second){_END}"),
)
#: Number words, fixed values.
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
_NUM = r"([-−–]?(?:\d+(?:[.,]\d+)?|[.,]\d+))"


def plain(text: Column) -> Column:
    """Lower case, full-width forms made plain, odd spaces and invisible characters removed."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    slim = "".join(chr(0x21 + k) for k in range(94))
    t = F.translate(text, wide + "　   ⁻¹ſ", slim + "    -1s")
    t = F.regexp_replace(t, "[​‌‍⁠﻿­]", "")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def unit_in(text: Column) -> Column:
    """The unit of speed that a text names, as a key of KMH_PER_UNIT; null if none."""
    t = plain(text)
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(SPELLINGS):
        out = F.when(t.rlike(pattern), F.lit(unit)).otherwise(out)
    return out


def unit_in_prose(text: Column) -> Column:
    """The unit of a bare figure according to a sentence about it, as feeds' notes are.

    Besides the spellings, prose may put a few words between a length and the time it is covered in.
    """
    t = plain(text)
    between = r"\s+(?:[\p{L}]+\s+){0,3}(?:in|per|each|every|an?)\s+(?:(?:one|single|each|every|an?)\s+)?"
    loose = F.lit(None).cast("string")
    for unit, length, time in (("km/h", _KM, _HOUR), ("mph", _MILE, _HOUR), ("m/min", _METRE, _MIN), ("m/s", _METRE, _SEC)):
        loose = F.coalesce(loose, F.when(t.rlike(f"{_BEGIN}{length}{between}{time}{_END}"), F.lit(unit)))
    return F.coalesce(unit_in(text), loose)


def speed_number(text: Column) -> Column:
    """The number of a written speed, DECIMAL(18,6); null if it states none.

    The number before the unit is meant, else the one after it, else, in a text without a unit, its
    only plain number behind marks of vagueness ("max", "ca.", "~", "<="); remarks in brackets and after
    a comma with a blank, and counters such as "km 12:", are passed over. A comma is a decimal comma.
    """
    t = F.regexp_replace(plain(text), r"\([^)]*\)|\[[^\]]*\]", " ")
    any_unit = "(?:" + "|".join(p for _, p in SPELLINGS).replace(_BEGIN, "") + ")"
    before = F.regexp_extract(t, rf"(?<![\d.,]){_NUM}\s*{any_unit}", 1)
    after = F.regexp_extract(t, rf"{_BEGIN}{any_unit}\s*[:=]?\s*{_NUM}(?![\d.,])", 1)
    tail = F.regexp_replace(F.regexp_replace(t, r", .*$", ""), r"^[\p{L}. ]+\d+\s*:\s*", "")
    bare = F.regexp_extract(tail, rf"^(?:[~≈<>=≤≥ ]|max(?:imum)?\.?|min(?:imum)?\.?|ca\.?|circa|about|approx\.?|etwa|env\.?|up to|under|limit:?|=)*\s*{_NUM}\s*[.;!?*]?$", 1)
    pick = lambda c: F.when(c != "", c)
    digits = F.coalesce(pick(before), pick(after), pick(bare))
    number = F.regexp_replace(F.regexp_replace(digits, ",", "."), "[−–]", "-").try_cast("decimal(18,6)")
    return F.coalesce(number, _worded(F.regexp_replace(t, r"[-–]", " ")))


def _worded(t: Column) -> Column:
    """A number written out in English at the start of a text ("thirty-five mph")."""
    table = F.create_map(*[x for k, v in WORDS.items() for x in (F.lit(k), F.lit(v))])
    words = F.split(F.regexp_replace(t, r"^(?:max(?:imum)?\.?|ca\.?|about|limit:?)\s+", ""), r"\s+")
    # Words at the start as long as they are number words: hundreds multiply, the rest add.
    fold = F.aggregate(
        words,
        F.struct(F.lit(0).alias("sum"), F.lit(True).alias("go"), F.lit(0).alias("n")),
        lambda a, w: F.when(
            a["go"] & table[w].isNotNull(),
            F.struct(F.when(w == "hundred", F.greatest(a["sum"], F.lit(1)) * 100).otherwise(a["sum"] + table[w]).alias("sum"), F.lit(True).alias("go"), (a["n"] + 1).alias("n")),
        ).otherwise(F.struct(a["sum"].alias("sum"), F.lit(False).alias("go"), a["n"].alias("n"))),
    )
    starts = t.rlike(r"^(?:(?:max(?:imum)?\.?|ca\.?|about|limit:?)\s+)?(?:" + "|".join(WORDS) + r")\b")
    return F.when(starts, fold["sum"].cast("decimal(18,6)"))


def to_kmh_x100(number: Column, unit: Column) -> Column:
    """Hundredths of km/h, exact decimal arithmetic, rounded half up."""
    factor = F.lit(None).cast("decimal(9,6)")
    for u, f in KMH_PER_UNIT.items():
        factor = F.when(unit == u, F.lit(f).cast("decimal(9,6)")).otherwise(factor)
    return F.round(number * factor * 100, 0).cast("long")
