"""Scalar functions over codes, labels, numbers and text (``Column`` to ``Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__missing__"

# County codes and names.
COUNTY_NAMES = {
    "01": "Budapest",
    "02": "Baranya",
    "03": "Bacs-Kiskun",
    "04": "Bekes",
    "05": "Borsod-Abauj-Zemplen",
    "06": "Csongrad-Csanad",
    "07": "Fejer",
    "08": "Gyor-Moson-Sopron",
    "09": "Hajdu-Bihar",
    "10": "Heves",
    "11": "Jasz-Nagykun-Szolnok",
    "12": "Komarom-Esztergom",
    "13": "Nograd",
    "14": "Pest",
    "15": "Somogy",
    "16": "Szabolcs-Szatmar-Bereg",
    "17": "Tolna",
    "18": "Vas",
    "19": "Veszprem",
    "20": "Zala",
}


def zero_filled(code: Column, width: int) -> Column:
    """Digits are filled with zeros to ``width``; longer or non-digit codes stay as they are (FN1)."""
    s = F.trim(code.cast("string"))
    return F.when(s.rlike("^[0-9]+$") & (F.length(s) < width), F.lpad(s, width, "0")).otherwise(s)


def unit_id(maz: Column, taz: Column, szk: Column) -> Column:
    """County, settlement and unit code as one id (FN2); null if a part is null."""
    return F.concat(zero_filled(maz, 2), F.lit("-"), zero_filled(taz, 3), F.lit("-"), zero_filled(szk, 3))


def county_code(code: Column) -> Column:
    return zero_filled(code, 2)


def optional_int(value: Column) -> Column:
    """Null or empty is null; anything but an integer is null too (FN4)."""
    return F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("bigint")


def safe_float(value: Column) -> Column:
    """Null unless a finite number (FN8)."""
    x = value.cast("string").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def compact_label(label: Column) -> Column:
    """What stands before the first parenthesis (FN12)."""
    return F.trim(F.substring_index(F.trim(label), "(", 1))


def county_label(code: Column, names: dict[str, str] = COUNTY_NAMES) -> Column:
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    c = county_code(code)
    return F.coalesce(F.try_element_at(known, c), F.concat(F.lit("maz "), c))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100.0)


def percentage_points(delta: Column) -> Column:
    return F.format_string("%+.1f pp", delta * 100.0)


def stable_colour(label: Column, prefix: str = "") -> Column:
    """``#`` and the first six hex digits of the label's md5 (FN14)."""
    return F.concat(F.lit("#"), F.substring(F.md5(F.concat(F.lit(prefix), label)), 1, 6))


def column_draw(name: Column) -> Column:
    """Draw index of a wide column ``d000123``, null for other names (FN18)."""
    return F.nullif(F.regexp_extract(name, r"^d(\d{6})$", 1), F.lit("")).cast("int")


def draw_column(index: int) -> str:
    return f"d{index:06d}"


def district_key(district: Column) -> Column:
    """Text key of a district, with a marker for none (FN21)."""
    return F.coalesce(district.cast("int").cast("string"), F.lit(MISSING))


def draw_list(text: Column) -> Column:
    """Comma-separated draws in order of first mention (ORD6)."""
    parts = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


# Fixed value: what counts as a mention of the effective sample size in a sampler's log.
ESS_PATTERN = r"(?im)(effective\s+sample\s+size|(^|\s)ESS\s*[:=])"


def log_scan(text: Column, excerpt_chars: int = 4000) -> Column:
    """Status, mentions of effective sample size, and the end of a sampler log (FN15)."""
    empty = text.isNull() | (F.trim(text) == "")
    return F.struct(
        F.when(empty, "empty_or_unreadable").otherwise("scanned").alias("parse_status"),
        F.when(empty, F.lit(0)).otherwise(F.regexp_count(text, F.lit(ESS_PATTERN))).cast("bigint").alias("ess_line_hits"),
        F.when(~empty, F.right(text, F.lit(excerpt_chars))).alias("excerpt_suffix"),
    )


def json_object(keys: Column, values: Column) -> Column:
    return F.to_json(F.map_from_arrays(keys, values))


def joined_reasons(*pairs: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in order, joined by ``"; "`` (FN20)."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull()), "; ")


SEVERITIES = ("ok", "warn", "severe")


def worst_severity(*pairs: tuple[Column, int]) -> Column:
    rank = F.greatest(F.lit(0), *(F.when(c, F.lit(r)).otherwise(F.lit(0)) for c, r in pairs))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)
