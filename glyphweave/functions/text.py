"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pivot_index(length: Column) -> Column:
    """Which letter of a word the eye rests on."""
    return F.when(length <= 1, 0).when(length <= 5, 1).when(length <= 9, 2).when(length <= 13, 3).otherwise(4)


def dwell(text: Column) -> Column:
    """How long a word is shown, as a multiple of the usual time."""
    long = F.when(F.length(text) > 8, 0.3).otherwise(0.0)
    stop = F.when(text.rlike("[.,;:!?]$"), 0.6).otherwise(0.0)
    return F.lit(1.0) + long + stop


def pivot_split(text: Column, width: int = 12) -> dict[str, Column]:
    """The parts before, at and after the pivot letter, padded to `width` but never cut."""
    at = pivot_index(F.length(text))
    pre, post = F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text))
    padded = lambda s, pad: F.when(F.length(s) >= width, s).otherwise(pad(s, width, " "))
    return {"pre": padded(pre, F.lpad), "pivot": F.substring(text, at + 1, F.lit(1)), "post": padded(post, F.rpad)}


def format_bytes(n: Column) -> Column:
    kilo, mega = 1024, 1024 * 1024
    return (
        F.when(n < kilo, F.format_string("%d B", n.cast("long")))
        .when(n < mega, F.format_string("%.1f KB", n / kilo))
        .otherwise(F.format_string("%.1f MB", n / mega))
    )


def format_number(n: Column, decimals: int) -> Column:
    """At most `decimals` decimals, without trailing zeros; never "-0"."""
    text = F.format_string(f"%.{decimals}f", n.cast("double"))
    short = F.regexp_replace(text, r"\.?0+$", "") if decimals else text
    return F.when(short == "-0", "0").otherwise(short)


def half_up(x: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(x + 0.5)


def filename_from_url(url: Column) -> Column:
    """Last path segment, decoded; "document.pdf" if there is none or the URL can't be read."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    name = F.element_at(F.split(path, "/"), -1)
    decoded = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(F.coalesce(name, F.lit("")) == "", "document.pdf").otherwise(F.coalesce(decoded, F.lit("document.pdf")))


def export_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("_edited.pdf"))


def data_url_bytes(url: Column) -> Column:
    """What follows the first comma of a data URL, decoded."""
    return F.try_to_binary(F.substring(url, F.locate(",", url) + 1, F.length(url)), F.lit("base64"))


def squeeze(text: Column) -> Column:
    """Runs of white space, no-break spaces too, as one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def hex_string(text: Column) -> Column:
    """Bytes of a hexadecimal string: other characters are skipped, an odd digit gets a zero."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def utf16be(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def bytes_to_code(data: Column) -> Column:
    """Big-endian number of up to eight bytes."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def is_dirty(version: Column, exported: Column) -> Column:
    return ~version.eqNullSafe(exported)


def date_stamp(moment: Column) -> Column:
    """Day of a moment in UTC."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd")


def seek(share: Column, n: Column) -> Column:
    """Feed position at a share of the way, clamped."""
    return F.greatest(F.lit(0), F.least(n - 1, half_up(share * (n - 1))))


def step_position(position: Column, by: int, n: Column) -> Column:
    """Feed position some words on or back, kept within the feed."""
    return F.greatest(F.lit(0), F.least(n - 1, position + by))


def progress(position: Column, n: Column) -> Column:
    """How far a feed position is, in per cent."""
    return F.when(n > 1, position / (n - 1) * 100).otherwise(F.lit(0.0))


def change_speed(words_per_minute: Column, steps: int) -> Column:
    """Reading speed some steps of 25 up or down, between 60 and 1200 words a minute."""
    return F.greatest(F.lit(60), F.least(F.lit(1200), words_per_minute + 25 * steps))


def wrap_text(text: Column, width: int) -> Column:
    """Greedy lines of at most `width` characters; a longer word has a line of its own; no words give one empty line.

    A line is what a greedy pattern takes from the squeezed text up to a space or the end.
    """
    flat = squeeze(text)
    lines = F.regexp_extract_all(flat, F.lit(f"(.{{1,{width}}}|[^ ]+)(?: |$)"), F.lit(1))
    return F.when(flat == "", F.array(F.lit(""))).otherwise(lines)
