"""Font encodings and widths: byte to character, glyph name to character, and widths of the standard fonts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of bytes 0x80 to 0x9F in the Windows encoding.
WIN_HIGH = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6,
    0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C,
    0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}

# Where the standard encoding differs from ASCII.
STANDARD_SPECIAL = {
    0x27: 0x2019, 0x60: 0x2018, 0xA4: 0x2044, 0xA6: 0x0192, 0xA8: 0x00A4, 0xA9: 0x0027, 0xAA: 0x201C, 0xAB: 0x00AB,
    0xAC: 0x2039, 0xAD: 0x203A, 0xAE: 0xFB01, 0xAF: 0xFB02, 0xB1: 0x2013, 0xB2: 0x2020, 0xB3: 0x2021, 0xB4: 0x00B7,
    0xB7: 0x2022, 0xB8: 0x201A, 0xB9: 0x201E, 0xBA: 0x201D, 0xBC: 0x2026, 0xBD: 0x2030, 0xC1: 0x0060, 0xC2: 0x00B4,
    0xC3: 0x02C6, 0xC4: 0x02DC, 0xD0: 0x2014, 0xE1: 0x00C6, 0xE8: 0x0141, 0xE9: 0x00D8, 0xEA: 0x0152, 0xF1: 0x00E6,
    0xF8: 0x0142, 0xF9: 0x00F8, 0xFA: 0x0153, 0xFB: 0x00DF,
}

# Published names of digits, signs and letters without accents that go by a name, in code order.
GLYPH_NAMES = {
    "space": 0x20, "exclam": 0x21, "quotedbl": 0x22, "numbersign": 0x23, "dollar": 0x24, "percent": 0x25,
    "ampersand": 0x26, "quotesingle": 0x27, "parenleft": 0x28, "parenright": 0x29, "asterisk": 0x2A, "plus": 0x2B,
    "comma": 0x2C, "hyphen": 0x2D, "period": 0x2E, "slash": 0x2F, "zero": 0x30, "one": 0x31, "two": 0x32, "three": 0x33,
    "four": 0x34, "five": 0x35, "six": 0x36, "seven": 0x37, "eight": 0x38, "nine": 0x39, "colon": 0x3A,
    "semicolon": 0x3B, "less": 0x3C, "equal": 0x3D, "greater": 0x3E, "question": 0x3F, "at": 0x40, "bracketleft": 0x5B,
    "backslash": 0x5C, "bracketright": 0x5D, "asciicircum": 0x5E, "underscore": 0x5F, "grave": 0x60, "braceleft": 0x7B,
    "bar": 0x7C, "braceright": 0x7D, "asciitilde": 0x7E, "nbspace": 0xA0, "exclamdown": 0xA1, "cent": 0xA2,
    "sterling": 0xA3, "currency": 0xA4, "yen": 0xA5, "brokenbar": 0xA6, "section": 0xA7, "dieresis": 0xA8,
    "copyright": 0xA9, "ordfeminine": 0xAA, "guillemotleft": 0xAB, "logicalnot": 0xAC, "sfthyphen": 0xAD,
    "registered": 0xAE, "macron": 0xAF, "degree": 0xB0, "plusminus": 0xB1, "twosuperior": 0xB2, "threesuperior": 0xB3,
    "acute": 0xB4, "mu": 0xB5, "paragraph": 0xB6, "middot": 0xB7, "periodcentered": 0xB7, "cedilla": 0xB8,
    "onesuperior": 0xB9, "ordmasculine": 0xBA, "guillemotright": 0xBB, "onequarter": 0xBC, "onehalf": 0xBD,
    "threequarters": 0xBE, "questiondown": 0xBF, "AE": 0xC6, "Eth": 0xD0, "multiply": 0xD7, "Oslash": 0xD8,
    "Thorn": 0xDE, "germandbls": 0xDF, "ae": 0xE6, "eth": 0xF0, "divide": 0xF7, "oslash": 0xF8, "thorn": 0xFE,
    "dotlessi": 0x131, "Lslash": 0x141, "lslash": 0x142, "OE": 0x152, "oe": 0x153, "florin": 0x192, "circumflex": 0x2C6,
    "caron": 0x2C7, "breve": 0x2D8, "dotaccent": 0x2D9, "ring": 0x2DA, "ogonek": 0x2DB, "tilde": 0x2DC,
    "hungarumlaut": 0x2DD, "endash": 0x2013, "emdash": 0x2014, "quoteleft": 0x2018, "quoteright": 0x2019,
    "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020,
    "daggerdbl": 0x2021, "bullet": 0x2022, "ellipsis": 0x2026, "perthousand": 0x2030, "guilsinglleft": 0x2039,
    "guilsinglright": 0x203A, "fraction": 0x2044, "Euro": 0x20AC, "trademark": 0x2122, "minus": 0x2212, "fi": 0xFB01,
    "fl": 0xFB02,
}

#: Accented letters are named by letter and accent; Unicode composes them. The accents' combining forms.
ACCENTS = {
    "grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307,
    "dieresis": 0x308, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C, "cedilla": 0x327, "ogonek": 0x328,
}
ACCENTED = re.compile(rf"^([A-Za-z])({'|'.join(ACCENTS)})$")

# Published widths, in thousandths of an em, of characters 32 to 126.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
TIMES = [
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722,
    556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500,
    500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
]
FIXED_WIDTH, OTHER_WIDTH = 600, 556


def win_ansi(byte: int) -> int:
    return WIN_HIGH.get(byte, byte)


def standard(byte: int) -> int | None:
    """Character of a byte in the standard encoding; None for a byte that it leaves open."""
    return STANDARD_SPECIAL.get(byte, byte if byte < 0x80 else None)


def glyph_name(name: str) -> int | None:
    """Character of a glyph name: single letters and digits, known names, accented letters, uniXXXX and uXXXX forms."""
    if len(name) == 1 and name.isascii() and name.isalnum():
        return ord(name)
    if name in GLYPH_NAMES:
        return GLYPH_NAMES[name]
    if m := ACCENTED.match(name):
        letter = unicodedata.normalize("NFC", m[1] + chr(ACCENTS[m[2]]))
        if len(letter) == 1:
            return ord(letter)
    if m := re.match(r"uni([0-9A-Fa-f]{4})", name) or re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name):
        return int(m[1], 16)
    return None


def standard_width(base_font: str, char: int) -> int:
    """Width of a character in a font known by name alone."""
    name = base_font.lower()
    if "courier" in name or "mono" in name:
        return FIXED_WIDTH
    widths = TIMES if "times" in name or "serif" in name else HELVETICA
    return widths[char - 32] if 32 <= char <= 126 else OTHER_WIDTH


def width_column(base_font: Column, char: Column) -> Column:
    """standard_width as an expression; `char` is a code point."""
    name = F.lower(base_font)
    at = lambda widths: F.element_at(F.array(*map(F.lit, widths)), (char - 31).cast("int"))
    inside = char.between(32, 126)
    return (
        F.when(name.contains("courier") | name.contains("mono"), FIXED_WIDTH)
        .when(~inside, OTHER_WIDTH)
        .when(name.contains("times") | name.contains("serif"), at(TIMES))
        .otherwise(at(HELVETICA))
    )


def measure_column(base_font: Column, text: Column) -> Column:
    """Width of a text in thousandths of an em."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda total, c: total + width_column(base_font, F.unicode(c) if hasattr(F, "unicode") else F.ascii(c)))
