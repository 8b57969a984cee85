"""Reading dates and times out of text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, January first. Fixed values of the languages.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}

_ACCENTED, _PLAIN = "éèêûôäöüñáíóú", "eeeuoaounaiou"
_SEP = "\u0001"

# After the date: hour, minute, second, fraction, half of the day, zone.
_TIME = (
    r"(?:,?[\sTt]\s*(?:at\s|um\s|à\s|a\slas\s)?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    r"(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?(?:\s*([^\s\d:.,].*))?)?$"
)
_FORMS = {
    # year month day as digits, led by the year
    "ymd": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*([^\s\d:.,].*)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    # two short numbers and a year, order by the source
    "xxy": (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    # day, month name, year, with a weekday or without
    "dmy": (
        r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})\.?(?:\s+de)?[\s-]+(\p{L}+)\.?,?(?:\s+del?)?[\s-]+(\d{4})" + _TIME,
        "$3|$2|$1|$4|$5|$6|$7|$8|$9",
    ),
    # month name, day, year
    "mdy": (
        r"^(?:\p{L}+\.?,\s+)?(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME,
        "$3|$1|$2|$4|$5|$6|$7|$8|$9",
    ),
}


def squeeze(c: Column) -> Column:
    """Outer blanks off, inner runs of white space to one blank, by Unicode's idea of white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"(?U)[\s\p{Z}]+", " ")


def month_number(name: Column) -> Column:
    """1 to 12 for a month name of ``MONTHS`` or its abbreviation of three letters or more; else NULL."""
    n = F.translate(F.lower(name), _ACCENTED, _PLAIN)
    out = None
    for m in range(12):
        forms = sorted({_fold(w.split()[m]) for w in MONTHS.values()})
        # an abbreviation is a prefix of a name; three letters tell months apart but for juin and juillet
        hit = F.lit(False)
        for f in forms:
            least = 4 if f.startswith(("jui", "mar")) else 3
            hit = hit | (F.lit(f).startswith(n) & (F.length(n) >= least))
        if m == 2:
            hit = hit | (n == "mar")
        out = F.when(hit, m + 1) if out is None else out.when(hit, m + 1)
    return out


def _fold(w: str) -> str:
    return w.translate(str.maketrans(_ACCENTED, _PLAIN))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by arithmetic; no error for odd input."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    mp = F.pmod(m + 9, F.lit(12))
    doy = F.floor((mp * 153 + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parts(text: Column) -> Column:
    """Array of [form, year, month, day, hour, minute, second, fraction, half, zone], or NULL if no form fits."""
    out = None
    for form, (pattern, template) in _FORMS.items():
        made = F.split(F.regexp_replace(text, pattern, _SEP.join([form, *template.split("|")])), _SEP)
        hit = text.rlike(pattern)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out
