"""Text functions: file names, fixed decimals, digit strings and record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What follows the last / or \\."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def without_extension(name: Column) -> Column:
    """The name up to its last dot; all of it where there is none."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    """What follows the last dot; empty where there is none."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def compressible(name: Column) -> Column:
    """Whether a file name is that of a structure text, gzipped or not."""
    return name.rlike(r"\.(pdb|cif)(\.gz)?$")


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column, separator: str) -> Column:
    """Non-empty pieces between separators."""
    return F.filter(F.split(text, F.lit(r"\Q" + separator + r"\E")), lambda w: w != "")


def strip_blanks(text: Column) -> Column:
    """Without blanks and tabs at either end."""
    return F.trim(text, F.lit(" \t"))


def fixed_decimals(value: Column, places: int) -> Column:
    """Half a unit is added away from zero and the rest is cut off: text with so many decimals."""
    scale = 10**places
    units = F.floor(F.abs(value) * scale + 0.5).cast("long")
    sign = F.when((value < 0) & (units > 0), "-").otherwise("")
    whole = F.concat(sign, F.floor(units / scale).cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((units % scale).cast("string"), places, "0")) if places else whole


def confidence_digits(value: Column, digits: int, unit_scale: Column | bool = False) -> Column:
    """One to four digits of a confidence of 0 to 100, cut off rather than rounded.

    One digit stands for tens, two for whole numbers, three and four add decimals. On
    the unit scale a value of 0 to 1 counts as its hundredfold, for one or two digits.
    The top of the scale stays at the last digit, 9.
    """
    digits = max(1, min(4, digits))
    unit = F.lit(unit_scale) if isinstance(unit_scale, bool) else unit_scale
    v = F.when(unit & F.lit(digits <= 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 100).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))
    tens = F.least(F.floor(v / 10), F.lit(9)).cast("int").cast("string")
    if digits == 1:
        return tens
    two = F.concat(tens, (F.floor(v) % 10).cast("int").cast("string"))
    if digits == 2:
        return two
    three = F.concat(two, F.lit("."), (F.floor(v * 10) % 10).cast("int").cast("string"))
    return three if digits == 3 else F.concat(three, (F.floor(v * 100) % 10).cast("int").cast("string"))


def cut(line: Column, start: int, end: int) -> Column:
    """Columns start to end of a record, counted from 1, trimmed."""
    return F.trim(F.substring(line, start, end - start + 1))


def hybrid_number(field: Column, width: int) -> Column:
    """A decimal number, or one in base 36 that goes on where width digits end."""
    top = 10**width
    base36 = F.conv(field, 36, 10).cast("long") - 10 * 36 ** (width - 1) + top
    lower = base36 + 26 * 36 ** (width - 1)
    first = F.substring(field, 1, 1)
    return F.when(field.rlike(r"^[+-]?\d+$"), field.try_cast("long")).when(first.rlike("[A-Z]"), base36).when(first.rlike("[a-z]"), lower)


def iso_date(field: Column) -> Column:
    """A date DD-MON-YY as YYYY-MM-DD; years beyond 60 are those of the twentieth century."""
    months = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
    month = F.array_position(F.array(*[F.lit(m) for m in months]), F.upper(F.substring(field, 4, 3)))
    year = F.concat(F.when(F.substring(field, 8, 1) > "6", "19").otherwise("20"), F.substring(field, 8, 2))
    return F.when(month > 0, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.substring(field, 1, 2)))
