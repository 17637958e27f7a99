"""Scalar functions as Column expressions: hashes, tokens, cleaning, masking and number formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash_of(payload: Column) -> Column:
    """First 8 bytes of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(payload, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def unit_hash(seed: int, value: Column) -> Column:
    return unit_hash_of(F.concat(F.lit(f"{seed}:"), value))


def subject_token(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("-"), F.lit(" ")), r"\s+", " ")), " ", "_")


def clean(x: Column) -> Column:
    """Brackets as parentheses, semicolons as commas, white space as one blank."""
    return F.trim(F.regexp_replace(F.translate(x, "[];", "(),"), r"\s+", " "))


def mask(x: Column, identity: Column, marker: str = "[CASE_ENTITY]") -> Column:
    """Whole-word occurrences of an identity, in any case, as the marker."""
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), identity, F.lit(r"\E(?!\w)"))
    return F.when(identity.isNull() | (identity == ""), x).otherwise(F.regexp_replace(x, pattern, F.lit(marker)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression that uses a value many times and computes it once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _mantissa(digits: Column) -> Column:
    """Digits with a point after the first, without trailing zeros."""
    return F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 20)), r"\.?0*$", "")


def _exponent(power: Column) -> Column:
    digits = F.abs(power).cast("string")
    return F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, F.concat(F.lit("0"), digits)).otherwise(digits))


def _sign(x: Column) -> Column:
    return F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent of two digits below 0.0001 and from a million on."""
    a, short = F.abs(x), x.cast("string")

    def written(scientific: Column) -> Column:
        power = F.substring_index(scientific, "e", -1).cast("int")
        scale = F.pow(F.lit(10.0), F.lit(5) - power)
        plain = F.regexp_replace((F.rint(a * scale) / scale).cast("decimal(38,12)").cast("string"), r"\.?0*$", "")
        return F.when((power < -4) | (power >= 6), F.concat(_mantissa(F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.", "")), _exponent(power))).otherwise(plain)

    text = F.when(a == 0, "0").otherwise(let(F.format_string("%.5e", a), written))
    # Most numbers have up to six digits as they are.
    return F.when((a >= 1e-3) & (a < 1e6) & (F.length(short) <= 7), F.regexp_replace(short, r"\.0$", "")).otherwise(F.concat(_sign(x), text))


def _shortest(a: Column, text: Column) -> Column:
    """The runtime has two digits at least and may have more than it needs; the shortest form that is the same number counts."""

    def same(n: int) -> Column:
        def form(tried: Column) -> Column:
            digits = _mantissa(F.regexp_replace(F.substring_index(tried, "e", 1), r"\.", ""))
            scientific = F.concat(digits, F.lit("E"), F.substring_index(tried, "e", -1).cast("int").cast("string"))
            return F.when(tried.cast("double") == a, F.when(F.contains(text, F.lit("E")), scientific).otherwise(text))

        return let(F.format_string(f"%.{n}e", a), form)

    return F.coalesce(*map(same, (0, 14, 15, 16)), text)


def python_float(x: Column) -> Column:
    """A finite double as Python's str() has it: its shortest digits, with an exponent from 1e16 on and below 0.0001. Of two
    shortest forms above 1e17 it may not be the nearer one."""

    def moved(parts: Column) -> Column:
        digits, power = parts["digits"], parts["power"]
        places = F.regexp_replace(digits, r"\.", "")
        shift = power + 1 - F.length(places)  # zeros behind the digits
        large = F.when(shift >= 0, F.concat(places, F.repeat(F.lit("0"), shift), F.lit(".0")))
        large = large.otherwise(F.concat(F.substring(places, F.lit(1), power + 1), F.lit("."), F.substring(places, power + 2, F.lit(30))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), places)
        return F.when((power >= 16) | (power < -4), F.concat(digits, _exponent(power))).when(power >= 0, large).otherwise(small)

    def written(text: Column) -> Column:
        digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        parts = F.struct(digits.alias("digits"), F.substring_index(text, "E", -1).cast("int").alias("power"))
        return F.when(F.contains(text, F.lit("E")), let(parts, moved)).otherwise(text)

    def any_form(short: Column) -> Column:
        full = let(_shortest(F.abs(x), F.abs(x).cast("string")), written)
        return F.when((F.length(short) < 16) & ~F.contains(short, F.lit("E")), short).otherwise(F.concat(F.when(F.startswith(short, F.lit("-")), "-").otherwise(""), full))

    return let(x.cast("string"), any_form)


def ordinal_id(prefix: str, width: int, x: Column) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(x.cast("string")) >= width, x.cast("string")).otherwise(F.lpad(x.cast("string"), width, "0")))


def score_direction(x: Column, neutral: float = 0.05) -> Column:
    return F.when(x < -neutral, -1).when(x > neutral, 1).otherwise(0)


def normalised_text(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def is_token(x: Column) -> Column:
    return x.rlike("^[a-z][a-z0-9_]*$")


def is_sha256(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def float32_hex(x: Column) -> Column:
    """The eight hexadecimal digits of a number as a big-endian IEEE single; normal numbers and 0."""
    a = F.abs(x.cast("float").cast("double"))
    e = F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a))).cast("int")
    e = F.when(a < F.pow(F.lit(2.0), e), e - 1).when(a >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)
    fraction = F.rint((a / F.pow(F.lit(2.0), e) - 1) * 8388608).cast("long")
    bits = F.when(a == 0, F.lit(0)).otherwise((e + 127).cast("long") * 8388608 + fraction) + F.when(x < 0, 2147483648).otherwise(0)
    return F.lower(F.lpad(F.hex(bits), 8, "0"))
