"""Column helpers shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Round half towards plus infinity, as a BIGINT."""
    return F.floor(x + F.lit(0.5)).cast("long")


def frames_of(ms: Column, fps: Column) -> Column:
    return js_round(ms.cast("double") * fps.cast("double") / F.lit(1000.0))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def seconds_text(ms: Column, digits: int = 1) -> Column:
    """Seconds with ``digits`` decimals (1, 2 or 4) from integer milliseconds, half up, in integers."""
    unit = {1: 100, 2: 10}.get(digits)
    if unit is None:
        return fixed(ms / F.lit(1000.0), digits)
    n = F.floor((ms + F.lit(unit // 2)) / F.lit(unit)).cast("long")
    base = 10**digits
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(n)
    return F.concat(
        sign, F.floor(a / F.lit(base)).cast("long").cast("string"), F.lit("."), F.lpad((a % base).cast("string"), digits, "0")
    )


# The characters that trimming takes for white space.
WHITE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def blank(c: Column) -> Column:
    """Nothing but white space of any kind."""
    return c.rlike(rf"\A[{WHITE}]*\z")


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def present(c: Column) -> Column:
    """Neither null nor empty: the truth test of a text field."""
    return c.isNotNull() & (c != "")


def numbered(prefix: str, n: Column, digits: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", n)


def normalized_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\x{80}-\x{10FFFF}]", "")


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Distance of two 64-bit hashes held as unsigned 32-bit halves."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def hash_half(hex_hash: Column, half: int) -> Column:
    """Upper (0) or lower (1) half of a 16-digit hex hash as BIGINT."""
    part = F.substring(F.lpad(hex_hash, 16, "0"), 1 + 8 * half, 8)
    return F.conv(part, 16, 10).cast("long")


def clock(ms: Column) -> Column:
    """MM:SS.cc as the player shows it: the rounded hundredths may read 100."""
    s = F.floor(ms / F.lit(1000)).cast("long")
    cc = js_round((ms % 1000).cast("double") / F.lit(10.0))
    return F.concat(
        F.when(s >= 6000, F.floor(s / 60).cast("string")).otherwise(F.lpad(F.floor(s / 60).cast("string"), 2, "0")),
        F.lit(":"),
        F.lpad((s % 60).cast("string"), 2, "0"),
        F.lit("."),
        F.when(cc >= 100, cc.cast("string")).otherwise(F.lpad(cc.cast("string"), 2, "0")),
    )


def frame_label(frame_number: Column) -> Column:
    """H:MM:SS (or M:SS) label of a frame numbered from 1 at one frame per second."""
    s = F.greatest(frame_number - 1, F.lit(0)).cast("long")
    h, m, sec = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    tail = F.lpad(sec.cast("string"), 2, "0")
    return F.when(
        h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), tail)
    ).otherwise(F.concat(m.cast("string"), F.lit(":"), tail))


def age_bucket(created: Column, as_of: Column) -> Column:
    """'5m', '3h' or '2d' between two timestamps; ``as_of`` is passed in so that results repeat."""
    mins = F.floor((F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(created.cast("timestamp"))) / F.lit(60000)).cast("long")
    hours = F.floor(mins / 60).cast("long")
    return (
        F.when(mins < 60, F.concat(mins.cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(hours / 24).cast("long").cast("string"), F.lit("d")))
    )


def image_media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"([^.]*)$", 1))
    return F.when(ext.isin("png", "webp", "gif"), F.concat(F.lit("image/"), ext)).otherwise(F.lit("image/jpeg"))
