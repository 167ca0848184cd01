"""Writing direction of text and language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character ranges written right to left, and language codes (lower case, without region).
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0700}-\x{074F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
HEBREW = r"[\x{0590}-\x{05FF}]"
ARABIC = r"[\x{0600}-\x{06FF}]"
LATIN = "[a-zA-Z]"
RTL_LANGUAGES = ("he", "ar", "fa", "ur", "yi", "iw", "heb", "ara", "fas", "urd", "yid")
# Languages marked right-to-left when a transcript is read in.
TRANSCRIPT_RTL_LANGUAGES = ("ar", "he", "fa", "ur", "yi", "ps", "sd", "ug", "ku", "dv", "ha", "syr")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_direction(text: Column) -> Column:
    """'rtl' only when strictly more characters run right to left than Latin letters left to right.

    Counting builds a list of all matches, so only texts with such a character at all are counted.
    """
    return F.when(text.rlike(RTL) & (count_matches(text, RTL) > count_matches(text, LATIN)), "rtl").otherwise("ltr")


def direction_or(text: Column, default: str = "ltr") -> Column:
    return F.when(text.rlike(r"^\s*$"), F.lit(default)).otherwise(text_direction(text))


def is_rtl_language(code: Column) -> Column:
    return F.split_part(F.lower(code), F.lit("-"), F.lit(1)).isin(*RTL_LANGUAGES)


def wrapped(text: Column, direction: Column) -> Column:
    """Text between direction marks."""
    return F.concat(F.when(direction == "rtl", "\u202b").otherwise("\u202a"), text, F.lit("\u202c"))


def direction_profile(df: DataFrame, text: str, language: str) -> DataFrame:
    """Direction columns for a text column and a language code column."""
    t = F.col(text)
    rtl = t.rlike(RTL)
    return df.withColumns(
        {
            "direction": direction_or(t),
            "has_hebrew": t.rlike(HEBREW),
            "has_arabic": t.rlike(ARABIC),
            "has_rtl": rtl,
            "is_mixed": rtl & t.rlike(LATIN),
            "rtl_language": is_rtl_language(F.col(language)),
            "wrapped": wrapped(t, direction_or(t)),
        }
    )


def direction_rollup(profile: DataFrame, by: list[str]) -> DataFrame:
    """How many texts of each kind per group."""
    return profile.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("direction") == "rtl").alias("rtl_texts"),
        F.count_if("has_hebrew").alias("hebrew_texts"),
        F.count_if("has_arabic").alias("arabic_texts"),
        F.count_if("is_mixed").alias("mixed_texts"),
        F.count_if("rtl_language").alias("rtl_language_texts"),
    )
