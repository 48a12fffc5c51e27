"""Row-level text features as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K

_SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
_WORD = r"(?U)[^\s\x{1c}-\x{1f}]+"


def normalise(text: Column) -> Column:
    """Tags and white space of any kind become one space, edges are trimmed; null is empty."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), _SPACE, " ")
    return F.regexp_replace(spaced, "^ | $", "")


def token_count(text: Column) -> Column:
    """Runs of Latin letters, digits and Arabic script."""
    return F.regexp_count(text, F.lit(K.TOKEN))


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD))


_GAP = r"[\s\x{1c}-\x{1f}]"
_INK = r"[^\s\x{1c}-\x{1f}]"


def has_words(text: Column, n: int) -> Column:
    """word_count() of n at least; a long text is read no further than its n-th word."""
    if n <= 0:
        return F.lit(True)
    return F.coalesce(text, F.lit("")).rlike(f"(?U){_INK}++(?:{_GAP}++{_INK}++){{{n - 1}}}")


_MARKED = f"(?i)(?<![A-Za-z])(?:{'|'.join(K.ROMAN_URDU_MARKERS)})(?![A-Za-z])"


def language(text: Column) -> Column:
    """Both scripts: code_switched; Arabic: urdu_script; a marker word: roman_urdu; all else, also no letters: english."""
    arabic, latin = text.rlike(f"[{K.ARABIC}]"), text.rlike("[A-Za-z]")
    return F.when(arabic & latin, "code_switched").when(arabic, "urdu_script").when(text.rlike(_MARKED), "roman_urdu").otherwise("english")


def language_wide(text: Column) -> Column:
    """The classifier with the wider word list; any letter of the Arabic block counts."""
    arabic = text.rlike("[\\u0600-\\u06FF]")
    marked = text.rlike(rf"(?iU)\b({K.WIDE_ROMAN_MARKERS})\b")
    return F.when(arabic & text.rlike("[A-Za-z]"), "code_switched").when(arabic, "urdu_script").when(marked, "roman_urdu").otherwise("english")


def script(text: Column) -> Column:
    arabic = text.rlike(f"[{K.ARABIC}]")
    return F.when(arabic & text.rlike("[a-zA-Z]"), "mixed").when(arabic, "urdu_script").otherwise("latin")


def drop_reason(text_clean: Column) -> Column:
    """empty, emoji_only, too_short, or null for a text that stays."""
    n = token_count(text_clean)
    return F.when(text_clean == "", "empty").when(n == 0, "emoji_only").when(n < K.MIN_WORDS, "too_short")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(model: str | Column, prompt: str, taxonomy_version: int, text: Column, provider: str | None = None) -> Column:
    """The whole identity of a request; a null text has no key."""
    name = model if isinstance(model, Column) else F.lit(model)
    parts = [*([F.lit(provider)] if provider else []), name, F.lit(prompt), F.lit(f"taxonomy_v{taxonomy_version}"), text]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.sha2(joined, 256)


def year(date: Column) -> Column:
    return F.substring(date, 1, 4)


def month(date: Column) -> Column:
    """By the string, so no time zone moves a row into another month."""
    return F.substring(date, 1, 7)


def length_bucket(text: Column) -> Column:
    n = word_count(text)
    return F.when(n < 10, "short").when(n < 20, "medium").when(n < 40, "long").otherwise("very_long")


def severity_proxy(text: Column) -> Column:
    return text.rlike(K.to_java(K.MONEY, True)) & text.rlike(K.to_java(K.LOSS, True))


def names_something_concrete(text: Column, rating: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(K.to_java(K.SPECIFIC, True)) | ((rated(rating) <= 3) & (word_count(t) > 12))


def rated(rating: Column) -> Column:
    """A missing rating, or 0, counts as 5."""
    return F.coalesce(F.nullif(rating, F.lit(0)), F.lit(5))


def is_bad(rating: Column) -> Column:
    return rated(rating) <= 2


def digit_view(text: Column) -> Column:
    return F.translate(text, K.OTHER_DIGITS, K.ASCII_DIGITS)


def has_pii_risk_cue(text: Column) -> Column:
    return digit_view(text).rlike(K.to_java(K.RISK_CUE))


def has_keyword(tag: str, text: Column, groups=K.KEYWORD_GROUPS) -> Column:
    """Whether a text holds a keyword group; an unknown group never matches."""
    pattern = next((p for name, _, p in groups if name == tag), None)
    return F.lit(False) if pattern is None else F.coalesce(text.rlike(K.to_java(pattern, True)), F.lit(False))


def signal_score(text: Column, patterns: tuple[str, ...]) -> Column:
    return sum((text.rlike(K.to_java(p, True)).cast("int") for p in patterns), F.lit(0))


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def timestamp(value: Column) -> Column:
    """ISO time with or without an offset; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
