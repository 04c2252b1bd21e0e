"""Caption cleaning and checks as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

#: Word boundaries are spelt out, as engines differ in what \b means beside accented letters.
EDGE = "[^0-9A-Za-zÀ-ÿ_]"


def strip_think(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


#: A letter, digit or underscore of any script beside a word.
INNER = r"[\p{L}\p{N}_]"


def drop_words(c: Column, words: Iterable[str]) -> Column:
    """Replace the words (and their -er/-est forms, with commas beside them) by one blank."""
    start, end = K.COLOR_PATTERN.format(words="|".join(words)).split(r"\b(", 1)
    inner, after = end.rsplit(r"\b", 1)
    return F.regexp_replace(c, rf"(?i){start}(?<!{INNER})({inner}(?!{INNER}){after}", " ")


def tidy(c: Column) -> Column:
    """Punctuation after words were cut out; the order matters, only outer commas are stripped."""
    for pattern, to in K.TIDY_RULES:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(F.trim(c), K.OUTER_COMMAS, ""))


def clean(c: Column, words: Iterable[str] = (*K.COLOR_WORDS, "shadows?")) -> Column:
    return tidy(drop_words(strip_think(c), words))


def has_word(c: Column, words: Iterable[str], suffix: str = "") -> Column:
    return c.rlike(rf"(?i)(^|{EDGE})({'|'.join(words)}){suffix}($|{EDGE})")


def word_count(c: Column) -> Column:
    """White-space separated words; none in an empty text."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def method_name(path: Column) -> Column:
    """The method in a result file's path, or the file's name."""
    base = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(base, r"visloc_(.+?)_results\.csv$", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(base, r"\.csv$", ""))


def alpha_in(path: Column) -> Column:
    return F.regexp_extract(path, r"_a([0-9.]+)_", 1).try_cast("double")


def backbone_tag(model: Column) -> Column:
    return F.replace(F.replace(F.element_at(F.split(model, "/"), -1), F.lit("-"), F.lit("_")), F.lit("."), F.lit("_"))
