"""String functions as Column builders (STR-*). All but the NFKC ones stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Python's white space as a Java character class; word characters as letters, numbers and underscore.
SPACE = r"[\s\x{0085}\p{Z}\x{001C}-\x{001F}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# Function words of the question templates.
QUESTION_STOP_WORDS = (
    "what", "is", "the", "how", "much", "many", "was", "were", "paid", "given", "by", "of", "name",
    "first", "item", "items", "bought", "amount", "charge",
)


def collapse(text: Column) -> Column:
    """STR-02: runs of white space become one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_answer(text: Column) -> Column:
    """STR-01: lower case, punctuation to spaces, white space collapsed; null becomes empty."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?!{SPACE}){NOT_WORD}", " "))


def words(text: Column) -> Column:
    """The words of a page as an array, empty for null or blank."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two strings; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def anls(prediction: Column, gold: Column, threshold: float = 0.5) -> Column:
    """STR-04 for one gold answer: similarity of the normalised strings, 0 below the threshold."""
    return normalized_anls(normalize_answer(prediction), normalize_answer(gold), threshold)


def normalized_anls(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """anls() of strings that are normalised already. Equal ones are not compared letter by letter."""
    score = similarity(a, b)
    return F.when(a == b, F.lit(1.0)).when(score >= threshold, score).otherwise(F.lit(0.0))


def best_anls(prediction: Column, golds: Column, threshold: float = 0.5) -> Column:
    """STR-04 for an array of accepted answers: the best of them; null for an empty array."""
    p = normalize_answer(prediction)
    score = F.array_max(F.transform(golds, lambda g: similarity(p, normalize_answer(g))))
    return F.when(score >= threshold, score).when(score.isNotNull(), F.lit(0.0))


def exact_match(prediction: Column, golds: Column) -> Column:
    """STR-05: the normalised prediction equals any normalised accepted answer."""
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: normalize_answer(g) == p)


def last_number(words_: Column) -> Column:
    """STR-06: the last word with a digit, else empty."""
    return F.coalesce(F.try_element_at(F.filter(words_, lambda w: w.rlike(DIGIT)), F.lit(-1)), F.lit(""))


def content_words(question: Column) -> Column:
    """The normalised words of a question without function words."""
    found = F.split(normalize_answer(question), " ")
    return F.filter(found, lambda w: (w != "") & ~w.isin(*QUESTION_STOP_WORDS))


def common_prefix(a: Column, b: Column) -> Column:
    """STR-07: the length of the longest common prefix."""
    top = F.least(F.length(a), F.length(b))
    lengths = F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(lengths, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))


def answer_on_page(prediction: Column, page_words: Column, most_words: int = 20) -> Column:
    """STR-09: the normalised prediction is the normalised text of a run of at most ``most_words`` words of the page, from the border of a word to the border of a word.

    page_words: the page as an array of words; words without letters or digits count in a run, though they add no text.
    """
    return let(normalize_answer(prediction), lambda t: let(F.transform(page_words, normalize_answer), lambda c: on_page(t, c, most_words)))


def on_page(target: Column, cleaned: Column, most_words: int = 20) -> Column:
    """answer_on_page() of a normalised prediction and the normalised words of a page.

    Each word that the prediction can begin with starts a run, which is spelled out until it is the prediction.
    """

    def spelled(said: Column, word: Column, target: Column) -> Column:
        longer = F.when(said == "", word).otherwise(F.concat(said, F.lit(" "), word))
        return F.when((said == target) | (word == ""), said).otherwise(longer)

    def starts(word: Column, i: Column) -> Column:
        begins = (word != "") & F.startswith(F.concat(target, F.lit(" ")), F.concat(word, F.lit(" ")))
        run = F.aggregate(F.slice(cleaned, i + 1, most_words), F.lit(""), lambda said, w: spelled(said, w, target))
        return F.when(begins, run == target).otherwise(F.lit(False))

    return (target != "") & F.coalesce(F.array_contains(F.transform(cleaned, starts), True), F.lit(False))


def spreadsheet_safe(text: Column) -> Column:
    """STR-12: a leading = + - @ (after white space) or tab, CR or LF gets an apostrophe before it; null becomes empty."""
    risky = F.regexp_replace(text, f"^{SPACE}+", "").rlike(r"^[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.coalesce(F.when(risky, F.concat(F.lit("'"), text)).otherwise(text), F.lit(""))


def page_key(words_: Column) -> Column:
    """STR-13: the lower-cased word sequence; group by it as an array."""
    return F.transform(words_, F.lower)


def _nfkc(text: Column, fold: bool) -> Column:
    """NFKC, and case folding if asked for, in Arrow batches. The function is made on call: it needs a session."""

    @F.pandas_udf("string")
    def normalized(batch: pd.Series) -> pd.Series:
        flat = batch.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
        return flat.map(lambda x: None if x is None else x.casefold()) if fold else flat

    return normalized(text)


def nfkc(text: Column, fold: bool = False) -> Column:
    """NFKC, and case folding if asked for. ASCII is that already: Python gets nulls in its place."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text) if fold else text).otherwise(_nfkc(F.when(~plain, text), fold))


def key_text(text: Column, ascii_only: bool = False) -> Column:
    """STR-10: NFKC, case folded, everything but word characters removed. ascii_only: the caller knows that it is; no Python then."""
    return F.regexp_replace(F.lower(text) if ascii_only else nfkc(text, True), f"{NOT_WORD}+", "")


def clean(text: Column, ascii_only: bool = False) -> Column:
    """STR-11: NFKC and collapsed white space."""
    return collapse(text if ascii_only else nfkc(text))


def shown(value: Column, missing: str, digits: int | None = None) -> Column:
    """STR-14: a value as it is displayed, with this many decimals if it is a number; ``missing`` for null."""
    return F.when(value.isNull(), missing).otherwise(value.cast("string") if digits is None else F.format_string(f"%.{digits}f", value))
