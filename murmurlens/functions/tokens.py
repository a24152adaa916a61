"""Tokens, n-grams and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import split_spaces

#: A tokenizer turns a text column into an ``array<string>`` column.  Pass one
#: built on a pandas UDF to plug in a word segmenter.
Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """White-space split without empty items."""
    return F.filter(split_spaces(text), lambda t: t != "")


def is_term(token: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Token filter: two or more characters, has a letter, no stop word.

    An all-digit token fails the letter test, so it needs no rule of its own.
    Most tokens start with a-z, which two byte comparisons find out.
    """
    ascii_start = (token >= "a") & (token < "{")
    return (
        (F.char_length(token) >= 2)
        & ~token.isin(*config.stop_words)
        & (ascii_start | token.rlike(f"[a-z{config.letters}]"))
    )


def terms(text: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Default tokenizer: lower case, split, :func:`is_term`."""
    return F.filter(split_spaces(F.lower(text)), lambda t: is_term(t, config))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of the *filtered* tokens, so pairs bridge stop words."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.size(tokens) - 1),
        F.slice(tokens, F.lit(2), F.size(tokens) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """N-grams for any ``n``; an array shorter than ``n`` has none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return tokens
    if n == 2:
        return bigrams(tokens)
    grams = F.transform(
        F.slice(tokens, F.lit(1), F.size(tokens) - (n - 1)),
        lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)]),
    )
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def char_count(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    return F.size(words(text))
