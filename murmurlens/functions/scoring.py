"""Weighted lexicon scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from murmurlens.config import LEVELS, VIETNAMESE, TextConfig
from murmurlens.functions.common import let


def _weight(term: Column, weights: Mapping[str, int]) -> Column:
    pairs = [F.lit(v) for item in sorted(weights.items()) for v in item]
    return F.try_element_at(F.create_map(*pairs), term)


def lexicon_hits(tokens: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Weights of all lexicon hits: single words, then two-word phrases.

    Membership is a hash-set test; the weight map is read for hits only, and a
    phrase is put together only where a phrase can start.
    """
    found = F.transform(
        F.filter(tokens, lambda t: t.isin(*config.lexicon_words)),
        lambda t: _weight(t, config.lexicon_words),
    )
    phrases = config.lexicon_phrases
    if not phrases:
        return found
    openers = sorted({p.split(" ")[0] for p in phrases})
    paired = F.zip_with(
        tokens,
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))),
        lambda a, b: F.when(a.isin(*openers), _weight(F.concat(a, F.lit(" "), b), phrases)),
    )
    return F.concat(found, F.filter(paired, lambda w: w.isNotNull()))


def score_of_hits(hits: Column) -> Column:
    """``min(100, 10 * mean weight + 5 * hits)``, 0 without a hit."""
    n = F.size(hits)
    total = F.aggregate(hits, F.lit(0), lambda acc, w: acc + w)
    score = F.least(F.lit(100.0), total * 10.0 / n + n * 5.0)
    return F.when(n > 0, F.round(score, 2)).otherwise(F.lit(0.0))


def toxic_score(tokens: Column, config: TextConfig = VIETNAMESE) -> Column:
    return let(tokens, lambda t: let(lexicon_hits(t, config), score_of_hits))


def toxic_level(score: Column) -> Column:
    none, mild, medium, heavy, extreme = LEVELS
    return (
        F.when(score == 0, none)
        .when(score < 20, mild)
        .when(score < 50, medium)
        .when(score < 80, heavy)
        .otherwise(extreme)
    )


def toxic_word_count(tokens: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Single-word hits only."""
    return F.size(F.filter(tokens, lambda t: t.isin(*config.lexicon_words)))


def correlation_band(r: Column) -> Column:
    strength = F.abs(r)
    return F.when(strength < 0.3, "weak").when(strength < 0.7, "medium").when(strength.isNotNull(), "strong")
