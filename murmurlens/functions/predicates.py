"""Row predicates over text, label and author."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from murmurlens.config import (
    BOT_AUTHORS, DELETED_BODIES, LABELS, QUOTA_MARKERS, TOXIC_LABELS, VIETNAMESE, TextConfig,
)
from murmurlens.functions.cleaning import strip
from murmurlens.functions.common import let

#: Characters for which Python's ``str.isdigit`` holds beyond decimal digits.
_DIGITS = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"


def has_valid_label(label: Column) -> Column:
    return label.isin(*LABELS)


def is_unlabelled(label: Column) -> Column:
    """Null counts as unlabelled."""
    return ~F.coalesce(label.isin(*LABELS), F.lit(False))


def is_toxic(label: Column) -> Column:
    return F.coalesce(label.isin(*TOXIC_LABELS), F.lit(False))


def is_valid_comment(text: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Long enough, no user-interface phrase inside, not only digits."""
    lowered = F.lower(text)
    ok = (F.char_length(strip(text)) >= 5) & ~F.replace(text, F.lit(" "), F.lit("")).rlike(f"^[{_DIGITS}]+$")
    for phrase in config.ui_phrases:
        ok = ok & ~lowered.contains(phrase.lower())
    return F.coalesce(ok, F.lit(False))


def is_live_comment(body: Column, author: Column) -> Column:
    """Neither deleted nor written by a known bot."""
    return ~F.coalesce(body, F.lit("")).isin(*DELETED_BODIES) & ~F.lower(
        F.coalesce(author, F.lit(""))
    ).isin(*BOT_AUTHORS)


def looks_vietnamese(text: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Diacritics and hint words decide; plain ASCII Vietnamese passes too."""

    def verdict(t: Column) -> Column:
        """``t`` has the lowered text, the number of words and the hint hits."""
        accented = t["text"].rlike(f"[{config.letters}]")
        n, hits = t["n"], t["hits"]
        ok = (hits >= 2) | ((hits >= 1) & (hits * 4 >= n)) | (((hits >= 1) | (n <= 4)) & accented)
        return F.coalesce((n > 0) & ok, F.lit(False))

    def counted(lowered: Column) -> Column:
        def counts(found: Column) -> Column:
            hits = F.size(F.filter(found, lambda t: t.isin(*config.hint_words)))
            return F.struct(lowered.alias("text"), F.size(found).alias("n"), hits.alias("hits"))

        return let(F.regexp_extract_all(lowered, F.lit(r"([a-zA-ZÀ-ỹĐđ]+)"), F.lit(1)), counts)

    return F.coalesce(let(let(F.lower(strip(text)), counted), verdict), F.lit(False))


def is_quota_error(message: Column) -> Column:
    lowered = F.lower(message)
    found = F.lit(False)
    for marker in QUOTA_MARKERS:
        found = found | lowered.contains(marker)
    return F.coalesce(found, F.lit(False))
