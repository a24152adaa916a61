"""Text cleaning as native column expressions.

Java's ``\\w``, ``\\s`` and ``\\d`` are ASCII only, so every rule spells out the
Unicode classes it means.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.common import let

# Ship the Python helpers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values: cleaning patterns ---------------------------------------
#: Letters, digits and underscore.  ASCII first: the matcher tests those cheaply.
WORD = r"a-z0-9_\p{L}\p{N}"
#: White space beyond ASCII, and everything that is no white space at all.
WIDE_SPACES = r"\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
NON_SPACE = rf"[^\s{WIDE_SPACES}]"
URL = rf"(?i)https?://{NON_SPACE}+|www\.{NON_SPACE}+"
EMAIL = rf"(?<!{NON_SPACE}){NON_SPACE}+@{NON_SPACE}+\.{NON_SPACE}+"
PHONE = r"(?:\+84|0)\p{Nd}{9,10}"
EMOJI_RANGES = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)
EMOJI = f"[{EMOJI_RANGES}]+"
REPEAT = r"([^\n])\1{3,}"
PUNCTUATION = r".,!?\-"
SPECIAL = rf"[^{WORD}\s{PUNCTUATION}]"
# ---- end of fixed values ---------------------------------------------------

#: Characters that Python's ``str.strip`` removes.
STRIP_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_spaces(text: Column) -> Column:
    """Split at Unicode white space, as Python's ``str.split`` does."""
    return F.split(text, rf"[\s{WIDE_SPACES}]+")


def expand_abbreviations(text: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Lower-case and spell out whole-word abbreviations.

    One pass tests whether any abbreviation occurs.  A text that holds one is
    cut into word and non-word pieces and looked up piece by piece, so the cost
    does not depend on how many abbreviations there are.
    """
    table = config.abbreviations
    if not table:
        return F.lower(text)
    initials = "".join(sorted({key[0] for key in table}))
    present = rf"(?=[{initials}])(?<![{WORD}])(?:{'|'.join(table)})(?![{WORD}])"
    expansion = F.create_map(*[F.lit(v) for item in table.items() for v in item])

    def expand(lowered: Column) -> Column:
        pieces = F.regexp_extract_all(lowered, F.lit(rf"([{WORD}]+|[^{WORD}]+)"), F.lit(1))
        spelled = F.transform(pieces, lambda p: F.when(p.isin(*table), expansion[p]).otherwise(p))
        return F.when(lowered.rlike(present), F.array_join(spelled, "")).otherwise(lowered)

    return let(F.lower(text), expand)


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def drop_emails(text: Column) -> Column:
    """The rule always takes a whole run of non-blanks, so it is tried once per run, and only in texts with an ``@``."""
    return _where(text, lambda t: t.contains("@"), lambda t: F.regexp_replace(t, EMAIL, " "))


def drop_phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, " ")


def _where(text: Column, possible: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    return let(text, lambda t: F.when(possible(t), change(t)).otherwise(t))


def _drop_contacts(lowered: Column) -> Column:
    """URLs, e-mails, phones; a substring test spares most texts each pattern."""
    out = _where(lowered, lambda t: t.contains("http") | t.contains("www."), drop_urls)
    return _where(drop_emails(out), lambda t: t.contains("0") | t.contains("+84"), drop_phones)


def drop_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, " ")


def collapse_repeats(text: Column) -> Column:
    """Four or more equal characters in a row become two; three stay."""
    return F.regexp_replace(text, REPEAT, "$1$1")


def drop_special(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, " ")


def collapse_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column, keep_emoji: bool = False, config: TextConfig = VIETNAMESE) -> Column:
    """The whole chain in its fixed order; null and blank give ``''``.

    Abbreviations expand before links go, and the result is always lower case.
    Apply once: collapsing repeats can create a new abbreviation.  Emoji,
    special characters and white space end up as one blank whichever goes
    first, so a single last pass takes all three.
    """
    kept = rf"\p{{L}}\p{{N}}&&[^{EMOJI_RANGES}]" if not keep_emoji else r"\p{L}\p{N}"
    out = collapse_repeats(_drop_contacts(expand_abbreviations(text, config)))
    out = F.btrim(F.regexp_replace(out, rf"[^a-z0-9_{PUNCTUATION}[{kept}]]+", " "))
    return F.coalesce(out, F.lit(""))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it (opt-in step)."""

    def compose(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return F.pandas_udf(compose, StringType())(text)


def comparison_form(text: Column) -> Column:
    """Light normalisation used to compare two comments."""
    return F.btrim(F.regexp_replace(F.lower(text), rf"[^{WORD}]+", " "))
