"""Term and n-gram frequencies.

One table of counts ``(label, word, count)`` answers every word question.
Counting is a hash aggregate with map-side combine, so a frequent word costs
one row per task, and the top-k cuts never sort the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from murmurlens.config import LABELS, VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import split_spaces
from murmurlens.functions.predicates import is_toxic
from murmurlens.operators.dedup import cap_per_group
from murmurlens.functions.tokens import Tokenizer, is_term, ngrams, terms


def word_counts(df: DataFrame, config: TextConfig = VIETNAMESE, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``label, word, count``.

    The default tokenizer explodes first and filters rows, which keeps the
    filter in generated code; a custom one hands over its own array.
    """
    labelled = df.filter(F.col("label").isNotNull())
    if tokenizer is None:
        split = split_spaces(F.lower(F.col("text")))
        words = labelled.select("label", F.explode(split).alias("word")).filter(is_term(F.col("word"), config))
    else:
        words = labelled.select("label", F.explode(tokenizer(F.col("text"))).alias("word"))
    return words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("count"))


def top_toxic_words(counts: DataFrame, n: int = 20) -> DataFrame:
    total = counts.filter(is_toxic(F.col("label"))).groupBy("word").agg(F.sum("count").alias("count"))
    return top_k(total, "word", n)


def top_k(counts: DataFrame, term: str, k: int) -> DataFrame:
    """Largest counts first, ties by term."""
    return counts.orderBy(F.desc("count"), F.asc(term)).limit(k)


def display_cut(counts: DataFrame, term: str, k: int = 15) -> DataFrame:
    """The top ``k`` in ascending order, as a bar chart lists them."""
    return top_k(counts, term, k).orderBy(F.asc("count"), F.desc(term))


def keywords_per_label(counts: DataFrame, k: int = 15, labels: Sequence[str] = LABELS) -> DataFrame:
    """Top ``k`` words of each label, whatever ``k``: labels are cut before they meet in one task."""
    return _top_of_each(counts.filter(F.col("label").isin(*labels)), "label", "word", k)


def _top_of_each(counts: DataFrame, group: str, term: str, k: int) -> DataFrame:
    cut = cap_per_group(counts.withColumn("__down", -F.col("count")), [group], k, ["__down", term]).drop("__down")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), F.asc(term))))


def ngram_counts(df: DataFrame, sizes: Sequence[int] = (2, 3), toxic_only: bool = True,
                 config: TextConfig = VIETNAMESE, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``n, ngram, count`` for all sizes in one pass over the text."""
    rows = df.filter(is_toxic(F.col("label"))) if toxic_only else df
    make = tokenizer or (lambda text: terms(text, config))
    tokens = rows.select(make(F.col("text")).alias("tokens"))
    grams = F.array(*[
        F.struct(F.lit(n).alias("n"), ngrams(F.col("tokens"), n).alias("grams")) for n in sizes
    ])
    return (
        tokens.select(F.inline(grams)).select("n", F.explode("grams").alias("ngram"))
        .groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("count"))
    )


def top_ngrams(counts: DataFrame, k: int = 20) -> DataFrame:
    return _top_of_each(counts, "n", "ngram", k)


def distinct_ngrams(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("distinct_ngrams"))


#: Lexicon entries up to which the lexicon is broadcast (an entry takes about 100 bytes).
BROADCAST_ENTRIES = 100_000
#: Copies of a larger lexicon that a term's rows are dealt out to.
_SALTS = 16
#: Hashes of a table at most, as a power of two (a byte each), and bits of one of Spark's bitmaps.
_MOST_HASHES, _BITMAP = 20, 32768


def lexicon_lookup(df: DataFrame, lexicon: DataFrame, config: TextConfig = VIETNAMESE,
                   order: str = "seq", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Hits and total weight per row by joining exploded terms to a lexicon table.

    For lexicons too large for a literal map.  Terms meet the lexicon first and
    only hits are added up.  A lexicon of at most ``broadcast_entries`` is sent to all
    executors, so no text is shuffled.  Of a larger one a table of hashes is sent
    (:func:`_hash_table`), which leaves the hits and few other terms; these are joined by
    term, each term's rows dealt out to several copies of its entry, as a frequent
    term may be a large part of all rows.
    """
    tokens = df.select(order, terms(F.col("text"), config).alias("tokens"))
    if lexicon.limit(broadcast_entries + 1).count() <= broadcast_entries:
        candidates = tokens.select(order, F.explode(F.concat("tokens", ngrams(F.col("tokens"), 2))).alias("term"))
        hits = candidates.join(F.broadcast(lexicon), "term")
    else:
        known = _hash_table(lexicon, F.col("term"))
        opens = _hash_table(lexicon.filter(F.col("term").contains(" ")), F.substring_index("term", " ", 1))
        pairs = F.zip_with(
            "tokens", F.slice("tokens", F.lit(2), F.greatest(F.size("tokens"), F.lit(1))),
            lambda a, b: F.when(opens(a), F.concat(a, F.lit(" "), b)))
        candidates = tokens.select(order, F.explode(F.concat("tokens", F.filter(pairs, lambda p: p.isNotNull()))).alias("term"))
        salted = lexicon.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salt = F.pmod(F.xxhash64(order), F.lit(_SALTS)).cast("int")
        hits = candidates.filter(known(F.col("term"))).withColumn("__salt", salt).join(salted, ["term", "__salt"])
    return hits.groupBy(order).agg(F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("weight"))


def _hash_table(entries: DataFrame, value: Column) -> Callable[[Column], Column]:
    """A test that every value of ``entries`` passes, and of other values the fewer the larger the table is for them.

    A byte for each hash; the entries' hashes are gathered as bitmaps by executors.
    """
    # 64 hashes for an entry, within limits
    size = 1 << min(max((64 * entries.count()).bit_length(), 16), _MOST_HASHES)
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(size))
    places = entries.select(place(value).alias("at"))
    parts = places.groupBy(F.floor(F.col("at") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias("bits")).collect()
    table = np.zeros(size, dtype=np.uint8)
    for part, bits in parts:
        table[part * _BITMAP:(part + 1) * _BITMAP] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
    known = F.lit(table.tobytes())
    return lambda v: F.substring(known, place(v).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
