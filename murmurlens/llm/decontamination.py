"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask names the positions of a short span that are hashed; the others may hold any
word.  Hashes of all masked spans of the test items meet those of the training
texts, and around each hit the two word sequences are laid over each other.  A
text is contaminated by an item if some ``WINDOW`` consecutive words of the item,
so laid, agree in at least ``SIMILARITY`` of the positions.  The masks are chosen such
that any two differing positions of a window leave some masked span untouched, so
no such window is missed.  An item shorter than a window must agree as a whole, in as
large a share of its words.  It has masks of its own: cut into one piece more than
words may differ, one of its pieces is left untouched.

Words are what ASCII white space separates, lower-cased.  Null counts as the empty
text: no words, never contaminated, and as an item never found.  Rows are told apart
by id and text, so repeated ids are judged each by its own text and repeated rows
get the same answer; null ids are ids like any other.  Items are told apart by their
row; their ids are reported once each, null ids as null.  Other columns pass through
where documents are returned and may have any name but those starting with two
underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.functions.common import computed_once
from murmurlens.session import materialise

WINDOW = 13
SIMILARITY = 0.8
#: Positions that are hashed.  Every pair of positions of a window misses some shift of one of them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Test sides of up to so many seeds are broadcast (16 bytes each and the hash table's room); larger ones are shuffled.
BROADCAST_SEEDS = 500_000
_LONG = tuple(enumerate(MASKS))
#: Shorter masks, for pieces of items of fewer words than a window: a number that no other has, and positions.
_SHORT = {q: (len(MASKS) + q, tuple(range(q))) for q in range(1, 5)}


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x09-\\x0D ]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(hashes: Column, number: int, mask: tuple[int, ...], start: Column) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(hashes, start + p) for p in mask))


def _seeds(hashes: Column, number: int, mask: tuple[int, ...]) -> Column:
    """Hashes of all spans of a mask, by start."""
    seeds = F.transform(F.sequence(F.lit(0), F.size(hashes) - mask[-1] - 1), lambda start: _seed(hashes, number, mask, start))
    return F.when(F.size(hashes) > mask[-1], seeds).otherwise(F.array().cast("array<bigint>"))


def _exploded_seeds(rows: DataFrame, masks: tuple, *keys: str) -> DataFrame:
    """keys, start and seed of all masked spans; ``rows`` has ``__words``, the word hashes."""
    both = computed_once(rows, "__words", F.col("__words")).withColumn("__n", F.size("__words"))
    arrays = F.concat(*(_seeds(F.col("__words"), *m) for m in masks))
    at = both.select(*keys, "__n", F.posexplode(arrays).alias("__at", "__seed"))
    start, before = F.col("__at"), F.lit(0)
    for _, mask in masks[:-1]:
        before = before + F.greatest(F.col("__n") - mask[-1], F.lit(0))
        start = F.when(F.col("__at") >= before, F.col("__at") - before).otherwise(start)
    return at.select(*keys, start.alias("__start"), "__seed")


def _needed(n: Column) -> Column:
    """Agreeing words that a window, or a whole shorter item, of ``n`` words must have."""
    return F.ceil(F.lit(SIMILARITY) * F.least(F.lit(WINDOW), n)).cast("int")


def _short_seeds(items: DataFrame) -> DataFrame:
    """__item, __start and seed of the pieces of items shorter than a window, and ``q``, the words of a piece."""
    n = F.size("__item_words")
    pieces = n - _needed(n) + 1
    cut = items.where(n < WINDOW).select("__item", "__item_words", pieces.alias("pieces"), F.floor(n / pieces).cast("int").alias("q"))
    starts = cut.select("__item", "__item_words", "q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"))
    starts = starts.withColumn("__start", F.col("k") * F.col("q"))
    seed = F.coalesce(*(F.when(F.col("q") == q, _seed(F.col("__item_words"), *m, F.col("__start"))) for q, m in _SHORT.items()))
    return starts.select("__item", "__start", seed.alias("__seed"), "q")


def _agreement(words: Column, item: Column, shift: Column) -> Column:
    """The most agreeing positions of a window, the item's word ``t`` laid over the text's ``shift + t``."""
    n = F.size(item)
    width = F.least(F.lit(WINDOW), n)
    equal = F.transform(item, lambda w, t: F.when((shift + t >= 0) & F.equal_null(F.get(words, F.greatest(shift + t, F.lit(0))), w), 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(F.slice(equal, s, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums)


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(__id, __hash, __item, item_id): texts, by id and hash of the text, with the items that contaminate them."""
    spark = docs.sparkSession
    items = materialise(
        benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("__item_words")).where(F.size("__item_words") > 0)
        .select("item_id", "__item_words", F.xxhash64("item_id", "__item_words").alias("__item")).dropDuplicates(["__item"]),
        "decontamination-items")
    whole = items.where(F.size("__item_words") >= WINDOW).select("__item", F.col("__item_words").alias("__words"))
    item_seeds = _exploded_seeds(whole, _LONG, "__item").withColumn("q", F.lit(None).cast("int")).unionByName(_short_seeds(items))
    item_seeds = materialise(item_seeds.withColumnRenamed("__start", "__item_start"), "decontamination-seeds")
    small = item_seeds.count() <= BROADCAST_SEEDS
    # texts are hashed with the shorter masks only if some item has them: four at most
    lengths = sorted(r["q"] for r in item_seeds.where("q is not null").select("q").distinct().collect())
    masks = _LONG + tuple(_SHORT[q] for q in lengths)
    item_seeds = item_seeds.drop("q")
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    texts = texts.select("__id", "__text", F.xxhash64("__text").alias("__hash"))
    seeds = _exploded_seeds(texts.select("__id", "__hash", word_hashes(F.col("__text")).alias("__words")), masks, "__id", "__hash")
    hits = seeds.join(F.broadcast(item_seeds) if small else item_seeds, "__seed")
    hits = hits.select("__id", "__hash", "__item", (F.col("__start") - F.col("__item_start")).alias("__shift")).distinct()
    # lay the sequences over each other, texts with hits only
    per_text = hits.groupBy("__id", "__hash").agg(F.collect_list(F.struct("__item", "__shift")).alias("__hits"))
    right = per_text.select(F.col("__id").alias("__hit_id"), F.col("__hash").alias("__hit_hash"), "__hits")
    found = texts.join(right, (F.col("__hash") == F.col("__hit_hash")) & F.col("__id").eqNullSafe(F.col("__hit_id")))
    found = found.select("__id", "__hash", "__hits", word_hashes(F.col("__text")).alias("__words"))
    found = computed_once(found, "__words", F.col("__words"))
    # only the words under an item go on with its hit
    placed = F.transform("__hits", lambda h: F.struct(h["__item"].alias("__item"), h["__shift"].alias("__shift")))
    placed = found.select("__id", "__hash", "__words", F.explode(placed).alias("h"))
    judged = placed.select("__id", "__hash", "__words", "h.__item", "h.__shift").join(F.broadcast(items) if small else items, "__item")
    judged = judged.where(_agreement(F.col("__words"), F.col("__item_words"), F.col("__shift")) >= _needed(F.size("__item_words")))
    return judged.select("__id", "__hash", "__item", "item_id").distinct()


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (sorted) of every row."""
    found = contaminations(docs, benchmark, text)
    per_text = found.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__row_hash"))
    joined = rows.join(per_text, (F.col("__row_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no item contaminates, all columns as they were."""
    found = contaminations(docs, benchmark, text).select("__id", "__hash").distinct()
    same = (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__hash")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    return docs.join(found, same, "left_anti")
