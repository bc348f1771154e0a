"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

Words are the runs of letters and digits of the lower-cased text, shingles are five words in a row, taken as sets.  A
document is contaminated by a test item if it contains 0.8 or more of the item's distinct shingles (a null item_id matches nothing).

Under a random order of all shingles, the least shingle of an item is in a document with a probability equal to the
item's containment in it, whatever the document's length.  So an item's signature, its least shingles under some hash
functions, is looked up among the shingles of documents themselves: short items are found in documents of any length.
Items are partitioned by size (powers of two), and each partition has its own parameters: how many shingles an item's
signature has (``lookups``; items of up to LOOKUPS shingles use all of theirs), and in how many of them a document must
agree to be a candidate (``least_hits``: the most for which an item at the threshold is missed with a chance of MISS or
less; for items that use all their shingles, the threshold itself).  Larger items so ask for more agreement, and a common
passage that they share with very many documents makes no candidates.  Candidates are verified exactly, by counting the
item's distinct shingles in the document.

Items of fewer than five words have no shingles and match nothing; null and empty texts count as such.  Repeated
rows keep a row each, and equal texts are searched as one.  Items of one id are separate items.  Tables without rows give no matches.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.ship import cut, fresh, small, text_id

SHINGLE = 5
CONTAINED = 0.8
#: Shingles that an item is looked up by, at least, and the chance that it is missed at the threshold.
LOOKUPS, MISS = 10, 1e-6
#: Largest partition: items of 2**TOP shingles and more are looked up by as many.
TOP = 20


def lookups(k: int) -> int:
    """Shingles of the signatures in the partition of items of more than 2**(k - 1), up to 2**k shingles."""
    return LOOKUPS + 2 * min(k, TOP)


def least_hits(m: int) -> int:
    """Of m lookups, each a hit with probability CONTAINED or more, the most that fewer hits than that have chance MISS at most.

    The signature's shingles are drawn without putting back, which strays less than the binomial does that is counted here.
    """
    total, h = 0.0, 0
    while (total := total + comb(m, h) * CONTAINED**h * (1 - CONTAINED) ** (m - h)) <= MISS:
        h += 1
    return max(1, h)


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def shingles(words_column: Column) -> Column:
    """Hashes of the runs of five words of an array."""
    n = F.size(words_column) - SHINGLE + 1
    run = lambda i: F.xxhash64(*[F.get(words_column, i + k) for k in range(SHINGLE)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<long>"))


def shingles_of(text: str) -> Column:
    """Shingle hashes of a text in order; the word list is bound to a name, so it is made once for each row."""
    return F.transform(F.array(words(text)), lambda w: shingles(w))[0]


def item_signatures(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, n, shingles) of the items, and (shingle, item_id, hits) of their signatures; hits is what a candidate needs."""
    sets = cut(items.select("item_id", F.array_distinct(shingles_of("text")).alias("shingles")).where(F.size("shingles") > 0))
    sets = sets.select("item_id", F.size("shingles").alias("n"), "shingles")
    partition = F.least(F.ceil(F.log2("n")).cast("int"), F.lit(TOP))
    functions = F.array(*[F.lit(lookups(k)) for k in range(TOP + 1)])[partition]
    least = lambda seed: F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, seed).alias("h"), s.alias("s"))))["s"]
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(1), functions), least))
    needed = F.array(*[F.lit(least_hits(max(1, m))) for m in range(lookups(TOP) + 1)])
    signed = sets.select("item_id", "n", F.when(F.col("n") <= LOOKUPS, F.col("shingles")).otherwise(drawn).alias("signature"))
    hits = F.when(F.col("n") <= LOOKUPS, F.ceil(CONTAINED * F.col("n") - 1e-9).cast("int")).otherwise(needed[F.size("signature")])
    return sets, signed.select("item_id", hits.alias("hits"), F.explode("signature").alias("shingle"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """text_hash, item_id, containment (0.8 or more) of distinct document texts and test items."""
    sets, signatures = item_signatures(items)
    signatures = small(signatures)
    hashed = docs.select(text_hash(), F.col("text").cast("string").alias("text"))
    parts = hashed.select("text_hash", F.explode(shingles_of("text")).alias("shingle"))
    # With a checked, small list of signatures no shingle is moved; only what they hit is.
    hit = parts.join(signatures, "shingle").select("text_hash", "item_id", "hits", "shingle").distinct()
    candidates = cut(hit.groupBy("text_hash", "item_id").agg(F.count("*").alias("n_hits"), F.min("hits").alias("hits")).where("n_hits >= hits").select("text_hash", "item_id"))
    held = small(candidates.select("text_hash").distinct())
    texts = hashed.join(held, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text"))
    pairs = candidates.join(texts.select("text_hash", F.array_distinct(shingles_of("text")).alias("has")), "text_hash").join(sets, "item_id")
    found = F.size(F.array_intersect("shingles", "has"))
    return pairs.where(found >= CONTAINED * F.col("n")).select("text_hash", "item_id", (found / F.col("n")).alias("containment"))


def text_hash() -> Column:
    return text_id(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined), containment (the largest; 0 without a match) of every row."""
    by_text = matches(docs, items).groupBy("text_hash").agg(
        F.countDistinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.max("containment").alias("containment")
    )
    rows = docs.select("doc_id", text_hash()).join(small(by_text), "text_hash", "left")
    return rows.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no test item is contained in, all columns as they are."""
    leaked = small(matches(docs, items).select("text_hash").distinct())
    key = fresh(docs, "text_hash")
    keyed = docs.withColumn(key, text_hash())
    return keyed.join(leaked, keyed[key] == leaked["text_hash"], "left_anti").drop(key)
