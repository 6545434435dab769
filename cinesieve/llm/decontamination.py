"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a text where at least `threshold` of its distinct 5-word shingles occur there. Items are partitioned
by their number of shingles, in powers of two; an item's sketch is its shingles with the smallest hashes, those first that
fewest items hold, as many as one more than its partition's largest item may lack, or all of them. So a text that contains
the item shares a shingle with the sketch for certain, however long the text is. Texts that share one are candidates; their
shingles are then compared with those of their candidate items as strings. An item of fewer words is a partition of its own:
one shingle of its length, and texts are cut into shingles of that length too, where items of it occur.

Only hashes of shingles that fall into a sketch leave the scan. Documents aren't shuffled whole: candidates are joined
back by document, a side that Spark broadcasts or shuffles by its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, let, new_names, staged

WORDS, THRESHOLD = 5, 0.8
#: A sketch of at most this many rows, of 16 bytes each, goes to all executors.
BROADCAST_ROWS = 1 << 21
#: The items' shingles as strings go to all executors up to this many, some 100 bytes each.
BROADCAST_SHINGLES = 1 << 17


def tokens(text: Column) -> Column:
    """The maximal runs of letters and digits, in lower case."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def _each(w: Column, width: int, make) -> Column:
    """make(words of a shingle) for every shingle; a shorter sequence is one shingle, an empty one none."""
    at = lambda i: [F.get(w, i + k) for k in range(width)]
    many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make(at(i)))
    return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(make([F.array_join(w, " ")])))


def _all(w: Column, width: int, shorter: tuple[int, ...], make, kind: str) -> Column:
    """_each of the width and of each shorter length, of sequences that have it."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*[F.coalesce(F.when(F.size(w) >= k, _each(w, k, make)), none) for k in shorter], F.coalesce(_each(w, width, make), none)) if shorter else _each(w, width, make)


def hashes(text: Column, width: int = WORDS, shorter: tuple[int, ...] = ()) -> Column:
    return let(tokens(text), lambda w: _all(w, width, shorter, lambda parts: F.xxhash64(F.concat_ws(" ", *parts)), "bigint"))


def strings(text: Column, width: int = WORDS, shorter: tuple[int, ...] = ()) -> Column:
    return let(tokens(text), lambda w: _all(w, width, shorter, lambda parts: F.concat_ws(" ", *parts), "string"))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """item, item_key (the text's hash), shingle, h, n (distinct shingles of the item), in_sketch.

    A sketch takes shingles that few items hold before others, and of these the smallest hashes: a template that all
    items share then makes no candidates.
    """
    text = items.select(col(id_col).alias("item"), F.xxhash64(col(text_col)).alias("item_key"), F.explode(strings(col(text_col), width)).alias("shingle")).distinct()
    holders = text.groupBy("shingle").agg(F.count("*").alias("holders"))
    hashed = text.join(holders, "shingle").withColumn("h", F.xxhash64("shingle"))
    own = W.partitionBy("item", "item_key")
    counted = hashed.withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("holders", "h", "shingle")))
    largest = F.least(F.pow(F.lit(2), F.ceil(F.log2("n"))), F.lit(float(1 << 30)))  # of the item's size partition
    may_lack = F.floor(largest * (1 - threshold) + 1e-9)
    return counted.select("item", "item_key", "shingle", "h", "n", (F.col("rank") <= may_lack + 1).alias("in_sketch"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each text that contains an item: doc, key, item, item_key, n_shared, n_item, containment.

    key and item_key are the texts' hashes: documents with one id, and items with one id or with none, are judged each by
    its own text, repeated rows once. Null and empty texts and items without words have no shingles and never match; an item
    of fewer than 5 words is found where a text has these words one after another. Null ids are kept.
    A very long text is searched whole: its shingles leave the scan as hashes, and only those in a sketch go further.
    Empty tables give no rows. Other columns are not read.
    """
    of_items = staged(item_shingles(items, item_id, item_text, width, threshold), "item-shingles")
    n_words = F.length("shingle") - F.length(F.translate("shingle", " ", "")) + 1
    shorter = tuple(sorted(r.k for r in of_items.select(n_words.alias("k")).where(F.col("k") < width).distinct().collect()))  # width - 1 lengths at most
    sketch = of_items.where("in_sketch").select("h", "item", "item_key").distinct()
    if of_items.where("in_sketch").count() <= BROADCAST_ROWS:  # else both sides are shuffled by hash
        sketch = F.broadcast(sketch)
    texts = docs.select(col(id_col).alias("doc"), F.xxhash64(col(text_col)).alias("key"), col(text_col).alias("text"))
    shingles = texts.select("doc", "key", F.explode(hashes(F.col("text"), width, shorter)).alias("h"))
    candidates = staged(shingles.join(sketch, "h").select("doc", "key", "item", "item_key").distinct(), "candidates")
    chosen = candidates.select("doc", "key").distinct().withColumnsRenamed({"doc": "_d", "key": "_k"})
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    held = texts.join(chosen, same, "left_semi").select("doc", "key", F.explode(F.array_distinct(strings(F.col("text"), width, shorter))).alias("shingle"))
    # a candidate text's shingles are looked up among those of its own candidate items, and no others
    lists = of_items.select(F.col("item").alias("_i"), F.col("item_key").alias("_ik"), F.col("shingle").alias("_s"), "n")
    lists = F.broadcast(lists) if of_items.count() <= BROADCAST_SHINGLES else lists
    wanted = candidates.join(lists, F.col("item").eqNullSafe(F.col("_i")) & (F.col("item_key") == F.col("_ik")))
    wanted = wanted.select(F.col("doc").alias("_d"), F.col("key").alias("_k"), "item", "item_key", "_s", "n")
    found = held.join(wanted, same & (F.col("shingle") == F.col("_s")))
    shared = found.groupBy("doc", "key", "item", "item_key").agg(F.countDistinct("shingle").alias("n_shared"), F.first("n").alias("n_item"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text contains an item; same columns whatever their names.

    Null and empty texts contain nothing and stay, as do all rows where there are no items; repeated rows stay or go
    together. Null ids are told apart by their texts. The rows that go are joined by id and text hash.
    """
    the_doc, the_key = new_names(docs, "doc", "key")
    hit = contained(docs, items, id_col, text_col, **options).select(F.col("doc").alias(the_doc), F.col("key").alias(the_key)).distinct()
    same = col(id_col).eqNullSafe(F.col(the_doc)) & (F.xxhash64(col(text_col)) == F.col(the_key))
    return docs.join(hit, same, "left_anti")
