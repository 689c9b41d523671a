"""Test items inside documents: containment search with MinHash sketches by item size, exact shingles at the end.

An item is contained in a document if enough of its word shingles are among the document's.  Of each item the shingles
with the smallest hashes are its sketch.  A document that contains the item can lack only so many shingles, so a sketch
that is longer than this number by ``d`` has at least ``d`` shingles in the document: items are partitioned by size,
larger ones ask for more hits, and no contained item is missed.  Documents probe the sketches with all of their
shingles; pairs with enough hits are verified with all shingles of the item.

DataFrame operations only.  Sketches and item shingles are written first, so the planner knows their size: it broadcasts
them while they are small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import materialize, text_column, words

SHINGLE = 5
# sizes from which an item asks for more sketch hits, and how many
SIZE_PARTITIONS = [(4, 1), (16, 2), (64, 4), (None, 8)]


def shingled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shingle): 64-bit hashes of the five-word shingles of ``text``, as often as they come.

    Fewer words are one shingle, no words none.
    """
    split = rows.select(*keys, words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = split.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))).alias("i"))
    return at.select(*keys, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(SHINGLE)]).alias("shingle"))


def least_shared(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / F.lit(100.0)).cast("bigint")


def item_tables(items: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(item, shingle, size, need: all shingles; item, shingle, hits: sketches)."""
    per_item = shingled(items, ["item"]).groupBy("item").agg(F.collect_set("shingle").alias("shingles"))
    size = F.size("shingles").cast("bigint")
    hits = F.lit(SIZE_PARTITIONS[-1][1])
    for bound, n in reversed(SIZE_PARTITIONS[:-1]):
        hits = F.when(size <= bound, n).otherwise(hits)
    sized = per_item.select("item", "shingles", size.alias("size"), least_shared(size, percent).alias("need"), hits.alias("partition_hits"))
    missing = F.col("size") - F.col("need")
    sized = sized.withColumn("hits", F.least(F.col("partition_hits").cast("bigint"), F.col("need")))
    ordered = F.sort_array(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("rank"), s.alias("shingle"))))
    sketch = F.transform(F.slice(ordered, F.lit(1), (missing + F.col("hits")).cast("int")), lambda x: x["shingle"])
    full = sized.select("item", "size", "need", F.explode("shingles").alias("shingle"))
    sketches = sized.select("item", "hits", F.explode(sketch).alias("shingle"))
    return materialize(full, "benchmark-shingles"), materialize(sketches, "benchmark-sketches")


def find_items(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_shingles, n_shared, containment) for every document that holds at least ``percent`` of an item.

    Words are lower-cased (A-Z) runs between ASCII white space.  An item of fewer than five words is one shingle and is
    found only in documents that are these words; items and documents without words match nothing.  Rows that share an
    id (or have none) are one document, and likewise one item.  Empty tables give no pairs.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_column(docs, text).alias("text"))
    tests = items.select(F.col(item_id).alias("item"), text_column(items, item_text).alias("text"))
    full, sketches = item_tables(tests, percent)
    # a document's hits are few: they are made distinct after the probe
    probed = shingled(rows, ["doc"]).join(sketches, "shingle").select("doc", "item", "hits", "shingle").distinct()
    pairs = probed.groupBy("doc", "item").agg(F.count("*").alias("n"), F.max("hits").alias("hits")).where("n >= hits")
    pairs = materialize(pairs.select("doc", "item"), "benchmark-candidates")
    hit = pairs.select(F.col("doc").alias("hit")).distinct()
    chosen = rows.join(hit, rows["doc"].eqNullSafe(hit["hit"]), "left_semi")
    present = shingled(chosen, ["doc"]).join(full, "shingle").select("doc", "item", "size", "need", "shingle").distinct()
    counted = present.groupBy("doc", "item").agg(
        F.count("*").alias("n_shared"), F.max("size").alias("n_shingles"), F.max("need").alias("need")
    )
    asked = pairs.select(F.col("doc").alias("asked_doc"), F.col("item").alias("asked_item"))
    counted = counted.join(asked, counted["doc"].eqNullSafe(asked["asked_doc"]) & counted["item"].eqNullSafe(asked["asked_item"]), "left_semi")
    found = counted.where("n_shared >= need")
    return found.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_id), "n_shingles", "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )
