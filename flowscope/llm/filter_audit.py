"""What every filter removes in every order of a set of filters.

Each document fails some of the filters; which ones is a mask.  Documents are counted by part and mask, and every such
cell is folded over the constant array of all orders: ``transform`` runs through the orders, ``aggregate`` through the
steps of one, and the cell becomes one array of weighted structs, a struct for each step of each order.  The arrays of a
part are added element by element; a part has at most as many cells as there are masks.

Whole texts never leave their task: duplicates are found by SHA-256, after copies were counted map-side.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.llm.common import UPPER, text_column

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 100, 80, 10
MARKS = "[#$%&*|]"
DUPLICATE = 1 << LETTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failing(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(spaced, " "), "")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("bigint") < LEAST_DISTINCT_PERCENT * F.size(words).cast("bigint"),
        100 * upper.cast("bigint") > MOST_UPPER_PERCENT * F.length(text).cast("bigint"),
        text.rlike(MARKS),
    ]
    mask = F.lit(0)
    for bit, fails in enumerate(tests):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters.

    Copies of a text are counted per part and text first; of those rows only the ones with the table's smallest id pass
    the duplicate filter.  A row without an id comes after every row with one.
    """
    text = text_column(docs)
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), failing(text).alias("mask"),
    )
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    known = rows.where("id is not null").join(marked, "id", "left").fillna(0, ["good", "toxic"])
    nameless = rows.where("id is null").select("id", "part", "digest", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    every = known.unionByName(nameless)
    one = F.lit(1).cast("bigint")
    by_id = every.groupBy("id", "part", "digest", "mask", "good", "toxic").agg(F.sum(one).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n", (F.col("n") * F.col("good")).alias("good"),
                           (F.col("n") * F.col("toxic")).alias("toxic")))
    by_text = by_id.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        first.alias("first"),
    )
    # a text has as many rows here as parts: the window's groups are small
    lowest = F.min(F.struct("first.no_id", "first.id")).over(W.partitionBy("digest"))
    leads = F.struct("first.no_id", "first.id") == F.col("lowest")
    led = by_text.withColumn("lowest", lowest).withColumn("leads", leads)
    counts = ("n", "good", "toxic")
    none = F.lit(0).cast("bigint")
    heads = [F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(none).alias(c) for c in counts]
    rest = [(F.col(c) - F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(none)).alias(c) for c in counts]
    split = led.select("part", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), *heads), F.struct((F.col("mask") + DUPLICATE).alias("mask"), *rest),
    ))).where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def folded(mask: Column, n: Column, good: Column, toxic: Column, orders: list[str]) -> Column:
    """One struct of weighted counts for every step of every order, in that order."""
    steps = F.array(*[F.array(*[F.lit(1 << LETTERS.index(x)) for x in order]) for order in orders])
    none = F.lit(0).cast("bigint")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) > 0, state["gone"]
        here = fails & ~gone
        row = F.struct(
            F.when(fails | gone, none).otherwise(n).alias("kept"),
            F.when(here, n).otherwise(none).alias("removed"),
            F.when(fails & gone, n).otherwise(none).alias("redundant"),
            F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
            F.when(here, good).otherwise(none).alias("good_lost"),
            F.when(here, toxic).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["rows"], F.array(row)).alias("rows"))

    empty = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(False).alias("gone"), empty.alias("rows"))
    return F.flatten(F.transform(steps, lambda order: F.aggregate(order, start, step, lambda state: state["rows"])))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts, shapley) for every part, order of the five filters and step.

    Needs ``doc_id, text, lang`` and ``doc_id, quality, toxic``; other columns are not read.  Null texts are empty, a null
    ``lang`` is the part ''.  Every row of ``docs`` counts, repeated ones too; equal texts under the same id are no
    duplicates of each other.  A row without an id has no labels and is a duplicate of any row with an id and its
    text, but not of another row without one.  A document is good or toxic if any of its labels says so.  An empty table
    has no parts.  ``shapley`` is what the step's filter removes, summed over all orders.
    """
    orders = ["".join(p) for p in permutations(LETTERS)]
    cells = mask_cells(docs, labels)
    arrays = cells.select("part", folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), orders).alias("rows"))

    def add(total: Column, more: Column) -> Column:
        return F.zip_with(total, more, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))

    zero = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COUNTS]), len(orders) * len(LETTERS))
    summed = arrays.groupBy("part").agg(F.aggregate(F.collect_list("rows"), zero, add).alias("rows"))  # at most 32 arrays
    steps = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(x).alias("letter"))
                      for order in orders for i, x in enumerate(order)])
    named = summed.select("part", F.zip_with("rows", steps, lambda r, s: F.struct(
        s["filter_order"].alias("filter_order"), s["step"].alias("step"), s["letter"].alias("letter"), *[r[c].alias(c) for c in COUNTS],
    )).alias("rows"))
    def share(letter: str) -> Column:
        removed = lambda total, r: total + F.when(r["letter"] == letter, r["removed"]).otherwise(0)
        return F.aggregate("rows", F.lit(0).cast("bigint"), removed)

    shares = F.create_map(*[part for x in LETTERS for part in (F.lit(x), share(x))])
    out = named.withColumn("shares", shares).select("part", "shares", F.inline("rows"))
    return out.select("part", "filter_order", "step", *COUNTS, F.col("shares")[F.col("letter")].alias("shapley"))
