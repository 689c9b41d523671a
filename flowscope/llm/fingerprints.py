"""Fingerprints of documents, of their edited forms, and of their neighbours by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.llm.common import materialize, text_column
from flowscope.llm.weighted_sampling import fingerprint, likeness, signatures

PLACES = 32


def next_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (distinct ``keys``) with ``next_<key>``: the following row in key order, the first after the last.

    Rows are laid out by ranges, ordered inside a range, and a range's last row takes the first row of the next range.
    One small row per range is all that meets in one place.
    """
    ranged = rows.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # the sampled borders are fixed from here on
    key = F.struct(*[F.col(k).isNull().alias(f"no_{k}") for k in keys], *keys)
    inside = W.partitionBy("range").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    led = ranged.withColumn("following", F.lead(key).over(inside))
    heads = materialize(ranged.groupBy("range").agg(F.min(key).alias("head")), "range-heads")
    over_ranges = W.orderBy("range")
    heads = heads.select(
        "range", F.coalesce(F.lead("head").over(over_ranges), F.first("head").over(over_ranges)).alias("next_head")
    )
    joined = led.join(F.broadcast(heads), "range")  # as many rows as there are partitions
    following = F.coalesce("following", "next_head")
    return joined.select(*rows.columns, *[following[k].alias(f"next_{k}") for k in keys])


NO_ID = (1 << 63) - 1  # stands for a missing id in joins


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = text_column(docs, text)
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))


def _id(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def fingerprint_documents(docs: DataFrame, places: int = PLACES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) for every row of ``docs``; equal texts have equal fingerprints.

    Null texts are empty; texts without words share a fingerprint of their own kind.  Repeated rows appear as often as
    they come, rows without an id too.
    """
    rows = _keyed(docs, id_col, text)
    signed = signatures(rows.dropDuplicates(["key"]).select("key", "text"), ["key"], places)
    named = rows.select("id", "key").join(signed, "key", "left")
    return named.select(_id("id").alias(id_col), fingerprint(F.col("signature"), places).alias("fingerprint"))


def compare_edited_and_next(docs: DataFrame, places: int = PLACES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The edited text has its last quarter (floor) of code points replaced by the first as many, or all, of the next
    document by id.  Null texts are empty; a text without words has a fingerprint of its own kind, and two such are
    alike.  Rows equal in id and text are one document and appear as often as they come; rows that share an id are
    ordered by a hash of their text, rows without an id are last.  A single document is its own next one.
    """
    keys = ["id", "key"]
    rows = _keyed(docs, id_col, text)
    sized = rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    order = materialize(next_in_order(sized, keys), "fingerprint-order")
    # what each next document gives its predecessor: only the beginning that is needed travels
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.col("id").alias("to_id"),
                          F.col("key").alias("to_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    single = rows.dropDuplicates(keys)  # the texts are laid out by id and key once, for all that follows
    heads = single.join(wanted, keys).select(
        F.col("to_id").alias("id"), F.col("to_key").alias("key"), F.expr("substring(text, 1, quarter)").alias("head")
    )
    edited = F.expr("concat(substring(text, 1, length(text) - floor(length(text) / 4)), head)")
    whole = single.join(heads, keys).select(*keys, "text", edited.alias("edited"))
    version = F.explode(F.array(
        F.struct(F.lit(0).alias("edit"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")),
    )).alias("version")
    signed = signatures(whole.select(*keys, version).select(*keys, "version.edit", "version.text"), [*keys, "edit"], places)
    pairs = signed.groupBy(*keys).agg(
        F.max(F.when(F.col("edit") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("edit") == 1, F.col("signature"))).alias("changed")
    )
    digests = whole.select(*keys, F.sha2("edited", 256).alias("edited_sha256"))
    blank = F.array_repeat(F.lit(-1), places)
    prints = materialize(digests.join(pairs, keys, "left").select(
        *keys, "edited_sha256", *[F.coalesce(F.col(c).cast("array<int>"), blank).alias(c) for c in ("own", "changed")]
    ), "fingerprints")
    nexts = prints.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("own").alias("next"))
    out = order.join(prints, keys).join(nexts, ["next_id", "next_key"]).select(
        _id("id").alias(id_col), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("own"), places).alias("fingerprint"), fingerprint(F.col("changed"), places).alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"), "copies",
    )
    return out.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).drop("copy", "copies")
