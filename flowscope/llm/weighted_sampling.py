"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Every term of a text has a weight (how often it occurs).  For each of the signature's places a gamma-distributed pair
and a uniform number are derived from the term alone; they turn the weight into a level and a score, and the term with
the smallest score gives the place's value, made of term and level.  Two texts agree in a place with a probability that
equals the generalised Jaccard similarity of their weights: sum of the smaller weights over sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import words

TOGETHER = 8  # places worked out for one row at a time: keeps generated methods small
VALUE_BITS = 25


def _unit(number: Column, bits: int) -> Column:
    """A whole number of so many bits as a number between 0 and 1, never either."""
    return (number + F.lit(0.5)) / F.lit(float(1 << bits))


def sample_rank(term: Column, log_weight: Column, place: Column) -> Column:
    """Score and value of a term in one place as one number: the smallest number has the smallest score."""
    draw, again = F.xxhash64(term, place), F.xxhash64(place, term)
    low21, low22 = F.lit((1 << 21) - 1), F.lit((1 << 22) - 1)
    rate = -F.log(_unit(F.shiftrightunsigned(draw, 43), 21) * _unit(F.shiftrightunsigned(draw, 22).bitwiseAND(low21), 21))
    offset = _unit(draw.bitwiseAND(low22), 22)
    reach = -F.log(_unit(F.shiftrightunsigned(again, 32), 32) * _unit(again.bitwiseAND(F.lit((1 << 32) - 1)), 32))
    level = F.floor(log_weight / rate + offset)
    score = F.log(reach) - rate * (level - offset + F.lit(1.0))
    scaled = ((F.greatest(F.least(score, F.lit(63.0)), F.lit(-63.0)) + F.lit(64.0)) * F.lit(float(1 << 31))).cast("bigint")
    value = F.xxhash64(term, level).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    return F.shiftleft(scaled, VALUE_BITS).bitwiseOR(value)


def term_weights(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, log_weight): how often each word occurs in each text, words as 64-bit hashes."""
    terms = texts.select(*keys, F.explode(words(F.col(text))).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    return terms.groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("log_weight"))


def signatures(texts: DataFrame, keys: list[str], places: int, text: str = "text") -> DataFrame:
    """(keys, signature array<bigint>) of every text that has a word.  Nothing is shuffled if ``texts`` is laid out by
    some of ``keys``."""
    rounds = places // TOGETHER
    rows = term_weights(texts, keys, text).select("*", F.explode(F.array(*[F.lit(i) for i in range(rounds)])).alias("round"))
    ranks = [
        F.min(sample_rank(F.col("term"), F.col("log_weight"), F.col("round") * TOGETHER + j)).alias(f"place{j}") for j in range(TOGETHER)
    ]
    smallest = rows.groupBy(*keys, "round").agg(*ranks)
    values = F.array(*[F.col(f"place{j}").bitwiseAND(F.lit((1 << VALUE_BITS) - 1)) for j in range(TOGETHER)])
    gathered = smallest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("round", values.alias("values")))).alias("rounds"))
    return gathered.select(*keys, F.flatten(F.transform("rounds", lambda r: r["values"])).alias("signature"))


def fingerprint(signature: Column, places: int) -> Column:
    """The signature as text: seven hexadecimal digits a place; a text without words (null, or -1 everywhere) has dashes."""
    shown = F.transform(signature, lambda v: F.when(v < 0, "-" * 7).otherwise(F.lower(F.lpad(F.hex(v), 7, "0"))))
    return F.coalesce(F.array_join(shown, ""), F.lit("-" * 7 * places))


def likeness(one: str, other: str) -> Column:
    """Share of equal places of two signatures, 0 to 1."""
    same = F.zip_with(one, other, lambda a, b: a == b)
    return F.size(F.filter(same, lambda x: x)) / F.size(one)
