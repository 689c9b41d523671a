"""Secrets in texts: fixed patterns, and strings of high entropy; DataFrame functions only, and nothing is shuffled.

A pattern's matches get their places from the lengths of what ``split`` leaves between them.  Candidate strings that no
pattern covers, and the segments of paths by themselves, are judged by the Shannon entropy of a window that slides over them: a character that enters and one that
leaves change two packed counts and the sum the entropy is made of.  The time grows with the text, however many matches
it holds.  The bound depends on the character class of the string.
An allow-list keeps out what is random by nature but no secret.  It never touches pattern matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import text_column

# The patterns of the contract; lengths below which a match is dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs are maximal: the same matches as of + that have 20 characters
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# character class of a candidate, and the entropy in bits that a window of it must reach
CLASSES = [("^[0-9A-Fa-f]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("^[A-Za-z0-9+/_=-]+$", 3.8)]
# A word is of one case, capitalised or in camel case with humps that are not short; possessive, so nothing backtracks.
SHORT = "By|Of|Is|To|In|On|At|Id|Or|If|As|An|No|Tag|Map|Key|Set|Get|Url|Max|Min|New|Add|For|And|The|Not|All|Any|Row|Day|Out|Top|End"
CAMEL = f"[a-z]*+(?:[A-Z]{{1,5}}[a-z]{{3,}}+|(?:{SHORT})(?![a-z]))++[A-Z]{{0,4}}"
WORD = f"(?:[A-Z]?[a-z]++|[A-Z]++|{CAMEL})(?![A-Za-z])"
SEGMENT = f"[_-]*+{WORD}(?:[_-]++{WORD})*+[_-]*+[0-9]{{0,4}}"
UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
ALLOWED = [
    f"^[+/_=-]*+{WORD}(?:[+/_=-]++{WORD})*+[+/_=-]*+$", "^[^A-Za-z]*$",  # words, numbers
    f"^{UUID}$", f"^{WORD}[0-9]{{1,4}}$",  # a word with a number
    f"^/?(?:{SEGMENT}/)++(?:(?:{SEGMENT})?(?:[_-][0-9]{{1,4}}){{0,3}}|[0-9]++(?:[_-][0-9]++)*+|{UUID})$",  # a path of words
]
PLACEHOLDER = "(?i)example|dummy|sample|placeholder|changeme|xxxx"


BLOCK = 512  # elements whose running values are built one by one
PIECE = 1024  # code points of a block of text that parts are cut from


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima or the like of an array of bigint, each with its own element.

    Appending to an array copies it.  Blocks of fixed size are built that way and then moved on by what stands before
    them, so the time grows with the number of elements and not with its square.
    """
    none = F.expr("cast(array() as array<bigint>)")
    last = lambda a: F.get(a, F.size(a) - 1)
    joined = lambda before, x: F.when(before.isNull(), x).otherwise(combine(before, x))

    def inside(block: Column) -> Column:
        return F.aggregate(block, none, lambda out, x: F.array_append(out, joined(last(out), x)))

    def moved(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("bigint")), inside(F.transform(blocks, last)))
        return F.flatten(F.transform(blocks, lambda block, i: let(
            F.get(before, i), lambda b: F.transform(block, lambda x: joined(b, x)))))

    starts = lambda a: F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(BLOCK))
    blocks = let(values, lambda a: F.transform(starts(a), lambda at: inside(F.slice(a, at + 1, BLOCK))))
    return let(blocks, moved)


def match_spans(text: Column, pattern: str, kind: int, keep_group: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, stop, match) of the non-overlapping matches, leftmost first, in code points."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if keep_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group))
    zipped = F.arrays_zip(found.alias("found"), between.alias("between"), judged.alias("judged"))
    real = F.filter(zipped, lambda x: x["found"].isNotNull())  # one piece more than matches

    def spans(matches: Column) -> Column:
        size = F.transform(matches, lambda x: (F.length(x["between"]) + F.length(x["found"])).cast("bigint"))
        return F.zip_with(matches, running(size, lambda a, b: a + b), lambda x, stop: F.struct(
            F.length(x["judged"]).alias("size"), _span(stop - F.length(x["found"]), kind, stop, x["found"]).alias("span")))

    kept = F.filter(let(real, spans), lambda s: s["size"] >= least)
    return F.transform(kept, lambda s: s["span"])


NO_SPANS = "cast(array() as array<struct<start: bigint, kind: int, stop: bigint, match: string>>)"


def _span(start: Column, kind: int, stop: Column, match: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), match.alias("match"))


def text_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut_out(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` of the text with these pieces; its time does not grow with ``start``."""
    first = F.floor(start / PIECE).cast("int")
    count = F.greatest(F.ceil(stop / PIECE).cast("int") - first, F.lit(0))
    near = F.array_join(F.slice(pieces, first + 1, count), "")
    return F.substring(near, (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))


COUNT_BITS = 5  # a count of a window fits into 5 bits, 12 counts into a long
COUNTS_PER_LONG = 12


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of at most 31 characters of a string over ``ALPHABET``.

    The counts are packed into longs, so a step changes two of them where they are.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError(f"a window has 1 to {(1 << COUNT_BITS) - 1} characters")
    longs = range(-(-len(ALPHABET) // COUNTS_PER_LONG))
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{j}") for j in longs], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    shift = lambda at: (at % COUNTS_PER_LONG) * COUNT_BITS
    one = lambda at, j: F.when(F.floor(at / COUNTS_PER_LONG) == j, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(at))).otherwise(F.lit(0).cast("bigint"))

    def count(state: Column, at: Column) -> Column:
        packed = F.lit(0).cast("bigint")
        for j in longs:
            packed = F.when(F.floor(at / COUNTS_PER_LONG) == j, state[f"c{j}"]).otherwise(packed)
        return F.call_function("shiftright", packed, shift(at)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(state: Column, x: Column) -> Column:
        entering, leaving = x["entering"], x["leaving"]
        changed = leaving.isNull() | (entering != leaving)

        def after(n: Column) -> Column:
            change = F.get(plogp, n["in"] + 1) - F.get(plogp, n["in"]) + F.when(
                leaving.isNull(), 0.0).otherwise(F.get(plogp, n["out"] - 1) - F.get(plogp, n["out"]))
            return state["sum"] + F.when(changed, change).otherwise(0.0)

        total = let(F.struct(count(state, entering).alias("in"), F.when(leaving.isNull(), 1).otherwise(count(state, leaving)).alias("out")), after)
        counts = [
            F.when(changed, state[f"c{j}"] + one(entering, j) - F.when(leaving.isNull(), F.lit(0).cast("bigint")).otherwise(one(leaving, j)))
            .otherwise(state[f"c{j}"]).alias(f"c{j}") for j in longs
        ]
        best = lambda t: F.when(x["full"], F.greatest(state["best"], F.lit(math.log2(window)) - t / window)).otherwise(state["best"])
        return let(total, lambda t: F.struct(*counts, t.alias("sum"), best(t).alias("best")))

    def slide(codes: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.struct(
            c.alias("entering"), F.when(i >= window, F.get(codes, i - window)).alias("leaving"), (i + 1 >= window).alias("full")))
        return F.aggregate(steps, zero, step, lambda s: s["best"])

    letters = F.filter(F.split(string, ""), lambda c: c != "")
    return let(F.transform(letters, place), slide)


def is_random(string: Column) -> Column:
    """A candidate that the allow-list lets pass and one of whose windows is random for its character class."""
    segments = F.split(string, "/")
    allowed = F.exists(segments, lambda x: x.rlike(PLACEHOLDER) & ~x.rlike(f"^{SEGMENT}$"))
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(pattern)
    bound = F.when(string.rlike(CLASSES[0][0]), CLASSES[0][1])
    for pattern, bits in CLASSES[1:]:
        bound = bound.when(string.rlike(pattern), bits)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(string) >= bound)


def outside(strings: Column, base: Column, text: Column) -> Column:
    """The parts of all candidates between the base spans, in order, that are still long enough to be candidates.

    Both lists are in order.  What base spans leave free is a list of gaps; each candidate finds its gaps by binary
    search, so no candidate looks at all base spans.
    """

    def gaps(ordered: Column) -> Column:
        def free(reach: Column) -> Column:
            before = F.transform(ordered, lambda b, i: F.struct(
                F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, i - 1)).alias("start"), b["start"].alias("stop")))
            last = F.struct(F.get(reach, F.size(reach) - 1).alias("start"), F.length(text).cast("bigint").alias("stop"))
            return F.filter(F.concat(before, F.array(last)), lambda g: g["stop"] - g["start"] >= WINDOW)

        return let(running(F.transform(ordered, lambda b: b["stop"]), F.greatest), free)

    def at_least(free: Column, bound: Callable[[Column], Column]) -> Column:
        """Number of the first gap for which ``bound`` holds; it holds for all gaps after it."""
        start = F.struct(F.lit(0).alias("low"), F.size(free).alias("high"))
        middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

        def halve(s: Column, _: Column) -> Column:
            return let(middle(s), lambda m: F.when(s["low"] >= s["high"], s).when(
                bound(F.get(free, m)), F.struct(s["low"].alias("low"), m.alias("high"))).otherwise(
                F.struct((m + 1).alias("low"), s["high"].alias("high"))))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(free) + 1)).cast("int")), start, halve, lambda s: s["low"])

    def parts(string: Column, found: Column) -> Column:
        first = at_least(found["gaps"], lambda g: g["stop"] > string["start"])
        end = at_least(found["gaps"], lambda g: g["start"] >= string["stop"])
        near = let(first, lambda at: F.slice(found["gaps"], at + 1, F.greatest(end - at, F.lit(0))))
        clipped = F.transform(near, lambda g: F.struct(
            F.greatest(g["start"], string["start"]).alias("start"), F.least(g["stop"], string["stop"]).alias("stop")))
        long = F.filter(clipped, lambda g: g["stop"] - g["start"] >= WINDOW)
        return F.transform(long, lambda g: _span(g["start"], 3, g["stop"], F.when(
            g["stop"] - g["start"] == string["stop"] - string["start"], string["match"]).otherwise(
            cut_out(found["pieces"], g["start"], g["stop"]))))

    found = F.struct(let(F.array_sort(base), gaps).alias("gaps"), text_pieces(text).alias("pieces"))
    cut = let(found, lambda x: F.flatten(F.transform(strings, lambda s: parts(s, x))))
    return F.when((F.size(base) == 0) | (F.size(strings) == 0), strings).otherwise(cut)


def random_parts(string: Column) -> Column:
    """Random segments of a candidate if there is nothing but words beside them, else the candidate if it is random.

    A secret may itself hold slashes: a candidate is judged whole too, however short its segments are.
    """
    segments = F.transform(F.split(string["match"], "/"), lambda x: F.struct(
        x.alias("match"), ((F.length(x) >= WINDOW) & is_random(x)).alias("random"), (F.length(x) + 1).cast("bigint").alias("size")))
    whole = F.array(_span(string["start"], 3, string["stop"], string["match"]))

    def choose(parts: Column) -> Column:
        any_random = F.exists(parts, lambda x: x["random"])
        words = F.forall(parts, lambda x: (x["match"] == "") | x["random"] | x["match"].rlike(f"^{SEGMENT}$"))
        ends = running(F.transform(parts, lambda x: x["size"]), lambda a, b: a + b)
        placed = F.zip_with(parts, ends, lambda x, end: F.struct(x["random"].alias("random"), _span(
            string["start"] + end - x["size"], 3, string["start"] + end - 1, x["match"]).alias("span")))
        found = F.when(any_random, F.transform(F.filter(placed, lambda x: x["random"]), lambda x: x["span"])).otherwise(F.expr(NO_SPANS))
        return F.when(any_random & words, found).when((F.size(parts) > 1) & is_random(string["match"]), whole).otherwise(found)

    return let(segments, choose)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``: array of (kind, start, stop), in code points, by start and kind.

    ``assign``, ``access`` and ``hex`` are the pattern matches; ``entropy`` spans are random strings in what these leave
    of the candidates.  Letters of a single case count as words, also where they are random.  Null and empty texts have no spans.  Every row gives one row, repeated ones and those without an id too.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text).alias("text"))
    return with_spans(rows).select(F.col("id").alias(id_col), "spans")


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column ``text`` that is not null) and their ``spans``."""
    body = F.col("text")
    none, lowered = F.expr(NO_SPANS), F.lower(body)
    # cheap tests first: most texts hold no keyword and no long run
    named = lowered.contains("passw") | lowered.contains("secret") | lowered.contains("token") | lowered.contains("api")
    assign = F.when(named, match_spans(body, ASSIGN, 0, 2, ASSIGN_VALUE)).otherwise(none)
    access = F.when(body.contains("AKIA"), match_spans(body, ACCESS, 1)).otherwise(none)
    hexes = F.when(body.rlike(HEX), match_spans(body, HEX, 2)).otherwise(none)
    found = rows.select("*", F.concat(assign, access, hexes).alias("base"))
    strings = F.when(body.rlike(CANDIDATE), match_spans(body, CANDIDATE, 3)).otherwise(none)
    found = found.select("*", let(strings, lambda s: outside(s, F.col("base"), body)).alias("candidates"))
    more = F.flatten(F.transform("candidates", random_parts))
    ordered = F.array_sort(F.concat(F.col("base"), more))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(ordered, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select("*", spans.alias("spans")).drop("base", "candidates")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap are replaced together.  Spans are in order."""

    def replaced(x: Column) -> Column:
        reach, pieces = x["reach"], x["pieces"]
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, i - 1))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(
            cut_out(pieces, before(i), s["start"]), F.lit(mark))).otherwise(""))
        rest = cut_out(pieces, F.get(reach, F.size(reach) - 1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(parts, ""), rest)

    reach = running(F.transform(spans, lambda s: s["stop"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(reach.alias("reach"), text_pieces(text).alias("pieces")), replaced))
