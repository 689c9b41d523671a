"""Block and allow rules for URLs, and the reputation of the hosts that no rule covers.

Labelled pages say how often a host's pages are bad.  Counts are shrunk through three beta-binomial levels: a public
suffix towards all pages, a registered domain towards its suffix, a host towards its domain.  How strongly is estimated
from the counts themselves, per level, by the spread of the groups around their parents (method of moments).  A host is
blocked if the lower bound of its posterior bad rate is above a limit; hosts without labelled pages have their domain's.

DataFrame functions only.  Rules and reputation are worked out once for each host; pages then look up their host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import lower_ascii, materialize

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BAD_LIMIT = 0.5  # the bad rate above which a host goes
DEVIATIONS = 1.645  # that the posterior mean has to be above it
LEAST_SPREAD, MOST_SPREAD = 1e-4, 0.99  # intraclass correlation of a level
HEAVY_SHARE = 1000  # keys with more than 1 / 1000 of the rows are looked up apart: there are fewer than 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.

    Without ``://``, and for null, both are empty.
    """
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def domain_levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, public suffix).  The suffix is the last label, or the longest of ``suffixes`` that fits.

    User names and ports do not count; a numeric address is its own domain under the suffix ''.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", "")
    numeric = name.rlike(r"^([0-9.]+|\[.*\]?)$")
    labels = F.split(name, r"\.")
    size = F.lit(1)
    for width in sorted({s.count(".") + 1 for s in suffixes}):
        listed = [s for s in suffixes if s.count(".") + 1 == width]
        size = F.when(F.array_join(F.slice(labels, -F.least(F.lit(width), F.size(labels)), width), ".").isin(listed), width).otherwise(size)
    last = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), n), ".")
    return F.when(numeric, name).otherwise(last(size + 1)), F.when(numeric, "").otherwise(last(size))


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each of their keys; ``weight`` says for how many.

    The keys that hold more than a thousandth of all rows are fewer than a thousand: they are broadcast, so no task
    meets a hot key.  The others are joined by a shuffle, or as the planner sees fit.
    """
    total = table.agg(F.sum(weight).alias("n")).first().n or 0
    heavy = F.col(weight) * HEAVY_SHARE > total
    names = table.where(heavy).select(key).withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(names), key, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(table.where(heavy)), key)
    cold = marked.where("_heavy is null").drop("_heavy").join(table.where(~heavy), key)
    return hot.unionByName(cold)


def spread(groups: DataFrame, mean: Column) -> float:
    """How far groups of (n, bad) lie from the mean their parent gives them, as a share of the largest possible."""
    expected, variance = F.col("n") * mean, mean * (1 - mean)
    got = groups.agg(
        F.sum(F.pow(F.col("bad") - expected, F.lit(2.0)) - F.col("n") * variance).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * variance).alias("room"),
    ).first()
    share = got.over / got.room if got.room else 0.0
    return min(max(share, LEAST_SPREAD), MOST_SPREAD)


def host_reputation(hosts: DataFrame, limit: float = BAD_LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """``hosts`` (host, domain, suffix, pages, n, bad) with ``bad_rate, bad_bound`` and ``reputation`` (allow or block)."""

    def level(rows: DataFrame, keys: list[str], members: str) -> DataFrame:
        counted = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "bad")], F.count("*").alias(members))
        return materialize(counted, f"url-{keys[0]}")

    def shrunk(groups: DataFrame, mean: Column) -> DataFrame:
        """Adds the posterior's parameters and mean, from the prior around ``mean``."""
        strength = 1 / spread(groups, mean) - 1
        a, b = strength * mean + F.col("bad"), strength * (1 - mean) + F.col("n") - F.col("bad")
        return groups.withColumn("a", a).withColumn("b", b).withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))

    domains = level(hosts, ["domain", "suffix"], "hosts_in")
    suffixes = level(domains, ["suffix"], "domains_in")
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = F.lit(((whole.bad or 0) + 1.0) / ((whole.n or 0) + 2.0))
    top = shrunk(suffixes, mean).select("suffix", "domains_in", F.col("rate").alias("prior"))
    under = materialize(look_up(domains, top, "suffix", "domains_in"), "url-domain-priors")
    middle = materialize(shrunk(under, F.col("prior")).select("domain", "hosts_in", F.col("rate").alias("prior")), "url-domains")
    below = materialize(look_up(hosts, middle, "domain", "hosts_in").drop("hosts_in"), "url-host-priors")
    judged = shrunk(below, F.col("prior"))
    total = F.col("a") + F.col("b")
    bound = F.col("rate") - deviations * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    judged = judged.withColumn("bad_rate", F.col("rate")).withColumn("bad_bound", bound)
    return judged.withColumn("reputation", F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).drop("a", "b", "rate", "prior")


def fitting_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, fitting): for hosts that some rule fits, its (path, rule, verdict), longest first.

    ``rules`` is a list of the caller; its host parts are looked up among the endings of each host.
    """
    spark = hosts.sparkSession
    rows = [F.struct(F.lit(r.split("/", 1)[0]).alias("rule_host"), F.lit("/" + r.split("/", 1)[1]).alias("path"),
                     F.lit(r).alias("rule"), F.lit(verdict).alias("verdict")) for verdict, r in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    depth = max(r.split("/", 1)[0].count(".") + 1 for _, r in rules)
    labels = F.split("host", r"\.")
    width = F.least(F.size(labels), F.lit(depth))
    endings = F.transform(F.sequence(F.lit(1), width), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    found = hosts.select("host", F.explode(endings).alias("rule_host")).join(F.broadcast(table), "rule_host")  # the caller's list
    order = F.struct((-F.length("rule")).alias("shorter"), (-F.length("rule_host")).alias("wider"), "rule", "path", "verdict")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("fitting"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, suffixes: Sequence[str] = (),
               limit: float = BAD_LIMIT, deviations: float = DEVIATIONS, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bad_bound) for every row of ``pages``.

    ``outcomes`` (``url, bad``): labelled pages, bad true or false (null counts for nothing).  ``rules``: (verdict,
    host/path) pairs; a rule fits its host, all hosts below it, and paths that start with its path; the longest decides.
    Where none fits, the host's reputation does.  Rows without a URL share the host ''; repeated rows are judged each and
    count each; other columns are not read; an empty table gives no rows, and without outcomes nothing is blocked but by
    rules.
    """
    host, path = url_parts(F.col(url).cast("string"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("bad is not null").select(url_parts(F.col("url").cast("string"))[0].alias("host"), F.col("bad").cast("bigint").alias("bad"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    seen = rows.select("host", one.alias("pages"), none.alias("n"), none.alias("bad"))
    both = seen.union(labelled.select("host", none, one, F.col("bad")))
    domain, suffix = domain_levels(F.col("host"), suffixes)
    hosts = both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "bad")])
    hosts = materialize(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "url-host-counts")
    known = host_reputation(hosts, limit, deviations)
    if rules:
        known = known.join(fitting_rules(hosts, rules), "host", "left")
    else:
        known = known.withColumn("fitting", F.lit(None).cast("array<struct<shorter:int,wider:int,rule:string,path:string,verdict:string>>"))
    known = materialize(known.select("host", "pages", "bad_rate", "bad_bound", "reputation", "fitting"), "url-host-verdicts")
    met = look_up(rows, known, "host", "pages")
    chosen = F.get(F.filter("fitting", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return met.withColumn("chosen", chosen).select(
        id_col, "host", "path", F.col("chosen.rule").alias("rule"), F.coalesce("chosen.verdict", "reputation").alias("verdict"),
        "bad_rate", "bad_bound",
    )
