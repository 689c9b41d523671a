"""One named query for each training-data operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.chat import chat_digests, formatted_table
from flowscope.llm.decontaminate import find_items
from flowscope.llm.filter_audit import audit_filters
from flowscope.llm.fingerprints import compare_edited_and_next
from flowscope.llm.jaccard_join import jaccard_components
from flowscope.llm.lexical_search import rank_documents
from flowscope.llm.line_crf import held_out, train, with_quality
from flowscope.llm.packing import pack_documents
from flowscope.llm.secrets import scan_secrets, span_list
from flowscope.llm.suffix_dedup import remove_repeats
from flowscope.llm.token_counts import count_tokens
from flowscope.llm.url_filters import BAD_LIMIT, DEVIATIONS, LEAST_SPREAD, MOST_SPREAD, RULES, judge_urls, url_parts
from flowscope.llm.warc import archive_pages, page_archive_folder, page_id_of, read_archives


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=5, percent=75)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=100)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = page_archive_folder(spark)
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least=0)
    records = read_archives(spark, folder, verify=True).where("record_type in ('response', 'revisit')")
    return records.select(
        page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)]
    chats = chats.union(spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string"))
    return chat_digests(formatted_table(chats, public_tokenizers.path("byte_bpe_50k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), limit=10)


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


DOCUMENT_NUMBER = "([0-9]+)(\\.html)?/?$"


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's path ends with the number of the document it shows; that document's labels are its outcome."""
    number = F.regexp_extract(url_parts(F.col("url"))[1], DOCUMENT_NUMBER, 1).try_cast("bigint")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return pages.select("url", number.alias("doc_id")).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    outcomes = page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_urls(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_warc": op5_warc,
    "op6_secret_scans": op6_secret_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_url_filters": op13_url_filters,
}

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS BIGINT), 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_SHINGLES = """
  SELECT DISTINCT {id} AS id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (
    SELECT {id}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM (
      SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)
"""

OP7 = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
s AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM s JOIN n ON n.id = item_id WHERE 100 * n_shared >= 75 * n
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(r, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g'))
    + length('<|im_start|><|im_sep|><|im_end|>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_TERMS = """SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM {table}"""

OP11 = f"""
WITH d AS ({_TERMS.format(id="doc_id", table="documents")}), b AS ({_TERMS.format(id="item_id", table="benchmark")}),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, t, 25 + (75 * CAST(len(t) AS BIGINT) * n_docs) // n_terms AS m FROM d, c WHERE len(t) > 0),
tf AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM m) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(t) AS term FROM b) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(generate_series(1, 5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, array_to_string([substr('ABCDE', CAST(k AS BIGINT), 1) for k in o], '') AS filter_order, step, o[step] AS letter, n, good, toxic,
    fails[o[step]] AS bad, list_bool_or([fails[k] for k in o[1:step - 1]]) AS gone,
    len([v for v in fails if v]) = 1 AS alone
  FROM cells, o, (SELECT i AS step FROM x)),
r AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN bad OR coalesce(gone, false) THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN bad AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bad AND coalesce(gone, false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bad AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bad AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""

OP13 = rf"""
WITH raw AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM raw),
o AS (SELECT host, CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS BIGINT) AS bad
  FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '([0-9]+)(\.html)?/?$', 1) AS BIGINT)),
h AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$|\.(:[0-9]*)?$', '') AS name,
    coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT DISTINCT host FROM p) LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host) USING (host)),
hosts AS (SELECT host, n, bad,
    CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\]?)$') THEN name ELSE regexp_extract(name, '([^.]*\.)?[^.]*$') END AS domain,
    CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\]?)$') THEN '' ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM h),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1.0::DOUBLE) / (sum(sum(n)) OVER () + 2.0::DOUBLE) AS u
  FROM domains GROUP BY suffix),
k0 AS (SELECT least(greatest(coalesce(sum(pow(bad - n * u, 2) - n * (u * (1 - u))) / nullif(sum(n * (n - 1) * (u * (1 - u))), 0), 0),
  {LEAST_SPREAD}::DOUBLE), {MOST_SPREAD}::DOUBLE) AS r FROM s0),
s AS (SELECT suffix, ((1 / r - 1) * u + bad) / (((1 / r - 1) * u + bad) + ((1 / r - 1) * (1 - u) + n - bad)) AS prior FROM s0, k0),
d0 AS (SELECT domain, n, bad, prior AS u FROM domains JOIN s USING (suffix)),
k1 AS (SELECT least(greatest(coalesce(sum(pow(bad - n * u, 2) - n * (u * (1 - u))) / nullif(sum(n * (n - 1) * (u * (1 - u))), 0), 0),
  {LEAST_SPREAD}::DOUBLE), {MOST_SPREAD}::DOUBLE) AS r FROM d0),
d AS (SELECT domain, ((1 / r - 1) * u + bad) / (((1 / r - 1) * u + bad) + ((1 / r - 1) * (1 - u) + n - bad)) AS prior FROM d0, k1),
h0 AS (SELECT host, n, bad, prior AS u FROM hosts JOIN d USING (domain)),
k2 AS (SELECT least(greatest(coalesce(sum(pow(bad - n * u, 2) - n * (u * (1 - u))) / nullif(sum(n * (n - 1) * (u * (1 - u))), 0), 0),
  {LEAST_SPREAD}::DOUBLE), {MOST_SPREAD}::DOUBLE) AS r FROM h0),
ab AS (SELECT host, (1 / r - 1) * u + bad AS a, (1 / r - 1) * (1 - u) + n - bad AS b FROM h0, k2),
rep AS (SELECT host, CASE WHEN a / (a + b) - {DEVIATIONS}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {BAD_LIMIT}::DOUBLE
  THEN 'block' ELSE 'allow' END AS verdict FROM ab),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}')" for v, r in RULES)}) v(verdict, rule_host, rule_path, rule)),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(fit.verdict, rep.verdict) AS verdict FROM p JOIN rep USING (host) LEFT JOIN fit USING (page_id)
"""

CHECKS: dict[str, str] = {
    "op5_warc": OP5, "op7_benchmark_decontamination": OP7, "op9_chat_formatting": OP9, "op11_ranked_lexical_search": OP11,
    "op12_filter_interaction_audit": OP12, "op13_url_filters": OP13,
}
