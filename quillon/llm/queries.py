"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html_extraction, quality_classifier, quality_rules, simhash, token_counts, toxicity, training_pages, url_filter, warc_revisits
from .common import read, store

#: op6: rules, and the listed hosts.
URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
#: op1: a page is asked for once more so many pages later, or earlier, than it is got; the home page is got at every HOME-th page, and changes with every LASTS-th.
AGAIN, HOME, LASTS = 1000, 10, 997
#: op5: least probability of a grade over the lowest.
LEAST_TAIL = 0.5


def crawl(pages: DataFrame) -> DataFrame:
    """Captures of a crawl that takes the pages in the order of their ids. Each is asked for once more, with the validator of its response: AGAIN pages later, or as long before it is got, by a hash of its url. At each page the home page is got or asked for as well, so one URL has a third of all captures."""

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.md5(text.cast("binary")), F.lit('"'))

    html, page = F.coalesce(F.col("html"), F.lit("")), F.col("page_id")
    etag, late = quoted(html), page + F.when(F.md5(F.col("url").cast("binary")) < "8", AGAIN).otherwise(-AGAIN)
    none = F.lit(None).cast("string")
    got = page % HOME == 0
    home = quoted(F.floor(F.when(got, page).otherwise(page + F.lit(HOME // 2)) / LASTS).cast("string"))
    first = pages.select(
        F.concat(F.lit("r"), page.cast("string")).alias("record_id"), "page_id", "url", (2 * page).alias("ts"), F.lit(True).alias("full"),
        F.array(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.octet_length(html)), pair("ETag", etag), pair("Date", page)).alias("headers"), etag.alias("digest"),
    )
    again = pages.select(
        F.concat(F.lit("v"), page.cast("string")).alias("record_id"), "page_id", "url", (2 * late + 1).alias("ts"), F.lit(False).alias("full"),
        F.array(pair("Content-Length", F.lit("0")), pair("ETag", F.concat(F.lit("W/"), etag)), pair("Date", late)).alias("headers"), none.alias("digest"),
    )
    homes = pages.select(
        F.concat(F.lit("h"), page.cast("string")).alias("record_id"), "page_id", F.lit("http://home.invalid/").alias("url"), (2 * page).alias("ts"), got.alias("full"),
        F.array(pair("ETag", home), pair("Date", page)).alias("headers"), none.alias("digest"),
    )
    return first.unionByName(again).unionByName(homes)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve(crawl(read(spark, sf_dir, "pages")))
    fields = F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit("="), h["value"]))
    return found.select("record_id", F.regexp_extract("record_id", r"\d+", 0).cast("long").alias("page_id"), "canonical_url", "outcome", "response_id", F.array_join(F.array_sort(fields), "; ").alias("headers"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()), "toxic")
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Ordinal:
    """labels rates quality by two grades, so there is one threshold."""
    return quality_classifier.train(docs, read(spark, sf_dir, "labels"), "quality")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", "expected_grade", F.try_element_at("tail", F.lit(1)).alias("tail_1"), quality_classifier.likely("tail", LEAST_TAIL).alias("kept"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.parse_rules(URL_RULES), listed)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


@lru_cache(maxsize=1)
def html_model() -> html_extraction.Model:
    return html_extraction.train(training_pages.labelled())


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(read(spark, sf_dir, "pages", dealt=True).select("page_id", "url", "html"), html_model())
    return found.withColumn("n_chars", F.length("text").cast("long"))


def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ledger(quality_rules.measure(read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [F.col(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_ledger(spark, sf_dir).select("doc_id", *measures, "fail_bits", (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version rejects, from one stored ledger."""
    book = store(quality_ledger(spark, sf_dir), "ledger")
    each = [quality_rules.ablations(book, v).select(F.lit(v).alias("version"), "rule", "n_failed", "n_only", "n_kept") for v in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, each)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read(spark, sf_dir, "documents", dealt=True).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_revisits, op2_token_counts, op3_simhash_near_dedup, op4_toxicity, op5_quality_classifier, op6_url_filter, op7_decontamination, op8_html_extraction, op9_quality_rules, op10_bpe, quality_ablations)
}

_PARTS = r"'^.*?://([^/?#]*)([^?#]*)(\?([^#]*))?'"

SQL: dict[str, str] = {
    "op1_warc_revisits": rf"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html, url,
         regexp_replace(regexp_replace(lower(regexp_extract(url, {_PARTS}, 1, 's')), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(url, {_PARTS}, 2, 's'), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, {_PARTS}, 4, 's'), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '{warc_revisits.TRACKING}'))), '&') AS query
  FROM pages),
canon AS (
  SELECT page_id, md5(url) AS url_md5, '"' || md5(html) || '"' AS etag, strlen(html) AS size,
         CASE WHEN contains(url, '://') AND host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM parts),
asked AS (SELECT *, page_id + CASE WHEN url_md5 < '8' THEN {AGAIN} ELSE -{AGAIN} END AS late FROM canon),
found AS (
  SELECT v.page_id, v.etag, v.late, v.canonical_url, arg_max(r.page_id, r.page_id) AS rid, arg_max(r.etag, r.page_id) AS retag, arg_max(r.size, r.page_id) AS rsize
  FROM asked v LEFT JOIN canon r ON v.canonical_url = r.canonical_url AND r.page_id <= v.late
  GROUP BY v.page_id, v.etag, v.late, v.canonical_url),
homes AS (
  SELECT page_id, page_id % {HOME} = 0 AS got, '"' || md5(((CASE WHEN page_id % {HOME} = 0 THEN page_id ELSE page_id + {HOME // 2} END) // {LASTS})::VARCHAR) || '"' AS etag FROM canon),
home AS (
  SELECT *, max(page_id) FILTER (got) OVER w AS rid, arg_max(etag, page_id) FILTER (got) OVER w AS retag FROM homes WINDOW w AS (ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT 'r' || page_id AS record_id, page_id, canonical_url, 'full' AS outcome, 'r' || page_id AS response_id,
       'content-length=' || size || '; content-type=text/html; date=' || page_id || '; etag=' || etag AS headers
FROM canon
UNION ALL
SELECT 'h' || page_id, page_id, 'home.invalid', CASE WHEN got THEN 'full' WHEN rid IS NULL THEN 'unmatched' WHEN etag = retag THEN 'resolved' ELSE 'mismatch' END,
       CASE WHEN got THEN 'h' || page_id WHEN etag = retag THEN 'h' || rid END, 'date=' || page_id || '; etag=' || etag
FROM home
UNION ALL
SELECT 'v' || page_id, page_id, canonical_url,
       CASE WHEN rid IS NULL THEN 'unmatched' WHEN etag = retag THEN 'resolved' ELSE 'mismatch' END,
       CASE WHEN etag = retag THEN 'r' || rid END,
       CASE WHEN etag = retag THEN 'content-length=' || rsize || '; content-type=text/html; date=' || late || '; etag=W/' || etag
            ELSE 'content-length=0; date=' || late || '; etag=W/' || etag END
FROM found""",
    "op6_url_filter": rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, {_PARTS}, 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, {_PARTS}, 2, 's'), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.parse_rules(URL_RULES))}) t(verdict, rhost, rpath)),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(p.host, '(^|\.)({"|".join(h.replace(".", chr(92) + ".") for h in LISTED_HOSTS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id""",
}

_MEASURED = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs),
grams AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM split WHERE len(words) >= 3),
named AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM grams),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM named),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) WHERE times >= 2 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(d.n_lines, 0) AS n_lines,
         len(list_distinct(words)) AS n_distinct, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{Lu}\p{Ll}]', '', 'g')) AS n_alpha
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN dups d ON s.doc_id = d.doc_id)
"""
#: Written out, not made from the operator's own rules.
_FAILS = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "upper_case": "n_alpha >= 50 AND 100 * n_upper > 60 * n_alpha",
    "few_distinct_words": "n_words >= 50 AND 100 * n_distinct < 8 * least(n_words, 1000)",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}
_VERSIONS = {"base": list(_FAILS)[:2], "v1": list(_FAILS)[:6], "v2": list(_FAILS)}


def _any(rules: list[str]) -> str:
    return " OR ".join(f"({_FAILS[r]})" for r in rules) or "false"


SQL["op9_quality_rules"] = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" + ".join(f"({f})::BIGINT * {1 << i}" for i, f in enumerate(_FAILS.values()))})::BIGINT AS fail_bits,
       ({_any(_VERSIONS["base"])}) AS base_failed, NOT ({_any(_VERSIONS["v1"])}) AS kept
FROM measured"""
SQL["quality_ablations"] = _MEASURED + " UNION ALL ".join(
    f"SELECT '{v}' AS version, '{r}' AS rule, count(*) FILTER ({_FAILS[r]}) AS n_failed, count(*) FILTER (({_FAILS[r]}) AND NOT ({_any([x for x in rules if x != r])})) AS n_only, count(*) FILTER (NOT ({_any(rules)})) AS n_kept FROM measured"
    for v, rules in _VERSIONS.items() for r in rules
)
