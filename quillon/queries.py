"""Queries over the sales tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions.score import Params
from .functions.text import clean, clean_compact, cut_tail, highlight, replaced, row_text, stop_words, tokens, two_places
from .operators import index, nonfree, reports, topk
from .operators.query import parse
from .plans.networks import NetworkIndex
from .sinks.render import highlighted, html_table, lines, stats_row
from .sources.bibliography_xml import load, records
from .sources.frequency_file import read_frequencies
from .sources.run_file import read_config, read_queries
from .sources.tables import Database, from_parquet
from .sources.workspace import Workspace
from .spec import SALES, SchemaSpec, Table
from .streaming.progressive import Progressive

FLAGSHIP, TABLES = "furniture widget", ["customer", "part"]
K = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sales(spark: SparkSession, sf_dir: str) -> Database:
    return from_parquet(spark, SALES, sf_dir)


DOCS = SchemaSpec("documents", (Table("documents", ("doc_id",), ("text",)),))


@query(f"SELECT doc_id, len({o.tok('text')})::INT AS n_tokens, len(list_distinct({o.tok('text')}))::INT AS n_distinct, md5(array_to_string({o.tok('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize_documents(spark, sf_dir):
    words = F.col("words")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"), F.md5(F.array_join(words, " ").cast("binary")).alias("tokens_md5"))


@query("SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[[:punct:][:space:]]+', ' ', 'g')) AS cleaned FROM part")
def clean_compact_part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", clean_compact(row_text(SALES.by_name["part"].text)).alias("cleaned"))


_STOP = ", ".join(f"'{w}'" for w in stop_words())
_INDEX = f"SELECT 'part' AS tbl, word, pk, count(*)::INT AS tf FROM (SELECT p_partkey::VARCHAR AS pk, unnest({o.words_of(SALES, 'part')}) AS word FROM part) WHERE word NOT IN ({_STOP}) GROUP BY word, pk"


@query(_INDEX)
def inverted_index_part(spark, sf_dir):
    return index.build_index(sales(spark, sf_dir), ("part",)).drop("dl")


@query(f"SELECT word, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM ({_INDEX}) GROUP BY word")
def dictionary_part(spark, sf_dir):
    return index.dictionary(index.build_index(sales(spark, sf_dir), ("part",)))


@query(f"SELECT doc_id::VARCHAR AS pk, len({o.tok('text')})::INT AS dl FROM documents")
def doc_length_documents(spark, sf_dir):
    return index.doc_lengths(from_parquet(spark, DOCS, sf_dir), "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_rows, avg(len({o.words_of(SALES, t)})) AS avgdl FROM {t}" for t in SALES.text_tables))
def avgdl_by_table(spark, sf_dir):
    return index.average_lengths(sales(spark, sf_dir))


def stats_of(spark, sf_dir, text=FLAGSHIP):
    db = sales(spark, sf_dir)
    return db, nonfree.statistics(db, parse(text))


_Q = o.asked("furniture", "widget")
_WORDS = ("furniture", "widget")
_WITH = "WITH " + ", ".join(o.base_ctes(_Q)) + " "


@query(_WITH + " UNION ALL ".join(f"SELECT '{k}' AS keyword, '{t}' AS tbl, df_{t}_{i} AS df, df_{t}_{i} / n_{t} AS selectivity FROM st" for i, k in enumerate(_WORDS) for t in SALES.text_tables))
def df_by_keyword_table(spark, sf_dir):
    return reports.df_by_table(*stats_of(spark, sf_dir))


def _least(i: int) -> str:
    return "least(" + ", ".join(f"CASE WHEN df_{t}_{i} > 0 THEN df_{t}_{i} / n_{t} END" for t in SALES.text_tables) + ")"


@query(_WITH + " UNION ALL ".join(f"SELECT '{k}' AS keyword, df{i}::BIGINT AS df, idf{i} AS idf, ln(n / (df{i} + 1)) AS idf_plus_one, ln(1 / {_least(i)}) AS idf_separate FROM st" for i, k in enumerate(_WORDS)))
def idf_variants(spark, sf_dir):
    return reports.idf_report(*stats_of(spark, sf_dir))


def nonfree_sql(q, t):
    return "WITH " + ", ".join(o.base_ctes(q)) + f" SELECT key, dl, [{', '.join(f'c{i}' for i in range(len(q.ranked)))}] AS tf, round(score, 9) AS score FROM nf_{t}"


def nonfree_query(name: str, text: str, table: str, q: o.Asked) -> None:
    def run(spark, sf_dir):
        db, stats = stats_of(spark, sf_dir, text)
        return nonfree.nonfree(db, table, stats).select("key", "dl", "tf", F.round("score", 9).alias("score"))

    QUERIES[name], SQL[name] = run, nonfree_sql(q, table)


RED_PLATE = o.Word(("red", "plate"))
nonfree_query("nonfree_customer", FLAGSHIP, "customer", _Q)
nonfree_query("nonfree_part", FLAGSHIP, "part", _Q)
nonfree_query("nonfree_phrase", "'red plate' furniture", "part", o.asked(RED_PLATE, "furniture"))
nonfree_query("nonfree_not", "widget -red", "part", o.asked("widget", without="red"))
nonfree_query("nonfree_table_qualified", "part:red customer:furniture", "part", o.asked(o.Word(("red",), table="part"), o.Word(("furniture",), table="customer")))
nonfree_query("nonfree_negative_idf", "brand", "part", o.asked("brand"))


@query(_WITH + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_nonfree, min(score) AS min_score, max(score) AS max_score, count(*) / (SELECT n_{t} FROM st)::DOUBLE AS selectivity FROM nf_{t}" for t in TABLES))
def nonfree_minmax(spark, sf_dir):
    return reports.extremes(*stats_of(spark, sf_dir))


@query(_WITH + "SELECT key, round(score, 9) AS score, row_number() OVER w AS row_n, max(r) OVER (PARTITION BY round(score, 9)) AS block FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS r FROM nf_part) WINDOW w AS (ORDER BY round(score, 9) DESC, key)")
def score_blocks(spark, sf_dir):
    db, stats = stats_of(spark, sf_dir)
    return nonfree.ranked(nonfree.nonfree(db, "part", stats)).select("key", F.round("score", 9).alias("score"), "row_n", "block")


def planned(spark, sf_dir, text=FLAGSHIP, **how):
    return topk.prepare(sales(spark, sf_dir), text, **how)


def closed(s: topk.Search, df: DataFrame) -> DataFrame:
    """df, which doesn't read the search's rows, once these are deleted."""
    s.close()
    return df


_NETS = o.CUSTOMER_PART


@query("SELECT cn_no, cn_key, cn_size, n_nonfree, round(weight, 9) AS weight FROM (VALUES " + ", ".join(f"({i}::INT, '{n.key}', {n.size}::INT, {len(n.held)}::INT, {o.weight(n.size, len(n.held), 2)})" for i, n in enumerate(_NETS)) + ") t(cn_no, cn_key, cn_size, n_nonfree, weight)")
def cn_catalog(spark, sf_dir):
    s = planned(spark, sf_dir)
    return closed(s, reports.network_catalog(s.planner, s.networks).drop("bound").withColumn("weight", F.round("weight", 9)))


@query("SELECT * FROM (VALUES (1, 5), (2, 8), (3, 21), (4, 49), (5, 135)) t(max_size, networks)")
def cn_counts(spark, sf_dir):
    """Networks of all text tables by the most nodes, from the offline index."""
    rows = [(m, len(NetworkIndex(SALES, m).of(SALES.text_tables))) for m in range(1, 6)]
    return spark.createDataFrame(rows, "max_size int, networks int")


@query("SELECT * FROM (VALUES (3, 21), (4, 49)) t(max_size, networks)")
def cn_timing_file(spark, sf_dir):
    """Lines of the timing file, without their times."""
    return spark.createDataFrame([(int(x.split()[0]), int(x.split()[2])) for x in reports.network_timings(SALES, 4)], "max_size int, networks int")


@query(
    _WITH + " UNION ALL ".join(
        f"SELECT '{n.key}' AS cn_key, round({o.weight(n.size, len(n.held), 2)} * (pow(2, 0.5) - pow(2 - ({' + '.join(f'(({"+".join(f"df_{t}_{i}" for t in dict.fromkeys(x for x, h in n.tables if h))}) > 0)::INT' for i in range(2))}), 0.5)) * ("
        + " + ".join(f"greatest(0, idf{i}) * {o.damp('(' + ' + '.join(f'(SELECT max(c{i}) FROM c_{t})' for t, h in n.tables if h) + ')')}" for i in range(2))
        + "), 9) AS bound FROM st"
        for n in _NETS
    )
)
def cn_upper_bounds(spark, sf_dir):
    s = planned(spark, sf_dir)
    return closed(s, reports.network_catalog(s.planner, s.networks).select("cn_key", F.round("bound", 9).alias("bound")))


def network_query(name: str, number: list[int], symmetry: bool = True) -> None:
    def run(spark, sf_dir):
        s = planned(spark, sf_dir, break_symmetry=symmetry)
        return reduce(DataFrame.unionByName, [s.planner.scored(s.networks[i], tf_text=True) for i in number])

    QUERIES[name], SQL[name] = run, o.networks_sql(_Q, [_NETS[i] for i in number], break_symmetry=symmetry)


network_query("cn_size1", [0, 1])
network_query("cn_size3_selfjoin", [2], symmetry=False)
network_query("cn_symmetry_broken", [2])
network_query("cn_size4_path", [3])
network_query("cn_size4_star", [4])


@query(o.networks_sql(_Q, _NETS, select="cn_key, count(*) AS n_trees, max(score) AS best, min(score) AS worst", tail="GROUP BY cn_key"))
def cn_scores(spark, sf_dir):
    s = planned(spark, sf_dir)
    return reduce(DataFrame.unionByName, [s.planner.extremes(n) for n in s.networks])


def top_query(name: str, text: str, q: o.Asked, networks: list[o.Tree], k: int = K, algorithm: str = "sparse", max_size: int = 4, indexed: bool = False, **how) -> None:
    """indexed: with an inverted index of all text tables, written for the query, in place of scans."""

    def run(spark, sf_dir):
        db = sales(spark, sf_dir)
        if not indexed:
            return topk.search(db, text, k, algorithm, max_size=max_size, **how)
        space = Workspace(spark, "index")
        found = topk.search(db, text, k, algorithm, max_size=max_size, words=index.WordIndex.write(db, space.path, 16, stop=()), **how)
        space.drop()
        return found

    known = {a: b for a, b in how.items() if a in ("p", "and_mode", "break_symmetry")}
    QUERIES[name], SQL[name] = run, o.top_sql(q, networks, k, **known)


_AFRICA, _ONE = o.asked("africa", "widget"), "000000001"
_MUST = o.asked(o.Word(("furniture",), must=True), o.Word(("widget",), must=True))
top_query("topk_or", FLAGSHIP, _Q, _NETS)
top_query("topk_and", "+africa +brand", o.asked(o.Word(("africa",), must=True), o.Word(("brand",), must=True)), o.REGION_PART_5, max_size=5)
top_query("topk_and_rank_only", "+furniture +widget", _MUST, _NETS, k=400, and_mode="rank_only")
top_query("topk_spaced_plus", "+ africa + brand", o.asked("africa", "brand"), o.REGION_PART_5, max_size=5)
top_query("topk_not", "furniture widget -red", o.asked("furniture", "widget", without="red"), _NETS)
top_query("topk_phrase", "furniture 'red plate'", o.asked("furniture", RED_PLATE), _NETS)
top_query("topk_punctuated", "furniture red--plate", o.asked("furniture", RED_PLATE), _NETS)
top_query("topk_number", _ONE, o.asked(_ONE), o.ONE_CUSTOMER_SUPPLIER)
top_query("topk_table", f"supplier:{_ONE}", o.asked(o.Word((_ONE,), table="supplier")), [o.SUPPLIER])
top_query("topk_three_words", "furniture widget red", o.asked("furniture", "widget", "red"), _NETS)
top_query("topk_unknown_word", "widget zzzz", o.asked("widget"), [o.PART])
top_query("topk_self_tie", "supplier widget", o.asked("supplier", "widget"), o.PART_SUPPLIER)
top_query("topk_size5", "africa widget", _AFRICA, o.REGION_PART_5, max_size=5)
top_query("topk_star", "@2 furniture part:*", o.asked("furniture"), [o.ORDERED_FREE])
top_query("topk_pinned_cn", "@2 furniture widget", _Q, [o.CUSTOMERS_2])
top_query("topk_both_orders", "@2 furniture widget", _Q, [o.CUSTOMERS_2], break_symmetry=False)
top_query("topk_alpha1", FLAGSHIP, _Q, _NETS, p=Params(alpha=1.0))
top_query("topk_soft_missing", FLAGSHIP, _Q, _NETS, p=Params(soft_missing=True))
top_query("topk_score1", FLAGSHIP, _Q, _NETS, p=Params(method="tuple_average"))
top_query("topk_score3", FLAGSHIP, _Q, _NETS, p=Params(method="virtual_document"))
top_query("topk_indexed", FLAGSHIP, _Q, _NETS, indexed=True)
top_query("topk_indexed_phrase_not", "furniture 'red plate' -machinery", o.asked("furniture", RED_PLATE, without="machinery"), _NETS, indexed=True)
for _a in ("sparse", "global_pipeline", "queue_pipeline", "two_level_bound", "tree_pipeline"):
    top_query(f"topk_alg_{_a}", FLAGSHIP, _Q, _NETS, algorithm=_a)
    top_query(f"topk_many_{_a}", "africa widget", _AFRICA, o.REGION_PART_5, k=300, algorithm=_a, max_size=5)


@query(o.top_sql(_Q, _NETS, K))
def topk_one_plan(spark, sf_dir):
    return topk.search_plan(sales(spark, sf_dir), FLAGSHIP, K)


@query("SELECT 0.0::DOUBLE AS score, 0::INT AS cn_size, '' AS cn_key, '' AS node_keys, 0::INT AS dl, [0::INT] AS tf WHERE false")
def topk_invalid(spark, sf_dir):
    return topk.search(sales(spark, sf_dir), "'red", K)


_TEXT = """string_agg(CASE split_part(k, ':', 1) WHEN 'customer' THEN (SELECT 'customer: ' || concat_ws(' ', c_name, c_mktsegment) FROM customer WHERE c_custkey::VARCHAR = split_part(k, ':', 2))
 WHEN 'part' THEN (SELECT 'part: ' || concat_ws(' ', p_name, p_brand, p_type) FROM part WHERE p_partkey::VARCHAR = split_part(k, ':', 2)) END, ' | ' ORDER BY i)"""
_LATE = f"SELECT score, cn_key, node_keys, {_TEXT} AS text FROM (SELECT score, cn_key, node_keys, unnest(string_split(node_keys, '|')) AS k, generate_subscripts(string_split(node_keys, '|'), 1) AS i FROM ({o.top_sql(_Q, _NETS, K)})) GROUP BY score, cn_key, node_keys"


@query(_LATE)
def topk_late_text(spark, sf_dir):
    found = topk.search_with_texts(sales(spark, sf_dir), FLAGSHIP, K)
    nodes = F.filter("nodes", lambda n: n["text"].isNotNull())
    return found.select("score", "cn_key", "node_keys", F.array_join(F.transform(nodes, lambda n: F.concat(n["tbl"], F.lit(": "), n["text"])), " | ").alias("text"))


_DRILL = "split_part(split_part(text, ' | ', 1), ': ', 1) || ':''' || lower(split_part(split_part(text, ' | ', 1), ': ', 2)) || ''''"


@query(f"SELECT format('{{:.2f}}', score) AS score_text, cn_key, node_keys, regexp_replace(regexp_replace(text, 'furniture', '<b>furniture</b>', 'gi'), 'widget', '<b>widget</b>', 'gi') AS text, {_DRILL} AS drill FROM ({_LATE})")
def topk_highlight(spark, sf_dir):
    return highlighted(topk.search_with_texts(sales(spark, sf_dir), FLAGSHIP, K), parse(FLAGSHIP))


@query("SELECT c_custkey, regexp_replace(c_mktsegment, 'furniture', '<b>furniture</b>', 'gi') AS marked, format('{:.2f}', c_acctbal) AS two_places FROM customer")
def highlight_customer(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select("c_custkey", highlight(F.col("c_mktsegment"), ["furniture"]).alias("marked"), two_places(F.col("c_acctbal")).alias("two_places"))


@query(o.top_sql(_Q, _NETS, 15))
def progressive_next(spark, sf_dir):
    p = Progressive(sales(spark, sf_dir), FLAGSHIP, 15)
    return spark.createDataFrame([*p.next(1), *p.next(4), *p.next(100)], topk.RESULT)


def _estimate_sql() -> str:
    n = o.CUSTOMERS_2
    base = ", ".join(o.base_ctes(_Q))
    return f"""WITH {base}, pairs AS (SELECT a.c0 AS a0, b.c0 AS b0 FROM fr_nation n JOIN fr_customer a ON a.c_nationkey = n.n_nationkey JOIN fr_customer b ON b.c_nationkey = n.n_nationkey AND a.key <> b.key),
c AS (SELECT count(*) AS n_all, count(*) FILTER (a0 > 0 OR b0 > 0) AS n_with FROM pairs)
SELECT '{n.key}' AS cn_key, 'furniture' AS keyword, n_all, n_with, round(ln(n_all / n_with), 9) AS idf, round(ln(1 / (1 - pow(1 - df_customer_0 / n_customer, 2))), 9) AS estimate FROM c, st"""


def estimates(spark, sf_dir) -> DataFrame:
    s = planned(spark, sf_dir)
    return closed(s, reports.idf_estimate_error(s.planner, s.networks))


@query(_estimate_sql())
def idf_estimate_error(spark, sf_dir):
    return estimates(spark, sf_dir).select("cn_key", "keyword", "n_all", "n_with", F.round("idf", 9).alias("idf"), F.round("estimate", 9).alias("estimate"))


@query(f"SELECT count(*) AS n, round(avg(abs(estimate - idf) / idf), 6) AS mean_error FROM ({_estimate_sql()})")
def idf_estimate_mean_error(spark, sf_dir):
    return reports.mean_error(estimates(spark, sf_dir)).withColumn("mean_error", F.round("mean_error", 6))


@query(f"SELECT p_partkey, ' ' || array_to_string({o.words_of(SALES, 'part')}, '  ') || ' ' AS cleaned, replace(p_name, ' ', '_') AS replaced, left(p_name, greatest(length(p_name) - 3, 0)) AS cut FROM part")
def clean_part(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", clean(row_text(SALES.by_name["part"].text)).alias("cleaned"), replaced(F.col("p_name"), " ", "_").alias("replaced"), cut_tail(F.col("p_name"), 3).alias("cut"))


@query(f"SELECT tbl, word, pk, tf FROM ({_INDEX}) WHERE word IN ('widget', 'plate')")
def index_written(spark, sf_dir):
    """The index as it is written, probed for two words."""
    space, db = Workspace(spark, "index"), sales(spark, sf_dir)
    found = index.WordIndex.write(db, space.path, 16).probe("part", ["widget", "plate"]).select("tbl", "word", "pk", "tf")
    return _kept(space, found)


@query(f"SELECT word, sum(tf)::BIGINT AS occurrences FROM ({_INDEX}) GROUP BY word")
def frequency_file(spark, sf_dir):
    """A dictionary written as lines of running counts, and read again."""
    words = sorted((r.word, r.occurrences) for r in index.dictionary(index.build_index(sales(spark, sf_dir), ("part",))).collect())  # a vocabulary of some tens of words
    upto = [sum(n for _, n in words[: i + 1]) for i in range(len(words))]
    space = Workspace(spark, "words")
    spark.createDataFrame([(f"{w} - {u}",) for (w, _), u in zip(words, upto)], "value string").coalesce(1).write.text(f"{space.path}/dict")
    return _kept(space, read_frequencies(spark, f"{space.path}/dict"))


@query(" UNION ALL ".join(f"SELECT '{t.name}' AS tbl, count(*) AS n_rows, '{','.join(t.pk)}' AS keys FROM {t.name}" for t in SALES.tables))
def catalog_sizes(spark, sf_dir):
    db = sales(spark, sf_dir)
    rows = [(t, n, ",".join(c for c in db.columns(t) if c in SALES.by_name[t].pk)) for t, n in db.sizes().items()]
    return spark.createDataFrame(rows, "tbl string, n_rows long, keys string")


_RUN = ["K = 4", "DATASET = sales", "ALGS = 1 2 5 7 10", "OFFLINE_CN_SEARCH = true", "ALPHA = 1.5", "MAXCN = 5", "SERVER = here", "", "7 furniture widget", "8 +red"]


@query("SELECT * FROM (VALUES ('k', '4'), ('algorithms', 'sparse global_pipeline queue_pipeline two_level_bound tree_pipeline'), ('offline', 'True'), ('alpha', '1.5'), ('max_size', '5'), ('server', 'here'), ('query 7', 'furniture widget'), ('query 8', '+red')) t(name, value)")
def run_file(spark, sf_dir):
    c = read_config(_RUN)
    rows = [("k", str(c.k)), ("algorithms", " ".join(c.algorithms)), ("offline", str(c.offline_networks)), ("alpha", str(c.alpha)), ("max_size", str(c.max_size)), ("server", c.connection["server"])]
    return spark.createDataFrame([*rows, *((f"query {n}", w) for n, w in read_queries(_RUN))], "name string, value string")


@query(f"SELECT 'Q7 Asparse T' || row_number() OVER (ORDER BY score DESC, cn_size, cn_key, node_keys) || ' ' || format('{{:.2f}}', score) || ' ' || node_keys AS line FROM ({o.top_sql(_Q, _NETS, K)})")
def console_lines(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in lines("7", "sparse", topk.search(sales(spark, sf_dir), FLAGSHIP, K).collect())], "line string")


@query(f"SELECT '<tr><td>' || score_text || '</td><td>' || replace(replace(cn_key, '>', '&gt;'), '<', '&lt;') || '</td><td>' || text || '</td><td>' || replace(drill, chr(39), '&#x27;') || '</td></tr>' AS html FROM ({SQL['topk_highlight']})")
def html_rows(spark, sf_dir):
    found = QUERIES["topk_highlight"](spark, sf_dir).collect()
    return spark.createDataFrame([(x + "</tr>",) for x in html_table(found).split("</tr>")[1:-1]], "html string")


@query(f"SELECT 'furniture widget' AS query, 'sparse' AS algorithm, 5.0::DOUBLE AS networks, 5.0::DOUBLE AS run_and_pruned, min(score) AS kth_score FROM ({o.top_sql(_Q, _NETS, K)})")
def search_stats(spark, sf_dir):
    s = planned(spark, sf_dir)
    list(topk.results(s, K))
    m = s.metrics
    return stats_row(spark.range(1), FLAGSHIP, "sparse", {"networks": m["networks"], "run_and_pruned": m["run"] + m["pruned"], "kth_score": m["kth_score"]})


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


def bibliography(spark, sf_dir) -> tuple[dict[str, DataFrame], Workspace]:
    """A bibliography made of parts (articles by their brand and type, in journals that have no record, citing other parts, some of which don't exist) and suppliers (papers in the article of their number)."""
    space, key = Workspace(spark, "xml"), F.col("p_partkey").cast("string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(
        F.lit('<article key="part/'), key, F.lit('">'), _tag("author", F.col("p_brand")), _tag("author", F.col("p_type")), _tag("title", F.col("p_name")), _tag("publisher", F.col("p_type")),
        _tag("crossref", F.concat(F.lit("j/"), F.col("p_partkey") % 40)), _tag("cite", F.concat(F.lit("part/"), F.col("p_partkey") * 3)), _tag("cite", F.lit("...")), F.lit("</article>"),
    ).alias("value"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(
        F.lit('<inproceedings key="sup/'), F.col("s_suppkey").cast("string"), F.lit('">'), _tag("author", F.col("s_name")), _tag("title", F.col("s_name")), _tag("crossref", F.concat(F.lit("part/"), F.col("s_suppkey"))), F.lit("</inproceedings>"),
    ).alias("value"))
    # 8 files with a root element each
    each = part.unionByName(supplier).groupBy(F.pmod(F.xxhash64("value"), F.lit(8)).alias("file")).agg(F.concat(F.lit("<dblp>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n</dblp>")).alias("value"))
    each.select("value").write.option("maxRecordsPerFile", 1).text(f"{space.path}/xml")
    return load(records(spark, f"{space.path}/xml", ("article", "inproceedings"))), space


_ITEMS = """WITH rec AS (
  SELECT 'part/' || p_partkey AS key, 'article' AS type, p_name AS title, 'j/' || (p_partkey % 40) AS crossref, p_type AS publisher FROM part
  UNION ALL SELECT 'sup/' || s_suppkey, 'inproceedings', s_name, 'part/' || s_suppkey, NULL FROM supplier),
cited AS (SELECT 'part/' || p_partkey AS key, 'part/' || (p_partkey * 3) AS reference FROM part),
stub AS (SELECT key, max(type) FILTER (type <> 'unknown') AS known FROM (
    SELECT crossref AS key, CASE type WHEN 'article' THEN 'journal' ELSE 'proceedings' END AS type FROM rec UNION ALL SELECT reference, 'unknown' FROM cited) WHERE key NOT IN (SELECT key FROM rec) GROUP BY key),
every AS (SELECT key, type, title, crossref, publisher FROM rec UNION ALL SELECT key, coalesce(known, 'unknown'), NULL, NULL, NULL FROM stub),
item AS (SELECT *, row_number() OVER (ORDER BY key) AS item_id FROM every),
pub AS (SELECT publisher AS name, row_number() OVER (ORDER BY publisher) AS publisher_id FROM (SELECT DISTINCT publisher FROM rec WHERE publisher <> '')),
wrote AS (SELECT DISTINCT 'part/' || p_partkey AS key, unnest([p_brand, p_type]) AS name FROM part UNION SELECT 'sup/' || s_suppkey, s_name FROM supplier),
person AS (SELECT name, row_number() OVER (ORDER BY name) AS person_id FROM (SELECT DISTINCT name FROM wrote))
"""


def _kept(space: Workspace, df: DataFrame) -> DataFrame:
    """df, written, so that what it was made of can go."""
    out = Workspace(df.sparkSession, "made").table(df, "rows")
    space.drop()
    return out


@query(_ITEMS + "SELECT i.item_id, i.key, i.type, i.title, c.item_id AS cross_ref, p.publisher_id FROM item i LEFT JOIN item c ON i.crossref = c.key LEFT JOIN pub p ON i.publisher = p.name")
def xml_items(spark, sf_dir):
    found, space = bibliography(spark, sf_dir)
    return _kept(space, found["item"].select("item_id", "key", "type", "title", "cross_ref", "publisher_id"))


@query(_ITEMS + "SELECT 'wrote' AS link, person_id AS a, item_id AS b FROM wrote JOIN person USING (name) JOIN item USING (key) UNION ALL SELECT 'cites', a.item_id, b.item_id FROM cited c JOIN item a ON c.key = a.key JOIN item b ON c.reference = b.key")
def xml_links(spark, sf_dir):
    found, space = bibliography(spark, sf_dir)
    wrote = found["person_item"].select(F.lit("wrote").alias("link"), F.col("person_id").alias("a"), F.col("item_id").alias("b"))
    return _kept(space, wrote.unionByName(found["cite"].select(F.lit("cites").alias("link"), F.col("item_id").alias("a"), F.col("reference").alias("b"))))


_DRAWS = [(q, d, ((q * 7 + d * 3) % 40 + 0.5) / 40) for q in range(6) for d in range(3)]


@query(
    f"WITH d AS (SELECT word, sum(tf)::BIGINT AS occurrences FROM ({_INDEX}) GROUP BY word), r AS (SELECT word, sum(occurrences) OVER (ORDER BY word) AS high, occurrences, (SELECT sum(occurrences) FROM d) AS total FROM d), "
    f"x AS (SELECT * FROM (VALUES {', '.join(f'({q}::BIGINT, {d}::BIGINT, {a!r}::DOUBLE)' for q, d, a in _DRAWS)}) t(query, draw, spot)) "
    "SELECT query, draw, word FROM x JOIN r ON floor(spot * total) >= high - occurrences AND floor(spot * total) < high"
)
def workload_generator(spark, sf_dir):
    draws = spark.createDataFrame(_DRAWS, "query long, draw long, at double")
    return reports.workload(index.dictionary(index.build_index(sales(spark, sf_dir), ("part",))), draws)


def _flat(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """tf as text, so that values compare alike everywhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumn("tf", F.array_join(F.transform("tf", lambda t: t.cast("string")), ",")) if "tf" in df.columns and df.schema["tf"].dataType.typeName() == "array" else df

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


for _n in QUERIES:
    if _n.startswith(("topk", "nonfree", "cn_size", "cn_symmetry", "progressive")) and " AS tf" in SQL[_n]:
        QUERIES[_n], SQL[_n] = _flat(QUERIES[_n]), SQL[_n] if "text" in _n or "highlight" in _n else f"SELECT * REPLACE (array_to_string(tf::VARCHAR[], ',') AS tf) FROM ({SQL[_n]})"
