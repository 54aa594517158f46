"""The pipeline against its stages done by hand, and queries against DuckDB."""

import glob
import os

import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from quillon.llm import decontamination, quality_classifier, quality_rules, simhash
from quillon.llm.queries import LEAST_TAIL, QUERIES, SQL, quality_model

FOLDER = "/root/testdata/sf0.001"


SCHEMA = "doc_id long, text string, row string, tail string, fp string, rank string, n_words string, clean string"


def expected(texts: dict, folder: str, model) -> dict:
    """What the pipeline gives for texts with distinct ids, by loops over the operators' functions of one text."""
    left = {}
    for i, t in texts.items():
        slots, values = quality_classifier.Features().of(t)
        tails = model.tails(model.weights[slots] @ values[:, None])
        if not tails.size or tails[0, 0] >= LEAST_TAIL:
            left[i] = t
    policy = [quality_rules.RULES[x].replace(" AND ", " and ").replace("least(", "min(") for x in quality_rules.POLICIES["v1"]]
    left = {i: t for i, t in left.items() if not any(eval(p, {"min": min}, dict(zip(quality_rules.MEASURES, quality_rules.measures(t)))) for p in policy)}
    prints = {i: simhash.word_prints(t) for i, t in left.items()}
    up = {i: i for i in left}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in left:
        for b in left:
            if a < b and (prints[a][0] ^ prints[b][0]).bit_count() <= simhash.NEAR and (prints[a][1] ^ prints[b][1]).bit_count() <= simhash.VERIFY:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    left = {i: t for i, t in left.items() if top(i) == i}
    import pyarrow.parquet as pq

    bench = pq.read_table(f"{folder}/benchmark.parquet").sort_by("item_id")["text"].to_pylist()
    ids = list(left)
    bad = {ids[m[0]] for m in decontamination.matches(list(left.values()), decontamination.index_of(bench))}
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {i: tok.encode(t, add_special_tokens=False).ids for i, t in left.items() if i not in bad}


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = expected(texts, FOLDER, quality_model(spark, docs, FOLDER))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(want) < len(texts)


def odd_folder(spark, tmp_path, docs, labels, items) -> str:
    import os

    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    return str(tmp_path)


def odd_documents():
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns with the names that stages use."""
    import random

    r = random.Random(20)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + r.choice("abcdefghij") + r.choice("klmnopq") for _ in range(n)) + "."
    base = [prose(90) for _ in range(12)]
    near = base[0].split()
    near[40] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), None, "", " \n ", prose(40_000), "### " * 400, "few words only"]
    extra = ("r", "t", "f", "k", "n", "c")
    rows = [(i, t, *extra) for i, t in enumerate(texts)]
    return texts, [*rows, rows[3], (None, base[4], *extra), (None, None, *extra)]


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, labelled):
    import corpus_pipeline

    texts, rows = odd_documents()
    labels = [(i, 0 if i in (19, 20) else 1, 0) for i in range(21)] + [(2, None, 1), (None, 1, 0)] if labelled else []
    folder = odd_folder(spark, tmp_path, rows, labels, [("b", texts[5]), ("n", None)] if labelled else [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        found = [r.asDict() for r in kept.collect()]
        assert all(tuple(r.values()) in set(rows) for r in found)  # no value is changed
        if name == "simhash_near_dedup":
            assert sorted((r["doc_id"] for r in found if r["doc_id"] is not None)) == [*range(12), 15, 18, 19, 20] and len(found) == 16
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {*range(12), 18} - ({5} if labelled else set())


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    folder = odd_folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(stage(spark, docs, folder).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
    assert QUERIES["op4_toxicity"](spark, folder).count() == 0 and QUERIES["op5_quality_classifier"](spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, FOLDER).toPandas()[list(want.columns)]
    text = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))
    assert text(got) == text(want)
