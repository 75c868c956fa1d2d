"""The pipeline's stages and their whole run against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from test_texts import brute_components, brute_lines, labelled, words

import __spark_entry__
import corpus_pipeline
from lanternflow.llm import packing, pii, quality_classifier


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    docs, labels = labelled(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(6)
    base = [" ".join(words(rng, 90)) for _ in range(12)]
    extra = [(1000 + i, f"{base[i % 12]} number{i} ends here", "en", "s", 0) for i in range(30)]
    extra += [(2000 + i, f"A line that several documents hold.\nown words {' '.join(words(rng, 60))}\nwrite to u{i}@corp.example", "en", "s", 0) for i in range(8)]
    top = str(tmp_path_factory.mktemp("sf"))
    docs.union(spark.createDataFrame(extra, docs.schema)).repartition(4).write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    return top


def test_stages_and_run(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    labels = spark.read.parquet(f"{table}/labels.parquet")
    columns, rows = docs.dtypes, {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, table)
        assert docs.dtypes == columns
        docs.write.parquet(f"{table}/{name}")
        docs = spark.read.parquet(f"{table}/{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
        assert all(out[name][i].lang == rows[i].lang and out[name][i].source == rows[i].source for i in out[name])

    source = spark.read.parquet(f"{table}/documents.parquet")
    good = {r.doc_id for r in quality_classifier.scores(source, labels).collect() if r.predicted == 1}
    assert set(out["quality"]) == good and {i: r.text for i, r in out["quality"].items()} == {i: rows[i].text for i in good}

    lines = {i: t for i, _, _, t in brute_lines([(i, rows[i].text) for i in good])}
    assert {i: r.text for i, r in out["line_dedup"].items()} == lines and all(r.n_chars == len(r.text) for r in out["line_dedup"].values())

    one = {i for i, _, c in brute_components(list(lines.items())) if c == i}
    assert set(out["near_duplicates"]) == one and len(one) < len(lines)

    found = {r.doc_id: r.spans for r in pii.find_pii(spark.read.parquet(f"{table}/near_duplicates")).collect()}
    assert {i: r.text for i, r in out["pii"].items()} == {i: pii.mask(lines[i], found[i]) for i in one}
    assert not any("@corp.example" in r.text for r in out["pii"].values())

    made = defaultdict(int)
    tok = packing.byte_tokens(packing.tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(np.frombuffer(tok.encode([r.text])[0], "<u4")) + 1 for i, r in out["pii"].items()}
    for r in corpus_pipeline.run(spark, table).collect():
        made[r.doc_id] += r.length
    assert dict(made) == want


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "pii", "packing"]
    names = [q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages_of_odd_tables(spark, table, tmp_path):
    """Null, empty, repeated and tied rows, and no rows at all, pass through every stage."""
    docs = spark.read.parquet(f"{table}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "\n\n", "en", "s", 2), (3, "one two", "en", "s", 7)]
    for rows in (odd, []):
        now = spark.createDataFrame(rows, docs.schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, table)
            assert now.dtypes == docs.dtypes and now.count() <= len(rows)
        made = corpus_pipeline.STAGES[-1][1](spark, now, table)
        assert made.count() == now.count()


def test_run_of_an_empty_table(spark, table, tmp_path):
    spark.read.parquet(f"{table}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
