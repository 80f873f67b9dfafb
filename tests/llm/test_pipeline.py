"""The pipeline's stages against plain versions of what they decide."""

from __future__ import annotations

import math
from functools import cache

import corpus_pipeline
import duckdb
import helpers

from tessella.llm import language, packing, quality


def told_languages(model, texts):
    """{id: whether its language is told}, by a plain recursion over each word in logarithms."""
    vocab = language.vocabulary(model.path)
    index = {x: i for i, x in enumerate(vocab.pieces)}
    logs = [[math.log(x) if x else -math.inf for x in column] for column in model.shares.T.tolist()]

    @cache
    def word_log(word, lang):
        text, sums = language.MARK + word, [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for start in range(max(0, end - vocab.longest), end):
                i = index.get(text[start:end], len(vocab) if end - start == 1 else None)
                if i is not None:
                    terms.append(sums[start] + logs[lang][i])
            most = max(terms)
            sums.append(most + math.log(sum(math.exp(x - most) for x in terms)))
        return sums[-1]

    out = {}
    for i, text in texts.items():
        words = language.words_of(text or "")
        own = [sum(word_log(w, lang) for w in words) for lang in range(len(model.langs))]
        letters = any(c.isalpha() for w in words for c in w)
        out[i] = letters and 1 / sum(math.exp(x - max(own)) for x in own) >= language.LEAST_SCORE
    return out


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dumb = [(1_000_000 + i, t, "en", "s", 1) for i, t in enumerate([None, "", "12 3", "½ ...", " "])]  # no language can be told
    docs = docs.unionByName(spark.createDataFrame(dumb, helpers.SCHEMA))
    kept = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        rows = docs.collect()
        assert docs.columns == columns and all(before[r["doc_id"]] == r for r in rows)
        if name == "language_id":
            model = language.op3_model(spark.createDataFrame(list(before.values()), docs.schema))
            told = told_languages(model, {i: r["text"] for i, r in before.items()})
            assert {r["doc_id"] for r in rows} == {i for i, x in told.items() if x} and not all(told.values())
        if name == "quality_rules":
            documents = spark.createDataFrame(list(before.values()), docs.schema).toPandas()  # noqa: F841  (the SQL reads it)
            judged = duckdb.sql(f"SELECT doc_id FROM ({quality.OP5_SQL}) WHERE kept").fetchall()
            assert {r["doc_id"] for r in rows} == {i for (i,) in judged}
        if name == "exact_dedup":
            assert len({" ".join(helpers.WORD.findall(r["text"])) for r in rows}) == len(rows)
        if name == "minhash_dedup":
            components = helpers.near_components([(r["doc_id"], r["text"]) for r in before.values()], 5, 80)
            assert {r["doc_id"] for r in rows} == {c for _, c in components.values()}
        kept.append(len(rows))
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[2] > kept[3] >= kept[4] > 100
    packed = corpus_pipeline.run(spark, sf_dir)
    assert len(packed.inputFiles()) > 0 and "/packing/" in packed.inputFiles()[0]
    assert packed.columns == packing.NAMES
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_awkward_documents_and_none(spark):
    for docs in (helpers.awkward(spark), helpers.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.count() <= docs.count() if name != "packing" else out.count() >= docs.count()
            assert out.columns == (docs.columns if name != "packing" else packing.NAMES)


def test_ids_that_do_not_tell_rows_apart(spark):
    """Repeated and missing ids: one row of each text, and of each component, goes on."""
    base = " ".join(f"the word{i} and" for i in range(40))
    rows = [(1, base), (1, base + " "), (1, base), (None, base), (None, base + " more"), (2, base + " end"), (3, base.upper())]
    docs = helpers.documents(spark, rows, extra=True)
    exact = corpus_pipeline.exact_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"] or 0), len(r["text"])) for r in exact.collect()) == sorted(
        [(1, len(base)), (1, len(base) + 1), (0, len(base) + 5), (2, len(base) + 4), (3, len(base))]
    )
    near = corpus_pipeline.near_duplicates(spark, exact, "")
    assert sorted(((r["doc_id"] or 0), len(r["text"])) for r in near.collect()) == [(0, len(base) + 5), (1, len(base))]
