import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from texloom.llm import mixing, toxicity
from texloom.llm.queries import oracle_sql, queries
from tests.llm import fixtures as X


def tables(spark, folder):
    rng = random.Random(8)
    vocab = ["w" + str(k) for k in range(500)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(20, 120))) for _ in range(160)]
    item = " ".join(rng.choices(vocab, k=40))
    for k in range(160):
        if k % 8 == 0:
            texts[k] += " trash idiot"
        if k % 10 == 3:
            texts[k] = texts[k - 1] + " end"
        if k == 41:
            texts[k] = item
        if k == 42:
            texts[k] = " ".join(texts[k].split()[:5] + item.split()[:14] + rng.choices(vocab, k=400))
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, int("trash" in t)) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(7, item)]


def test_pipeline_is_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("score >= 0.3").collect()}
    assert toxic == {k for k in range(160) if "trash" in rows[k][1]}
    left = [r for r in rows if r[0] not in toxic]
    later = {i for i, _, c in X.jaccard_components(left) if i != c}
    left = [r for r in left if r[0] not in later]
    hits = {r[0]: r for r in X.contamination(left, items)}
    left = [r for r in left if not hits[r[0]][5]]
    assert hits[41][5] and hits[42][2] == 14 and not hits[42][5]

    out = corpus_pipeline.run(spark, folder).collect()
    taken = collections.Counter(r["doc_id"] for r in out)
    assert set(taken) <= {r[0] for r in left}
    words = {r[0]: len(r[1].split()) - hits[r[0]][2] for r in left}
    sizes = collections.Counter()
    for r in left:
        sizes[r[3]] += words[r[0]]
    want = mixing.targets(list(sizes.items()))
    for source, goal in want.items():
        n = sum(words[r[0]] * taken[r[0]] for r in left if r[3] == source)
        assert goal - 60 < n <= goal
    out.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out]).tolist()[:-1]]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    changed = corpus_pipeline.remove_benchmark(spark, docs, folder)
    assert changed.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_every_operator_has_its_query():
    names = queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(oracle_sql()) <= set(names)
