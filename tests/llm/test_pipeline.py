"""Each stage of the pipeline against a brute-force version on its own input; queries against their SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointflux.llm import mixing, quality, queries
from test_texts import brute_draws, brute_near, brute_spans, words

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(text)))
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, before, SF)
        rows = out.collect()
        seen[name] = (before.collect(), rows)
        if name != "packing":
            assert out.columns == docs.columns
            before = spark.createDataFrame(rows, out.schema)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = quality.Scorer(model)
    source, kept = seen["quality"]
    assert Counter(kept) == Counter(r for r in source if score(r.text) >= 0.5)
    source, kept = seen["near_dedup"]
    least = brute_near([(r.doc_id, r.text) for r in source])
    assert Counter(kept) == Counter(r for r in source if least[r.doc_id, r.text][0] == r.doc_id)
    source, out = seen["pii"]
    texts = {r.doc_id: r.text for r in out}
    assert len(out) == len(source) and all(texts[r.doc_id] == redacted(r.text) for r in source)
    source, out = seen["mixing"]
    keys = {(r.doc_id, r.text): r.u for r in spark.createDataFrame(source, docs.schema).withColumn("u", mixing.order_key(F.col("doc_id"), F.col("text"))).collect()}
    want = brute_draws([(r.source, len(words(r.text)), keys[r.doc_id, r.text]) for r in source])
    times = Counter(out)
    for r in source:
        assert times[r] == want[r.source, keys[r.doc_id, r.text]] * source.count(r) or not words(r.text)
    assert set(times) <= set(source)
    source, out = seen["packing"]
    assert sum(r.words for r in out) == sum(len(words(r.text)) for r in source)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)
