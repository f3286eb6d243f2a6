from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_llm_decontam import slow
from test_llm_simhash import slow_components, slow_fingerprint

import corpus_pipeline
from veilspark.llm import decontam, toxicity

SMALL = "/root/testdata/sf0.001"


def written(df, path):
    df.write.parquet(f"file:{path}")
    return df.sparkSession.read.parquet(f"file:{path}")


def all_docs(spark, odd_docs):
    """Documents with odd rows, near copies and benchmark passages among them, and more columns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = odd_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    near = docs.where("doc_id % 20 = 0").withColumns({"doc_id": F.col("doc_id") + 20_000, "text": F.concat("text", F.lit(" tail"))})
    held = docs.where("doc_id % 50 = 1").withColumns({"doc_id": F.col("doc_id") + 30_000, "text": F.concat(F.lit(item + " "), F.substring("text", 1, 200))})
    return docs.union(more).union(near).union(held).withColumns({"Size": F.lit("x"), "n_hit": F.lit(1), "score": F.lit("y"), "_k1": F.lit(0)})


def test_stages_do_what_they_say(spark, odd_docs, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = written(all_docs(spark, odd_docs), tmp_path / "0")

    civil = written(stages["toxicity"](spark, docs, SMALL), tmp_path / "1")
    assert civil.columns == docs.columns
    judged = toxicity.judge(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = Counter(r.doc_id for r in judged.where("predicted = 0").collect())
    assert Counter(r.doc_id for r in civil.collect()) == want and 0 < docs.count() - civil.count() < docs.count() / 4

    one = written(stages["near_duplicates"](spark, civil, SMALL), tmp_path / "2")
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in civil.collect()]
    groups = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert sorted((r.doc_id for r in one.collect()), key=str) == sorted(set(groups), key=str)

    clean = written(stages["decontamination"](spark, one, SMALL), tmp_path / "3")
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {r[0] for r in slow([(r.doc_id, r.text) for r in one.collect()], items, decontam.WINDOW) if r[-1]}
    assert dirty and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - dirty

    mixed = written(stages["mixing"](spark, clean, SMALL), tmp_path / "4")
    assert mixed.columns == docs.columns
    size = {r.doc_id: len((r.text or "").encode().split()) for r in clean.collect()}
    source = {r.doc_id: r.source for r in clean.collect()}
    from test_llm_filters import slow_targets
    per_source, taken, times = Counter(), Counter(), Counter(r.doc_id for r in mixed.collect())
    for i, n in size.items():
        per_source[source[i]] += n
        taken[source[i]] += n * times[i]
    assert max(times.values()) <= 3
    for s, target in slow_targets(per_source).items():
        assert abs(taken[s] - target) <= max(n for i, n in size.items() if source[i] == s)

    ids = stages["token_ids"](spark, mixed, SMALL).orderBy("start").collect()
    assert Counter(r.doc_id for r in ids) == times
    assert [r.start for r in ids] == np.cumsum([0] + [r.n_tokens for r in ids])[:-1].tolist()


def test_no_documents_and_reruns(spark, odd_docs, tmp_path):
    docs = written(all_docs(spark, odd_docs).limit(0), tmp_path / "none")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SMALL), tmp_path / f"none{i}")
        assert docs.count() == 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) for _ in range(2))
    assert once == again and len(once) > 100
