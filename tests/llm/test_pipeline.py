"""The pipeline's stages against what each stage should keep, worked out in plain Python."""

import collections
import re

import corpus_pipeline
from kelpforge.llm import language_id
from tests.llm.test_near_copies import plain_lost
from tests.llm.test_operators import plain_contaminated


def test_stages_keep_what_they_should(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        frames.append(docs)
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    model = language_id.train(frames[0])
    assert set(texts[1]) == {d for d, t in texts[0].items() if (p := model.predict(t))[0] != "und" and p[1] >= 0.34}
    groups = collections.defaultdict(list)
    for d, t in texts[1].items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d))
    assert set(texts[2]) == {min(m)[1] for m in groups.values()}
    lost = plain_lost(list(texts[2].items()))
    assert set(texts[3]) == set(texts[2]) - lost and lost
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_contaminated(texts[3].items(), items)}
    assert set(texts[4]) == set(texts[3]) - leaks and leaks
    words = collections.Counter()
    for r in docs.collect():
        words[r.doc_id] += r.n_words
    assert words == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts[4].items()}


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
