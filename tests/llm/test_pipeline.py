"""The pipeline on a small table: every stage's decisions, one after another."""
import random
from collections import Counter

import corpus_pipeline
from maskweave.llm import quality
from maskweave.storage import stage


def text(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    item = text(rnd, 30)
    good = [(i, text(rnd, 400), "en", f"s{i % 3}", 1) for i in range(40)]
    copies = [(100 + i, good[i][1] if i % 2 else good[i][1] + " more words", "en", "s1", 1) for i in range(10)]
    bad = [(200, "short", "en", "s0", 1), (201, "a b c " * 60, "en", "s0", 1), (202, None, None, None, None)]
    leaks = [(300, text(rnd, 100) + " " + item + " " + text(rnd, 50), "en", "s2", 1)]
    rows = good + copies + bad + leaks + [(7, good[7][1], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, f in corpus_pipeline.STAGES:
        out = stage(f(spark, docs, str(tmp_path)), "t")
        seen.append(Counter(r.doc_id for r in out.select("doc_id").collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    ids = {r[0] for r in rows}
    assert set(seen[0]) == ids - {200, 201, 202}
    assert set(seen[1]) == set(range(40)) | {300} and max(seen[1].values()) == 1
    assert set(seen[2]) == set(range(40))
    assert set(seen[3]) <= set(range(40)) and len(seen[3]) > 20 and seen[4] == seen[3]
    assert quality.prior(3, 60, 0, 0.0)[1] == 0.0
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in run.collect()) == seen[4]
