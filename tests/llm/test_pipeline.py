from collections import Counter

import corpus_pipeline
from verispark.llm import quality, queries

from .brute import WORD, brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        given, got = before.collect(), after.collect()
        if name != "byte_bpe":
            assert after.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(before).collect() if r.kept}
            assert sorted(got) == sorted(r for r in given if r.doc_id in kept) and 100 < len(got) < len(given)
        elif name == "line_dedup":
            rows = [(r.doc_id, r.text, r.h) for r in before.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
            assert {r.doc_id: r.text for r in got} == {r[0]: t for r, t in zip(rows, brute_lines(rows))}
        elif name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in given]
            alone = [d for d, t in rows if not WORD.search(t or "")]
            assert sorted(r.doc_id for r in got) == sorted({c for d, c, _ in brute_classes(rows) if d not in alone} | set(alone))
        elif name == "source_mix":
            times, size = Counter(r.doc_id for r in got), {r.doc_id: len(WORD.findall(r.text or "")) for r in given}
            assert set(times) <= set(size) and max(times.values()) <= 3
            assert abs(sum(n * size[d] for d, n in times.items()) - sum(size.values())) <= 0.1 * sum(size.values())
        else:
            bpe, text = queries.public_tokenizer(), {r.doc_id: r.text for r in given}
            assert all(r.exact and r.ids == bpe.library.encode_ordinary(text[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in got)
            assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in given)
        before = after


def test_run_and_odd_rows(spark, odd_docs, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    # the quality rules reject most of these texts, so the other stages also get them directly
    for n, (table, stages) in enumerate(((odd_docs, corpus_pipeline.STAGES), (odd_docs, corpus_pipeline.STAGES[1:]), (odd_docs.limit(0), corpus_pipeline.STAGES))):
        for k, (_, stage) in enumerate(stages):
            path = f"{tmp_path}/{n}-{k}"
            stage(spark, table, SF).write.parquet(path)
            table = spark.read.parquet(path)
        assert table.columns == ["doc_id", "source", "n_tokens", "ids", "exact"]
