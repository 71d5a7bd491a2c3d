from pyspark.sql import functions as F

from verispark.streaming import incremental as I


def test_resume_takes_up_new_files_once(spark, tmp_path):
    """Later runs score added trials only; repeated ones are left out, bad ones are kept with a reason."""
    landing, base = str(tmp_path / "landing"), str(tmp_path / "base")
    schema = "trial_id string, label int, enroll_utt string, test_utt string"
    vectors = spark.createDataFrame([(f"u{k}", [1.0, float(k)], [1.0, -float(k)]) for k in range(5)], "utterance string, e1 array<double>, e2 array<double>")
    first = [("t1", 1, "u0", "u1"), ("t2", 0, "u1", "u2"), ("t2", 0, "u1", "u2"), ("t3", 1, "u0", "gone"), (None, 1, "u0", "u1"), ("t4", 7, "u0", "u1")]
    later = [("t1", 1, "u0", "u1"), ("t5", 1, "u3", "u4"), ("t6", None, "u3", "u4"), ("t7", 0, None, "u4")]

    def run():
        stream = spark.readStream.schema(schema).parquet(landing)
        I.resume_scoring(stream, vectors, ["e1", "e2"], lambda: (F.col("score_e1") + F.col("score_e2")).alias("llr"), base, confidence_threshold=0.6)
        return sorted(((r.trial_id or "", r.reason or "", r.llr is not None, r.decision) for r in I.resumed(spark, base).collect()))

    spark.createDataFrame(first, schema).write.mode("append").parquet(landing)
    assert [r[:3] for r in run()] == [("", "no trial id", False), ("t1", "", True), ("t2", "", True), ("t3", "no embedding", False), ("t4", "no label", False)]
    spark.createDataFrame(later, schema).write.mode("append").parquet(landing)
    second = run()
    assert [r[:2] for r in second if r[0] > "t4"] == [("t5", ""), ("t6", "no label"), ("t7", "no embedding")] and len(second) == 8
    assert run() == second
    want = spark.read.parquet(f"{base}/scored").filter("trial_id = 't1'").collect()
    assert len(want) == 1 and abs(want[0].llr - 2 * 2**-0.5) < 1e-9 and want[0].decision == "target"
