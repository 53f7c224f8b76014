"""The streamed fold ends where the batch query ends."""

from __future__ import annotations

from chalkline.plans.mastery import mastery_blend_fold, scored
from chalkline.streaming.mastery import running_mastery

SF = "/root/testdata/sf0.001"


def test_stream_ends_like_the_batch(spark, tmp_path):
    rows = scored(spark, SF).where("student_id < 5")
    rows.orderBy("submitted_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    latest = {}

    def keep(batch, _):
        latest.update({(r["student_id"], r["topic"]): (r["mastery"], r["attempts"], r["hints"]) for r in batch.collect()})

    query = running_mastery(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    batch = mastery_blend_fold(spark, SF).where("student_id < 5").collect()
    assert latest == {(r["student_id"], r["topic"]): (r["mastery"], r["attempts"], r["hints"]) for r in batch}
