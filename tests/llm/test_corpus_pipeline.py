"""The pipeline's stages on the smallest tables, each against plain Python on its own input."""

import os
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute_texts as B  # noqa: E402
import corpus_pipeline as P  # noqa: E402
from paneleffects.llm.tasks import BATCH_BYTES, BATCH_SETTING, bounded_batches  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, apply in P.STAGES:
        inputs[name] = docs
        out = apply(spark, docs, FOLDER)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        inputs[name + " out"] = docs
    rows = lambda name: [(r.doc_id, r.text) for r in inputs[name].collect()]

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {d for d, _ in rows("quality_classifier out")}
    assert sum((d in kept) == (q == 1) for d, q in quality.items()) >= 0.97 * len(quality)

    want = {d: gone for d, _, _, gone in B.repeated_lines(rows("line_dedup"))}
    after = dict(rows("line_dedup out"))
    for d, t in rows("line_dedup"):
        left = [x for i, x in enumerate(t.split("\n")) if str(i) not in want[d].split(",")]
        assert after.get(d, "") == ("\n".join(left) if any(x.strip() for x in left) else "")

    groups = B.jaccard_components(rows("jaccard_join"), 5, 80, 100)
    assert {d for d, _ in rows("jaccard_join out")} == {d for d, n, c in groups if d == c or n == 0}

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    import re
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(B.LOWER))
    windows = {tuple(w[i:i + 10]) for w in map(plain, items) for i in range(max(1, len(w) - 9))}
    clean = {d for d, t in rows("decontamination")
             if not any(tuple(plain(t)[i:i + 10]) in windows for i in range(max(1, len(plain(t)) - 9)))}
    assert {d for d, _ in rows("decontamination out")} == clean

    packed = inputs["best_fit_packing out"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in rows("best_fit_packing")}
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0


def test_python_gets_texts_in_bounded_batches(spark):
    """A stage leaves no task with all its texts in one batch; a limit of the session's own stays."""
    docs = spark.range(2000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("short line\n"), 800), F.col("id").cast("string")).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    held = spark.conf.get(BATCH_SETTING, None)
    try:
        spark.conf.unset(BATCH_SETTING)
        kept = P.line_stage(spark, docs, FOLDER)
        got = docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
        assert sum(r.rows for r in got) == 2000 and max(r.bytes for r in got) < 2 * BATCH_BYTES
        assert kept.exceptAll(docs).isEmpty() and kept.count() == 2000
        spark.conf.set(BATCH_SETTING, "5m")
        bounded_batches(spark)
        assert spark.conf.get(BATCH_SETTING) == "5m"
    finally:
        spark.conf.unset(BATCH_SETTING) if held is None else spark.conf.set(BATCH_SETTING, held)
