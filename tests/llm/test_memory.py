"""Memory of the corpus pipeline's tasks."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _common


def _resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_a_stage_sends_workers_bounded_batches(spark):
    before = spark.conf.get(_common._BATCH)

    def sizes(docs):
        def run(batches):
            yield from (pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"]) for b in batches)

        return docs.mapInArrow(run, "size long, n long").collect()

    docs = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("words "), 2_000).alias("text"))
    try:
        found = corpus_pipeline._stage(lambda spark, docs, sf_dir: sizes(docs))(spark, docs, "")
    finally:
        spark.conf.set(_common._BATCH, before)
    assert sum(r.n for r in found) == 2_000
    assert max(r.size for r in found) < 2 * _common.BATCH_BYTES


def test_a_lower_bound_stays(spark):
    before = spark.conf.get(_common._BATCH)
    try:
        spark.conf.set(_common._BATCH, "1m")
        _common.small_batches(spark)
        assert spark.conf.get(_common._BATCH) == "1m"
    finally:
        spark.conf.set(_common._BATCH, before)


def test_a_task_gives_back_what_it_has_freed():
    def work(batches):
        for batch in batches:
            many = [pa.array(["x" * 50_000] * 10) for _ in range(400)]  # 200 MB in pieces that allocators keep
            del many
            yield batch

    one = pa.record_batch([pa.array([1])], names=["a"])
    start = _resident()
    assert list(_common.tidy_rows(work)(iter([one]))) == [one]
    assert _resident() - start < 50e6
