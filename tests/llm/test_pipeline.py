"""The corpus pipeline against its stages done by hand."""

from __future__ import annotations

import random

import corpus_pipeline
from docpipe.llm import bpe
from test_operators import DOCS, LABELS, quality_rows, spans_by_hand, words


def write(spark, folder, docs):
    rng = random.Random(21)
    _, labels = quality_rows()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(rng, 40, 90_000)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]


def test_pipeline_by_hand(spark, tmp_path):
    rng = random.Random(20)
    rows, _ = quality_rows()
    item = " ".join(words(random.Random(21), 40, 90_000))
    passage = " ".join(words(rng, 60, 90_000))
    fresh = lambda: " ".join(words(rng, 120, 90_000)) + "."
    base = fresh()
    extra = [(1000, base), (1001, base + " tail"), (1002, fresh() + " " + item), (1003, fresh() + " " + passage), (1004, fresh() + " " + passage), (1005, None), (1006, "")]
    docs = rows + [(d, t, "en", "src1", len(t or "")) for d, t in extra]
    assert write(spark, tmp_path, docs) == item
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1000, 1003, 1004} <= set(out) and not {1001, 1002} & set(out)
    assert all(r["decoded_equal"] in (True, None) for r in out.values())
    assert not any(d % 3 == 0 and d < 300 for d in out)
    assert sum(d % 3 != 0 for d in out if d < 300) >= 0.97 * 200
    text = {d: t for d, t in extra}
    (a, b, first), = spans_by_hand([(d, text[d]) for d in (1000, 1003, 1004)], 50)[1004]
    assert first == 1003
    raw = text[1004].encode()
    codec = bpe.codec(bpe.VOCABULARY)
    for d, want in ((1003, text[1003].encode()), (1004, raw[:a] + raw[b:])):
        assert out[d]["tokens"] == codec.encode([want])[0].tolist()


def test_stages_keep_the_columns(spark, tmp_path):
    rows, _ = quality_rows(60)
    write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        after.write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = after
    assert docs.count()


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, one id with two texts, a very long text, clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(30)
    rows, _ = quality_rows(90)
    fresh = lambda n=100: " ".join(words(rng, n, 90_000)) + "."
    long, one, other = fresh(60_000), fresh(), fresh()
    extra = [(None, one), (2000, one), (2000, one), (2001, other), (2001, long), (2002, None), (None, None), (2003, ""), (2004, " \n"), (2005, long)]
    write(spark, tmp_path / "plain", rows + [(d, t, None if d == 2004 else "en", None if d == 2003 else "src1", None) for d, t in extra])
    docs = spark.read.parquet(str(tmp_path / "plain/documents.parquet"))
    for name in ("score", "keep", "text_hash", "__hash", "__spans", "tokens_", "label", "k1"):
        docs = docs.withColumn(name, F.lit("own"))
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"plain/{name}.parquet")).write.parquet(str(tmp_path / f"in/{name}.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "in/documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path / "in")).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) if "text" in docs.columns else None
        if seen[name] is not None:
            assert all(r == "own" for c in ("score", "keep", "__hash") for r, in docs.select(c).distinct().collect())
    at = {name: {d: sum(x == d for x, _ in rows_) for d in (None, 2000, 2001, 2002, 2005)} for name, rows_ in seen.items() if rows_ is not None}
    # The two nulls stay (one without a text), copies under one id become one, and of the two rows
    # with the long text the one of the smaller id stays beside that id's other text.
    assert at["quality_classifier"][2000] == 2 and at["near_dedup"] == {None: at["quality_classifier"][None], 2000: 1, 2001: 2, 2002: at["quality_classifier"][2002], 2005: 0}
    assert at["substring_dedup"] == at["near_dedup"] == at["decontamination"]
    assert {r["doc_id"]: r["n_tokens"] for r in docs.where("doc_id >= 2002").collect()}.get(2002) is None
    assert docs.where("decoded_equal = false").count() == 0 and docs.where("doc_id = 2001").agg(F.max("n_tokens")).first()[0] > 60_000


def test_empty_tables_pass_every_stage(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_earlier_stages_leave_no_files(spark, tmp_path):
    import os

    from docpipe.llm.common import shared_dir

    write(spark, tmp_path, quality_rows(30)[0])
    corpus_pipeline.run(spark, str(tmp_path))
    there = shared_dir(spark).removeprefix("file:")
    kept = [sorted(os.listdir(os.path.join(there, d))) for d in os.listdir(there) if d.startswith("pipeline-")]
    assert kept and all(k == ["tokenization"] for k in kept)
