"""The stages one after another on a small table of documents."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import secrets
from tests.llm.conftest import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, rows):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    return df


def test_stages(spark, tmp_path):
    rows = [(i, prose(i, 120), ["en", "fr"][i % 2]) for i in range(40)]
    near = rows[3][1].split()
    near[60] = "changed"
    rows += [(50, rows[7][1], "fr"), (51, " ".join(near), "fr"), (52, None, "en"), (53, "1 2 3", "en"), (54, prose(90, 40) + " secret = abcdef012345", "en")]
    docs = write(spark, tmp_path, rows)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if len(seen) < len(corpus_pipeline.STAGES):
            assert sorted(docs.columns) == sorted(COLUMNS) and docs.count() <= before.count()
    assert not {52, 53} & seen[0] and {54, *range(40)} <= seen[0]
    assert not {50} & seen[1] and {*range(40)} <= seen[1]
    assert not {51} & seen[2] and {*range(40)} <= seen[2]
    assert seen[3] == seen[2] == seen[4]
    third = spark.read.parquet(f"{tmp_path}/secret_scans").where("doc_id = 54").first()
    assert "abcdef012345" not in third.text and third.n_chars == len(third.text)


def test_run_and_empty_table(spark, tmp_path):
    write(spark, tmp_path, [(i, prose(i, 50), "en") for i in range(6)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(range(6))
    none = tmp_path / "none"
    none.mkdir()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{none}/documents.parquet")
    assert corpus_pipeline.run(spark, str(none)).select(F.count("*")).first()[0] == 0


def test_batches_to_workers_are_bounded_by_bytes(spark, monkeypatch):
    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([str(b.nbytes)] * b.num_rows), pa.array([0] * b.num_rows, pa.int64()), *b.columns[1:]], ["text", "n_chars", *b.schema.names[1:]])

        return run

    monkeypatch.setattr(secrets, "_batches", sizes)
    text = F.when(F.col("id") == 3000, F.repeat(F.lit("x"), 6_000_000)).otherwise(F.repeat(F.lit("x"), 4000))
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(0).cast("long").alias("n_chars"))
    out = corpus_pipeline.redact_secrets(spark, docs, "").collect()
    found = [int(r.text) for r in out]
    assert sorted(r.doc_id for r in out) == list(range(6000))
    # One row at least, so the row that is longer than the limit comes on top of a full batch at most.
    assert sorted(set(found))[-1] < 11 << 20 and sum(n > 5 << 20 for n in found) < 1500 and len(set(found)) > 1
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, "1m")
    assert max(int(r.text) for r in corpus_pipeline.redact_secrets(spark, docs.where("doc_id <> 3000"), "").collect()) < 3 << 19 and spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)
