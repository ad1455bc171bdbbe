import brute
import oracle
import pytest

import corpus_pipeline as P
from tessera.llm import pii, queries as Q
from tessera.llm.quality_model import quality_model


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(name, spark, sf_dir):
    oracle.compare(Q.queries()[name](spark, sf_dir), oracle.connect(sf_dir), Q.oracle_sql()[name])


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_each(n):
    assert sum(k.startswith(f"op{n}_") for k in Q.queries()) == 1


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        out = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id: r.text for r in before.collect()}
        assert ids <= set(was)
        if name == "near_duplicates":
            groups = brute.jaccard(list(was.items()), 5, 80, 100)
            assert ids == {c for _, c in groups.values()}
        if name in ("personal_data", "mixing"):
            assert ids == set(was)
        if name == "quality":
            scores = quality_model(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in scores.where("score >= 0.7").collect()}
        if name == "decontamination":
            items = [brute.words((r.text or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for d, t in was.items():
                w = brute.words((t or "").lower())
                whole = any(len(i) <= len(w) and any(w[a : a + len(i)] == i for a in range(len(w) - len(i) + 1) if w[a] == i[0]) for i in items if i)
                none = all(len(set(i) & set(w)) < 0.3 * len(set(i)) for i in items if i)
                assert not (whole and d in ids) and not (none and d not in ids), d
        if name == "personal_data":
            said = brute.surrogates([was[d] for d in sorted(was)], pii, b"tessera surrogates")
            assert {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} == dict(zip(sorted(was), said.values()))
    assert docs.count() > 100


def test_stages_on_rows_without_an_id_or_with_a_shared_one(spark, sf_dir):
    long, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, long), (5, long + " end"), (5, other), (5, other), (None, "alone"), (None, None), (7, None), (8, leak + " " + other), (8, "clean " * 20), (None, leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text or "") for r in P.near_duplicates(spark, docs, sf_dir).collect())
    # an empty text is like none other
    assert kept == sorted([(5, long + " end"), (5, other), (0, "alone"), (0, ""), (7, ""), (8, leak + " " + other), (8, "clean " * 20), (0, leak)])
    clean = [(r.doc_id, r.text) for r in P.decontamination(spark, docs, sf_dir).collect()]
    assert len(clean) == 8 and (8, "clean " * 20) in clean and not any(t and leak in t for _, t in clean)


def test_run_over_no_documents(spark, sf_dir, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
