import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    """Each stage keeps columns and only rows that it got; decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).distinct().join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        counts.append(out.count())
        if name == "near-dedup":
            assert max(Counter(r.doc_id for r in out.select("doc_id").collect()).values()) == 1
        if name == "mixing":
            assert max(Counter(r.doc_id for r in out.select("doc_id").collect()).values()) <= 3
        docs = out
    assert counts[0] >= counts[1] >= counts[2] >= counts[3]
    assert counts[4] == counts[5]


def test_run_and_registration(spark):
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found}
    assert found["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rows_without_an_id(spark):
    """Null-id rows are decided and kept one by one."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(3)), (8, text(4)), (8, text(4)), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = [(None, ""), (None, text(1)), (None, text(2)), (7, text(3)), (8, text(4))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, spark.createDataFrame(out.collect(), out.schema), SF).collect())
    assert mixed == {x: 1 for x in want if x[1]}


def test_clashing_columns_and_no_rows(spark, tmp_path):
    """All stages on documents with columns of the stages' own names, and on none."""
    extra = ["score", "kept", "copies", "k", "n", "k1", "k2", "__id", "__size", "in_text", "rep", "perplexity", "threshold", "size", "g", "toxic"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", *(f"'x' AS {c}" for c in extra))
    for name, rows in (("a", docs), ("b", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == (name == "a")
        assert "ids" in out.columns


def test_missing_library_hides_llm_alone(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "streamcontract.llm", None)
    for name in [n for n in sys.modules if n.startswith("streamcontract.llm.") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    found = entry.queries()
    assert found and not any(k.startswith("op") and k[2].isdigit() for k in found) and "pipeline" not in found


def test_pieces_are_returned(spark):
    import sentencepiece

    from streamcontract.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.unigram_proto(pieces.public_model()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(20)
    want = {r.doc_id: sp.encode(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.pieces_stage(spark, docs, SF).collect()} == want
    assert "ids" in entry.queries()["op9_pieces"](spark, SF).columns


@pytest.mark.parametrize("name", ["op2_exact_topk", "op10_near_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, entry.queries()[name](spark, SF).select(*names).collect())) == sorted(want.fetchall())
