"""The pipeline stage by stage against what each must do to its own input."""

import corpus_pipeline as C
import __spark_entry__ as entry
from gistmill.llm import catalogue
from gistmill.llm.secrets import base_spans
from tests.llm.test_decontaminate import shingles
from tests.llm.test_simhash import shingle_sets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas().set_index("doc_id")
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda text: any(len(q & shingles(text)) >= 0.8 * len(q) for q in items)
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas().set_index("doc_id")
        gone = set(before.index) - set(after.index)
        assert after.index.is_unique and set(after.index) <= set(before.index)
        if name != "encode":
            assert docs.columns == columns
        if name == "near_dedup":
            assert after.text.is_unique
            word_sets = {i: shingle_sets(t) for i, t in before.text.items()}
            for i in gone:
                assert max(len(word_sets[i] & word_sets[j]) / len(word_sets[i] | word_sets[j]) for j in before.index if j != i) >= 0.8
        elif name == "decontaminate":
            assert gone and all(leaks(before.text[i]) for i in gone) and not any(map(leaks, after.text))
        else:
            assert not gone
        if name == "secrets":
            assert not any(s for t in after.text for s in base_spans(t)) and (after.n_chars == after.text.str.len()).all()
            assert all(after.text[i] == t for i, t in before.text.items() if not base_spans(t))
        if name == "encode":
            assert after.exact.all() and (after.n_tokens == after.ids.map(len)).all()
        before = after
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == sorted(before.index)


def test_odd_documents(spark):
    """Nulls, empty texts, repeated rows and no rows through all stages."""
    rows = [(1, None, None, None, None), (2, "", "aa", "s", 0), (None, "plain words stand here, one after another", None, "s", 3), (3, "12 34", "aa", None, 5), (4, "token = abcdef123456 and words", "aa", "s", 30)]
    made = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, source string, n_chars long")
    for docs, want in ((made, {None, 4}), (made.limit(0), set())):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, SF)
        assert [r.doc_id for r in docs.collect() if r.doc_id not in want] == [] and {r.doc_id for r in docs.collect()} == want


def test_catalogue():
    names = list(catalogue.queries())
    assert [n.split("_")[0] for n in names] == ["pipeline", *[f"op{i}" for i in range(1, 11)]]
    assert set(names) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(names)
