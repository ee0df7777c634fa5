"""The whole pipeline over a planted corpus against the plain versions of its stages, and the registered SQL."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import compare
from tests.llm import plain

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"op1_best_fit_packing", "op3_sharding", "op4_line_dedup", "op5_secret_scan", "op6_quality_rules", "op8_toxicity", "op12_conversation_repair",
               "op13_personal_data", "pipeline"}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, sentence(rng, 40) + (" vile" if i % 4 == 0 else ""), i % 4 == 0) for i in range(300)]  # marked ones are toxic
    page = sentence(rng, 120)
    item = sentence(rng, 25)
    rows += [(1000, page, False), (1001, page, False), (1002, page.replace(page.split()[60], "changed"), False)]  # copies, a near copy
    rows += [(1010 + i, f"{sentence(rng, 20 + i)} {item} {sentence(rng, 15)}", False) for i in range(3)]  # a benchmark item
    shared = sentence(rng, 9)
    rows += [(1100 + i, "\n".join([sentence(rng, 12), shared, sentence(rng, 14), sentence(rng, 11)]), False) for i in range(8)]  # a line on many sites
    rows += [(1200, "", False), (1201, None, False), (1202, "one", False), (1203, sentence(rng, 3000), False)]
    docs = [(d, t, "en" if d % 2 else None, f"s{d % 5}", len(t or "")) for d, t, _ in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(not bad), int(bad)) for d, _, bad in rows if d < 300], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, sentence(rng, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, {d for d, _, bad in rows if bad}, [(1, item)]


def test_run_equals_the_plain_stages(spark, corpus):
    folder, docs, toxic, items = corpus
    kept = [(d, t, s) for d, t, _, s, _ in docs if d not in toxic]
    lines = plain.lines(kept, max_share=1.0)
    kept = [(d, lines[d][0]) for d, _, _ in kept]
    assert sum(lines[d][1] for d, _ in kept) == 7
    first = plain.near(kept, 5, 80)
    kept = [(d, t) for d, t in kept if first[d][1] == d]
    assert {1001, 1002}.isdisjoint(d for d, _ in kept)
    hit = {d for d, _, n, _ in plain.contamination(kept, items) if n}
    assert hit == {1010, 1011, 1012}
    want = plain.pieces([(d, t) for d, t in kept if d not in hit])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_of_an_empty_corpus(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_columns_of_any_name_stay(spark, corpus):
    """Columns with the names that the stages use inside."""
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 1000")
    clashing = docs.selectExpr("*", "1 AS key", "2 AS _key", "'x' AS its_id", "3 AS its_text", "4 AS goes", "5 AS component", "6 AS k", "7 AS a", "8 AS bad_id")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns, name
        assert {tuple(r)[-9:] for r in out.collect()} == {(1, 2, "x", 3, 4, 5, 6, 7, 8)}, name


def test_scratch_of_a_stage_goes(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 1000")
    corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    spent = list(corpus_pipeline._spent[spark.sparkContext.applicationId])
    assert any(os.path.exists(p) for p in spent)
    corpus_pipeline.drop_contaminated(spark, docs, folder).collect()
    assert not any(os.path.exists(p) for p in spent)


def test_queries_without_sql_are_known():
    assert set(entry.queries()) - set(entry.oracle_sql()) == WITHOUT_SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op") and k[2].isdigit()))
def test_query_equals_its_sql(spark, name):
    out, _, _ = compare.compare(spark, compare.connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert out.startswith("ok") and "TYPES" not in out, out
