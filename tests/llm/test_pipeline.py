"""The pipeline's stages over planted cases."""

import numpy as np

import corpus_pipeline
from geoloom.llm import queries

from .test_operators import prose


def test_stages_act(spark, tmp_path):
    bench = prose(900, 30)
    passage = prose(901, 60)
    rows, labels = [], []
    for i in range(300):
        w = prose(2_000 + i, 80).split()
        if i % 6 == 0:
            w[40] = ("nasty", "vile")[i % 4 // 2]
        rows.append((i, " ".join(w), "en", "s", len(" ".join(w))))
        labels.append((i, 1, int(i % 6 == 0)))
    add = lambda i, t: rows.append((i, t, "en", "s", len(t)))
    add(1_000, rows[1][1])  # a copy
    w = rows[2][1].split()
    add(1_001, " ".join([*w[:10], "changed", *w[11:]]))  # a near copy
    add(1_002, f"{prose(902, 40)} {bench} {prose(903, 40)}")  # a leak
    for k in range(3):
        add(1_003 + k, f"{prose(904 + k, 60)} {passage} {prose(914 + k, 60)}")
    d = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    clean = {i for i in range(300) if i % 6}
    assert clean <= set(out) | {1, 2} and {1_003, 1_004, 1_005} <= set(out)
    assert not {1_000, 1_001, 1_002} & set(out) and {1, 2} <= set(out)
    assert len([i for i in out if i < 300 and i % 6 == 0]) <= 5
    assert all(passage not in r["text"] for r in out.values())
    assert all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in out.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
    assert corpus_pipeline.ORACLE_SQL is None and np.isfinite(len(out))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, and columns that stages use themselves."""
    d = f"file://{tmp_path}/odd"
    texts = [(None, prose(1, 50)), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, prose(2, 20_000)), (5, prose(3, 60)), (5, prose(3, 60)), (5, prose(4, 60)), (6, "x" * 100_000), (7, "one"), (8, prose(3, 60)), (9, " " * 50_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_hit string, score double, token_ids string, fingerprint int, component_id int, _toxicity int, removed int"
    docs = spark.createDataFrame([(i, t, None, "s", None, 11, "12", 0.5, "t", 3, 4, 5, 6) for i, t in texts], schema)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one"), (None, prose(9, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        assert {(r["kept"], r["n_hit"], r["score"], r["removed"], r["_toxicity"]) for r in now.collect()} == {(11, "12", 0.5, 6, 5)}
    left = [r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()]
    # 2, 3 and 9 equal 1, which has no words either; 8 and one text of 5 are equal; 7 is a benchmark item.
    assert sorted(i or 0 for i in left) == [0, 0, 1, 4, 5, 5, 5, 6]
    none = f"file://{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
