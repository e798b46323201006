"""The pipeline's stages take effect and keep clean documents."""

import random

import corpus_pipeline
from docstrata.llm.queries import ORACLES, QUERIES

WORDS = [a + b for a in "stone river cloud tree house light paper glass".split() for b in "er ing ed ly s ous".split()]


def test_registered():
    assert [k.split("_")[0] for k in sorted((q for q in QUERIES if q.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, text(60)) for i in range(200)]
    labels = [(i, 1, 0) for i in range(200)]
    for i in range(200, 260):
        ws = text(60).split()
        ws[5] = ws[30] = "nastyword"
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, 1))
    item = text(25)
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, text(40) + " " + item + " " + text(40)), (303, text(50) + " write to a.b@c.de now")]
    frame = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    spark.createDataFrame(frame, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        at[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns or name == "source_mixing"
    clean = {*range(200), 300, 301, 302, 303}
    assert set(at["toxicity"]) == clean
    assert set(at["simhash_near_dedup"]) == clean - {300, 301}
    assert set(at["benchmark_decontamination"]) == clean - {300, 301, 302}
    assert set(at["pii"]) == set(at["benchmark_decontamination"]) and at["pii"][303].text.endswith("write to [EMAIL] now")
    assert set(at["source_mixing"]) <= set(at["pii"]) and all(r.copies > 0 for r in at["source_mixing"].values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.copies) for r in whole.collect()} == {(i, r.copies) for i, r in at["source_mixing"].items()}


def small(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _scored string, _searched string, row string, doc_id2 int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[:12])), (2, None), (None, "x"), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_whole_run_with_odd_rows_and_names(spark, tmp_path):
    own = lambda k: " ".join(WORDS[(7 * k + 3 * i) % len(WORDS)] for i in range(30 + k))
    rows = [(1, own(1)), (1, own(1)), (2, None), (None, own(3)), (None, None), (5, ""), (6, own(6) + " mail a.b@c.de"), (7, "z " + " ".join(WORDS[:12]))]
    small(spark, [(i, t, "en", None, None, "a", "b", "c", 1) for i, t in rows], tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert docs.columns == columns
    # Repeated rows stay once, empty texts are one group, the benchmark's document goes, and nothing is rejected for toxicity.
    before = docs.collect()
    texts = {(r.doc_id, r.text) for r in before if r.text}
    assert texts == {(1, own(1)), (None, own(3)), (6, own(6) + " mail [EMAIL]")} and len(before) == 4
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*columns, "copies"]
    kept = got.collect()
    assert kept and {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in before}
    assert {(r._scored, r._searched, r.row) for r in kept} == {("a", "b", "c")}


def test_whole_run_of_an_empty_table(spark, tmp_path):
    small(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
