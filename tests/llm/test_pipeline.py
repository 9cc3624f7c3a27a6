"""The pipeline against plain versions of its stages on the smallest tables."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from ethoflow.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as duplicates
from tests.llm.test_pii import brute as base_spans

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    left = [(i, t) for i, t in rows.items() if not scored[i]]
    left = [(i, dict(left)[i]) for i, _, c in duplicates(left, 5, 4, 5) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {d for d, *_, c in contaminated(left, items, 13) if c}
    left = {i: t for i, t in left if str(i) not in bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got.keys() == left.keys()
    for i, r in got.items():
        assert r.n_tokens == len(r.ids)
        if not base_spans(left[i]) and "<" not in r.text:
            assert r.text == left[i]
        for s in base_spans(left[i]):
            _, a, b = s.split(":")
            assert left[i][int(a) : int(b)] not in r.text or len(left[i][int(a) : int(b)]) < 9


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]
    assert zlib.crc32(b"0") % 5 >= 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 40").unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (7, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.where(F.col("doc_id").isNull()).count() == 1


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, passage):
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_of_repeated_and_null_ids(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    other = " ".join(f"plain{i}" for i in range(20))
    rows = [(None, passage), (5, passage), (7, passage), (7, other), (7, other), (8, None), (8, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], KIND)
    sf = folder(spark, tmp_path, passage)
    stage = dict(corpus_pipeline.STAGES)
    near = ids_and_texts(stage["near_duplicates"](spark, docs, sf))
    assert near == sorted([(5, passage), (7, other), (8, None), (8, None), (None, None), (9, "")], key=repr)
    clean = ids_and_texts(stage["decontamination"](spark, docs, sf))
    assert clean == sorted([x for x in rows if x[1] != passage], key=repr)
    toxic = ids_and_texts(stage["toxicity"](spark, docs, sf))
    assert toxic == sorted(rows, key=repr)
    masked = stage["personal_data"](spark, spark.createDataFrame([(7, "mail a.b@example.com", "en", "s", 1), (7, "no", "en", "s", 1), (None, "ip 10.0.0.1", "en", "s", 1)], KIND), sf)
    assert ids_and_texts(masked) == sorted([(7, "mail <EMAIL>"), (7, "no"), (None, "ip <IP>")], key=repr)
    assert stage["pieces"](spark, docs, sf).count() == len(rows)


def test_smallest_id_stays_where_others_repeat(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    like = text + " more"
    far = " ".join(f"v{i}" for i in range(30))
    rows = [(9, text), (4, like), (9, far), (3, far), (3, text + " x"), (2, "lone words here"), (2, "other lone words")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], KIND)
    got = ids_and_texts(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)))
    assert got == sorted([(3, far), (3, text + " x"), (2, "lone words here"), (2, "other lone words")], key=repr)


def test_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, "a b c")
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)
