import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossia.llm.common import read


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = read(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == columns and out.count() <= kept.count(), name
        assert out.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = out
    assert before * 0.5 < kept.count() < before
    assert kept.select(F.lower("text")).distinct().count() >= kept.where("text <> ''").select(F.lower("text")).distinct().count()
    assert out.agg(F.countDistinct("doc_id")).first()[0] == kept.count()
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 1024").count() == 0


def test_last_stage_holds_the_tokens(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a b c"), (2, "long text " * 3000), (2, "long text " * 3000), (3, None), (None, "x")]
    out = corpus_pipeline.packed(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).toPandas()
    assert (out.ids.map(len) == 4 * out.length).all()
    for doc, text in {1: "a b c", 2: "long text " * 3000, 3: ""}.items():
        want = [i.to_bytes(4, "little") for i in [*library.encode(text, add_special_tokens=False).ids, 2]]
        held = out[out.doc_id == doc]
        assert held.length.sum() == len(want) * sum(d == doc for d, _ in rows)
        for r in held.itertuples():
            assert bytes(r.ids) == b"".join(want[r.start : r.start + r.length])
    assert not out.duplicated(["sequence_id", "offset"]).any()


def odd_documents(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more words"
    rows = [(1, None), (2, ""), (3, None), (4, base), (4, base), (5, base.upper()), (6, base + " at the end"), (None, "no id at all"), (7, "very long " * 40_000), (8, "clean short text"), (9, base + " then x y z")]
    rows = [(i, t, "s", 40, "keep", 1, "kept", "label", 2) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, _loser string, _toxicity int, kept_text string, score string, n_removed int")


def test_odd_rows_and_clashing_names_in_every_stage(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(tuple(r)[3:] == (40, "keep", 1, "kept", "label", 2) for r in rows), name
        assert {r.doc_id for r in rows} >= {1, 7, 8, None} if name != "exact dedup" else {r.doc_id for r in rows} >= {3, 7, 8, None}, name
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert left[1] is None and left[4] == docs.where("doc_id = 4").first().text and left[6] == "at the end" and left[9] == "then x y z"
    ids = sorted((r.doc_id for r in corpus_pipeline.exact_copies(spark, docs, sf_dir).collect()), key=repr)
    assert ids == sorted([3, 5, 6, None, 7, 8, 9], key=repr)
    ids = sorted((r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()), key=repr)
    assert ids.count(4) == 2 and 5 not in ids and 6 not in ids
    packed = corpus_pipeline.packed(spark, docs, sf_dir)
    assert packed.count() >= docs.count() and corpus_pipeline.packed(spark, docs.limit(0), sf_dir).collect() == []
