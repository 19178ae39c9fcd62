"""The pipeline: every stage's decision against a plain version of it, odd rows, and the whole run."""

import hashlib
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from phrasemill.llm.queries import PIECES, op1_templates, op3_pu_quality, op5_zstd_toxicity
from tests.llm.test_near_copies import plain

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_dedup", "decontaminate", "encode"]
    kept = lambda name: stages[name](spark, docs, FOLDER)
    for name in list(stages)[:-1]:
        assert kept(name).schema == docs.schema
    assert ids(kept("quality")) == ids(op3_pu_quality(spark, FOLDER).filter("predicted = 1"))
    assert ids(kept("toxicity")) == ids(op5_zstd_toxicity(spark, FOLDER).filter("predicted = 0"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    assert ids(kept("near_dedup")) == [rows[k][0] for k, first in enumerate(plain([t for _, t in rows])) if k == first]
    found = {r.doc_id for r in op1_templates(spark, FOLDER).collect()}
    assert ids(kept("decontaminate")) == [i for i in ids(docs) if i not in found]


def test_run(spark, docs):
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, FOLDER)
        step = spark.createDataFrame(step.collect(), docs.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for r in step.collect():
        found = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(),
                          hashlib.sha256(library.decode(found).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(got) < docs.count()


CLASHES = ["score", "score_", "component", "print", "row", "held", "text_", "item", "line", "Key"]


def test_odd_rows(spark, docs):
    """Null ids and texts, repeated rows, columns with the names that stages use; every stage keeps the columns it was given."""
    odd = docs.limit(30).withColumns({c: F.lit("mine") for c in CLASHES})
    none = odd.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    mixed = spark.createDataFrame(odd.unionByName(none).unionByName(odd.limit(3)).collect(), odd.schema)
    rows = mixed.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, mixed, FOLDER)
        if name == "encode":
            assert out.count() == rows and out.filter("doc_id is null").agg(F.max("n_tokens")).first()[0] == 2
        else:
            assert out.columns == mixed.columns and out.filter(" or ".join(f"{c} <> 'mine'" for c in CLASHES)).isEmpty()
            before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in (mixed, out))
            assert set(after) <= set(before) and 0 < len(after) <= rows
        if name in ("near_dedup", "decontaminate"):
            assert out.filter("doc_id is null").count() == 2
        assert stage(spark, mixed.limit(0), FOLDER).count() == 0


def test_decontaminate_by_text(spark, docs):
    """Rows are judged one by one, also where ids repeat or are missing; what two rows hold together does not count."""
    item = next(r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 24)
    words = item.split()
    rows = [(1, item, "a"), (1, "nothing of the kind in here", "b"), (None, f"so {item} it is", "c"), (None, "clean", "d"), (2, " ".join(words[:10]), "e"),
            (2, " ".join(words[14:24]), "f"), (3, None, "g"), (1, item, "h")]
    out = dict(corpus_pipeline.STAGES)["decontaminate"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), FOLDER)
    assert sorted(r.source for r in out.collect()) == ["b", "d", "e", "f", "g"]
