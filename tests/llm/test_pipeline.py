"""The corpus pipeline, each stage on its own input, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from curvespark.llm import bpe, toxicity
from tests.llm.test_documents import contaminated

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "x", 0), (10**6, 'a token = "0f1e2d3c4b5a69788796a5b4c3d2e1f001122334" here', "en", "y", 1)], docs.schema)
    docs.union(odd).coalesce(1).write.parquet(f"{folder}/0")
    frames = [spark.read.parquet(f"{folder}/0")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, frames[-1], DATA).write.parquet(f"{folder}/{k + 1}")
        frames.append(spark.read.parquet(f"{folder}/{k + 1}"))
    return frames


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect() if r.doc_id is not None)


def test_columns(stages):
    assert all(f.columns == COLUMNS for f in stages[:5]) and stages[5].columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(stages[0], labels.where(~toxicity.held_out()))
    scores = {r.doc_id: model.score(r.text) for r in stages[0].collect()}
    assert ids(stages[1]) == sorted(k for k, s in scores.items() if s < toxicity.THRESHOLD and k is not None)
    assert stages[1].where("doc_id is null").count() == 2


def test_one_of_each_group_stays(stages):
    from curvespark.llm.simhash import simhash
    from tests.llm.test_documents import brute_groups

    rows = [(r.doc_id, simhash(r.text)) for r in stages[1].collect()]
    groups = brute_groups(sorted({p for _, p in rows}))
    best = {}
    for doc_id, p in rows:
        best[groups[p]] = min(best.get(groups[p], (True, 0)), (doc_id is None, doc_id or 0))
    assert ids(stages[2]) == sorted(d for none, d in best.values() if not none) and stages[2].count() == len(best)


def test_contaminated_documents_go(spark, stages):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in contaminated([(r.doc_id, r.text) for r in stages[2].collect()], bench) if hit and 20 * hit >= n}
    assert ids(stages[3]) == sorted(set(ids(stages[2])) - bad)


def test_secrets_are_masked_and_documents_stay(stages):
    assert ids(stages[4]) == ids(stages[3]) and stages[4].count() == stages[3].count()
    changed = stages[3].select("doc_id", F.col("text").alias("old"), F.col("n_chars").alias("n")).join(stages[4], "doc_id").where("old <> text").collect()
    assert changed and all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)
    assert next(r for r in changed if r.doc_id == 10**6).text == 'a token = "[SECRET]" here'


def test_tokens_decode_to_the_texts(stages):
    import tiktoken

    tokenizer = pipeline.tokenizer()
    library = tiktoken.Encoding("own", pat_str=tokenizer.pattern, mergeable_ranks=tokenizer.ranks, special_tokens={})
    want = sorted(((r.doc_id, library.encode_ordinary(r.text or ""), r.text or "") for r in stages[4].collect()), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in stages[5].collect()), key=str) == want and isinstance(tokenizer, bpe.Tokenizer)


def test_run(spark, stages):
    got = pipeline.run(spark, DATA)
    assert got.columns == stages[5].columns and got.count() > 0
