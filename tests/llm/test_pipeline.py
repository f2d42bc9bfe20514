import pytest

from tests.llm.conftest import DATA, prose
from tests.llm.test_weak_quality import JUNK, varied

cp = pytest.importorskip("corpus_pipeline")


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "private_data", "pack"]
    assert cp.ORACLE_SQL is None


@pytest.fixture
def folder(spark, make, tmp_path):
    item = " ".join(f"bench{i} item" for i in range(12))
    good = [varied(i) for i in range(30)]
    texts = [*good, *JUNK, good[0], good[1] + " One.", varied(50).replace(".", " " + item + ".", 1), varied(51) + " Mail me at a.b@mail.example.com today."]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts


def test_decisions_take_effect(spark, folder):
    """Each stage on its own, chained, against what its operator decides."""
    from tracemill.llm import decontamination, pii, superminhash, tokens, weak_quality

    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    steps = [
        lambda d: {r.doc_id for r in weak_quality.score_quality(d).collect() if not r.keep},
        lambda d: {r.doc_id for r in superminhash.groups(d).collect() if not r.keep},
        lambda d: {r.doc_id for r in decontamination.leaks(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()},
    ]
    for (_, stage), gone in zip(cp.STAGES, steps):
        drop = gone(docs)
        assert drop
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        kept = {k: v for k, v in kept.items() if k not in drop}
        assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept
    docs = cp.STAGES[3][1](spark, docs, sf_dir)
    kept = {k: pii.mask(v) for k, v in kept.items()}
    assert docs.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {k: (v, len(v)) for k, v in kept.items()}
    got = {}
    for r in sorted(cp.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.first_token)):
        got.setdefault(r.doc_id, []).extend(r.tokens)
    assert got == {k: tokens.ids(v).tolist() for k, v in kept.items()}
    assert set(range(3, 29)) <= set(got) and not set(range(30, 36)) & set(got)


def test_null_texts_and_an_empty_table(spark, make, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    make([(1, None), (None, varied(1)), (2, ""), (3, varied(2)), (3, varied(2))]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == {None, 3}


def test_columns_of_any_name(spark, folder):
    """Every stage but the last returns the columns that it got, whatever they are called."""
    from pyspark.sql import functions as F

    sf_dir, _ = folder
    odd = ("__gone", "__votes", "__code", "__quality", "votes", "code", "key", "node", "region", "tick`s", "a.b")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(c) for c in odd if "`" not in c and "." not in c})
    docs = docs.withColumn("tick`s", F.lit("tick`s")).withColumn("a.b", F.lit("a.b"))
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        rows = docs.collect()
        assert rows and all(r[c] == c for r in rows for c in odd)


def test_on_the_small_tables(spark):
    """Every decision and every token, worked out a document at a time from what the operators say of single texts."""
    from tests.llm.test_decontamination import brute
    from tests.llm.test_superminhash import jaccard, shingles
    from tracemill.llm import pii, superminhash, tokens, weak_quality

    sf_dir = f"{DATA}/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: docs[r.doc_id] for r in weak_quality.op8_weak_quality(spark, sf_dir).collect() if r.keep}
    sets, root = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and jaccard(sets[a], sets[b]) >= superminhash.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    leaked = {d for d, *_ in brute(list(kept.items()), items)}
    assert leaked and len(kept) < len(docs)
    want = {i: tokens.ids(pii.mask(t)).tolist() for i, t in kept.items() if i not in leaked}
    got = {}
    for r in sorted(cp.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.first_token)):
        got.setdefault(r.doc_id, []).extend(r.tokens)
    assert got == {i: t for i, t in want.items() if t}
