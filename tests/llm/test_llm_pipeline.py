"""The pipeline, stage by stage, against brute force on the smallest table."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from test_llm_nearcopies import first_ids
from test_llm_operators import SF, removed, words
from runlens.llm import mixing, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stage[name](spark, df, SF).write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")

    good = step("quality rules", docs)
    assert good.columns == names
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.verdicts(docs).collect() if r.kept}

    rows = sorted((r.doc_id, r.text) for r in good.collect())
    single = step("simhash near-dedup", good)
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == first_ids(rows)

    rows = sorted((r.doc_id, r.text) for r in single.collect())
    cut = step("suffix-array dedup", single)
    want = {d: n for d, _, n, _, _ in removed(rows)}
    assert cut.columns == names and cut.count() == len(rows)
    before = dict(rows)
    for r in cut.collect():
        assert r.n_chars == len(r.text) and 0 <= len(before[r.doc_id].encode()) - want[str(r.doc_id)] - len(r.text.encode()) <= 8

    mixed = step("mixing sources", cut)
    taken = Counter()
    for r in mixing.Mix(cut).taken().collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
    assert mixed.columns == names and got == Counter({k: v for k, v in taken.items() if v})

    last = step("sentencepiece encoding", mixed)
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in last.collect()) == want and all(r.n_tokens == len(r.ids) for r in last.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in all columns, empty and long texts, rows that repeat, ids with unlike texts, names that clash, no rows at all."""
    rng = random.Random(5)
    base = [(i, words(rng, 80), "en", f"s{i % 2}", 7, "h", "x", 1, 2) for i in range(12)]
    odd = [(None,) * 9, (20, None, "en", "s0", 0, None, None, 1, 1), (21, "", None, None, 0, "", "", 1, 1), base[0], base[0], (1, words(rng, 90), "en", "s1", 1, "h", "y", 3, 4), (22, words(rng, 4000), "en", "s0", 1, "h", "z", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, own_run string, key long, own_key long"
    whole = spark.createDataFrame(base + odd, schema)
    for k, docs in enumerate((whole, whole.limit(0))):
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if j < 4:
                assert out.columns == whole.columns
            out.write.parquet(f"{tmp_path}/{k}-{j}")
            assert name and (spark.read.parquet(f"{tmp_path}/{k}-{j}").count() > 0) == (k == 0)
            docs = spark.read.parquet(f"{tmp_path}/{k}-{j}") if j else docs  # the rules leave few of these: go on with all
