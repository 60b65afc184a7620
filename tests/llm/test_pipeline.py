from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from confab.llm import quality
from tests.llm.support import awkward, sha, table, words
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"
ROWS = [*awkward(), (None, "no id here at all", "a"), (None, None, None)]


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


def test_quality_stage_keeps_what_scores_high(spark, docs):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {}
    for d, t, _ in ROWS:
        raw = (t or "").encode()
        stats = quality.statistics(quality.np.frombuffer(raw, quality.np.uint8), quality.np.array([0, len(raw)]))[0]
        total = model.intercept + sum(w for w, rule in model.rules if all((stats[i] > b) == above for i, above, b in rule))
        score[d, t] = total + sum(w * min(max(stats[i], low), high) for w, i, low, high in model.linear)
    got = cp.quality_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert rows_of(got) == Counter(r for r in ROWS if score[r[0], r[1]] >= 0)


def test_exact_stage_keeps_one_of_each(spark, docs):
    got = cp.exact_stage(spark, docs, SF)
    assert got.columns == docs.columns
    want = Counter((d, b) for d, _, _, kept, b in exact_brute(ROWS) if kept)
    assert Counter((r.doc_id, sha("".join(words(r.text)))) for r in got.collect()) == want


def test_near_stage_keeps_one_of_each_group(spark, docs):
    got = cp.near_stage(spark, docs, SF)
    assert got.columns == docs.columns
    stay = {d for d, _, c in near_brute(ROWS) if d == c}
    assert rows_of(got) == Counter(r for r in ROWS if r[0] in stay)


def test_mixing_stage_takes_whole_documents_to_the_target(spark, docs):
    got = cp.mixing_stage(spark, docs, SF)
    assert got.columns == docs.columns
    sizes, taken, most = Counter(), Counter(), Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
        most[s] = max(most[s], len(words(t)))
    for (d, t, s), n in rows_of(got).items():
        assert n <= 2 * ROWS.count((d, t, s))
        taken[s] += n * len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    goal = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in sizes)


def test_bpe_stage_is_the_tokenizer(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, cp.bpe_stage(spark, docs, SF).collect())) == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_run_applies_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = stage(spark, docs, SF)
    want = Counter(map(tuple, docs.collect()))
    assert want and Counter(map(tuple, cp.run(spark, SF).collect())) == want
    assert docs.filter(F.col("n_tokens") == 0).count() == 0
