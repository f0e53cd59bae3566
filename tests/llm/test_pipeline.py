"""Stages of the corpus pipeline, each against a brute-force version of what the one before kept."""

import collections
import hashlib

import pytest
from test_operators import CLASHING, SHAPE, component_want, corpus, repeated_words, words_of

import corpus_pipeline
from pyspark.sql import functions as F


def passes(t):
    w = words_of(t)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    letters = sum(c.isalpha() for c in t or "")
    return not (n < 50 or 100 * repeated_words(w) > 50 * n or not 3 * n <= chars <= 10 * n or sum(c in "#*$%&|<>" for c in t) * 10 > n or (len(lines) - len(set(lines))) * 10 > 3 * len(lines) or letters * 2 < chars)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SHAPE).write.parquet(f"{at}/documents.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(at)).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept.append(docs)
    return kept


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, stages):
    good = [(i, t) for i, t, *_ in corpus() if passes(t)]
    assert pairs(stages[0]) == collections.Counter(good) and stages[0].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = {}
    for i, t in good:
        last[t] = max(last.get(t, i), i)
    exact = [(i, t) for t, i in last.items()]
    assert pairs(stages[1]) == collections.Counter(exact)
    near = [(i, t) for i, t in exact if any(x[0] == i == x[2] for x in component_want(exact))]
    assert pairs(stages[2]) == collections.Counter(near)
    taken = mixed(near, {i: c for i, _, _, c, _ in corpus()})
    assert pairs(stages[3]) == collections.Counter({(i, t): taken[i] for i, t in near if taken[i]})
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for (i, t), n in pairs(stages[3]).items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want[i, len(ids), tuple(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += n
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in stages[4].collect()) == want


def mixed(docs, source):
    """How often each document is taken: whole copies of a source, then documents by their hash as long as that brings the sum nearer to its target."""
    sizes = collections.Counter()
    for i, t in docs:
        sizes[source[i]] += len(words_of(t))
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for s in order:
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest()[:15], i, len(words_of(t))) for i, t in docs if source[i] == s)
        whole = min(int(target[s] // sizes[s]), 3) if sizes[s] else 0
        budget, before = target[s] - whole * sizes[s], 0
        for _, i, n in mine:
            taken[i] = whole + (1 if whole < 3 and before + n / 2 <= budget else 0)
            before += n
    return taken


def test_pipeline_of_nothing(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)])):
        spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == 0


def test_pipeline_with_extra_columns(spark, stages, tmp_path):
    docs = spark.createDataFrame(corpus(), SHAPE)
    docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages, strict=True):
        made = stage(spark, rows, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter(r.doc_id for r in want.collect()), name
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
