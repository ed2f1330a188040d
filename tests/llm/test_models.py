import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import common, pitman_yor, suffix_dedup, toxicity_pu


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


# ---- toxicity


def test_toxicity_on_held_out_rows(spark, sf1):
    docs, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    got = {r.doc_id: r for r in toxicity_pu.toxicity(spark, docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    caught = sum(r.predicted for r, t in test if t) / sum(t for _, t in test)
    wrong = sum(r.predicted for r, t in test if not t) / sum(1 - t for _, t in test)
    assert caught >= 0.6 and wrong <= 0.05


def pu_risk(w, rows, positive, prior, share_p, share_u):
    """The non-negative risk row by row, as it is defined, and the part that is held at zero."""
    say = lambda g, y: math.log1p(math.exp(-y * g))
    as_positive = as_negative = unlabelled = 0.0
    for features, is_positive, p, u in zip(rows, positive, share_p, share_u, strict=True):
        g = w[-1] + sum(w[f] for f in features)
        as_positive += p * say(g, 1)
        as_negative += p * say(g, -1)
        unlabelled += u * say(g, -1)
    return prior * as_positive + max(0.0, unlabelled - prior * as_negative), unlabelled - prior * as_negative


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pu_weights_minimise_the_risk(seed):
    """At the weights that are fitted no step lowers the risk, and its numerical gradient is small."""
    draw, width, prior, n = np.random.default_rng(seed + 10), 6, 0.3, 1200
    positive = np.arange(n) < 300
    truth = positive | ((np.arange(n) >= 300) & (draw.random(n) < prior))
    rows = [[f for f in range(width) if draw.random() < (0.5 if (f < 2) == bool(t) else 0.25)] for t in truth]  # classes overlap
    features, row = np.array([f for r in rows for f in r]), np.repeat(np.arange(n), [len(r) for r in rows])
    w, b = toxicity_pu.fit_pu(features, row, positive, width, prior, seed, steps=3000)
    share = np.random.default_rng(seed).poisson(1.0, n).astype(float)  # its bootstrap
    share_p, share_u = np.where(positive, share, 0), np.where(positive, 0, share)
    given = (rows, positive, prior, share_p / share_p.sum(), share_u / share_u.sum())
    at = np.append(w, b)
    least, slack = pu_risk(at, *given)
    assert slack > 0.01  # the risk is smooth here
    for k in range(width + 1):
        step = np.zeros(width + 1)
        step[k] = 1e-4
        assert abs(pu_risk(at + step, *given)[0] - pu_risk(at - step, *given)[0]) / 2e-4 < 2e-3
    for _ in range(30):
        assert pu_risk(at + draw.normal(0, 0.3, width + 1), *given)[0] >= least - 1e-6
    assert w[:2].min() > 0 and w[:2].mean() > w[2:].mean()


def test_pu_risk_is_held_at_zero():
    """Where unlabelled rows are fitted too well the classifier steps back from that: what is held at zero stays near it."""
    positive = np.arange(40) < 20
    features, row = np.arange(40), np.arange(40)  # each row has a feature of its own
    w, b = toxicity_pu.fit_pu(features, row, positive, 40, 0.5, 0, steps=500)
    share = np.random.default_rng(0).poisson(1.0, 40).astype(float)
    share_p, share_u = np.where(positive, share, 0), np.where(positive, 0, share)
    assert pu_risk(np.append(w, b), [[k] for k in range(40)], positive, 0.5, share_p / share_p.sum(), share_u / share_u.sum())[1] > -0.3


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 0), (9, 1), (9, 0), (None, 1), (8, None), (2, 1)], "doc_id long, toxic int")
    got = toxicity_pu.toxicity(spark, odd, labels).collect()
    assert len(got) == odd.count() and all(r.score is not None for r in got)
    assert {r.predicted for r in toxicity_pu.toxicity(spark, odd, labels.where("false")).collect()} == {0}
    assert toxicity_pu.toxicity(spark, none, labels).count() == 0


def test_scores_are_alike_in_any_batches(spark, sf1, monkeypatch):
    """Slices of batches give the scores that whole batches give."""
    docs, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    weights, bias = toxicity_pu.fit(spark, docs, labels)
    monkeypatch.setattr(toxicity_pu, "fit", lambda *_: (weights, bias))
    monkeypatch.setattr(toxicity_pu, "BYTES", 30_000)
    held = weights.astype(np.float32)
    for r in toxicity_pu.toxicity(spark, docs.select("doc_id", "text"), labels).collect():
        words = sorted(set((r.text or "").encode().lower().split()))
        g = bias + (toxicity_pu.word_weights(words, held).sum() if words else 0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(g, -30), 30))), abs=1e-6)


# ---- Pitman-Yor


def brute_base(docs):
    count = collections.Counter()
    for i, words in docs:
        if fold(i) != 1:
            count.update(words)
    n, v = sum(count.values()), len(count)
    for i, words in docs:
        yield i, fold(i) == 1, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_counts_and_base_equal_brute_force(spark, odd, sf1, which, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BYTES", 60_000)
    df = odd if which == "odd" else spark.read.parquet(f"{sf1}/documents.parquet")
    docs = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in df.select("doc_id", "text").collect()]
    got = sorted(pitman_yor.score_texts(spark, df).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens))
    want = sorted(brute_base(docs), key=lambda r: (repr(r[0]), r[2]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert [r.base_score for r in got] == pytest.approx([r[5] for r in want])
    if which == "table":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("text")
    from foliant.llm.common import Scratch

    counts, model = pitman_yor.fit(spark, Scratch(spark), df, 3)
    shards = [pitman_yor.Shard(r.shard, r.blob) for r in counts.collect()]
    for context in (0, 1, len(model["frequent"])):
        total = 0.0
        for x in shards:
            for left, p, state in x.samples(model):
                rest = np.zeros(len(x.hashes))
                here = x.context == context
                rest[x.word[here]] = left[here]
                total += pitman_yor._mixed(model, state, rest, np.full(len(rest), context), p).sum() / pitman_yor.SAMPLES
        for state in model["states"][-pitman_yor.SAMPLES :]:
            total += pitman_yor._mixed(model, state, 0.0, context, pitman_yor.parent_probability(model, state, 0, 0)) / pitman_yor.SAMPLES
        assert total == pytest.approx(1.0, abs=1e-9)


def test_seating():
    draw = np.random.default_rng(1)
    customers = np.array([0, 1, 2, 50, 5000])
    tables = pitman_yor.seat(customers, np.full(5, 0.5), 0.5, draw)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= customers).all() and 1 <= tables[4] < 1000
    many = pitman_yor.seat(np.full(4000, 2), np.full(4000, 1.0), 0.5, draw)
    assert many.mean() == pytest.approx(1 + 1 / 1.5, abs=0.05)


def test_no_rows(spark, none):
    assert pitman_yor.score_texts(spark, none).count() == 0


def test_sample_of_ids_is_bounded(spark):
    """Ids that repeat many times are one each, and the sample is alike at any partitioning."""
    ids = spark.range(5000).selectExpr("IF(id < 3000, 7, id) AS doc_id")
    want = sorted(r.doc_id for r in ids.distinct().selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").limit(50).collect())
    for df in (ids, ids.repartition(7)):
        assert sorted(r.doc_id for r in toxicity_pu.first_ids(df, 50).collect()) == want
    assert toxicity_pu.first_ids(ids, 10_000).count() == 2001


def test_features_of_rows_come_in_small_parts():
    """A batch of many texts doesn't become one list of numbers, and the parts hold what the whole would."""
    texts = [None, "", *(f"Word{k} and {'filler ' * 20_000}" for k in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 == 0 for k in range(42)]), pa.array(range(42), pa.int64())], ["text", "positive", "place"])
    parts = list(toxicity_pu._rows_of_features([batch]))
    table = pa.Table.from_batches(parts)
    assert len(parts) > 3 and table.column("place").to_pylist() == list(range(42)) and table.column("positive").to_pylist() == batch.column(1).to_pylist()
    want = [sorted(f for w in set((t or "").lower().encode().split()) for f in toxicity_pu.word_features(w)) for t in texts]
    assert table.column("features").to_pylist() == want


def test_workers_carry_no_table_into_other_tasks():
    """What a task of one operator keeps goes when a task of another one begins, as does the table of an earlier model."""
    one = common.worker_kept("one", dict)
    assert common.worker_kept("one", dict) is one and list(common._kept) == ["one"]
    of_bucket = np.arange(toxicity_pu.BUCKETS, dtype=np.float32)
    want = [sum(of_bucket[f] for f in toxicity_pu.word_features(w)) for w in (b"these", b"words")]
    for model in ("first", "second"):
        assert toxicity_pu.kept_weights([b"these", b"words"], of_bucket, model).tolist() == want
        assert list(common._kept) == [model]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array(["x " * 300])], ["r", "q", "text"])
    list(suffix_dedup._anchor_rows([batch]))
    assert not common._kept
