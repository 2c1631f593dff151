"""Language ID, quality, language model: awkward rows, determinism, held-out quality, exact counts."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from awkward_rows import ROWS, clashing, rows_of

from burin.llm import byte_cnn, gam, recurrent_lm


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = {"en": ["the", "of", "th", "ing", "er", "and"], "fr": ["eau", "le", "èr", "de", "tion", "que"]}
    prose = lambda lang: " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80)))
    rows = [(i, lang, prose(lang)) for i in range(600) for lang in [rng.choice(["en", "fr"])]]
    bad = {i for i, _, _ in rows if i % 5 == 0}
    docs = spark.createDataFrame([clashing(i, t.upper().replace(" ", "!! ") if i in bad else t, lang) for i, lang, t in rows], ROWS)
    labels = spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i, _, _ in rows] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_language_of_held_out_texts(labelled):
    docs, _ = labelled
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in byte_cnn.identify(docs).collect() if r["held_out"]]
    assert len(got) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) > 0.97 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_of_awkward_rows(docs, no_docs):
    got = byte_cnn.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[k]["lang_pred"] for k in (200, 201, 202, 203)] == ["und"] * 4 and by[205]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in by.values())
    assert byte_cnn.identify(no_docs).count() == 0
    assert byte_cnn.keep_known(docs).columns == docs.columns
    assert {r["lang_pred"] for r in byte_cnn.identify(docs.withColumn("lang", docs.lang.substr(1, 0))).collect()} >= {"und"}


def test_windows_cover_the_whole_text():
    data = np.arange(2000, dtype=np.int64).astype(np.uint8)
    codes, row = byte_cnn.windows(data, np.array([0, 0, 1, 257, 2000]))
    assert row.tolist() == [1, 2] + [3] * int(row.tolist().count(3))
    covered = np.concatenate([c[c < 256][(0 if k == 0 else byte_cnn.WINDOW - byte_cnn.STEP) :] for k, c in enumerate(codes[row == 3])])
    assert covered.astype(np.uint8).tolist() == data[257:].tolist()


def test_network_gradient():
    """The loss falls along the training steps and the network tells two alphabets apart."""
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.integers(97, 105, (64, byte_cnn.WINDOW)), rng.integers(103, 112, (64, byte_cnn.WINDOW))]).astype(np.int16)
    labels = np.repeat([0, 1], 64)
    net = byte_cnn.train(codes, labels, ["a", "b"], epochs=4)
    assert (byte_cnn.window_probabilities(net, codes).argmax(1) == labels).mean() > 0.97


def test_quality_of_held_out_texts(labelled):
    docs, labels = labelled
    got = [r for r in gam.classify(docs, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 0) for r in got) > 0.97 * len(got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    kept = gam.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in gam.classify(docs, labels).where("predicted = 1").collect()}


def test_quality_of_awkward_rows(docs, no_docs, labelled):
    _, labels = labelled
    got = gam.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert {r["score"] for r in gam.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert gam.classify(no_docs, labels).count() == 0


def test_lookup_tables_are_additive():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9, "the interaction of two features must be learned by a pair"
    assert any({a, b} == {0, 1} for a, b, *_ in model.pairs)


def base_of(rows):
    """Brute force: n_tokens, n_known, train_tokens and base_score by doc_id."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    counts = collections.Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("known", [recurrent_lm.KNOWN, 5])
def test_base_scores_equal_brute_force(docs, known):
    """Also when most tokens' counts come from the join."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = base_of(rows)
    got = recurrent_lm.score(docs, known=known).collect()
    assert len(got) == len(rows)
    for r in got:
        n, k, total, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_language_model_beats_its_base(labelled, no_docs):
    docs, _ = labelled
    got = [r for r in recurrent_lm.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert recurrent_lm.score(no_docs).count() == 0


def small_net():
    corpus = recurrent_lm.Corpus(100, 10, 5, np.ones(8), np.ones(8), recurrent_lm.HEAD, np.arange(10, 0, -1), np.zeros(8, np.int64), np.full(8, -1), np.full(8, -1, np.int32))
    return recurrent_lm.fresh(corpus)


def plain_score(net, ids):
    """Natural log of the probability of ids, token by token, in double precision and with nothing shared with the module."""
    w = {k: np.asarray(getattr(net, k), float) for k in ("embed", "recur", "to_class", "class_bias", "member", "member_bias")}
    h, before, total, n = np.zeros(recurrent_lm.HIDDEN), 0, 0.0, recurrent_lm.HIDDEN
    share = lambda x, k: x[k] - np.log(np.exp(x).sum())
    for y in ids:
        x, u = w["embed"][before], h @ w["recur"]
        z, r = (1 / (1 + np.exp(-(x[i : i + n] + u[i : i + n]))) for i in (0, n))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        if y >= net.head:
            total += share(h @ w["to_class"] + w["class_bias"], len(net.bounds) - 1 + y - net.head)
        else:
            c = int(np.searchsorted(net.bounds, y, side="right")) - 1
            low, high = net.bounds[c], net.bounds[c + 1]
            total += share(h @ w["to_class"] + w["class_bias"], c) + share(w["member"][low:high] @ h + w["member_bias"][low:high], y - low)
        before = y
    return total


def test_state_carries_across_windows():
    net = small_net()
    ids = np.append(np.random.default_rng(2).integers(1, 10, 299), 0)
    ids[[5, 77, 200]] = net.head + 3
    got = recurrent_lm.score_ids(net, np.concatenate([ids, ids[-40:]]), np.array([0, 300, 340]))
    assert got[0] == pytest.approx(plain_score(net, ids), rel=1e-4) and got[1] == pytest.approx(plain_score(net, ids[-40:]), rel=1e-4)


def test_scores_equal_a_plain_computation(spark, docs):
    """Every text's score from the trained weights, token by token; counts of unknown tokens by the join."""
    frames = []
    real = recurrent_lm.fit

    def keep(rows, corpus, passes):
        net = real(rows, corpus, passes)
        frames.append((rows.select("doc_id", "n_tokens", "ids").collect(), corpus, net))
        return net

    recurrent_lm.fit = keep
    try:
        got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in recurrent_lm.score(docs, known=7).collect()}
    finally:
        recurrent_lm.fit = real
    rows, corpus, net = frames[0]
    texts = {(r["doc_id"], len((r["text"] or "").encode().lower().split()) + 1): r["text"] or "" for r in docs.collect()}
    counts = collections.Counter(w for r in docs.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in (r["text"] or "").encode().lower().split())
    for r in rows:
        ids = np.frombuffer(r["ids"], np.int16)
        words = texts[r["doc_id"], r["n_tokens"]].encode().lower().split()
        assert len(ids) == len(words) + 1 and ids[-1] == 0
        tail = sum(math.log10(counts[w] + 0.1) - corpus.log_tail[i - net.head] for w, i in zip(words, ids, strict=False) if i >= net.head)
        assert got[r["doc_id"], r["n_tokens"]] == pytest.approx(plain_score(net, ids) / math.log(10) + tail, rel=1e-4, abs=1e-6 * len(ids))


def test_scores_do_not_depend_on_partitions(spark, labelled):
    docs = labelled[0].limit(400)
    first = {r["doc_id"]: r["score"] for r in recurrent_lm.score(docs.repartition(2)).collect()}
    again = {r["doc_id"]: r["score"] for r in recurrent_lm.score(docs.repartition(7, "text")).collect()}
    assert first.keys() == again.keys() and all(again[k] == pytest.approx(v, rel=1e-3) for k, v in first.items())


def test_every_token_is_trained_on_with_carried_state(monkeypatch):
    net, real, seen, fresh = small_net(), recurrent_lm.gradients, [], []

    def spy(net, ids, valid, h):
        seen.extend(ids[:, 1:][valid].tolist())
        fresh.append(int((h == 0).all(0).sum()))
        return real(net, ids, valid, h)

    monkeypatch.setattr(recurrent_lm, "gradients", spy)
    sizes = [1, 500, 33, 64, 1, 200]
    ids, at = recurrent_lm.closed(np.random.default_rng(2).integers(1, 10, sum(sizes)), np.repeat(np.arange(6), sizes), 6)
    n = recurrent_lm.train(net, recurrent_lm.Adam(net, 1e-3), ids, at, lanes=2)
    assert n == len(seen) == len(ids) and sorted(seen) == sorted(ids.tolist()) and sum(fresh) == 6
    assert recurrent_lm.rounds_of(10**10) > recurrent_lm.rounds_of(10**8) > recurrent_lm.rounds_of(10**6)
    assert recurrent_lm.head_of(10**10) > recurrent_lm.head_of(10**6)


def test_gradient_is_the_slope_of_the_loss():
    net = small_net()
    ids = np.random.default_rng(4).integers(0, 10, (3, 7))
    valid, h = np.ones((3, 6), bool), np.zeros((recurrent_lm.HIDDEN, 3), np.float32)
    gradient, _, _ = recurrent_lm.gradients(net, ids, valid, h)
    names = ("embed", "recur", "to_class", "class_bias", "member", "member_bias")
    dense = {}
    for name, (rows, g) in zip(names, gradient, strict=True):
        dense[name] = np.zeros_like(getattr(net, name))
        dense[name][rows] = g
    for name, at in (("recur", (1, 2)), ("embed", (int(ids[0, 1]), 40)), ("to_class", (3, 0)), ("member", (2, 3)), ("class_bias", (0,))):
        losses = []
        for step in (1e-2, -1e-2):
            moved = net.like(net.flat())
            getattr(moved, name)[at] += step
            losses.append(recurrent_lm.gradients(moved, ids, valid, h)[2] / 18)
        assert dense[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


def test_a_batch_takes_the_steps_of_its_longest_documents_once(monkeypatch):
    """Documents are scored side by side by the batch: long ones that stand far apart in it share their steps."""
    net, steps, real = small_net(), [], recurrent_lm._step
    monkeypatch.setattr(recurrent_lm, "_step", lambda *a: (steps.append(1), real(*a)))
    sizes = np.ones(9000, int)
    sizes[[0, 4000, 8000]] = 700
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(1, 10, n - 1), 0) for n in sizes]
    batch = pa.record_batch([pa.array(range(9000)), pa.array([x.astype(np.int16).tobytes() for x in docs], pa.binary())], ["rid", "ids"])
    (got,) = recurrent_lm._score(net)(iter([batch]))
    assert len(steps) < 800
    for k in (0, 1, 4000, 8000, 8999):
        assert got.column(1)[k].as_py() == pytest.approx(plain_score(net, docs[k]) / math.log(10), rel=1e-4)


@pytest.mark.parametrize("top", [1, 3, 300])
def test_rows_of_an_input_are_added_up(top):
    rng = np.random.default_rng(top)
    inputs, rows = rng.integers(0, top, 2000) ** 2 // top, rng.standard_normal((2000, 5)).astype(np.float32)
    plain = np.zeros((top, 5))
    np.add.at(plain, inputs, rows.astype(float))
    own, got = recurrent_lm.by_input(inputs, rows)
    assert own.tolist() == sorted(set(inputs.tolist())) and np.allclose(got, plain[own], atol=1e-4)


def test_counts_of_blocks_equal_brute_force(monkeypatch):
    """Tokens of many blocks, with bytes over ASCII inside, at the ends and beside other texts."""
    monkeypatch.setattr(recurrent_lm, "blocks", lambda offsets: ((i, i + 3) for i in range(0, len(offsets) - 1, 3)))
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "The", "é", "naïve", "end.", "x" * 9, "é" * 9, "ok!", "日本"], k=rng.randint(0, 30))) for _ in range(60)] + ["é", "", "a"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    got = {(h, k): c for part in recurrent_lm._counts(iter([batch])) for h, k, c in zip(*(x.to_pylist() for x in part.columns), strict=True)}
    words = collections.Counter(w for t in texts for w in t.encode().replace(b"The", b"the").split())
    plain = lambda b: chr(b).isalnum() if b < 128 else True
    kinds = collections.Counter()
    for w, c in words.items():
        kinds[(max(w) >= 128) * 4 + (not plain(w[-1])) * 2 + (len(w) > 8), c] += 1
    assert collections.Counter((k, c) for (_, k), c in got.items()) == kinds and len(got) == len(words)


def test_scores_repeat(labelled):
    docs, labels = labelled
    assert rows_of(gam.classify(docs, labels)) == rows_of(gam.classify(docs, labels))


def test_plan_of_the_sample_does_not_grow_with_the_languages(spark, monkeypatch):
    from burin.llm import byte_cnn

    rows = [(i, f"text of language {i % 300} " * 3, f"l{i % 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = {}
    for sent in (byte_cnn.MOST_SENT, 10):
        monkeypatch.setattr(byte_cnn, "MOST_SENT", sent)
        monkeypatch.setattr(byte_cnn, "train", lambda codes, labels, langs, epochs, sent=sent: made.setdefault(sent, (codes.tobytes(), labels.tolist(), langs)))
        byte_cnn.fit(df)
    one, other = made.values()
    assert one == other and len(one[2]) == 300 and len(one[1]) > 300
