"""Scores of trained models against plain computations, row by row; names that clash; the pipeline on awkward tables."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pytest
from awkward_rows import ROWS, clashing, rows_of
from pyspark.sql import functions as F

from burin.llm import byte_cnn, gam, jaccard_join, merge_rounds


@pytest.fixture(scope="module")
def mixed(spark, docs):
    """The awkward rows, and texts of two languages of which each fifth is of low quality."""
    rng = random.Random(12)
    words = {"en": ["the", "of", "th", "ing", "er", "and"], "fr": ["eau", "le", "èr", "de", "tion", "que"]}
    prose = lambda lang: " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 90)))
    rows = [(1000 + i, prose(lang), lang) for i in range(300) for lang in [rng.choice(["en", "fr"])]]
    made = docs.unionByName(spark.createDataFrame([clashing(i, t.upper().replace(" ", "!! ") if i % 5 == 0 else t, lang) for i, t, lang in rows], ROWS))
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    return made, labels


def test_quality_scores_equal_a_plain_sum_of_tables(mixed):
    """Each text alone, each bin found by bisection, the sum in Python."""
    docs, labels = mixed
    model = gam.fit(gam.featured(docs), labels)
    assert model.pairs and len(model.tables) == len(gam.FEATURES)
    want = []
    for r in docs.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        x = gam.features(data, np.array([0, len(data)]))[0].tolist()
        total = model.base + sum(float(t[bisect.bisect_right(e.tolist(), v)]) for e, t, v in zip(model.edges, model.tables, x, strict=True))
        total += sum(float(t[bisect.bisect_right(ea.tolist(), x[a]), bisect.bisect_right(eb.tolist(), x[b])]) for a, b, ea, eb, t in model.pairs)
        want.append((r["doc_id"], 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))))
    got = [(r["doc_id"], r["score"]) for r in gam.classify(docs, labels).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for (i, a), (j, b) in zip(order(got), order(want), strict=True):
        assert i == j and a == pytest.approx(b, abs=1e-9)


def plain_probabilities(net, window: bytes) -> list[float]:
    """Filters slid over the bytes of one window with loops, the greatest of each, softmax."""
    rows = [net.embed[c].tolist() for c in window] + [net.embed[256].tolist()] * (byte_cnn.WINDOW - len(window) + max(byte_cnn.WIDTHS))
    best = []
    for k, width in enumerate(byte_cnn.WIDTHS):
        for f in range(k * byte_cnn.FILTERS, (k + 1) * byte_cnn.FILTERS):
            taps = net.filters[: width * byte_cnn.EMBED, f].tolist()
            top = max(sum(t * v for t, v in zip(taps, (x for row in rows[at : at + width] for x in row), strict=True)) for at in range(byte_cnn.WINDOW))
            best.append(max(0.0, top + float(net.shift[f])))
    logits = [sum(b * float(net.dense[n, c]) for n, b in enumerate(best)) + float(net.bias[c]) for c in range(len(net.langs))]
    e = [math.exp(v - max(logits)) for v in logits]
    return [v / sum(e) for v in e]


def test_languages_equal_a_plain_computation(mixed):
    docs, _ = mixed
    net = byte_cnn.fit(docs)
    some = docs.where("doc_id IN (0, 5, 200, 201, 203, 204, 207, 1000, 1007, 1011, 1018)")
    got = {r["doc_id"]: r for r in byte_cnn.predict(some.select("doc_id", "text"), net).collect()}
    for i, r in got.items():
        data = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        starts = range(0, max(1, len(data) - byte_cnn.WINDOW + byte_cnn.STEP), byte_cnn.STEP)
        each = [plain_probabilities(net, data[s : s + byte_cnn.WINDOW]) for s in starts]
        mean = [sum(p[c] for p in each) / len(each) for c in range(len(net.langs))]
        assert r["lang_pred"] == net.langs[max(range(len(mean)), key=mean.__getitem__)], i
        assert r["score"] == pytest.approx(max(mean), abs=1e-4)


def test_columns_named_like_the_operators_own_survive(docs):
    named = docs.limit(20).unionByName(docs.where("doc_id IN (100, 101, 103, 200)"))
    for name in ("__has_letter", "__text", "__lang_pred", "__lang_score", "__gone", "__again", "ids"):
        named = named.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    for kept in (byte_cnn.keep_known(named, least=0.0), jaccard_join.deduplicated(named)):
        assert kept.columns == named.columns and set(rows_of(kept)) <= set(rows_of(named))
        assert kept.count() > 5
    ids = {r["doc_id"] for r in jaccard_join.deduplicated(named).collect()}
    assert 100 in ids and 101 not in ids and 103 not in ids
    encoded = merge_rounds.encode(named)
    assert encoded.columns == [c for c in named.columns if c != "ids"] + ["ids"] and dict(encoded.dtypes)["ids"] == "array<int>"
    again = merge_rounds.encode(encoded)
    assert rows_of(again) == rows_of(encoded)


def test_pipeline_on_awkward_and_empty_tables(spark, mixed, no_docs, tmp_path):
    import corpus_pipeline

    docs, labels = mixed
    item = docs.where("doc_id = 1001").first()["text"]
    items = spark.createDataFrame([(1, " ".join(item.split()[3:14])), (2, None), (None, "no such words")], "item_id long, text string")
    for name, tables in (("full", (docs, labels, items)), ("empty", (no_docs, labels.limit(0), items.limit(0))), ("unlabelled", (docs, labels.limit(0), items))):
        for table, df in zip(("documents", "labels", "benchmark"), tables, strict=True):
            df.coalesce(1).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.columns == [*docs.columns, "ids", "n_tokens"]
        ids = [r["doc_id"] for r in got.collect()]
        if name == "full":
            good = {i for i in range(1000, 1300) if i % 5}
            assert 1001 not in ids and not {200, 201, 202, 203} & set(ids), "benchmark passages and texts without letters go"
            assert len(good & set(ids)) > 0.9 * len(good) and len(set(ids)) == len(ids)
        else:
            assert ids == [], "nothing to keep, or no label that tells good from bad: every score is 0.5"
