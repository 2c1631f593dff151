"""Product codes, centroids and personal data, against plain computations."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from burin.llm import laesa, orchard, span_crf

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, cluster int, key string, x int, v string"


def vectors(width, n=150, seed=4):
    """Rows with nulls, other lengths, repeats, ties, a common vector and clashing columns."""
    rng = random.Random(seed)
    some = lambda: [rng.choice([-0.5, 0.25, rng.gauss(0, 0.3)]) for _ in range(width)]
    row = lambda i, v, label=1: (i, v, label, "c", 5, 9, "k", 3, "v")
    rows = [row(i * 3, some(), rng.choice([0, 1, None])) for i in range(n)]
    common = some()
    rows += [row(1000 + i, common, 2) for i in range(n)]
    rows += [row(7, None), row(8, []), row(10, [0.1] * (width - 1)), row(11, [None] * width), row(13, [math.nan] * width), row(14, [math.inf] + [0.0] * (width - 1)), row(None, some()), row(None, some()), rows[0], rows[0], rows[5]]
    rng.shuffle(rows)
    return rows


def kept(rows, width, scale):
    good = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], r[2], [math.floor(scale * float(np.float32(x))) for x in r[1]], [float(np.float32(x)) for x in r[1]]) for r in good]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(x, centres):
    return min(range(len(centres)), key=lambda i: (distance(x, centres[i]), i))


def lloyd(points, centres, rounds):
    for _ in range(rounds):
        own = [nearest(p, centres) for p in points]
        for c in range(len(centres)):
            mine = [p for p, o in zip(points, own, strict=True) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return centres


def test_codes_equal_plain_rounds_and_sql(spark, views):
    df = spark.createDataFrame(vectors(16), VECTORS)
    rows = sorted(kept(vectors(16), 16, 4096), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    books = []
    for p in range(8):
        points = [r[2][2 * p : 2 * p + 2] for r in rows]
        books.append(lloyd(points, [list(x) for x in points[:16]], 6))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want, total = [], {}
    for k, label, v, _ in rows:
        codes = [nearest(v[2 * p : 2 * p + 2], books[p]) for p in range(8)]
        error = sum(distance(v[2 * p : 2 * p + 2], books[p][c]) for p, c in enumerate(codes))
        total[label] = total.get(label, 0) + error
        want.append((k, label, bytes(codes).hex(), error))
    got = sorted(map(str, (tuple(r) for r in orchard.compress(df).collect())))
    assert got == sorted(str((k, c, e, total[label], digest)) for k, label, c, e in want)
    found = views(embeddings=df).execute(orchard.SQL).fetchall()
    assert got == sorted(map(str, found))


def test_codes_of_few_and_no_rows(spark):
    df = spark.createDataFrame(vectors(16)[:5], VECTORS)
    assert orchard.compress(df).count() == len(kept(vectors(16)[:5], 16, 4096))
    assert orchard.compress(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(Exception, match="63 bits"):
        orchard.compress(spark.createDataFrame([(1, [1e30] * 8, 1, "", 1, 1, "", 1, "")], VECTORS).selectExpr("vec_id", "embedding", "label")).collect()


def test_codes_decode_near_their_vectors(spark):
    df = spark.createDataFrame(vectors(16), VECTORS)
    books = orchard.fit(df)
    rows = orchard.encode(df.where("vec_id < 400"), books, "vec_id", "embedding").collect()
    near = books.decode(np.array([r["codes"] for r in rows]))
    for r, v in zip(rows, near, strict=True):
        assert abs(distance([4096 * x for x in r["embedding"]], [4096 * x for x in v]) - r["error"]) <= 2 * 16 * 4096 + 16 * 16
    with pytest.raises(ValueError):
        orchard.encode(df, books, "error")


def test_orchard_compares_fewer_entries_and_keeps_ties():
    rng = np.random.default_rng(0)
    entries = rng.integers(-4000, 4000, (64, 4))
    entries[5] = entries[40] = entries[9]
    x = np.concatenate([entries[rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 4)), np.repeat(entries[[40]], 5, 0), (entries[:5] + entries[10:15]) // 2])
    found = orchard.Orchard(entries)
    code, d = found.nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (d == every.min(1)).all()
    assert found.compared < 0.5 * every.size


def test_clusters_equal_plain_rounds_and_sql(spark, views):
    df = spark.createDataFrame(vectors(64, 60), VECTORS)
    order = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[3])
    rows = sorted(kept(vectors(64, 60), 64, 1024), key=order)
    centres = lloyd([r[2] for r in rows], [list(r[2]) for r in rows[:8]], 10)
    own = [(r[0], nearest(r[2], centres)) for r in rows]
    d = [distance(r[2], centres[c]) for r, (_, c) in zip(rows, own, strict=True)]
    inertia = [sum(x for x, (_, c) in zip(d, own, strict=True) if c == k) for k in range(8)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    got = sorted(map(str, (tuple(r) for r in laesa.cluster(df).collect())))
    assert got == sorted(str((k, c, x, inertia[c], sum(d), digest[c])) for (k, c), x in zip(own, d, strict=True))
    assert got == sorted(map(str, views(embeddings=df).execute(laesa.SQL).fetchall()))
    assert laesa.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert laesa.cluster(df.where("vec_id IS NULL")).count() == 2


def test_pivots_rule_out_centroids_but_no_tie():
    rng = np.random.default_rng(1)
    pivots = rng.integers(-4000, 4000, (8, 64))
    x = pivots[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 64))
    centroids = pivots + rng.integers(-50, 50, (8, 64))
    centroids[6] = centroids[2]
    own, d, computed = laesa.nearest(x, laesa.roots(x, pivots), centroids, laesa.roots(centroids, pivots))
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (d == every.min(1)).all()
    assert computed < 0.4 * every.size


# --- personal data -----------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return [True, kind == 1 and all(int(p) <= 255 for p in text.split(".")), 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, 10 <= len(digits) <= 15][kind]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m[0]))


def told(spans):
    return ",".join(f"{span_crf.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def model():
    return span_crf.train([], [])


def test_base_spans_equal_the_patterns(spark, model):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789" * 2 + "+-. ()@a.é\n") for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    rows = [(i, t, "a", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "a@b.cd", "z", 1, 1), (5000, None, "z", 1, 1), (0, texts[0], "a", 1, 2)], "doc_id long, text string, spans string, n_email int, base_sha256 int")
    got = {r["doc_id"]: r for r in span_crf.report(df, model=model).collect()}
    assert len(got) == 1502 and got[5000]["spans"] == "" and got[5000]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[None]["spans"] == "email:0:6"
    for i, t in enumerate(texts):
        base = plain(t)
        assert [got[i][f"n_{k}"] for k in span_crf.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        every = [(int(a), span_crf.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]
        added = [s for s in every if s not in base]
        assert set(base) <= set(every) and every == sorted(every)
        assert all(x is y or x[2] <= y[0] or y[2] <= x[0] for x in added for y in every)


def found_by(model, text):
    raw = text.encode()
    (base, added), = span_crf.spans_of_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model)
    return [(span_crf.KINDS[k], raw[a:b].decode()) for a, k, b in sorted(base + added)]


def test_spans_that_the_patterns_miss_are_added(model):
    assert found_by(model, "erntou +1 (269) 555-3296 4524132264652876 and") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert found_by(model, "Edble 4028005252517056 27.189.188.194 ersh") == [("card", "4028005252517056"), ("ip", "27.189.188.194")]
    assert found_by(model, "write to anna.b at example dot com today") == [("email", "anna.b at example dot com")]
    assert found_by(model, "anna (at) mail (dot) org, x@y.de") == [("email", "anna (at) mail (dot) org"), ("email", "x@y.de")]
    assert found_by(model, "call (212) 555-0147 now") == [("phone", "(212) 555-0147")]
    for clean in ("on 2024-03-01 at 10.30 we met", "version 3.11.2 of it", "pages 1990-2005", "id 4524132264652877 is none", "token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\"", "look at the dot on the map", "", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert found_by(model, clean) == []


def test_best_cut_equals_all_cuts(model):
    rng = random.Random(8)
    for _ in range(60):
        raw = " ".join(span_crf._other(rng) if rng.random() < 0.4 else span_crf._WRITERS[rng.choice([1, 2, 3])](rng) for _ in range(2)).encode()
        window = span_crf.window_of(raw, True)
        if window is None or not 0 < len(window.candidates) < 12:
            continue

        def value(chosen):
            at, y, score = 0, 0, 0.0
            for i, j, kind, key, _, _ in sorted(chosen):
                if i < at:
                    return -math.inf
                for _ in range(i - at):
                    score, y = score + model.beside[y, 0], 0
                score, y, at = score + model.beside[y, kind + 1] + model.score(kind, key), kind + 1, j
            for _ in range(window.n - at):
                score, y = score + model.beside[y, 0], 0
            return score

        every = (c for r in range(5) for c in itertools.combinations(window.candidates, r))
        best = max(every, key=value)
        got = {(a, k, b) for a, k, b in model.best(window)}
        chosen = [c for c in window.candidates if (c[4], c[2], c[5]) in got]
        assert value(chosen) == pytest.approx(value(best))


def test_gradient_is_that_of_the_likelihood():
    rng = random.Random(1)
    made = [span_crf._made(rng, [b"w"]) for _ in range(40)]
    examples = [(w, {s for s in gold if s[1]}) for raw, gold in made if (w := span_crf.window_of(raw, True)) and w.candidates and {s for s in gold if s[1]} <= {(c[4], c[2], c[5]) for c in w.candidates}]
    batch = span_crf.Batch(examples)
    start = np.random.default_rng(0)
    w, t = start.normal(0, 0.3, span_crf.BUCKETS), start.normal(0, 0.3, (5, 5))
    _, gw, gt = batch.gradient(w, t)
    for at in np.argsort(-np.abs(gw))[:5]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert (batch.gradient(up, t)[0] - batch.gradient(down, t)[0]) / 2e-4 == pytest.approx(gw[at], abs=1e-3)
    for at in ((0, 0), (0, 3), (3, 0), (4, 3)):
        up, down = t.copy(), t.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert (batch.gradient(w, up)[0] - batch.gradient(w, down)[0]) / 2e-4 == pytest.approx(gt[at], abs=1e-3)


def test_awkward_documents(docs, no_docs, model):
    got = span_crf.report(docs).collect()
    assert len(got) == docs.count() and all(r["spans"] == "" for r in got if r["doc_id"] in (200, 201, 202))
    assert span_crf.report(no_docs).collect() == []
    with pytest.raises(ValueError):
        span_crf.find(docs, model, "spans")


def test_long_rows_of_marks_take_linear_time(model):
    for text in ("1" * 300_000, "1 " * 60_000, "a" * 300_000 + "@", "@" * 100_000, "+1" * 50_000, "1." * 60_000, "(at) " * 20_000):
        raw = text.encode()
        list(span_crf.spans_of_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model))
