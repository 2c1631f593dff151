"""Top-k search, Jaccard join, page differencing and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from awkward_rows import awkward, rows_of, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burin.llm import components, cover_tree, jaccard_join, page_diff


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12)) / 4
    rows = [(i, [float(v) for v in centres[i % 6] + rng.standard_normal(12) / 12], "x") for i in range(900)]
    rows += [(1000 + i, rows[7][1], "x") for i in range(40)]  # ties
    rows += [(2000, None, "x"), (2100, [], "x"), (2200, [float("nan")] * 12, "x"), (2300, [None] * 12, "x"), (2400, [0.5, 0.5], "x"), (2401, [0.25, -1.0], "x"), (None, rows[3][1], "x"), (2500, [0.0] * 12, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize(("queries", "rows", "run"), [(8192, 100_000, 8192), (3, 300, 100)])
def test_top_k_equals_sql(vectors, views, queries, rows, run):
    got = cover_tree.top_k(vectors, cell_queries=queries, cell_rows=rows, run=run)
    assert rows_of(got) == sql_rows(views(embeddings=vectors), cover_tree.SQL, got.columns)


def test_rows_that_repeat_a_query_are_each_asked(vectors, views):
    twice = vectors.unionByName(vectors.where("vec_id IN (100, 200, 205)"))
    got = cover_tree.top_k(twice, cell_rows=300)
    assert rows_of(got) == sql_rows(views(embeddings=twice), cover_tree.SQL, got.columns)
    assert got.where("query_id = 100").count() == 20 and got.where("query_id = 300").count() == 10


def test_top_k_of_nothing(vectors):
    assert cover_tree.top_k(vectors.limit(0)).count() == 0


def test_parts_that_no_query_reaches_are_not_sent(spark):
    """Clusters in all directions: queries go to few parts, and a part of a third of the rows is split."""
    rng = np.random.default_rng(11)
    centres = np.eye(24) * 3
    rows = [(i, [float(v) for v in centres[0 if i % 3 == 0 else i % 24] + rng.standard_normal(24) / 40]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    dealt = cover_tree.deal(df, 100, "vec_id", "embedding", cell_queries=20, cell_rows=100)
    assert sum(r["rows"] for r in dealt.parts) == 6000 and len(dealt.parts) > 30
    assert max(r["count"] for r in dealt.rows.groupBy("p").count().collect()) < 200
    reached = cover_tree.reach(dealt, 10)
    sent = reached.selectExpr("sum(size(reached))").first()[0]
    assert sent < 0.5 * 60 * len(dealt.parts)
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(np.float64))
    want = []
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(6000), -s))[:10]
        want += [(q, r, int(i), int(s[i])) for r, i in enumerate(top, 1)]
    assert sorted(tuple(r) for r in cover_tree.top_k(df, cell_queries=20, cell_rows=100).collect()) == want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 4), st.integers(0, 1000))
def test_cover_tree_invariants(n, d, seed):
    points = np.floor(np.random.default_rng(seed).standard_normal((n, d)) * 8)
    tree = cover_tree.build(points, leaf=4, fanout=50)
    assert sorted(tree.place.tolist()) == list(range(n)) and (points[tree.place] == tree.points).all()
    for a, b, c, r, first, k in zip(tree.start, tree.end, tree.centre, tree.radius, tree.child, tree.children, strict=True):
        assert (np.sqrt(((tree.points[a:b] - c) ** 2).sum(1)) <= r + 1e-9).all()
        assert (tree.points[a:b] == c).all(1).any(), "a centre is a point of its own node"
        if k:
            below = tree.centre[first : first + k]
            apart = np.sqrt(((below[:, None] - below[None]) ** 2).sum(2)) + np.eye(k) * 1e9
            assert (below[0] == c).all(), "nesting"
            assert apart.min() > r / 2 - 1e-9, "separation"
            assert k == 50 or (tree.radius[first : first + k] <= r / 2 + 1e-9).all(), "covering"
            assert (tree.start[first], tree.end[first + k - 1]) == (a, b)


def test_join_equals_sql(spark, views):
    rows = [r for r in {(r[0], r[1]): r for r in awkward()}.values() if r[0] is not None]
    docs = spark.createDataFrame(rows).toDF("doc_id", "text", *[f"c{i}" for i in range(9)])
    got = jaccard_join.join(docs)
    assert rows_of(got) == sql_rows(views(documents=docs.select("doc_id", "text")), jaccard_join.SQL, got.columns)


def test_join_of_awkward_rows(docs, no_docs):
    got = jaccard_join.join(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[100]["class_id"] == by[101]["class_id"] == by[102]["class_id"] == by[103]["class_id"] == 100
    assert by[100]["n_links"] == 3 and by[200]["n_links"] == 0 and by[200]["class_id"] == 200 and by[None]["class_id"] is None
    kept = jaccard_join.deduplicated(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 100 in ids and 101 not in ids and 103 not in ids and 200 in ids and None in ids
    assert jaccard_join.join(no_docs).count() == jaccard_join.deduplicated(no_docs).count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 40)
    monkeypatch.setattr(jaccard_join, "BAND_BLOCK_ROWS", 50)


def test_recall_of_pairs_just_over_the_threshold(spark):
    """Planted pairs of similarity 0.8 to 0.86, a common passage in all of them: every pair is found, nothing else."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for k in range(300):
        own = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        other = own + [f"n{rng.randrange(10**9)}" for _ in range(rng.randint(15, 34))]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + other))]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    real = {k for k in range(300) if len(shingles(rows[2 * k][1]) & shingles(rows[2 * k + 1][1])) >= 0.8 * len(shingles(rows[2 * k][1]) | shingles(rows[2 * k + 1][1]))}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(real) > 250
    for k in range(300):
        assert (got[2 * k + 1], got[2 * k]) == (((2 * k, 1), (2 * k, 1)) if k in real else ((2 * k + 1, 0), (2 * k, 0)))


def test_large_component_in_blocks_loses_no_link(spark, small_blocks, views):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def changed():
        out = list(base)
        for _ in range(rng.randint(0, 4)):
            out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
        return " ".join(out)

    docs = spark.createDataFrame([(i, changed()) for i in range(220)], "doc_id long, text string")
    got = jaccard_join.join(docs)
    assert rows_of(got) == sql_rows(views(documents=docs), jaccard_join.SQL, got.columns)


def test_tables_of_the_join_have_few_files(spark, monkeypatch):
    """Tasks that hash texts or compare sets write no file each: what they find is shuffled first."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
        rows += [(2 * k, text), (2 * k + 1, text + " end")]
    files, write = [], jaccard_join.persisted

    def noted(df, keep=False):
        out = write(df, keep)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "persisted", noted)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(24))
    assert max(files) <= 4 and files[-1] == 1
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == {i: (i - i % 2, 1) for i in range(120)}


def test_pruning_bounds():
    least = jaccard_join.least_matches()
    assert len(least) == jaccard_join.VALUES // jaccard_join.CHUNK and all(a <= b for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(0)
    for _ in range(200):  # pairs at the threshold are not dropped
        hits = rng.random(jaccard_join.VALUES) < jaccard_join.THRESHOLD
        assert all(hits[: (k + 1) * jaccard_join.CHUNK].sum() >= m for k, m in enumerate(least))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


PAGE = '<html><head><title>t</title></head><body><div>Site name</div><ul class="menu"><li>Home</ul>{}<div>Contact us</div><!-- x --><script>"<p>no</p>"</script></body></html>'


def test_pages_without_containers_lose_shared_lines(spark):
    rows = [(i, f"http://h.example/a/{i}", PAGE.format(f"<h1>Title {i}</h1><p>Body &amp; more\n {i}</p><div class='comments'><p>first!</p></div>")) for i in range(6)]
    rows += [(20, "http://other.example/x", PAGE.format("<p>alone</p>")), (21, None, None), (22, "http://h.example/a/1", ""), (None, "http://h.example/b", "<article><p>own<p>two</article><p>not")]
    rows += [(30, "http://c.example/1", "<p>same</p><p>copy</p>"), (31, "http://c.example/2", "<p>same</p><p>copy</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_diff.extract(pages).collect()}
    assert [got[i]["text"] for i in range(6)] == [f"Title {i}\nBody & more {i}" for i in range(6)]
    assert got[20]["text"] == "Site name\nalone\nContact us" and got[21]["text"] == got[22]["text"] == "" and got[None]["text"] == "own\ntwo"
    assert got[30]["text"] == got[31]["text"] == "same\ncopy" and got[3]["n_chars"] == len(got[3]["text"])
    assert page_diff.extract(pages.limit(0)).count() == 0


def test_differencing_decides_on_pages_with_containers(spark):
    body = PAGE.format("<article><h1>Title {0}</h1><p>Share this story</p><p>Teaser {0}</p></article><div><p>The body of {0} stands in a sibling.</p></div>")
    rows = [(i, f"http://h.example/a/{i}", body.replace("{0}", f"number {i}")) for i in range(6)]
    rows += [(10, "http://alone.example/x", "<main><h1>Head</h1></main><div><p>A body without a partner</p></div>")]
    rows += [(20 + i, f"http://copies.example/{i}", f"<div>Site {i}</div><article><p>One long article that is on every page</p></article>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(1, 5)] == [f"Title number {i}\nTeaser number {i}\nThe body of number {i} stands in a sibling." for i in range(1, 5)]
    assert got[10] == "Head\nA body without a partner" and all("One long article that is on every page" in got[20 + i] for i in range(3))


def test_loose_rules_drop_no_main_text():
    kept = lambda page: [line for line, noise, _ in page_diff.lines_of(page) if not noise]
    assert kept("<p>a</p><svg width='1'/><p>b</p><iframe><p>c") == ["a", "b", "c"]
    assert kept("<p>a</p><script>var x;<p>b</p>") == ["a", "b"] and kept("<svg><text>x</text></svg><p>a") == ["a"]
    for wrapper in ("div class='has-sidebar'", "div class='content header-fixed'", "section id='discussion'"):
        name = wrapper.split()[0]
        assert kept(f"<nav>n</nav><{wrapper}><p>Most of the page</p></{name}><div class=ad>ad</div>") == ["Most of the page"]
        assert kept(f"<{wrapper}><article><p>own</p></article><div class=ad>an advert that is longer</div></{name}>") == ["own"]
    assert kept("<article class='post no-comments'><p>own text</p></article>") == ["own text"]
    assert kept("<article><p>own text</p></article><div class='comments'><article class='comment'><p>a comment longer than that</p></article></div>") == ["own text"]


def test_partners_do_not_depend_on_ranges(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i % 7}/{i}", PAGE.format(f"<p>Text {i}</p>")) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    few = rows_of(page_diff.extract(pages))
    monkeypatch.setattr(page_diff, "RANGE_PAGES", 9)
    assert rows_of(page_diff.extract(pages)) == few


def test_copies_between_a_page_and_its_neighbour(spark, monkeypatch):
    """A run of copies longer than a range: each is differenced against the page beyond it. Repeats, clashing columns and long ids."""
    monkeypatch.setattr(page_diff, "RANGE_PAGES", 5)
    page = lambda own: f"<html><body><div>Site name</div><div>Our motto of the site</div><p>{own}</p><div>All rights of the site</div></body></html>"
    copy = page("A story that many addresses show again and again")
    rows = [(f"id-{'x' * 30}-{i:04d}", f"http://a.example/story?utm={i:03d}", copy) for i in range(60)]
    rows += [rows[7]] * 25 + [("other", "http://a.example/zebra", page("Another story")), ("short", "http://a.example/zz", page("Hi")), ("none", None, None)]
    docs = spark.createDataFrame([(*r, "k", "b", "lines") for r in rows], "page_id string, url string, html string, k string, b string, lines string")
    got = page_diff.extract(docs).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert {t for i, t in texts.items() if i.startswith("id-")} == {"A story that many addresses show again and again"}
    assert texts["other"] == "Another story" and texts["short"] == "Hi" and texts["none"] == ""


def test_deep_nesting_is_linear():
    import time

    began = time.perf_counter()
    lines = page_diff.lines_of("<div class=menu>x</section>" * 40_000)
    assert len(lines) == 40_000 and time.perf_counter() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_shared_is_a_longest_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert len(page_diff.shared(a, b)) == table[-1, -1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert docs.columns[-2:] == ["ids", "n_tokens"] and sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 2
    assert docs.groupBy("text").count().where(F.col("count") > 1).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_long_lists_of_repeated_lines_are_aligned_exactly():
    import random
    import time

    rng = random.Random(4)
    for kinds, n, m in ((2, 130, 170), (5, 300, 90), (40, 200, 200), (1, 100, 300), (3, 1, 9000)):
        a, b = [rng.randrange(kinds) for _ in range(n)], [rng.randrange(kinds + 1) for _ in range(m)]
        row = [0] * (m + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        places = sorted(page_diff.shared(a, b))
        assert len(places) == row[-1]
        rest = iter(b)
        assert all(a[i] in rest for i in places)  # a subsequence of b too
    began = time.monotonic()
    a, b = [rng.randrange(2) for _ in range(40_000)], [rng.randrange(2) for _ in range(40_000)]
    assert len(page_diff.shared(a, b)) > 30_000 and time.monotonic() - began < 60
