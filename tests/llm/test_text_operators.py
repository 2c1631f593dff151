"""Decontamination, licences, SentencePiece, token counts against SQL or the library."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from awkward_rows import ROWS, clashing, rows_of, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from burin.llm import licenses, merge_rounds, token_transducer, wu_manber

DIGEST = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def items(spark, docs):
    some = [r["text"] for r in docs.where("doc_id IN (100, 1, 2)").orderBy("doc_id", ascending=False).collect()]
    rows = [(1, " ".join(some[0].split()[10:40])), (2, some[1]), (2, some[1]), (3, "ONE  two"), (4, None), (5, "..."), (None, "word word word"), (6, "no such passage stands anywhere in all of these texts here")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("bound", [wu_manber.PASS_WORDS, 300])
def test_decontamination_equals_sql(docs, items, views, bound):
    got = wu_manber.report(docs, items, bound=bound)
    duck = views(documents=docs, benchmark=items)
    assert rows_of(got, *DIGEST) == sql_rows(duck, wu_manber.SQL, DIGEST)
    assert got.where("contaminated").count() > 3


def test_decontamination_cleans(docs, items, no_docs):
    clean = wu_manber.clean(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == wu_manber.report(docs, items).where("NOT contaminated").count()
    assert wu_manber.report(no_docs, items).count() == 0
    assert wu_manber.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_licences_equal_sql(spark, views):
    paragraph = licenses.TEMPLATES[3][1].replace("Software without", "Software\nwithout")
    texts = [None, "", "x", "Released under the MIT License.", "RELEASED UNDER THE M.I.T License", "a\nLicensed under CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public License, version 3!", "intro\n\n" + paragraph + "\n\nend", "license " * 5000, "Copyright (c) 2020 Acme Corp. All rights reserved. Licensed under the MIT License.", "# " + paragraph.replace("\n", "\n# ") + "\n#\n# The end", "Licensed under something else entirely with many other words in it"]
    docs = spark.createDataFrame([clashing(i, t) for i, t in enumerate(texts)] + [clashing(None, texts[3]), clashing(3, texts[3])], ROWS)
    got = licenses.scan(docs)
    assert rows_of(got) == sql_rows(views(documents=docs), licenses.sql(), got.columns)
    by = {r["doc_id"]: r["licenses"] for r in got.collect() if r["doc_id"] is not None}
    assert by[3] == "MIT" and by[5] == "CC-BY-NC-4.0,GPL-3.0" and by[6] == by[8] == by[9] == "MIT" and by[7] == by[10] == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted({w for _, t in licenses.TEMPLATES for w in t.split()})), max_size=30))
def test_licence_anchors_never_lose_a_unit(words):
    unit = set(licenses.bigrams_of(" ".join(words)))
    for _, body in licenses.TEMPLATES:
        own = set(licenses.bigrams_of(body))
        if unit and 2 * len(unit & own) >= licenses.THRESHOLD * (len(unit) + len(own)):
            assert licenses.anchors_of(body, licenses.THRESHOLD) & {w for g in unit for w in g.split(" ")}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_encoding_and_counts_equal_the_library(docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in merge_rounds.encode_digests(docs).collect():
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in token_transducer.count_tokens(docs).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    assert merge_rounds.encode_digests(no_docs).count() == token_transducer.count_tokens(no_docs).count() == 0
    assert merge_rounds.encode(docs).columns == [*docs.columns, "ids"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n▁aeinthr.0é中"), max_size=60), max_size=8))
def test_any_text_encodes_as_in_the_library(library, texts):
    enc, machine = merge_rounds.encoder(None), token_transducer.transducer(None)
    ids, at = enc.encode(texts)
    back, to = enc.decode(ids, at)
    points = [np.array([ord(c) for c in t], np.int32) for t in texts]
    counts = machine.count(np.concatenate([np.zeros(0, np.int32), *points]), np.cumsum([0, *map(len, points)]))
    for k, t in enumerate(texts):
        expected = library.encode(t, add_bos=True, add_eos=True)
        assert ids[at[k] : at[k + 1]].tolist() == expected and counts[k] == len(expected) - 2
        assert back[to[k] : to[k + 1]].tobytes().decode() == library.decode(expected)


def test_chunks_without_a_synchronising_place(library):
    machine = token_transducer.transducer(None)
    texts = ["ab" * 3000, "a" * 2000, " " * 1500, "x" + "th" * 700 + " the end"]
    points = [np.array([ord(c) for c in t], np.int32) for t in texts]
    assert machine.count(np.concatenate(points), np.cumsum([0, *map(len, points)])).tolist() == [len(library.encode(t)) for t in texts]


def test_token_counts_of_long_texts_without_places_to_synchronise(monkeypatch):
    import random

    import numpy as np
    import sentencepiece

    from burin.llm import token_transducer as T
    from burin.llm.pieces import load, resolve

    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choices(letters, k=30_000)), "ab" * 4000, "", "hello world " * 300, "".join(rng.choices(letters, k=9_000))]
    want = [len(sentencepiece.SentencePieceProcessor(model_file=resolve(None)).encode(t)) for t in texts]
    points, offsets = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.cumsum([0, *map(len, texts)])
    # Sections that are shorter than a text, few transitions kept, and a table that must grow.
    for section, most, bits in ((1 << 11, 500, 8), (1 << 13, 5000, 12), (1 << 20, 1 << 20, 6)):
        monkeypatch.setattr(T, "SECTION", section)
        monkeypatch.setattr(T, "MOST_TRANSITIONS", most)
        monkeypatch.setattr(T, "_BITS", bits)
        machine = T.Transducer(load(resolve(None)))
        assert machine.count(points, offsets).tolist() == want
        assert 2 * machine.transitions <= 1 << machine.bits
