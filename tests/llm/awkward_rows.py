"""Rows that every operator must take, and comparisons with SQL."""

from __future__ import annotations

import random

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, lang_pred string, rank int, bands string, label string"


def clashing(doc_id, text, lang="en"):
    """A row with columns named like the operators' own."""
    return (doc_id, text, lang, "src", len(text or ""), 0.1, True, "zz", 5, "b", "c")


def awkward() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [clashing(i, prose(rng.randint(3, 90)), rng.choice(["en", "fr"])) for i in range(60)]
    rows += [clashing(100, base), clashing(101, base), clashing(102, " ".join(near)), clashing(103, base.upper()), clashing(103, base.upper())]
    rows += [clashing(200, None), clashing(201, ""), clashing(202, "   \n\t"), clashing(203, "!!! 42 ..."), clashing(None, base), clashing(204, "ñandú ✓ \U0001f600 x"), clashing(205, "word " * 30000), clashing(206, "x" * 70000), clashing(207, "one two")]
    return rows


def rows_of(df, *names):
    return sorted(map(str, (tuple(r[n] for n in (names or df.columns)) for r in df.collect())))


def sql_rows(duck, sql, names):
    found = duck.execute(sql)
    have = [x[0] for x in found.description]
    return sorted(str(tuple(r[have.index(n)] for n in names)) for r in found.fetchall())
