import random

import pytest

from veriquill.llm.spark_io import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, word string, spans string"


def awkward_rows():
    """Nulls, blanks, controls, repeated rows, ties, copies, a long text, license and benchmark passages, personal data."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "re", "ti", "on", "sh", "é", "ß", "Wh"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    base = prose(120)
    words = base.split(" ")
    texts = [None, "", "   \n\t ", "x", "one two three", base, base, " ".join([*words[:60], "changed", *words[61:]]), " ".join([*words[:20], prose(40), *words[60:]]), prose(9000)]
    texts += [f"{prose(30)}\nline 12 of the very common notice {i}\n{prose(10)}" for i in range(8)]
    texts += ["Mail a.b@c.example.com or +1 (743) 555-3824, 10.0.0.256 and 10.0.0.255; card 4111 1111 1111 1111. A+b@x.y", "a\x1cb\x85c\xa0d <|endoftext|> \U0001f600 'S it's", "GNU General Public License, the MIT license; CC-BY cc by cc  Apache License apache license"]
    texts += ["Licensed under the Apache License, Version 2.0 (the license); you may not use this file but in compliance with the License. You may obtain a copy of the License at x"]
    texts += [" ".join(["again and again the same eight words stand here"] * 6), "#$%& " * 30, prose(40) + "\n" + "same line here now\n" * 5]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[6], (None, base, None, None, None), (None, None, None, None, None)]
    return [(*r, "th", "word", "spans") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")


def rows_of(df, *columns):
    """Sorted rows as tuples; nulls come first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
