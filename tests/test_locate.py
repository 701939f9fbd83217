"""The locate cascade, claims and the resolving of cites against plain Python over every page."""

import random

import pytest
from pyspark.sql import functions as F

from veriquill.functions import matching as M
from veriquill.operators import locate
from veriquill.sources import tables as S

SF = "/root/testdata/sf0.001"


def common(a, b):
    """Length of the longest common subsequence, by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    return lambda n: [word() for _ in range(n)]


def test_overlaps():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(2))
        assert M.overlaps(a, b) == [common(a, b[:k]) for k in range(len(b) + 1)]


def test_perturbed_quotes(prose):
    """Changed letters, missing and added words are found where they stand; scores follow from the common letters."""
    rng = random.Random(2)
    for _ in range(60):
        words = prose(200)
        at = rng.randrange(10, 150)
        quote = words[at : at + 20]
        kind = rng.randrange(3)
        if kind == 0:
            quote[7] = "x" + quote[7][1:]
        elif kind == 1:
            del quote[9]
        else:
            quote.insert(5, "added")
        method, score, first, last, _ = M.locate(" ".join(words), " ".join(quote))
        q, s = M.squashed(" ".join(quote)), M.squashed(" ".join(words[first : last + 1]))
        both = common(q, s)
        assert method == "fuzzy" and abs(first - at) <= 1 and abs(last - at - 19) <= 1
        assert score >= both / len(q) * (both / len(s)) ** 0.5 - 1e-9 >= 0.78 - 1e-9


def test_literal_matches(prose):
    page = "Revenue rose 12.5 % to £1,588m in 2024. The Group’s net- debt fell. " + " ".join(prose(60)) + " Revenue rose 12.5 % again, effiCIent ﬁeld"
    assert M.locate(page, "revenue ROSE 12.5%") == ("exact", 1.0, 0, 2, 2)
    assert M.locate(page, "evenue rose 12.5") == ("exact", 0.97, 0, 2, 2)
    assert M.locate(page, "£1,588m in 2024") == ("exact", 1.0, 5, 7, 1) and M.locate(page, "£1,589m in 2024") is None
    assert M.locate(page, "efficient field")[:2] == ("exact", 1.0)
    assert M.locate(page, "a b") is None and M.locate("", "words") is None
    method, score, *_ = M.locate(page, "Revenue rose 12.5 % to … Group's net debt fell [...] again, efficient")
    assert method == "fragments" and score > 0.9
    words = page.split()
    assert M.locate(page, " ".join(reversed(words[20:40])))[0] == "block"


def test_claims():
    page = "In 2023 total revenue grew to £1,234m while operating costs fell by 3.4 per cent across the European business"
    assert M.align(page, "Revenue grew to £1,234m and operating costs fell 3.4 per cent")[0] == "aligned"
    assert M.align(page, "Revenue grew to £1,235m and operating costs fell 9.9 per cent") is None
    assert M.align(page, "costs") is None and M.align("", "operating costs fell") is None
    assert M.key_numbers(["2024", "1588", "12", "3.4", "1588"]) == ["1588", "3.4"] and M.is_year("2100") and not M.is_year("2101")


def policy(pages, hint, quote):
    """Stage, page and match by the rule, page by page."""
    sure = ("exact", "fuzzy", "fragments")
    hint = max(1, min(hint, len(pages)))
    here = M.locate(pages[hint - 1], quote)
    if here and here[0] in sure:
        return "hint", hint, here
    for p in (hint - 1, hint + 1):
        if 1 <= p <= len(pages) and (m := M.locate(pages[p - 1], quote)) and m[0] in sure:
            return "near", p, m
    q = M.squashed(quote)
    if len(q) >= 24:
        for p in sorted((p for p in range(1, len(pages) + 1) if q in M.squashed(pages[p - 1])), key=lambda p: abs(p - hint)):
            if (m := M.exact(M.Page(pages[p - 1]), quote)) is not None:
                return "document", p, m
    return "area" if here else "page", hint, here


def test_cascade(spark):
    """Every cite of the tables and some far off: by columns and joins as page by page."""
    docs = {r.doc_id: (r.text or "").split("\n") for r in S.read(spark, SF, "documents").collect()}
    cites = S.cites(spark, SF)
    far = cites.where("doc_id % 4 = 0").withColumn("page", F.lit(99).cast("long")).withColumn("cite_id", F.lit(2).cast("long"))
    cites = cites.unionByName(far)
    got = {(r.doc_id, r.cite_id): r for r in locate.locate(cites, S.pages(spark, SF)).collect()}
    asked = cites.collect()
    assert len(got) == len(asked)
    stages = set()
    for c in asked:
        stage, page, match = policy(docs[c.doc_id], c.page, c.quote)
        r = got[c.doc_id, c.cite_id]
        have = tuple(r.match)[:5] if r.match else None
        assert not r.match or r.match.matched == M.matched_text(docs[c.doc_id][page - 1], c.quote, match)
        assert (r.stage, r.found_page) == (stage, page), (c, r, stage, page, match)
        assert have == match or (have and match and have[0] == match[0] and abs(have[1] - match[1]) < 1e-9 and have[2:] == match[2:]), (c, have, match)
        stages.add(stage)
    assert stages == {"hint", "near", "document", "area", "page"}
    resolved = {(r.doc_id, r.cite_id): r for r in locate.resolve(cites, S.pages(spark, SF)).collect()}
    sources = set()
    for c in asked:
        stage, page, match = policy(docs[c.doc_id], c.page, c.quote)
        r, hint = resolved[c.doc_id, c.cite_id], max(1, min(c.page, len(docs[c.doc_id])))
        claimed = None if stage in ("hint", "near", "document") else M.align(docs[c.doc_id][hint - 1], c.claim)
        want = ("model", page, match) if stage in ("hint", "near", "document") else ("aligned", hint, ("block", *claimed[1:])) if claimed else ("none", hint, match)
        method, score = (want[2][0], round(want[2][1], 4)) if want[2] else ("page", 0.0)
        assert (r.source, r.page, r.method) == (want[0], want[1], method) and abs(r.score - score) < 2e-4
        sources.add(r.source)
    assert sources == {"model", "aligned", "none"}


def test_nulls_and_empty_tables(spark):
    cites = spark.createDataFrame([(1, 1, 1, None, None), (1, 2, None, "some words here", None), (2, 1, 1, "x", "y")], "doc_id long, cite_id long, page long, quote string, claim string")
    pages = spark.createDataFrame([(1, 1, "some words here and there"), (1, 2, None)], "doc_id long, page long, text string")
    got = {(r.doc_id, r.cite_id): (r.method, r.source) for r in locate.resolve(cites, pages).collect()}
    assert got == {(1, 1): ("page", "none"), (1, 2): ("exact", "model"), (2, 1): ("page", "none")}
    assert locate.resolve(cites.limit(0), pages).count() == 0


def test_every_row_comes_out_once(spark):
    """Null and repeated ids, documents without pages, and other columns of any name."""
    page = "Some words that a quote of this page has, and a few more of them."
    rows = [(1, None, 1, "words that a quote"), (1, None, 1, "a few more"), (1, 7, 1, "words that a quote"), (1, 7, 1, "nothing like it"), (None, 7, 1, "words that a quote"), (3, 1, 5, "words that a quote")]
    cites = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, cite_id long, page long, quote string, claim string, row string, hint_ string")
    found = locate.locate(cites, spark.createDataFrame([(1, 1, page)], "doc_id long, page long, text string"))
    assert sorted(((r.doc_id, r.cite_id, r.quote, r.stage, r.row) for r in found.collect()), key=repr) == sorted(
        [(i, c, q, "hint" if i == 1 and q != "nothing like it" else "page", "y") for i, c, _, q in rows], key=repr
    )
    assert locate.resolve(cites, spark.createDataFrame([], "doc_id long, page long, text string")).count() == len(rows)


def test_ligatures_far_off(spark):
    """A page that writes a quote with ligatures is found wherever it is."""
    quote = "efficient offices and final flights of fluffy fish"
    odd = quote.replace("ffi", "ﬃ").replace("ff", "ﬀ").replace("fi", "ﬁ").replace("fl", "ﬂ")
    rows = [(1, k, odd if k == 6 else f"page {k} with other words") for k in range(1, 8)]
    cites = spark.createDataFrame([(1, 1, 1, quote), (1, 2, 6, quote)], "doc_id long, cite_id long, page long, quote string")
    got = {r.cite_id: r for r in locate.locate(cites, spark.createDataFrame(rows, "doc_id long, page long, text string")).collect()}
    assert (got[1].stage, got[1].found_page, got[1].match.method, got[1].match.matched) == ("document", 6, "exact", odd) and got[2].stage == "hint"


def test_fuzzy_against_every_span(prose):
    """No run of whole words scores better than the one that is found by more than a little."""
    rng = random.Random(4)
    score = lambda q, s: (c := common(q, s)) / len(q) * (c / len(s)) ** 0.5
    for _ in range(6):
        words = prose(34)
        quote = words[9:23]
        quote[rng.randrange(14)] = "other"
        del quote[rng.randrange(13)]
        found = M.fuzzy(M.Page(" ".join(words)), " ".join(quote))
        q = M.squashed(" ".join(quote))
        best = max(score(q, "".join(words[a:b])) for a in range(34) for b in range(a + 1, 35) if abs(len("".join(words[a:b])) - len(q)) < len(q))
        assert found[1] >= best - 0.02
