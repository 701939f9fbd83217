"""Cite tags in odd forms, claims, answers as streams of pieces, and printed page numbers."""

import random

from pyspark.sql import functions as F

from veriquill.functions import cites as C
from veriquill.operators import answers, folios
from veriquill.sources import tables as S
from veriquill.streaming import cites as stream_of

SF = "/root/testdata/sf0.001"


def cites_of(raw, most=None):
    return [(e.page, e.quote) for e in C.scan(raw, most)[0] if isinstance(e, C.Cite)]


def test_tags():
    assert cites_of('a <cite doc="d" page="12-13" quote="it\'s "so" here"/> b') == [(12, 'it\'s "so" here')]
    assert cites_of("<CITE quote=“a  b” page='p. 7'>t</cite> <cite page=3/>") == [(7, "a b"), (3, None)]
    assert cites_of('<cite page=1 quote="a &quot;b&quot; &amp;c"/>') == [(1, 'a "b" &c')]
    assert cites_of('<cite quote="x"/> <cite page=0/> <cite page="x"/> <citepage=1/> <cite page="1" ') == []
    assert cites_of('<cite page=1 / > <cite hidden page=2 / quote=a>', 1) == [(1, None)]
    assert cites_of("<cite page=1 <cite page=2/>") == [(2, None)]
    assert cites_of('<cite page=1 quote="' + "a" * 2000 + '"/>') == []
    assert C.shown(C.scan("x <cite page=9/> y</cite> z <cite page=1/>.", 3)[0]) == "x y z [[c1]]."


def test_pieces_do_not_matter():
    rng = random.Random(1)
    bits = ["<cite ", "page=", '"12"', " ", "quote=\"a 'b' \"c\" d\"", "/>", ">", "<", "</cite>", "text", "\n", "<cite page=4/>", "“q”", 'page="x"', "doc=d", "é", "<ci", "/"]
    for _ in range(3000):
        raw = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        want, dropped = C.scan(raw, 10)
        stream, got, at = C.CiteStream(10), [], 0
        while at < len(raw):
            upto = at + rng.randint(1, 5)
            got += stream.feed(raw[at:upto])
            stream, at = C.CiteStream(10, *stream.state()), upto
        got += stream.feed("", final=True)
        assert C.shown(got) == C.shown(want) and stream.dropped == dropped
        assert [e for e in got if isinstance(e, C.Cite)] == [e for e in want if isinstance(e, C.Cite)]


def test_stream_of_pieces(spark, tmp_path):
    """Answers cut at random, over several batches, give the text and cites of whole answers."""
    rng, raws = random.Random(5), {r.answer_id: r.raw for r in S.answers(spark, SF).collect()}
    batches = [[] for _ in range(3)]
    for i, raw in raws.items():
        cuts = sorted(rng.sample(range(1, len(raw)), min(len(raw) - 1, 6)))
        pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        for seq, piece in enumerate(pieces):
            batches[3 * seq // len(pieces)].append((i, seq, piece, seq == len(pieces) - 1))
    schema = "answer_id long, seq long, piece string, last boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_of.scan_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
    events = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.answer_id, r.seq, r.place)):
        events.setdefault(r.answer_id, []).append(r.text if r.n is None else (r.n, r.page, r.quote))
    for i, raw in raws.items():
        want = C.scan(raw)[0]
        assert "".join(e if isinstance(e, str) else f"[[c{e[0]}]]" for e in events[i]) == C.shown(want)
        assert [e for e in events[i] if not isinstance(e, str)] == [(e.n, e.page, e.quote) for e in want if isinstance(e, C.Cite)]


def test_claims():
    claim = lambda raw: C.claim_for(raw, raw.rindex("<cite"))
    assert claim("Intro.\n- Sales **rose** by 5 %. [More](x) <cite page=3/>") == "Sales rose by 5 %. More"
    assert claim("One. Two, e.g. in No. 5 by J. Smith, `three` <cite page=3/>") == "Two, e.g. in No. 5 by J. Smith, three"
    assert claim("| a | **b** <cite page=1/> | c |\n") == "a b c" and claim("text\n\n| --- |\n<cite page=1/>") == "text" and claim("<cite page=1/>") == ""
    assert claim("# Head line <cite page=2/> First. Second [[c1]] part<cite page=1/>") == "Second part"
    assert claim("word " * 300 + "<cite page=1/>") == ("word " * 100).strip()


def test_with_cites(spark):
    rows = [(1, "A <cite page=1 quote='q'/> b <cite page=5/>", 2), (2, None, None), (3, "plain", 1)]
    got = {r.answer_id: r.answer for r in answers.with_cites(spark.createDataFrame(rows, "answer_id long, raw string, most_pages int")).collect()}
    assert (got[1].text, got[1].dropped, [(c.n, c.page, c.quote, c.claim) for c in got[1].cites]) == ("A [[c1]] b", 1, [(1, 1, "q", "A")])
    assert (got[2].text, got[2].cites, got[3].text) == ("", [], "plain")


def test_malformed_answers(spark):
    """No text stops a scan, over tables or as a stream; a page that no long holds is dropped and counted; markers of the model go."""
    texts = [None, "", "   ", "<", "<cite", "<cite doc=", '<cite doc="a" page="3" quote="not closed', "<<<<>>>>", "[[c1]]", "\x00\x01\x02", "<cite " * 200, '<cite page="3"/>' * 50, "é" * 10_000 + '<cite page="3"/>', "</cite>" * 30]
    texts += ["a <cite page=99999999999999999999999/> b <cite page=9223372036854775807/>", "x [[c1]] y <cite page=1/>", "Text [[c7]] more <cite page=2/>"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "answer_id long, raw string, most_pages int")
    got = {r.answer_id: r.answer for r in answers.with_cites(df).collect()}
    assert len(got) == len(texts) and [c.n for c in got[11].cites] == list(range(1, 51))
    assert (got[14].text, got[14].dropped, [c.page for c in got[14].cites]) == ("a b [[c1]]", 1, [2**63 - 1])
    assert (got[8].text, got[15].text, got[16].text) == ("", "x y [[c1]]", "Text more [[c1]]")


#: What cites support, by literal answers.
CLAIMS = [
    ("Sales were £5 million. Costs fell 2%.<cite page=1/>", "Costs fell 2%."),
    ("Sales were £5 million <cite page=1/>.", "Sales were £5 million"),
    ("Sales were £5.99 billion in 2024. Gains were £1.2 billion.<cite page=1/>", "Gains were £1.2 billion."),
    ("Spend on e.g. Masts rose. No. 5 plan met Mr. Ray’s aims.<cite page=1/>", "No. 5 plan met Mr. Ray’s aims."),
    ("- **Sales** rose 5% to £1.2 billion. It was a record.<cite page=1/>\n- Next", "Sales rose 5% to £1.2 billion. It was a record."),
    ("1. Payments were 31.36p<cite page=1/>", "Payments were 31.36p"),
    ("* Debt `fell` to [the note](http://x.y/z) value<cite page=1/>", "Debt fell to the note value"),
    ("## Head\nSales grew 5%.<cite page=1/>", "Sales grew 5%."),
    ("First one. The figure was £5m.\n<cite page=1/>", "The figure was £5m."),
    ("First.\n\n\n<cite page=1/>", "First."),
    ("> Said **in bold** words<cite page=1/>", "Said in bold words"),
    ("#tag stays<cite page=1/>", "#tag stays"),
    ("a *slanted **and bold** word* [with `code`](u)<cite page=1/>", "a slanted and bold word with code"),
    ("Asked? (Yes.) “No.” Then it ended<cite page=1/>", "Then it ended"),
    ("| Own | 7 |\n<cite page=1/>", "Own 7"),
    ("- " + "word " * 80 + "end. Next one<cite page=1/>", "Next one"),
]


def test_literal_claims():
    for raw, want in CLAIMS:
        assert C.claim_for(raw, raw.rindex("<cite")) == want, raw
    assert C.claim_for("", 0) == "" and C.claim_for("abc.", 50) == "abc."


#: Answers with pages up to 9, and what is shown of them.
SHOWN = [
    ("<cite page='3'/>starts", "[[c1]]starts"),
    ('<CITE doc="R" page="3"/> and <Cite page="4" /> mixed', "[[c1]] and [[c2]] mixed"),
    ('word <cite page="99"/> next', "word next"),
    ('word<cite page="99"/> next', "word next"),
    ('word <cite page="99"/>next', "word next"),
    ('end.\n <cite page="99"/> \nnext', "end.\n \nnext"),
    ("keeps  two", "keeps  two"),
    ('a <cite page="9"/> b <cite doc="R"/> c</cite> d', "a [[c1]] b c d"),
    ('see <cite doc="R" page="3" quote="oops', 'see <cite doc="R" page="3" quote="oops'),
    ("prose with a < b > c.", "prose with a < b > c."),
    ("| 1 | 2 <cite page='4' doc='R'/> |", "| 1 | 2 [[c1]] |"),
]


def test_literal_answers_cut_anywhere():
    for raw, want in SHOWN:
        for cut in range(len(raw) + 1):
            stream = C.CiteStream(9)
            early = C.shown(stream.feed(raw[:cut]))
            assert want.startswith(early) and early + C.shown(stream.feed(raw[cut:]) + stream.feed("", final=True)) == want, (raw, cut)


def test_answer_counts(spark):
    """Counts of answers follow from their cites and the sources these resolve to."""
    pages = S.pages(spark, SF)
    made = S.answers(spark, SF).where("answer_id < 24")
    got = answers.build(made, pages, pages.where("page <> 1")).collect()
    assert len(got) == made.count()
    for r in got:
        raw = made.where(F.col("answer_id") == r.doc_id).first()
        events, dropped = C.scan(raw.raw, raw.most_pages)
        cites = [e for e in events if isinstance(e, C.Cite)]
        assert (r.n_cites, r.n_dropped, r.n_unread) == (len(cites), dropped, sum(c.page == 1 for c in cites))
        assert r.n_cites == r.n_verified + r.n_aligned + r.n_page_only


def labels_of(found, n, full):
    """Printed labels of pages 1 to n from their candidates {page: [(kind, value, upper)]}."""
    left, runs = dict(found), []
    for _ in range(4):
        votes = {}
        for page, cands in left.items():
            for kind, value in {(k, v) for k, v, _ in cands}:
                votes.setdefault((kind, value - page), []).append(page)
        best = min(votes, key=lambda s: (-len(votes[s]), min(votes[s]), s), default=None)
        if best is None or len(votes[best]) < max(3 if runs else 2, -(-full * 3 // 100)):
            break
        upper = sum(u for p in votes[best] for k, v, u in left[p] if (k, v - p) == best)
        runs.append((best, votes[best], 2 * upper > len(votes[best])))
        left = {p: c for p, c in left.items() if p not in votes[best]}
    out, owned = {}, {p for _, pages, _ in runs for p in pages}
    for (kind, shift), pages, upper in runs:
        for p in range(min(pages), max(pages) + 1):
            if p not in out and (p in pages or p not in owned):
                roman = folios.ROMANS[p + shift - 1] if 0 < p + shift <= 39 else None
                out[p] = (str(p + shift) if p + shift > 0 else None) if kind == "arabic" else roman and (roman.upper() if upper else roman)
    return {p: label for p, label in out.items() if label}


def test_folios(spark):
    books = {
        1: ["Cover | i", "contents | ii", "iii", "photo", "Intro 1", "2", "", "text 4", "5 •", "– 6 –", "Back 0123 12345"],
        2: ["I", "II |", "III", "12", "13", "nothing", "15", "16 (x)", "2024", "4", "4"],
        3: ["no numbers", "1"],
        4: [None, "", "7"],
    }
    rows = [(d, k + 1, t) for d, ts in books.items() for k, t in enumerate(ts)]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    got = {}
    for r in folios.folio_labels(pages).collect():
        got.setdefault(r.doc_id, {})[r.page] = r.label
    cands = {(r.doc_id, r.page): [(c.kind, c.value, c.upper) for c in r.c] for r in pages.where("text is not null").select("doc_id", "page", folios.candidates(F.col("text")).alias("c")).collect()}
    for d, ts in books.items():
        found = {k + 1: cands[d, k + 1] for k, t in enumerate(ts) if t and t.strip() and cands[d, k + 1]}
        assert got.get(d, {}) == labels_of(found, len(ts), sum(bool(t and t.strip()) for t in ts)), d
    assert got[1] == {1: "i", 2: "ii", 3: "iii", 5: "1", 6: "2", 7: "3", 8: "4", 9: "5", 10: "6"} and got[2][1] == "I" and got[2][6] == "14"
    native = pages.select("doc_id", "page", F.when(F.col("doc_id") == 3, F.concat(F.lit("A-"), "page")).when(F.col("doc_id") == 2, F.col("page").cast("string")).otherwise("").alias("label"))
    own = {}
    for r in folios.printed_labels(pages, native).collect():
        own.setdefault(r.doc_id, {})[r.page] = r.label
    assert own == {**got, 3: {1: "A-1", 2: "A-2"}}
    assert folios.folio_labels(pages.limit(0)).count() == 0
