"""Page units, their scores and picks, quote windows and outlines against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veriquill.functions import terms as W, units as U
from veriquill.operators import evidence, outline, ranking, support
from veriquill.sources import tables as S

SF = "/root/testdata/sf0.001"


def told(text):
    return [(u.text, u.is_row, u.label) for u in U.units(text)]


def test_units_of_literal_pages():
    page = "Annual Report 12\n\nOur strategy\nWe serve nine million homes. Capital invest-\nment rose to £2,596m in 2025. It fell\nIn Part\nlater on.\n\n£m 2025/26 2024/25\nCapital expenditure (2,596) (2,288)\nOperating profit 1,234 n/m 7\nOutlook\nWe expect growth, e.g. No. 5 of it! And more.\n3 of 9 things fell (see page) 12"
    assert told(page) == [
        ("We serve nine million homes.", False, ""),
        ("Capital investment rose to £2,596m in 2025.", False, ""),
        ("It fell In Part later on.", False, ""),
        ("Capital expenditure: (2,596) (2025/26), (2,288) (2024/25)", True, "Capital expenditure"),
        ("Operating profit: 1,234 (2025/26), n/m (2024/25), 7", True, "Operating profit"),
        ("We expect growth, e.g.", False, ""),
        ("No. 5 of it!", False, ""),
    ]
    # a table's columns hold until the next header; running lines go at the edges only; lists without an end are no statements
    lines = "Middle line is here.\nBoth can do.\nEven for go.\npage 7 in the middle\nhighly it.\nJust know love.\nMany now open."
    assert [t for t, _, _ in told(lines)] == ["Middle line is here.", "Both can do.", "Even for go. page 7 in the middle highly it.", "Just know love.", "Many now open."]
    assert told("word " * 45) == [] and len(told("word " * 45 + "end.")) == 1 and told("") == [] and told("two words") == []
    assert told("a-\nb and c-\n\nThe end is near.\r\nIt is over now.") == [("a- b and c-", False, ""), ("The end is near.", False, ""), ("It is over now.", False, "")]
    assert [u.joined for u in U.units("We meas-\nure it twice.")] == [[1]] and U.states_amount("rose 12.5% to") and not U.states_amount("in 2024 by 7")
    assert [U.kind_of(x) for x in ("", "£m 2025/26 2024/25", "Sales 1 2", "Sales 1", "The Board", "The Board.", "the board", "Sales of 2024")] == ["blank", "header", "row", "prose", "heading", "prose", "prose", "prose"]


def plain_units(text):
    """The same rules as one pass over marked lines, written for this test."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    figure = lambda w: bool(re.fullmatch(r"[(£$€-]*\d[\d,.]*[%)]*|n/m|-", w, re.ASCII))
    ends = lambda w: bool(re.search("[.!?][)\\]”’\"']*$", w))
    full = [i for i, x in enumerate(lines) if x]
    running = lambda x: len(x.split()) <= 12 and not ends(x) and re.search(r"(?:^|\s)\d{1,3}$|^\d{1,3}\s|annual report|interim report|\bpage\s+\d+", x, re.I | re.ASCII)
    gone = {i for i in set(full[:3]) | set(full[-3:]) if running(lines[i])}
    out, gathered, columns = [], [], []

    def close():
        start = 0
        for i, (w, _) in enumerate(gathered):
            after = gathered[i + 1][0] if i + 1 < len(gathered) else None
            if after is None or (ends(w) and w.lower() not in ("no.", "nos.", "vs.", "etc.", "approx.", "inc.", "ltd.", "co.", "st.", "dr.", "mr.", "mrs.", "ms.") and len(w.rstrip(".!?")) > 1 and (after[0].isupper() or after[0] in "“‘(£$0123456789")):
                text = ""
                for v, cut in gathered[start : i + 1]:
                    v = re.sub("[\ufffe\u00ad\x02]", "", v)
                    text += v[:-1] + "\0" if cut else v + " "
                text = text.rstrip(" ").replace("\0", "")
                if len(text.split()) >= 3 and (i + 1 - start < 40 or ends(w)):
                    out.append(text)
                start = i + 1
        gathered.clear()

    for x in [x for i, x in enumerate(lines) if i not in gone] + [""]:
        ws = x.split()
        tail = 0
        while tail < len(ws) and figure(ws[-1 - tail]):
            tail += 1
        if not x:
            close()
        elif sum(bool(re.fullmatch(r"\d{4}/\d{2}", w)) for w in ws) >= 2 and len(ws) <= 8:
            close()
            columns[:] = [w for w in ws if re.fullmatch(r"\d{4}/\d{2}", w)]
        elif 2 <= tail < len(ws) <= 18 and len(ws) - tail <= 12:
            close()
            cells = [w + (f" ({columns[i]})" if i < len(columns) else "") for i, w in enumerate(ws[-tail:])]
            row = " ".join(ws[:-tail]) + ": " + ", ".join(cells)
            if len(row.split()) >= 3:
                out.append(row)
        elif len(ws) <= 7 and x[0].isupper() and not x.endswith((".", ",", ";", ":", "-", "?", "!", ")")) and not any(map(figure, ws)) and (not gathered or ends(gathered[-1][0])):
            close()
        else:
            gathered += [(w, i == len(ws) - 1 and x.endswith("-") and len(w) > 2 and w[-2].isalpha()) for i, w in enumerate(ws)]
    return out


def test_units_of_all_pages(spark):
    pages = S.report_pages(spark, SF)
    got = {}
    for r in support.page_units(pages).select("doc_id", "page", "unit", "told").collect():
        got.setdefault((r.doc_id, r.page), {})[r.unit] = r.told
    for p in pages.collect():
        have = got.get((p.doc_id, p.page), {})
        want = plain_units(p.text)
        assert [have[k] for k in sorted(have)] == want, (p.doc_id, p.page)
    assert support.page_units(pages.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, 1, None), (1, 2, "")], "doc_id long, page long, text string")
    assert support.page_units(nothing).count() == 0


@pytest.fixture(scope="module")
def asked(spark):
    """Units, questions, nodes, and terms of their texts."""
    few = "doc_id < 40"
    pages, questions = S.report_pages(spark, SF).where(few), S.report_questions(spark, SF).where(few)
    nodes = outline.ranked_nodes(outline.flatten(outline.newest(S.outlines(spark, SF).where(few), "doc_id")))
    units = support.page_units(pages)
    return units, questions, nodes


def known(spark, texts):
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string")
    return {r.t: (list(r.a), list(r.c)) for r in df.select("t", W.terms(F.col("t")).alias("a"), W.content_terms(F.col("t")).alias("c")).collect()}


def test_scores_and_picks(spark, asked):
    units, questions, nodes = asked
    ranked = ranking.rank_nodes(questions, nodes, ("doc_id",))
    relevance = outline.page_relevance(ranked, nodes, ("doc_id", "question_id"))
    scored = support.score_units(units, questions, nodes, relevance)
    got = {(r.doc_id, r.question_id, r.page, r.unit): (r.score, set(r.matched)) for r in scored.collect()}
    rel = {(r.doc_id, r.question_id, r.page): r.relevance for r in relevance.collect()}
    us, qs, ns = units.collect(), questions.collect(), nodes.collect()
    t = known(spark, [u.told for u in us] + [q.text for q in qs] + [x for n in ns for x in (n.title, n.keys, n.summary)] + [w for k, v in support.OTHER_WORDS.items() for w in (k, v)])
    other = {}
    for k, v in support.OTHER_WORDS.items():
        other[t[k][0][0]] = set(t[v][0])
    want, picks = {}, {}
    for q in qs:
        seq = t[q.text][1]
        words = list(dict.fromkeys(seq))
        if not words:
            continue
        mine = [n for n in ns if n.doc_id == q.doc_id]
        df = {w: max(1, sum(any(w in t[x][0] for x in (n.title, n.keys, n.summary)) for n in mine)) for w in words}
        weight = {w: math.log(1 + max(1, len(mine)) / (1 + df[w])) * (0.3 if w[0].isdigit() else 1) for w in words}
        total, strong = sum(weight.values()) or 1, {w for w in words if not w[0].isdigit()} or set(words)
        number = re.search(r"\b(how (?:much|many)|amount|total|number|value|figure|million|billion|percent|rate|cost|fees?|dividend|revenue|profit|debt|price|pence|cash|capital|equity)\b|[£$%]", q.text, re.I)
        ranked_units = []
        for u in us:
            if u.doc_id != q.doc_id:
                continue
            toks = set(t[u.told][0])
            matched = {w for w in words if w in toks or other.get(w, set()) & toks}
            label = {x for x in toks if not x[0].isdigit() and x not in W.NO_CONTENT} if u.is_row else set()
            named = bool(label) and label <= set(words)
            if len(matched & strong) < min(2, len(strong)) and not named:
                continue
            two = lambda s: set(zip(s, s[1:], strict=False))
            score = sum(weight[w] for w in matched) / total + 0.1 * len(two(seq) & two(t[u.told][1])) + (0.15 if named else 0)
            score *= (1.3 if u.amount else 0.45) if number else 1
            score *= 0.8 if len(u.words) > 70 else 0.9 if len(u.words) > 45 else 1
            score *= 0.7 + 0.5 * rel.get((q.doc_id, q.question_id, u.page), 0)
            want[q.doc_id, q.question_id, u.page, u.unit] = (round(score, 9), matched)
            ranked_units.append((-round(score, 9), u.page, u.unit, toks))
        ranked_units.sort(key=lambda x: x[:3])
        chosen = []
        for s, page, unit, toks in ranked_units:
            if -ranked_units[0][0] < 0.34 or -s < max(0.34, -0.6 * ranked_units[0][0]) or len(chosen) == 3:
                break
            if not any(len(toks & c[3]) / max(1, len(toks)) > 0.8 for c in chosen):
                chosen.append((s, page, unit, toks))
        picks |= {(q.doc_id, q.question_id, k + 1): c[1:3] for k, c in enumerate(chosen)}
    assert got.keys() == want.keys() and len(want) > 60
    for k, (score, matched) in want.items():
        assert abs(got[k][0] - score) < 1e-6 and got[k][1] == matched, k
    found = {(r.doc_id, r.question_id, r.pick): (r.page, r.unit) for r in support.pick_units(scored).collect()}
    assert found == picks and len(picks) > 20
    raws = {(r.answer_id, r.question_id): r.raw for r in support.compose(support.pick_units(scored), units).collect()}
    assert raws.keys() == {k[:2] for k in picks} and all(r.count("<cite") == sum(k[:2] == a for k in picks) for a, r in raws.items())
    empty = support.pick_units(scored.limit(0))
    assert empty.count() == 0


def window(words, joined, wanted, terms_of):
    bad = {i for i, w in enumerate(words) if any(c in w for c in "\ufffe\u00ad\"<>\\\x02")} | {j + d for j in joined for d in (0, 1)}
    n, width = len(words), min(25, len(words))
    hits = lambda a, b: len(wanted & {t for w in words[a:b] for t in terms_of[w]})
    whole = [(hits(s, s + width), -s) for s in range(n - width + 1) if not bad & set(range(s, s + width))]
    if whole:
        s = -max(whole)[1]
        return " ".join(words[s : s + width])
    cuts = [-1, *sorted(b for b in bad if b < n), n]
    runs = [(hits(a + 1, b), b - a - 1, -(a + 1)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a - 1 >= 4]
    if not runs:
        return None
    _, size, start = max(runs)
    return " ".join(words[-start : -start + min(size, 25)])


def test_quote_windows(spark):
    rng = random.Random(6)
    bag = ["sales", "costs", "fell", "rose", "1,234", "the", "grown", 'say"', "<x>", "so\u00ad", "meas-", "of", "profit's"]
    rows = []
    for k in range(250):
        words = [rng.choice(bag if rng.random() < 0.5 else bag[:7]) for _ in range(rng.choice([0, 1, 3, 8, 24, 25, 26, 60]))]
        joined = sorted(rng.sample(range(len(words)), min(len(words), rng.choice([0, 0, 1, 3]))))
        rows.append((k, words, joined, rng.sample(["sales", "cost", "fell", "rose", "1234", "grown", "profi"], 3)))
    df = spark.createDataFrame(rows, "k int, words array<string>, joined array<int>, wanted array<string>")
    got = {r.k: r.q for r in df.select("k", support.quote_window(F.col("words"), F.col("joined"), F.col("wanted")).alias("q")).collect()}
    terms_of = {w: a for w, (a, _) in known(spark, bag).items()}
    for k, words, joined, wanted in rows:
        assert got[k] == (window(words, joined, set(wanted), terms_of) if words else None), (words, joined, wanted)


def boundary_tree(spark):
    import json

    tree = [
        {"title": "Policy", "node_id": "4", "start_index": 9, "end_index": 21, "nodes": [{"title": "March", "node_id": "5", "start_index": 9, "end_index": 15}, {"title": "June", "node_id": "10", "start_index": 15, "end_index": 21}]},
        {"title": "Stability", "node_id": "14", "start_index": 21, "end_index": 31, "nodes": [{"title": "Stability (intro)", "node_id": "15", "start_index": 21, "end_index": 22}, {"title": "Watch", "node_id": "16", "start_index": 22, "end_index": 28}, {"title": "Rules", "node_id": "22", "start_index": 28, "end_index": 31}]},
    ]
    odd = ["x", None, {"title": "No range"}, {"title": "Backwards", "start_index": 9, "end_index": 3}, {"title": "  Spaced  ", "node_id": 7, "start_index": "3", "end_index": "5", "nodes": [{"title": None, "start_index": 4, "end_index": 4, "nodes": [[], {"title": "Deep", "node_id": "", "start_index": 4, "end_index": 9}]}, 5]}]
    return spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(odd)), (3, "[{"), (4, None), (5, "{}"), (6, "[]"), (None, json.dumps(tree[:1]))], "doc_id long, tree string")


def test_outlines(spark):
    nodes = outline.flatten(boundary_tree(spark))
    rows = {(r.doc_id, tuple(r.place)): r for r in nodes.collect()}
    assert sorted((k for k in rows if k[0] == 2), key=str) == [(2, (2,)), (2, (3,)), (2, (4, 0)), (2, (4, 0, 1)), (2, (4,))] and {k[0] for k in rows} == {1, 2, None}
    spaced = rows[2, (4,)]
    assert (spaced.path, spaced.node_id, spaced.lo, spaced.hi, spaced.exact, rows[2, (4, 0, 1)].path, rows[1, (1, 0)].path) == (["Spaced"], "7", 3, 5, False, ["Spaced", "Deep"], ["Stability"])
    assert {tuple(r.node_id) for r in outline.ranked_nodes(nodes.where("doc_id = 2")).collect()} == {(4, 0), (4, 0, 1)}
    pages = spark.createDataFrame([(1, p) for p in (0, 8, 9, 14, 15, 21, 22, 23, 28, 31, 32)] + [(2, 3), (2, 4), (2, 7), (9, 1)], "doc_id long, page long")
    named = evidence.deepest_section(pages, nodes, "place").join(nodes, ["doc_id", "place"]).collect()
    got = {(r.doc_id, r.page): (r.path, r.node_id) for r in named}
    want = {9: (["Policy", "March"], "5"), 14: (["Policy", "March"], "5"), 15: (["Policy", "June"], "10"), 21: (["Stability"], "15"), 22: (["Stability", "Watch"], "16"), 23: (["Stability", "Watch"], "16"), 28: (["Stability", "Rules"], "22"), 31: (["Stability", "Rules"], "22")}
    assert {p: v for (d, p), v in got.items() if d == 1} == want
    assert {p: v[0] for (d, p), v in got.items() if d == 2} == {3: ["Spaced"], 4: ["Spaced", "Deep"], 7: ["Spaced", "Deep"]}
    assert outline.flatten(boundary_tree(spark).limit(0)).count() == 0
    twins = spark.createDataFrame([(1, '[{"title": "A", "start_index": 1, "end_index": 3}, {"title": "B", "start_index": 1, "end_index": 3}, {"title": "C", "start_index": 2, "end_index": 4}]')], "doc_id long, tree string")
    pages = spark.createDataFrame([(1, 1), (1, 3), (None, 1), (1, None)], "doc_id long, page long")
    assert sorted((r.page, r.place) for r in evidence.deepest_section(pages, outline.flatten(twins), "place").collect()) == [(1, [0]), (3, [2])]


def test_sections_of_overlapping_ranges(spark, monkeypatch):
    """Random sections, nested or not, in runs of few pages, against all pairs."""
    monkeypatch.setattr(evidence, "SPAN", 7)
    rng = random.Random(3)
    nodes = []
    for d in range(6):
        for k in range(40):
            lo = rng.randint(1, 60)
            nodes.append((d, f"n{k:02d}", rng.randint(0, 4), lo, lo + rng.choice([-1, 0, 2, 9, 40])))
    pages = [(d, p) for d in range(6) for p in range(1, 70, rng.choice([1, 2]))]
    best = lambda d, p: min(((lo != p, -depth, hi - lo, -lo, n) for e, n, depth, lo, hi in nodes if e == d and lo <= p <= hi), default=None)
    want = {(d, p, best(d, p)[4]) for d, p in pages if best(d, p)}
    got = evidence.deepest_section(spark.createDataFrame(pages, "doc_id long, page long"), spark.createDataFrame(nodes, "doc_id long, node_id string, depth int, lo int, hi int"))
    assert {tuple(r) for r in got.collect()} == want


def test_titles(spark):
    rows = [("  My report ", "x.pdf", []), ("Cover", "C:\\a\\An_annual-report 2024.PDF", []), ("ab", None, ["  ", "Contents", "Review"]), (None, ".pdf", []), (None, None, [])]
    df = spark.createDataFrame(rows, "own string, name string, heads array<string>")
    assert [r[0] for r in df.select(outline.document_title(F.col("own"), F.col("name"), F.col("heads"))).collect()] == ["My report", "An annual report 2024", "Review", ".pdf", None]


def test_scores_deal_out_units_not_terms(spark):
    """Each unit is dealt out once as its stems, not as a row for each of its terms."""
    rows = spark.createDataFrame([(1, 1, "The board rose to fame today. It fell later on.")], "doc_id long, page long, text string")
    questions = spark.createDataFrame([(1, 0, "Which board rose?")], "doc_id long, question_id long, text string")
    nodes = spark.createDataFrame([(1, "a", "Board", "", "", 1, 1)], "doc_id long, node_id string, title string, keys string, summary string, lo long, hi long")
    relevance = spark.createDataFrame([(1, 0, 1, 1.0)], "doc_id long, question_id long, page long, relevance double")
    scored = support.score_units(support.page_units(rows), questions, nodes, relevance)
    assert [tuple(r) for r in scored.select("unit", F.array_sort("matched")).collect()] == [(0, ["board", "rose"])]
    assert "explode(" not in scored._jdf.queryExecution().optimizedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_the_same_in_tasks_of_python(spark):
    """stems() of a unit in Python are its terms() as a column, whatever signs a text has."""
    rng = random.Random(8)
    signs = ["a", "b", "s", "ed", "ings", "ations", "Sales", "turn", "'", "’", "'s", "’s", " ", "  ", "\t", "12", ",345", ",34", ".5", ".", "é", "İ", "K", "ẞ", "Σ", "£", "-", "­", "日本", "cares", "cared", "nation", "nations", "0"]
    texts = ["", "it's o's x's's don't", "fives fived cared carings"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", F.array_join(W.terms(F.col("t")), " ").alias("s")).collect():
        assert U.stems(texts[r.k]) == r.s, texts[r.k]


def asked_once(spark, text, question="Which board rose?", pages=1):
    rows = spark.createDataFrame([(1, p + 1, text) for p in range(pages)], "doc_id long, page long, text string")
    questions = spark.createDataFrame([(1, 0, question), (1, 1, "What fell later?")], "doc_id long, question_id long, text string")
    nodes = spark.createDataFrame([(1, "a", "Board", "", "", 1, 1)], "doc_id long, node_id string, title string, keys string, summary string, lo long, hi long")
    relevance = spark.createDataFrame([(1, 0, 1, 1.0)], "doc_id long, question_id long, page long, relevance double")
    return rows, questions, nodes, relevance


def test_units_of_a_question_are_dealt_out_once(spark):
    """Units are shuffled once, by document, and neither sorted for it nor shuffled again for relevance or the best score; pages add their own."""
    rows, questions, nodes, relevance = asked_once(spark, "The board rose to fame today. It fell later on.", pages=2)
    scored = support.score_units(support.page_units(rows), questions, nodes, relevance)
    got = {(r.question_id, r.page, r.unit): r.score for r in scored.collect()}
    assert got.keys() == {(0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 2, 1)}
    assert got[0, 1, 0] == pytest.approx(got[0, 2, 0] / 0.7 * 1.2) and got[1, 1, 1] == got[1, 2, 1]
    told = plan(scored).split("MapInArrow")[0]
    assert told.count("Exchange") == 1 and "SortMergeJoin" not in told


def test_picks_carry_their_texts(spark, monkeypatch):
    """Answers come from units that are read once; scores shuffled once more to be picked only where they can be."""
    rows, questions, nodes, relevance = asked_once(spark, "The board rose to fame today. It fell later on.")
    kept = []
    write = support.materialize
    monkeypatch.setattr(support, "materialize", lambda df, *a: kept.append(plan(df)) or write(df, *a))
    scored = support.score_units(support.page_units(rows), questions, nodes, relevance, texts=True)
    picked = support.pick_units(scored)
    assert sum("MapInArrow" in p for p in kept) == 1 and kept[1].split("MapInArrow")[0].count("Exchange") == 1
    raws = {r.question_id: r.raw for r in support.compose(picked).collect()}
    assert raws == {r.question_id: r.raw for r in support.compose(support.pick_units(support.score_units(support.page_units(rows), questions, nodes, relevance)), support.page_units(rows)).collect()}
    assert raws[0] == 'The board rose to fame today. <cite doc="d" page="1" quote="The board rose to fame today."/>'


def test_nodes_stay_one_row(spark, monkeypatch):
    """With an outline's columns a node is one row whatever it shares with questions; a question that comes twice ranks nodes as once."""
    kept = []
    write = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, *a: kept.append(write(df, *a)) or kept[-1])
    nodes = spark.createDataFrame([(1, k, "net sales of homes", "", f"part {k} of sales", k, k) for k in range(20, 40)], "doc_id long, node_id long, title string, keys string, summary string, lo long, hi long")
    questions = spark.createDataFrame([(1, 1, "net sales of part 27"), (2, 1, "sales")], "doc_id long, question_id long, text string")
    once = ranking.rank_nodes(questions, nodes, ("doc_id",)).collect()
    assert kept[1].count() == 20 and len(once) == 20 and next(r.node_id for r in once if r["rank"] == 1) == 27
    assert sorted(map(tuple, ranking.rank_nodes(questions.union(questions), nodes, ("doc_id",)).collect())) == sorted(map(tuple, once))
