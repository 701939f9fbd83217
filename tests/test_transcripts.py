"""Runs as they are shown: literal ones, and the same rows however a stream cuts them."""

import random
from datetime import timedelta

from veriquill.functions.transcripts import Shown, Transcript, label
from veriquill.sources import tables as S
from veriquill.streaming import transcripts

SF = "/root/testdata/sf0.001"


def play(events, most=None):
    run = Transcript(most)
    return [s for e in events for s in run.take(*e)]


def brief(rows):
    return [(r.kind, r.step or r.n, r.elapsed_ms, r.label or r.text or r.quote) for r in rows]


def test_a_source_with_results():
    rows = play([("start", 0), ("text", 100, "", "", None, "I will read."), ("call", 250, "a", "get_page_content", [3, 4]), ("result", 400, "a", "", [3]), ("text", 700, "", "", None, "Sales rose 5%."), ("text", 710, "", "", None, ' <cite page="3" quote="q"/> So.'), ("end", 800)], 9)
    assert brief(rows) == [
        ("step", 1, None, "Thinking"),
        ("step_done", 1, 100, "Thinking"),
        ("step", 2, None, "Read pages 3-4"),
        ("step_done", 2, 150, "Read page 3"),
        ("step", 3, None, "Thinking"),
        ("step_done", 3, 300, "Thinking"),
        ("token", None, None, "Sales rose 5%."),
        ("token", None, None, " "),
        ("citation", 1, None, "q"),
        ("token", None, None, "[[c1]]"),
        ("token", None, None, " So."),
    ]
    assert next(r.claim for r in rows if r.kind == "citation") == "Sales rose 5%."


def test_a_source_without_results():
    rows = play([("start", 0), ("added", 50, "i", "function_call"), ("called", 80, "a", "get_document", None, "i"), ("added", 120, "j", "function_call"), ("called", 130, "b", "x", None, "j"), ("added", 400, "k", "function_call"), ("called", 410, "c", "get_page_content", [], "k"), ("text", 600, "", "", None, "w" * 250), ("end", 700), ("text", 800, "", "", None, "late")])
    assert brief(rows) == [
        ("step", 1, None, "Thinking"),
        ("step_done", 1, 50, "Thinking"),
        ("step", 2, None, "Looked up the document"),
        ("step", 3, None, "Used x"),
        ("step_done", 2, 30, "Looked up the document"),
        ("step_done", 3, 10, "Used x"),
        ("step", 4, None, "Thinking"),
        ("step_done", 4, 270, "Thinking"),
        ("step", 5, None, "Read page content"),
        ("step_done", 5, 10, "Read page content"),
        ("step", 6, None, "Thinking"),
        ("step_done", 6, 190, "Thinking"),
        ("token", None, None, "w" * 250),
    ]
    assert label("get_page_content", [1, 2, 4], True) == "Could not read pages 1-2,4" and play([("odd", 1)]) == [] and play([("end", 1)]) == []


def test_short_text_waits_and_narration_goes():
    run = Transcript()
    assert run.take("text", 1, piece="a" * 199) == [] and run.take("text", 2, piece="b") == [Shown("token", text="a" * 199), Shown("token", text="b")]
    assert run.take("text", 3, piece="c") == [Shown("token", text="c")]
    run.take("call", 4, "k", "x")
    assert run.take("text", 5, piece="short") == [] and [s.text for s in run.take("end", 6)] == [None, "short"]


def test_batches_do_not_matter(spark, tmp_path):
    """Runs cut at random into batches, some events twice, give the rows of whole runs; a silent run ends by its timer."""
    rng, events = random.Random(9), S.run_events(spark, SF).where("answer_id < 60")
    rows, batches = {}, [[] for _ in range(4)]
    for r in events.collect():
        rows.setdefault(r.answer_id, []).append(r)
    for run in rows.values():
        cuts = sorted(rng.randrange(len(run) + 1) for _ in range(3))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(run)], strict=True)):
            batches[k] += run[max(0, a - rng.randrange(2)) : b]
    # later runs move the watermark past those without an end
    for k in (1, 2):
        last = events.first()
        batches.append([last.asDict() | {"answer_id": 10_000 + k, "seq": 0, "kind": "end", "at": last.at + 10**7 * k, "ts": last.ts + timedelta(seconds=10**4 * k)}])
    for batch in batches:
        spark.createDataFrame([r if isinstance(r, dict) else r.asDict() for r in batch], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set(*transcripts.STORE)
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = transcripts.shown_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(240)
    finally:
        spark.conf.unset(transcripts.STORE[0])
    key = lambda r: (r.answer_id, r.seq, r.place)
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[:3])
    whole = [tuple(r) for r in sorted(transcripts.shown(events).collect(), key=key)]
    cut_short = {i for i, run in rows.items() if run[-1].kind != "end"}
    assert [r for r in got if r[0] not in cut_short] == [r for r in whole if r[0] not in cut_short] and len(whole) > 500
    for i in cut_short:
        mine, have = [r for r in whole if r[0] == i], [r for r in got if r[0] == i]
        assert have[: len(mine)] == mine and all(r[1] == rows[i][-1].seq + 1 for r in have[len(mine) :])


def test_fold(spark):
    """Tokens of a run are its answer with markers, as a scan of the whole gives it."""
    from veriquill.functions import cites as C

    raws = {r.answer_id: (r.raw, r.most_pages) for r in S.answers(spark, SF).collect()}
    ended = {r.answer_id for r in S.run_events(spark, SF).where("kind = 'end'").select("answer_id").collect()}
    got = {r.answer_id: r for r in transcripts.folded(transcripts.shown(S.run_events(spark, SF))).collect()}
    assert got.keys() == raws.keys()
    for i, (raw, most) in raws.items():
        events = C.scan(raw, most)[0]
        if i in ended:
            assert (got[i].text, got[i].n_citations, got[i].open_steps) == (C.shown(events), sum(isinstance(e, C.Cite) for e in events), 0)
