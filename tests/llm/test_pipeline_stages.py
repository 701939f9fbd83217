"""Every stage of the pipeline leaves the rows and texts that plain Python leaves; the tagger finds a number planted in a long text."""

import collections

from veriquill.llm import pii
from veriquill.llm.queries import vocabulary
from veriquill.llm.spark_io import table

from .test_brute_force import ALNUM, BLANK, LOW, _components, gone_lines, sha

SF = "/root/testdata/sf0.001"


def good(rows, bench):
    def passes(t):
        w, at = BLANK.findall(t or ""), collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    return [r for r in rows if passes(r[1])]


def without_lines(rows, bench):
    gone = gone_lines(rows)
    out = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]), bool(gone[i, t])) for i, t in rows]
    return [(i, t) for i, t, cut in out if not cut or BLANK.search(t)]


def firsts(rows, bench):
    found = _components(rows)
    assert all(c is not None for n, c in found.values() if n)
    return [r for r in rows if r[0] == found[r][1]]


def uncontaminated(rows, bench):
    windows = set()
    for t in bench:
        w = ALNUM.findall((t or "").translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return [r for r in rows if not held(ALNUM.findall((r[1] or "").translate(LOW)))]


def test_stages(spark, awkward, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder = str(tmp_path)
    table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).union(awkward.selectExpr("doc_id + 1000 as doc_id", *corpus_pipeline.COLUMNS[1:])).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, folder, "documents")
    plain = [good, without_lines, firsts, uncontaminated]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder).cache()
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(after, key=repr) == sorted(expected(before, bench), key=repr), name
        assert 0 < len(after) <= len(before)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = [(i, len(ids), sha(" ".join(map(str, ids)))) for i, x in after for ids in [t.encode(x, add_special_tokens=False).ids]]
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tagger_finds_a_number_in_a_long_text():
    long = "word " * 300 + "call (743) 555-3824 now " + "word " * 300
    assert [(k, long[a:b]) for k, a, b in next(pii.all_spans(pii.trained(), [long]))[1]] == [("phone", "(743) 555-3824")]
