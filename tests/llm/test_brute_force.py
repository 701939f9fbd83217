"""Every operator against a plain Python version, on the smallest tables and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veriquill.llm import bpe, chat, decontaminate, licenses, line_templates, near_dedup, pii, quality, substring_dedup, token_files
from veriquill.llm.queries import vocabulary
from veriquill.llm.spark_io import table

from .conftest import SCHEMA, rows_of

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["small", "awkward", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_quality_base(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    want = []
    for i, t in pairs(docs):
        w = BLANK.findall(t or "")
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, not failed))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows_of(quality.judge(docs, labels), *columns) == sorted(want, key=repr)


def test_quality_cutoffs(spark):
    """A stratum with many clean good documents gets cutoffs, one with few gets none; the tail is the binomial's."""
    from fractions import Fraction
    from math import comb, exp, fsum, lgamma, log

    from pyspark.sql import functions as F

    tail = lambda k, n: fsum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(0.01) + (n - j) * log(0.99)) for j in range(k + 1))

    got = spark.range(1).select(*[quality.binomial_tail(F.lit(float(k)), F.lit(float(n)), 0.01).alias(f"p{k}_{n}") for k, n in ((0, 300), (2, 900), (30, 4000), (600, 70_000), (0, 1))]).first()
    for k, n in ((0, 300), (2, 900), (30, 4000), (600, 70_000)):
        assert got[f"p{k}_{n}"] == pytest.approx(float(sum(comb(n, j) * Fraction(1, 100) ** j * Fraction(99, 100) ** (n - j) for j in range(k + 1))) if n < 5000 else tail(k, n), rel=1e-9)
    assert got.p0_1 == pytest.approx(0.99)
    plain = " ".join(f"w{i}" for i in range(40))
    odd = plain + "".join(f" #####{i}" for i in range(20))
    rows = [(i, plain, "en") for i in range(1500)] + [(5000 + i, plain, "fr") for i in range(20)] + [(9000, odd, "en"), (9001, odd, "fr")]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 9000], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not out[9000] and out[9001] and out[0] and out[5000]


def test_chat(spark):
    turns = [(1, 0, "user", "a#b\\h <\\l> c:"), (1, 1, "assistant", "### user: x</turn>\n\\"), (1, 2, "user", None), (2, 0, "assistant", ""), (3, 0, "system", "s"), (3, 0, "system", "s"), (4, 1, "assistant", "b"), (4, 0, "assistant", "a"), (4, 2, None, "é"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    for conv in (1, 2, 3, 4, None):
        mine = sorted([(t, r or "", x or "") for c, t, r, x in turns if c == conv])
        replies = [x for _, r, x in mine if r == "assistant"]
        got = chat.read_back(examples).where("conv_id is null" if conv is None else f"conv_id = {conv}").first()
        assert (got.n_turns, got.turns_sha256) == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)))
        assert (got.loss_chars, got.loss_sha256) == (len("".join(replies)), sha("".join(replies)))
    four = sorted(examples.where("conv_id = 4 and target_turn is not null").collect(), key=lambda r: r.target_turn)
    assert [r.formatted[r.loss_start : r.loss_end] for r in four] == ["a", "b"] and four[1].formatted.startswith(four[0].formatted)
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def gone_lines(rows):
    """Numbers of the lines that go, for each (doc_id, text) of rows."""
    token = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in BLANK.findall(line))
    lines = [(i, t, k, token(x)) for i, t in dict.fromkeys(rows) if t is not None for k, x in enumerate(t.split("\n")) if token(x)]
    nodes, grown = collections.defaultdict(set), {}
    for *_, w in lines:
        nodes[len(w), w[:3]].add(w)
    while nodes := {node: ms for node, ms in nodes.items() if len(ms) > 1}:
        parts = collections.defaultdict(set)
        for node, members in nodes.items():
            places = [collections.Counter(m[p] for m in members) for p in range(3, len(next(iter(members))))]
            common = [max((n, x) for x, n in c.items())[1] for c in places]
            split = min((len(c), p) for p, c in enumerate(places) if len(c) > 1)[1]
            for m in members:
                if 100 * sum(a == b for a, b in zip(m[3:], common)) >= 70 * len(common):
                    grown[m] = node
                else:
                    parts[node, split, m[3 + split]].add(m)
        nodes = parts
    keys = lambda w: ([("family", grown[w], 5)] if w in grown else []) + ([("own", w, 2 if len(w) >= 50 else 5)] if w not in grown or len(w) >= 50 else [])
    holders, gone = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, _, w in lines:
        for key in keys(w):
            holders[key].add((i, t))
    for i, t, k, w in lines:
        for key in keys(w):
            if len(holders[key]) >= key[2] and i != min((x for x, _ in holders[key] if x is not None), default=None):
                gone[i, t].add(k)
    return gone


def test_line_templates(docs):
    gone = gone_lines(pairs(docs))
    want = [(i, len((t or "").split("\n")) if t is not None else 0, len(gone[i, t]), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in pairs(docs)]
    assert rows_of(line_templates.without_recurring_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)


def test_line_families(spark):
    """Two families of one leaf, short lines that recur, and a long line in two documents; lines of few documents and of no family stay."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    long, twice = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(30))
    texts = [f"Posted by the {word()} team under News today\n{word()} {word()} {word()} {word()}\nRead more" for _ in range(6)]
    texts += [f"Posted by the staff {word()} of our Berlin desk" for _ in range(9)]
    texts += [f"{long}\n{twice}\na", f"b {word()}\n{long}\n{twice}"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.kept_text for r in line_templates.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = gone_lines(rows)
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in rows}
    assert got[0] == texts[0] and all(got[k] == texts[k].split("\n")[1] for k in range(1, 6)) and got[6] == texts[6] and not any(got[k] for k in range(7, 15))
    assert got[15] == texts[15] and got[16] == f"{texts[16].split(chr(10))[0]}\n{twice}"


def test_license_base(docs):
    want = []
    for i, t in pairs(docs):
        w = ALNUM.findall((t or "").translate(LOW))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert rows_of(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)


def test_license_diagonals(spark):
    mit = licenses.TEMPLATES["mit"].split()
    texts = {"whole": " ".join(mit), "gaps": " ".join([*mit[:9], "new", "words", *mit[9:20], *mit[22:]]), "half": " ".join(mit[:12]), "other": "nothing of the kind " * 9}
    df = spark.createDataFrame([(k, f"x y z {t} end") for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and 0.6 <= got[1][1] < 1 and got[2] == ("", 0.0) and got[3] == ("", 0.0)


def test_whole_licenses_and_given_templates(spark):
    """Every template scores as itself and as no other license; a table of long texts serves as well, joined by a shuffle too."""
    texts = list(licenses.TEMPLATES.items())
    df = spark.createDataFrame([(k, f"some words before. {t.capitalize()}, and after") for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    for k, (name, _) in enumerate(texts):
        label = name.split(":")[0]
        assert got[k] == (label, 1.0) or (name == "gpl" and got[k][0] == "gpl") or (name == "apache" and got[k][0] == "apache")
    rng = random.Random(4)
    long = {f"own:{k}": " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta")) + str(rng.randrange(40)) for _ in range(3000)) for k in range(3)}
    body = long["own:1"].split()
    mine = spark.createDataFrame([(1, " ".join(body[:2100])), (2, " ".join(body[:1500])), (3, "a b"), (4, None)], "doc_id long, text string")
    table_of = licenses.template_table(spark, {**long, "short": "a b"})
    for few in (licenses.BROADCAST_GRAMS, 0):
        licenses.BROADCAST_GRAMS, kept = few, licenses.BROADCAST_GRAMS
        try:
            out = {r.doc_id: (r.labels, round(r.score, 3)) for r in licenses.scan(mine, table_of).collect()}
        finally:
            licenses.BROADCAST_GRAMS = kept
        assert out == {1: ("own", 0.7), 2: ("", 0.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_lines_of_rows_without_an_id(spark):
    """Of rows without an id that share a line one keeps it; any row with an id comes before them."""
    line = "a line that many rows have in common"
    rows = [(None, f"{line}\nown words {k} here") for k in range(7)]
    for more in ([], [(3, line)]):
        out = line_templates.without_recurring_lines(spark.createDataFrame([*rows, *more], "doc_id long, text string")).collect()
        kept = [r.doc_id for r in out if line in (r.kept_text or "")]
        assert kept == ([3] if more else [None])


def test_word_memory(monkeypatch):
    """Two generations of words and pieces give the ids that one memory of all gives."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 12)
    path = vocabulary("word_bpe_49k.json")
    mine, library, rng = bpe.WordBpe(path), Tokenizer.from_file(path), random.Random(2)
    bag = "some words of all kinds, é “odd” ones; 12,345 x.y I'm Über 日本".split() + [f"w{k}" for k in range(30)]
    for _ in range(120):
        texts = [" ".join(rng.choice(bag) for _ in range(rng.randrange(9))) for _ in range(3)]
        assert [ids for ids, _, _ in mine.encode(texts)] == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, start = [], 0
    for i, x in sorted(pairs(docs), key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    folder, manifest = token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"))
    got = rows_of(token_files.read_token_files(folder, manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    known = lambda rows: sorted((r for r in rows if r[0] is not None), key=repr)
    assert known(got) == known(want) and sorted(r[2:] for r in got) == sorted(r[2:] for r in want)


def test_encoder_pieces(monkeypatch):
    """Pieces, generations of them and whole texts give the library's ids, blanks, contractions and odd characters included."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    path = vocabulary("byte_bpe_50k.json")
    encode, t, rng = token_files.Encoder(path), Tokenizer.from_file(path), np.random.default_rng(8)
    bits = ["it's", "don't,", "O'er", "a.b", "...", " ", "  ", "\n", "\t", "é", "ß!", "12,345.6", "(x)", "'re", "\xa0", "日本", "word", "Über", "“q”", "–", "e\u0301", "\r\n", "<|endoftext|>", "#", "_"]
    for k in range(3000):
        text = rng.choice(["", " ", " ", "\n"]).join(rng.choice(bits[: rng.integers(3, len(bits) + 1)], rng.integers(1, 12)).tolist())
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_frames_damage_and_random_access():
    out = token_files.FrameFile()
    for i in range(5):
        out.add(i * 10 if i else None, np.arange(i, dtype="<u4").tobytes())
    data = out.bytes()
    reads = []
    reader = token_files.FrameReader(len(data), lambda at, n: reads.append(n) or data[at : at + n])
    assert reader.doc_ids.tolist() == [token_files.NULL_ID, 10, 20, 30, 40]
    assert reader.frame(3) == np.arange(3, dtype="<u4").tobytes() and reads[-1] == int(reader.table[3, 0])
    first = int(reader.starts[4])
    broken = bytearray(data)
    broken[first + int(reader.table[4, 0]) - 1] ^= 1
    with pytest.raises(Exception):
        token_files.reader_of(bytes(broken)).frame(4)
    assert token_files.reader_of(token_files.FrameFile().bytes()).doc_ids.tolist() == []


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, x in pairs(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert rows_of(bpe.encode_documents(docs, vocabulary("word_bpe_49k.json")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_pairs():
    """The vectorised pair test agrees with merging the pair."""
    b = bpe.word_bpe(vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    ids = np.array([i for t, i in b.vocab.items() if not t.endswith(b.end)])
    x, y = rng.choice(ids, 4000), rng.choice(ids, 4000)
    want = [b._merged([*b._symbols(b.text[p]), *b._symbols(b.text[q])]) == [p, q] for p, q in zip(x.tolist(), y.tolist())]
    assert b.compatible(x, y).tolist() == want and 0 < sum(want) < 4000


def test_personal_data_rules(docs):
    def base(t):
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
        number = lambda m: re.sub("[^0-9]", "", m.group())
        out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := number(m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0]
        return [(k, m.start(), m.end()) for k, m in out + [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(number(m)) <= 15]]

    want = []
    for i, t in pairs(docs):
        found = base(t or "")
        want.append((i, *[sum(k == x for k, *_ in found) for x in ("email", "ip", "card", "phone")], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    assert rows_of(pii.find_personal_data(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_personal_data_tagger():
    """Held-out accuracy, gradients, and windows that give the same spans wherever a text is cut."""
    tagger = pii.trained()
    held = pii.labelled_windows(300, 1234)
    got = pii.tagger_spans(tagger, [t for t, _ in held])
    hits = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, held))
    assert hits / sum(map(len, got)) > 0.75 and hits / sum(len(b) for _, b in held) > 0.75
    fresh = pii.Tagger(4, 3)
    fresh.w = {k: v.astype(np.float64) for k, v in fresh.w.items()}
    chars, mask = pii._batch([pii.codes("ab 12"), pii.codes("x@y")], 6)
    tags, _ = pii._batch([pii._tags(5, [("ip", 3, 5)]), pii._tags(3, [("email", 0, 3)])], 6)
    _, grad = fresh.gradient(chars, mask, tags)
    for k, v in fresh.w.items():
        at = tuple(np.unravel_index(np.argmax(np.abs(grad[k])), v.shape))
        v[at] += 1e-4
        up = fresh.gradient(chars, mask, tags)[0]
        v[at] -= 2e-4
        down = fresh.gradient(chars, mask, tags)[0]
        v[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(grad[k][at], rel=0.02), k
    long = "word " * 300 + "call (743) 555-3824 now " + "word " * 300
    assert [(k, long[a:b]) for k, a, b in next(pii.all_spans(tagger, [long]))[1]] == [("phone", "(743) 555-3824")]


#: Texts written by hand, and the spans that they hold beside those of the rules.
BY_HAND = [
    ("write to bob [at] site [dot] net today", ("email", "bob [at] site [dot] net")),
    ("mail sam at mill dot com soon", ("email", "sam at mill dot com")),
    ("write to anna(at)bora(dot)org today", ("email", "anna(at)bora(dot)org")),
    ("mail kim @ post.example now", ("email", "kim @ post.example")),
    ("call tel: 212-555-0187 now", ("phone", "212-555-0187")),
    ("ring 555 867 5309 please", ("phone", "555 867 5309")),
    ("ring (212) 555-0187 please", ("phone", "(212) 555-0187")),
    ("dial 212.555.0187 x", ("phone", "212.555.0187")),
    ("0049 301 2345678 is it", ("phone", "0049 301 2345678")),
    ("card 4111/1111/1111/1111 ok", ("card", "4111/1111/1111/1111")),
    ("card 4111.1111.1111.1111 ok", ("card", "4111.1111.1111.1111")),
    ("the host 10[.]1[.]2[.]3 fell", ("ip", "10[.]1[.]2[.]3")),
]
CLEAN = ["In 2023 sales rose by 12.5 % to 1,234 million.", "Version 1.2.3 of 2024-05-06 at 10:45 is out", "We met at home at noon, and at six we left.", "Order #4711 of 12 items for $19.99 (see page 7)", "no figures here at all", "id 123456789 and @handle"]


def test_spans_written_by_hand():
    """Whole spans of forms that no rule knows; clean texts hold none. A tagger of this size misses some forms."""
    tagger = pii.trained()
    found = [[(k, t[a:b]) for k, a, b in pii.tagger_spans(tagger, [t])[0] and next(pii.all_spans(tagger, [t]))[1]] for t, _ in BY_HAND]
    assert sum(want in got for got, (_, want) in zip(found, BY_HAND)) >= 6
    assert not any(next(pii.all_spans(tagger, [t]))[1] for t in CLEAN)


def test_reader_finds_the_best_paths(small):
    """Stretches that may not be outside, decoded by themselves, give the paths of whole windows, for any weights."""
    texts = [r.text for r in small.where("text is not null").limit(60).collect()]
    rough = pii.Tagger(6, 5, seed=3)
    for tagger, size in ((pii.trained(), 300), (rough, 90), (rough, 7)):
        windows = [pii.codes(t)[:size] for t in texts if t]
        chars, mask = pii._batch(windows, size)
        want = tagger.decode(chars, mask) * (mask > 0)
        got = np.zeros_like(want)
        for k, place, tags in pii.Reader(tagger).decode(windows):
            got[place : place + len(tags), k] = tags
        assert (got == want).all() and want.any()


def test_weights_are_kept(small, monkeypatch):
    monkeypatch.setattr(pii, "EXAMPLES", 60)
    monkeypatch.setattr(pii, "EPOCHS", 1)
    pii.trained.cache_clear()
    first = pii.tagger_for(small)
    monkeypatch.setattr(pii, "train", None)
    again = pii.tagger_for(small)
    pii.trained.cache_clear()
    assert all((again.w[k] == v).all() for k, v in first.w.items()) and len(pii.prose_of(small)) > 50 and pii.prose_of(small.limit(0)) == ()


def _components(rows):
    sets = {}
    for i, t in rows:
        w = BLANK.findall((t or "").translate(LOW))
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    keys = list(sets)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for x, a in enumerate(keys):
        for b in keys[:x]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                up[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in keys:
        groups[find(k)].append(k[0])
    return {k: (len(sets[k]), min((i for i in groups[find(k)] if i is not None), default=None)) for k in keys}


def test_near_duplicates(docs):
    rows = pairs(docs)
    found = _components(rows)
    want = [(i, *found[i, t], i == found[i, t][1]) for i, t in rows]
    assert rows_of(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_near_duplicate_family(spark):
    """A family of many variants of one text, among texts that share a long passage."""
    import random

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, shared = [word() for _ in range(150)], [word() for _ in range(90)]
    rows = [(i, " ".join(word() if rng.random() < rng.choice([0.01, 0.03, 0.06]) else w for w in base)) for i in range(120)]
    rows += [(200 + i, " ".join([*[word() for _ in range(60)], *shared])) for i in range(60)]
    found = _components(rows)
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    assert got == sorted(((i, found[i, t][1]) for i, t in rows), key=repr)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, docs, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    extra = [(1000, "one two three"), (1001, None), (1002, "  "), (1003, "X"), (1003, "X"), (1004, "the same eight words stand here again and again the same eight words"), (1005, "ab")]
    bench = table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    windows = collections.defaultdict(set)
    for i, t in bench.collect():
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(x) for x in windows}
    want = []
    for i, t in pairs(docs):
        w = ALNUM.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= {*range(k, k + n)}
                    items |= windows[x]
        want.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    assert rows_of(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def _kept(rows):
    first = {}
    words = {(i, t): BLANK.findall(t or "") for i, t in rows}
    far = lambda i: (i is None, i or 0)
    for (i, _), w in words.items():
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(first.get(x, far(i)), far(i))
    out = {}
    for (i, t), w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < far(i) for j in range(k, k + 13)}
        out[i, t] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup(docs):
    rows = pairs(docs)
    found = _kept(rows)
    want = [(i, *found[i, t]) for i, t in rows]
    assert rows_of(substring_dedup.remove_repeats(docs)[0], "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_substring_dedup_in_batches(small):
    """Three batches against a growing, compacted index give what one batch gives."""
    found = _kept(pairs(small))
    history, got = None, []
    for k, part in enumerate(("doc_id < 60", "doc_id between 60 and 120", "doc_id > 120")):
        out, index = substring_dedup.remove_repeats(small.where(part), history, buckets=8, n_runs=3, first=10 * k)
        got += rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256")
        runs, kept = (index.runs, index.docs) if history is None else (index.runs.unionByName(history.runs), index.docs.unionByName(history.docs))
        history = substring_dedup.Index(substring_dedup.compact(runs), kept)
    assert len(got) == small.count() and {r[0]: r[1:] for r in got} == {i: v for (i, _), v in found.items()}


def colliding_words():
    """Two words of 1,024 letters that every polynomial hash modulo 2^64 takes for one."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = colliding_words()
    head = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"x {head} {b}"), (4, a), (5, b)], "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(docs)[0], "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 13), (4, 0), (5, 0)]
    assert rows_of(near_dedup.near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_equal_fingerprints_of_other_words_remove_nothing(monkeypatch):
    """With fingerprints of 3 bits nearly all windows share theirs; the words decide, inside a run and against spans of others."""
    real = substring_dedup.Words.windows
    monkeypatch.setattr(substring_dedup.Words, "windows", lambda self, n: (real(self, n)[0] & np.uint64(7), real(self, n)[1]))
    one, two = [" ".join(f"{x}{k}" for k in range(20)) for x in "ab"]
    texts = [one, two, f"z {one}\n{two}", f"{two} y"]
    import pyarrow as pa

    run = substring_dedup._Run(pa.table({"doc_id": pa.array([1, 2, 3, 4]), "text": texts}))
    assert np.flatnonzero(~run.covered(pa.array([], pa.binary()))).tolist() == [*range(40), 40, 101]
    late = substring_dedup._Run(pa.table({"doc_id": pa.array([9]), "text": [f"q {one}"]}))
    assert not late.covered(pa.array([two.encode()], pa.binary())).any()


def test_windows_are_compared_word_by_word():
    import pyarrow as pa

    words = [f"w{k}" for k in range(40)]
    other = [*words[:20], "w2O", *words[21:]]
    one, two = (substring_dedup.Words(pa.array([" ".join(w), "\n ".join(w)]), fold_ascii=False) for w in (words, other))
    at = one.windows(13)[1]
    assert substring_dedup.same_windows(one, at, two, at).tolist() == [not any(k % 40 <= 20 < k % 40 + 13 for _ in "x") for k in at.tolist()]
    assert substring_dedup.same_windows(one, at[:28], one, at[:28] + 40).all() and not substring_dedup.same_windows(one, at[:27], one, at[:27] + 1).any()


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    table(spark, "/root/testdata/sf0.001", "documents").select(*corpus_pipeline.COLUMNS).union(awkward.selectExpr("doc_id + 1000 as doc_id", *corpus_pipeline.COLUMNS[1:])).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).write.parquet(f"{folder}/{name}.parquet")
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert after.columns == corpus_pipeline.COLUMNS, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        left = {r.doc_id for r in after.select("doc_id").collect()}
        assert left <= ids
        if name == "near duplicates":
            found = _components(pairs(docs))
            assert left == {i for (i, _), (_, c) in found.items() if i == c}
        docs = after
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
