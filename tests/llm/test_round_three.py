"""Clustering, sharding and fill-in-middle against plain Python, on the smallest tables and on awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriquill.llm import centroids, fill_middle, sharding
from veriquill.llm.spark_io import table

from .conftest import SCHEMA, rows_of

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(params=["small", "awkward", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


# centroids


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(x * 64) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(((sha(f"1:{i}"), q) for i, q in kept if i is not None))[:k]
    means = [q for _, q in seeds]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [(i, q, *min((gap(q, m), c) for c, m in enumerate(means))) for i, q in kept]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q, _, c in assign():
            groups[c].append(q)
        for c, qs in groups.items():
            means[c] = [sum(x) // len(qs) for x in zip(*qs, strict=True)]
    out = assign()
    per = collections.Counter()
    for _, _, d, c in out:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, means[c])))) for i, _, d, c in out), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    want = plain_clusters([(r.vec_id, r.embedding) for r in vectors.collect()], 16, 3)
    assert rows_of(centroids.cluster_vectors(vectors), *COLUMNS) == want


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_clusters_of_awkward_vectors(spark, n):
    """Ties, repeated rows and ids, rows without an id, clumps, unusable vectors, fewer vectors than centroids."""
    rng = random.Random(n)
    spread = lambda middle: [middle + rng.randint(-40, 40) / 64 for _ in range(64)]
    rows = [(i, spread(rng.choice([-9.0, 0.0, 9.0]))) for i in range(n)]
    rows += rows[:3] + [(None, e) for _, e in rows[:2]] + [(i, [0.5] * 64) for i in range(n, n + min(n, 90))]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63, [3e38] + [0.0] * 63]
    rows += [(9000 + k, e) for k, e in enumerate(bad)]
    vectors = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], "vec_id long, embedding array<float>, q string, cluster string").repartition(3)
    assert rows_of(centroids.cluster_vectors(vectors), *COLUMNS) == plain_clusters(rows[:-1], 16, 3)


def test_tree_prunes_and_assigns_as_all_pairs_do():
    """Far clumps are assigned as whole nodes; products beyond 2^53 and ties are exact."""
    rng = np.random.default_rng(5)
    clumps = rng.integers(-1000, 1000, (6, 8))
    for scale in (1, 1 << 16):
        points = (clumps[rng.integers(0, 6, 3000)] + rng.integers(-3, 4, (3000, 8))) * scale
        means = np.concatenate([clumps * scale, clumps[:1] * scale])
        order, boxes, _ = centroids.tree_of(points)
        placed = points[order]
        whole, places, clusters = centroids.descend(placed, boxes, means)
        owner = np.full(len(points), -1)
        owner[places] = clusters
        for (_, nodes, owners), bounds in zip(whole, centroids.node_bounds(len(points)), strict=True):
            for node, c in zip(nodes, owners, strict=True):
                owner[bounds[node] : bounds[node + 1]] = c
        assert owner.tolist() == ((placed[:, None] - means) ** 2).sum(2).argmin(1).tolist()
    points = rng.permutation(np.repeat(clumps[1:], 500, axis=0))
    order, boxes, _ = centroids.tree_of(points)
    whole, places, _ = centroids.descend(points[order], boxes, clumps)
    assert len(places) < len(points) / 4


# sharding


def descend(key, shards):
    node, levels = "", []
    for depth in range(3):
        kids = collections.Counter()
        for s in shards:
            names = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
            if names[depth] == node:
                kids[names[depth + 1]] += s.weight
        wait = lambda c, kids=kids: (-math.log((int(hashlib.md5(f"{key}@{c}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / kids[c], c)
        node = min(kids, key=wait)
        levels.append(node)
    return int(node.split("/")[-1])


def test_shards(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    key = lambda i, t: f"text {hashlib.md5(t.encode()).hexdigest()}" if i is None else f"id {i}"
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key", descend(key(i, t), sharding.layout(8)), descend(key(i, t), sharding.layout(9))) for i, t in rows]
    got = sharding.shard_documents(docs).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=repr) == sorted(want, key=repr)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_follow_ids_over_many_files(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("shard"), F.lit("f").alias("file"), F.lit("d").alias("doc"))
    path = sharding.write_shards(rows.repartition(7), sharding.layout(8))
    got = sharding.read_shards(spark, path, rows.schema)
    read = got.select("doc.*", F.col("shard").alias("in_shard"), "slot").collect()
    assert len(read) == 5000 and all(r.shard == 1 and r.file == "f" and r.doc == "d" and r.text == f"t{r.doc_id}" for r in read)
    by = collections.defaultdict(list)
    for r in read:
        by[r.in_shard].append((r.slot, r.doc_id))
    assert sorted(by) == list(range(8)) and min(map(len, by.values())) > 500
    assert all([i for _, i in sorted(s)] == sorted(i for _, i in s) and sorted(k for k, _ in s) == list(range(len(s))) for s in by.values())


def test_weights_move_rows_within_their_subtree(spark):
    """A heavier shard takes rows from others; none moves between two racks, or regions, whose weights stay."""
    before = sharding.layout(8)
    after = [s._replace(weight=3.0) if s.shard == 5 else s for s in before]
    keys = spark.range(20_000).select(F.concat(F.lit("id "), "id").alias("key"))
    moves = collections.Counter(map(tuple, keys.select(sharding.shard_of(F.col("key"), before).alias("a"), sharding.shard_of(F.col("key"), after).alias("b")).collect()))
    place = {s.shard: (s.region, s.rack) for s in before}
    for (a, b), n in moves.items():
        if a != b:
            # what moves goes into the region, the rack or the shard that grew
            assert place[b][0] == place[5][0] and (place[a][0] != place[b][0] or place[b] == place[5] and (place[a] != place[b] or b == 5)), (a, b, n)
    held = collections.Counter()
    for (_, b), n in moves.items():
        held[b] += n
    assert abs(held[5] / 20_000 - 0.3) < 0.02
    with pytest.raises(ValueError, match="no weight"):
        sharding.shard_of(F.lit("x"), [sharding.Shard("a", "b", 0, 0.0)])


# fill-in-middle


def plain_example(i, text):
    t = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = t[:a], t[a:b], t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(t), "plain", None, None, t, t
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(t), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t


def examples(docs):
    out = fill_middle.fill_in_middle(docs)
    return out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))


EXAMPLE = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again"]


def test_fill_in_middle(docs):
    want = sorted((plain_example(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert rows_of(examples(docs), *EXAMPLE) == want


def test_fill_in_middle_characters_and_sentinels(spark):
    rng = random.Random(8)
    alphabet = "ab<>PSM\n é€\U0001f600́<P<S<M"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 40, 511, 513, 1100]))) for _ in range(600)]
    texts += ["<P", "<P>", "<<S>", "<P<M>", "<PS>", "\U0001f600" * 700, "<" * 600, "é" * 256 + "<S" + ">"]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert rows_of(examples(df), *EXAMPLE) == sorted((plain_example(i, t) for i, t in enumerate(texts)), key=repr)


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units(spark, unit):
    """Cuts fall before words or lines only, and texts come back."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "é", " ", "  ", "\n", "\U0001f600"]) for _ in range(rng.randint(0, 400))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fill_middle.fill_in_middle(df, unit).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    blank = lambda c: c in " \n"
    seen = 0
    for r in out:
        t = texts[r.doc_id]
        begins = [k for k in range(len(t)) if not k or (t[k - 1] == "\n" if unit == "line" else blank(t[k - 1]) and not blank(t[k]))]
        assert (r.again, r.n) == (t, len(begins))
        if r.form != "plain":
            seen += 1
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {*begins, len(t)}
    assert seen > 40
