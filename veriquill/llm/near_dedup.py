"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimation, exact Jaccard.

1. Each text becomes its set of distinct word shingles (63-bit hashes) and keeps the K smallest, its bottom-k sketch.
2. Texts with equal sets form one class; from here on one representative stands for each class.
3. Inverted lists of retained values: values that one class alone holds are left out, and a class needs RHO of its sketch in common
   with another, so classes with fewer shared values are done. The others get the wider sketch WIDE, and only its rarest
   len - need + 1 values index them. Passages that many texts share are hardly ever among them.
4. In rounds, the members of each list that still has several components meet a few pivots, not each other. Pivots are picked by hashes of
   the members' ids, new ones each round, so lists with like members have like pivots and pairs grow with the members.
5. After TURNS rounds, members of lists that still have several components meet across components: through the rarest values of their full
   sets that other components hold, with as many of them as the exact overlap of the two sizes asks for. Variants of one text have nearly all
   values in common; those with one pivot as reference meet through what they have more and less than it.
6. The union sketch estimates the similarity, the full sets confirm it; these hold a second, independent hash of each shingle, so a chance
   match in the lists is not one here. Members that links already join need no further test.
7. Components are found by alternating star contraction, in tables in the shared folder.

At a similarity of just PERCENT, step 3 overlooks a link with a chance of 1.5e-6 by the K values and 1.4e-8 by the WIDE ones (binomial tails);
at higher ones with less. Sets of up to PERCENT of K, and of WIDE, shingles are held exactly.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept. Repeated rows come out once each, with
equal results. A row is its id and text (row, a 64-bit hash of both): texts of one id, or without one, link each for itself. A class's key is
the smallest of its rows, so it does not need an id. A component's id is its smallest non-null id, null if it has none. Pivots of equal
hash are told apart by id. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .spark_io import drop_table, materialize, spare_name
from .word_hash import Words, mix, slices

SHINGLE = 5
PERCENT = 75
#: Sketch sizes, and the share of a sketch that a link must have in common: at a similarity of 0.75, SIGMAS deviations below the mean.
K, RHO = 32, 0.375
WIDE, WIDE_RHO, SIGMAS = 256, 0.59, 6
#: Rounds of pivots before members meet across components.
TURNS = 2
#: Ids of candidate classes are broadcast up to this number (8 bytes each), joined by a shuffle beyond it.
BROADCAST_IDS = 2_000_000


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words, but not none, is one shingle."""
    hashes, at = words.windows(size)
    counts = np.diff(words.offsets)
    bounds = np.searchsorted(at, words.offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    alone = dict(zip(short.tolist(), words.whole(short), strict=True))
    return [np.array([alone[i]], np.uint64) >> np.uint64(1) if i in alone else np.unique(hashes[bounds[i] : bounds[i + 1]] >> np.uint64(1)) for i in range(len(counts))]


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), fold_ascii=True)
            sets, others = shingle_sets(words), shingle_sets(words.second())
            a, b = (pa.array(np.array([mix(s).sum() if len(s) else 0 for s in x], np.uint64).view(np.int64)) for x in (sets, others))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), a, b, _list_array([s[:K] for s in sets])],
                ["doc_id", "row", "n_shingles", "sig_a", "sig_b", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), fold_ascii=True)
            sets = shingle_sets(words)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), n, _list_array([s[:WIDE] for s in sets]), _list_array(shingle_sets(words.second()))], ["id", "n", "sketch", "full"])


def estimate(a: Column, b: Column) -> Column:
    """Share of the union's bottom-k sketch that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, WIDE)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _fits(n: str, m: str) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b), for every id in a link. Large and small stars alternate until nothing changes."""
    edges, state = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        drop_table(edges)
        before, state, edges = state, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), after
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, comp) after links (a, b) between components; comp has the ids that are not components of their own."""
    joined = components(links)
    if comp is None:
        return joined
    moved = joined.select(F.col("id").alias("comp"), F.col("comp").alias("now"))
    old = comp.join(moved, "comp", "left").select("id", F.coalesce("now", "comp").alias("comp"))
    return materialize(old.unionByName(joined.join(comp.select("id"), "id", "left_anti")))


def row_of(docs: DataFrame) -> Column:
    """A hash of id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, group (key of the component, null for rows without words) and component_id of each row of docs."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", row_of(docs).alias("row"))
    base = docs.mapInArrow(_sketches, "doc_id long, row long, n_shingles long, sig_a long, sig_b long, sketch array<long>")
    base = materialize(base.withColumn("set_id", F.xxhash64("sig_a", "sig_b", "n_shingles")).drop("sig_a"))
    # two of the three 64-bit digests of the set suffice as its key
    key = ["set_id", "sig_b"]
    classes = base.where("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("id"), F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes)
    comp = near_classes(docs, classes.select("id", "n", "sketch"))
    known = classes.select(*key, "id", "low").join(comp, "id", "left") if comp is not None else classes.select(*key, "id", "low", F.lit(None).cast("long").alias("comp"))
    known = known.select(*key, "low", F.coalesce("comp", "id").alias("group"))
    lows = known.groupBy("group").agg(F.min("low").alias("component_id"))
    found = materialize(known.select(*key, "group").join(lows, "group"))
    some = base.where("n_shingles > 0").join(found, key).select("doc_id", "row", "n_shingles", "group", "component_id")
    none = base.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def near_classes(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(id, comp) of the classes (id, n, sketch) that links join; None if there are none. docs: row (an id), text."""
    sets = materialize(_full_sets(docs, _indexed(classes, K, RHO).select("id")))
    indexed = materialize(_indexed(sets.select("id", "n", "sketch"), WIDE, WIDE_RHO))
    lists = indexed.select(F.explode("prefix").alias("value"), "id", "n", "hub", F.col("id").alias("comp"))
    mixed, comp = materialize(_mixed(lists)), None
    refs = materialize(_references(mixed))
    for turn in range(TURNS):
        pairs = _pivots(mixed, turn)
        if not turn:
            known = refs.where("id <> ref").select(*_pair("id", "ref", "id", "ref"))
            pairs = pairs.unionByName(known).distinct()
        links = materialize(_confirmed(pairs, indexed, sets))
        if links.isEmpty():
            break
        comp, before = merged(comp, links), mixed
        mixed = materialize(_mixed(_with_comp(before, comp)))
        drop_table(before)
    ids = materialize(mixed.select("id", "comp").distinct().join(refs, "id"))
    links = materialize(_confirmed(_across(ids, sets), indexed, sets))
    comp = comp if links.isEmpty() else merged(comp, links)
    for used in (sets, indexed, mixed, refs, ids):
        drop_table(used)
    return comp


def _with_comp(lists: DataFrame, comp: DataFrame) -> DataFrame:
    return lists.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _rows(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _indexed(reps: DataFrame, k: int, rho: float) -> DataFrame:
    """Classes that hold enough shared values to have a partner, with the rarest of them (prefix) and how common theirs are (hub).

    Up to PERCENT of k shingles, a class and any partner of it have their full sets as sketches, so the exact share is needed.
    """
    values = reps.select("id", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    common = values.join(shared, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"), F.avg(F.log("df")).alias("hub"))
    need = F.ceil(F.size("sketch") * F.when(F.col("n") * 100 <= PERCENT * k, PERCENT / 100).otherwise(rho)).cast("int")
    room = F.size("common") - need + 1
    return common.join(reps, "id").where(room > 0).select("id", "n", "sketch", "hub", F.slice("common.value", F.lit(1), room).alias("prefix"))


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = materialize(ids.withColumnRenamed("id", "row"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "row", "left_semi").select("row", "text")
    return texts.mapInArrow(_sets, "id long, n long, sketch array<long>, full array<long>").dropDuplicates(["id"])


def pair_need(n: Column, m: Column) -> Column:
    """Values that the sketches of two sets of these sizes have in common if their similarity is PERCENT or more.

    Two whole sets: exact. Else what the larger one's sketch holds of the overlap is a draw of WIDE from it, less SIGMAS deviations.
    """
    j = PERCENT / (100 + PERCENT)
    share = (F.least(n, m) / F.greatest(n, m) + 1) * j
    drawn = share * WIDE - F.sqrt(share * (1 - share) * WIDE) * SIGMAS
    return F.when(F.greatest(n, m) <= WIDE, F.ceil((n + m) * F.lit(PERCENT) / (100 + PERCENT))).otherwise(F.floor(drawn))


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists that hold several components."""
    several = lists.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("value")
    return lists.join(several, "value", "left_semi")


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs of each list's pivots and its members of other components: three that hashes of the id pick, first also the one with the commonest values."""
    one = F.struct(F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    orders = [F.struct(F.xxhash64(F.lit(3 * turn + k), "id"), "id") for k in range(3)]
    orders = orders if turn else [F.struct(-F.col("hub"), "id"), *orders[1:]]
    pivot = lists.groupBy("value").agg(F.array_distinct(F.array(*[F.min_by(one, o) for o in orders])).alias("p"))
    pairs = lists.join(pivot.select("value", F.inline("p")), "value").where(F.col("comp") != F.col("ca")).where(_fits("n", "na"))
    return pairs.select(*_pair("id", "a", "comp", "ca")).distinct()


def _pair(a: str, b: str, ca: str, cb: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.least(ca, cb).alias("ca"), F.greatest(ca, cb).alias("cb")]


def _references(lists: DataFrame) -> DataFrame:
    """id, ref: for each member of the lists the one with the commonest values that a list of it picks as pivot, or that one's own reference,
    or itself. Sizes of an id and its reference fit."""
    rank = lambda hub, i: F.struct((-F.col(hub)).alias("h"), F.col(i).alias("ref"))
    pivot = lists.groupBy("value").agg(F.min(F.struct((-F.col("hub")).alias("h"), F.col("id").alias("ref"), "n")).alias("p")).select("value", F.col("p.h").alias("h"), F.col("p.ref").alias("ref"), F.col("p.n").alias("m"))
    met = lists.join(pivot, "value").where(_fits("n", "m")).select("id", F.struct("h", "ref").alias("r"))
    one = met.unionByName(lists.select("id", rank("hub", "id").alias("r"))).groupBy("id").agg(F.min("r").alias("r")).select("id", "r.ref")
    one = materialize(one.join(lists.select("id", "n").distinct(), "id"))
    two = one.join(one.select(F.col("id").alias("ref"), F.col("ref").alias("next")), "ref").join(one.select(F.col("id").alias("next"), F.col("n").alias("m")), "next")
    return two.select("id", F.when(_fits("n", "m"), F.col("next")).otherwise(F.col("ref")).alias("ref"))


def _prefix_pairs(values: DataFrame, probe: Column, index: Column, need: Column, where: Column) -> DataFrame:
    """a, b, ca, cb: ids of different components that may have `need` values in common.

    values: id, comp, ref, n, d (values of the id in all) and v, one row for each value. Only values that other components hold too count,
    the rarest first. Two sets that share `need` values share one among the first out - need + 1 of each; probe and index are the least needs
    of an id as the larger and as the smaller of a pair. What is left from that value on has to be enough in both.
    """
    outside = values.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("v", "df")
    held = values.join(outside, "v").groupBy("id", "comp", "ref", "n", "d").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("common"))
    first = (F.size("common") - F.greatest(F.ceil(probe), F.lit(1)) + 1).cast("int")
    rows = held.where(first > 0).select("id", "comp", "ref", "n", "d", F.size("common").alias("out"), F.posexplode(F.slice("common.v", F.lit(1), first)).alias("at", "v"))
    rows = rows.select("v", "id", "comp", "ref", "n", "d", (F.col("out") - F.col("at")).alias("left"), index.alias("index"))
    a, b = (rows.select("v", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns[1:]]) for s in "ab")
    a = a.where("left_a >= index_a")
    apart = (F.col("comp_a") != F.col("comp_b")) & ((F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("id_a") < F.col("id_b"))))
    return a.join(b, "v").where(apart & where & (F.least("left_a", "left_b") >= need) & _fits("n_a", "n_b")).select(*_pair("id_a", "id_b", "comp_a", "comp_b")).distinct()


def _across(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ids (id, comp, ref) of different components whose full sets may be near.

    Ids of one reference, such as variants of one text, are compared by what they have more and less than it (delta): sets x and y differ by
    as much as their deltas do, and a link allows (n_x + n_y) / 7. An id has been held against its reference before, so two ids near it are
    linked through it; all other links share a part of their deltas, which is rare where the sets have nearly all in common. Ids of different references are compared by
    their sets, of which a link needs (n_x + n_y) * 3 / 7.
    """
    full = sets.join(ids, "id").select("id", "comp", "ref", F.size("full").alias("n"), "full")
    whole = full.select("id", "comp", "ref", "n", F.col("n").alias("d"), F.explode("full").alias("v"))
    j = PERCENT / (100 + PERCENT)
    need = (F.col("n_a") + F.col("n_b")) * j
    others = _prefix_pairs(whole, F.col("n") * (PERCENT / 100) - 1e-6, F.col("n") * 2 * j - 1e-6, need - 1e-6, F.col("ref_a") != F.col("ref_b"))
    pivot = sets.join(ids.select(F.col("ref").alias("id")).distinct(), "id").select(F.col("id").alias("ref"), F.col("full").alias("base"))
    mark = lambda sign, values: F.transform(values, lambda v: F.xxhash64("ref", F.lit(sign), v))
    delta = full.join(pivot, "ref").select("id", "comp", "ref", "n", F.concat(mark(1, F.array_except("full", "base")), mark(-1, F.array_except("base", "full"))).alias("delta"))
    delta = delta.select("id", "comp", "ref", "n", F.size("delta").alias("d"), F.explode("delta").alias("v"))
    # a link leaves room for a difference of n * (1 + 100 / PERCENT) * (1 - 2 * j) at most
    room = F.col("n") * ((1 + 100 / PERCENT) * (1 - 2 * j)) + 1e-6
    most = (F.col("n_a") + F.col("n_b")) * (1 - 2 * j)
    alike = _prefix_pairs(delta, F.col("d") - room, F.col("d") - room / 2, (F.col("d_a") + F.col("d_b") - most) / 2 - 1e-6, F.lit(True))
    return others.unionByName(alike).distinct()


def _confirmed(pairs: DataFrame, indexed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components that pairs (a, b, ca, cb) link, as the union sketch allows and the full sets confirm."""
    a, b = (indexed.select(*[F.col(c).alias(f"{c}{s}") for c in ("id", "n", "sketch")]) for s in "ab")
    likely = pairs.join(a.withColumnRenamed("ida", "a"), "a").join(b.withColumnRenamed("idb", "b"), "b")
    likely = likely.where(F.size(F.array_intersect("sketcha", "sketchb")) >= pair_need(F.col("na"), F.col("nb")))
    likely = likely.where(estimate(F.col("sketcha"), F.col("sketchb")) >= WIDE_RHO).select("a", "b", "ca", "cb")
    full = likely.join(sets.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b").join(sets.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
    both = F.size(F.array_intersect("fa", "fb"))
    return full.where(both * 100 >= PERCENT * (F.size("fa") + F.size("fb") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, all columns kept; of repeated rows of one id, all.

    A component without any id keeps the row that its key names, once: rows without an id that have its text cannot be told from copies.
    """
    found = materialize(_rows(docs))
    first = F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(F.col("group").isNull() | (F.col("row") == F.col("group")))
    gone = materialize(found.where(~first).select("row").distinct())
    left = docs.join(gone, row_of(docs) == gone["row"], "left_anti")
    copies = left["doc_id"].isNull() & F.coalesce(left["text"].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    key = spare_name(docs)
    one = left.where(copies).withColumn(key, row_of(left)).dropDuplicates([key]).drop(key)
    return left.where(~copies).unionByName(one)
