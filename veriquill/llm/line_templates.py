"""Line dedup by a log-template tree of fixed depth, in DataFrame operations.

A line's tokens that hold a digit are variable and become <*>. The tree's leaves are the number of tokens and the first DEPTH of them. In a
leaf with several different lines, each later place has its commonest token; the lines that agree with it in SIMILAR percent of the later
places have one template, in which the other places are variable too. The lines left over part by their token at the place with the fewest
different ones (two at least), and each part with several lines grows a template of its own in the same way, until none has any: so a leaf
holds as many templates as it has families of lines. A line of no family is a template of its own.

A template that MIN_DOCS documents hold recurs, and so does a line of LONG_TOKENS tokens or more that LONG_DOCS documents hold word for
word: its lines go from all documents but the first (the smallest doc_id), so one copy stays. Lines without a token stay.

Lines and leaves are told apart by 128 and 64 bits of hash; lines of one leaf are compared token by token.

Defined results: null and empty texts have no line to lose. Each row comes out once; repeated rows count as one document and lose the same
lines. Rows without an id come after all others, by a hash of their text. Ties between tokens go to the greater one, between places to the first. No documents give
no rows. Other columns of docs stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spark_io import drop_table, materialize
from .words_sql import with_key

DEPTH, SIMILAR, MIN_DOCS = 3, 70, 5
LONG_TOKENS, LONG_DOCS = 50, 2
VARIABLE = "<*>"
#: Leaves that several documents share, parts of them, and recurring templates are broadcast up to this number (some 40 bytes each), joined by a shuffle beyond it.
BROADCAST_KEYS = 1_000_000


def masked_tokens(line: Column) -> Column:
    """The tokens of a line, those with a digit as VARIABLE."""
    line = F.when(line.rlike("[\\x09-\\x0D]"), F.translate(line, "\t\n\x0b\x0c\r", " " * 5)).otherwise(line)
    line = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(line)
    return F.array_remove(F.split(line, " "), "")


def _few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if their number allows it."""
    keys = materialize(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.select("doc_id", "th", "at", masked_tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))
    own = [F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b")]
    return rows.select("doc_id", "th", "at", *own, leaf.alias("leaf"), F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("masked"))


def shared_lines(docs: DataFrame) -> DataFrame:
    """The lines of all leaves that several documents hold, and whether theirs has different lines (mixed)."""
    lines = materialize(_lines(docs))
    holder = F.xxhash64("doc_id", "th")
    leaves = lines.groupBy("leaf").agg(F.min(holder).alias("lo"), F.max(holder).alias("hi"), (F.min("a") < F.max("a")).alias("mixed"))
    shared = materialize(lines.join(_few(leaves.where("lo < hi").select("leaf", "mixed")), "leaf"))
    drop_table(lines)
    return shared


def grow_templates(members: DataFrame) -> DataFrame:
    """a, b, node: the template of every line of a family. members: a, b, node (its leaf), later (its tokens after the first DEPTH)."""
    grown, left = None, materialize(_several(members))
    while not left.isEmpty():
        counts = left.select("node", F.posexplode("later").alias("place", "token")).groupBy("node", "place", "token").agg(F.count("*").alias("n"))
        places = counts.groupBy("node", "place").agg(F.max_by("token", F.struct("n", "token")).alias("common"), F.count("*").alias("kinds"))
        nodes = places.groupBy("node").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "common"))), lambda x: x.common).alias("template"),
            F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "place"))).alias("split"),
        )
        agree = F.aggregate(F.zip_with("later", "template", lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda n, x: n + x)
        token = F.get("later", F.col("split.place"))
        held = left.join(nodes, "node").select("a", "b", "node", (agree * 100 >= F.size("later") * SIMILAR).alias("fits"), F.xxhash64("node", "split.place", token).alias("part"), "later")
        held = materialize(held.select("a", "b", "node", "fits", "part", F.when(~F.col("fits"), F.col("later")).alias("later")))
        drop_table(left)
        found = held.where("fits").select("a", "b", "node")
        grown = found if grown is None else grown.unionByName(found)
        left = materialize(_several(held.where("not fits").select("a", "b", F.col("part").alias("node"), "later")))
    return grown if grown is not None else left.select("a", "b", "node")


def _several(members: DataFrame) -> DataFrame:
    """Members of nodes that have more than one."""
    several = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    return members.join(_few(several), "node", "left_semi")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, at: places of the lines that go, for docs as with_key() gives them; one line may come twice."""
    lines = shared_lines(docs)
    members = lines.where("mixed").dropDuplicates(["a", "b"])
    grown = grow_templates(members.select("a", "b", F.col("leaf").alias("node"), F.slice(F.split("masked", " "), DEPTH + 1, 1 << 30).alias("later")))
    rows = lines.select("doc_id", "th", "at", "a", "b", "n").join(grown, ["a", "b"], "left")
    # a family's key is its node, another line's its own; a long line of a family has both
    key = lambda k1, k2, least: F.struct(k1.alias("k1"), k2.alias("k2"), least.alias("least"))
    long, exact = F.col("n") >= LONG_TOKENS, key(F.col("a"), F.col("b"), F.when(F.col("n") >= LONG_TOKENS, LONG_DOCS).otherwise(MIN_DOCS))
    family = key(F.col("node"), F.lit(0).cast("long"), F.lit(MIN_DOCS))
    keys = F.when(F.col("node").isNull(), F.array(exact)).when(long, F.array(exact, family)).otherwise(F.array(family))
    rows = materialize(rows.select("doc_id", "th", "at", F.inline(keys)))
    drop_table(lines)
    holders = rows.groupBy("k1", "k2", "least", "doc_id", "th").agg(F.lit(1).alias("one")).groupBy("k1", "k2", "least").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    recurring = _few(holders.where("docs >= least").select("k1", "k2", "first"))
    keeps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_id").isNotNull() | (F.col("th") == F.col("first.th")))
    return rows.join(recurring, ["k1", "k2"]).where(~keeps).select("doc_id", "th", "at")


def _with_gone(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs with, for each row, the numbers of the lines that go (null for none), and that column."""
    gone = recurring_lines(with_key(docs)).groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["th"])
    return docs.join(gone, same, "left"), gone["gone"]


def _kept_text(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers are in gone."""
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i))
    return F.when(gone.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(kept(ls), "\n"))[0])


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_text of each row of docs (doc_id, text)."""
    out, gone = _with_gone(docs)
    text = docs["text"]
    return out.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text,
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        _kept_text(text, gone).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n_chars and any others) without recurring lines; a document whose every line with words goes does so too."""
    out, gone = _with_gone(docs)
    text = _kept_text(docs["text"], gone)
    new = {"text": text, "n_chars": F.when(gone.isNull(), docs["n_chars"]).otherwise(F.length(text))}
    return out.where(gone.isNull() | text.rlike("[^\\x20\\x09-\\x0D]")).select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
