"""Quality rules with risk-controlled thresholds, in DataFrame operations.

Each rule is a ratio of a text and rejects what exceeds its cutoff. Cutoffs are chosen for each stratum (language) and rule on a labelled
holdout: the good documents (quality 1) that pass the base rules. A cutoff is admitted if the exact binomial tail of its false rejections at
the rate ALPHA / (number of rules) is at most DELTA / (strata * rules), which is the one-sided Clopper-Pearson bound with a Bonferroni
correction over strata and rules. Within a rule, cutoffs are tested from the most lenient on and testing stops at the first that fails
(fixed sequence), so they need no further correction. Then, with probability 1 - DELTA, all strata lose at most ALPHA of their good documents.
A stratum or rule without enough labels has no cutoff and rejects nothing.

Defined results: null and blank texts have no words and fail the base. Null languages are a stratum. Documents without a label or id take
no part in the choice but are judged. Each row comes out once; a document that comes repeatedly counts once in the holdout, as does a
repeated label; documents with both labels do not count. No documents give no rows; without labels there are no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spark_io import materialize
from .words_sql import BLANKS, words

ALPHA, DELTA = 0.04, 0.1
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Rules and their cutoffs, in percent, from the most lenient on.
RULES = {"symbol": "100 * n_symbols / greatest(word_chars, 1)", "dup_line": "100 * n_dup_lines / greatest(n_lines, 1)", "repeat": "100 * n_repeat_words / greatest(n_words, 1)", "long_word": "word_chars / greatest(n_words, 1)"}
CUTOFFS = {"symbol": [40, 30, 20, 15, 10, 7, 5, 3], "dup_line": [90, 75, 60, 50, 40, 30, 20, 10], "repeat": [28, 25, 22, 19, 16, 13, 10, 7], "long_word": [40, 30, 25, 20, 16, 14, 12, 10]}
#: Steps of the continued fraction of the binomial tail; it converges in fewer than the square root of the larger parameter.
STEPS = 2000


def features(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), lang and the counts of each row of docs (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "lang", text.alias("text"), words(F.col("text"), BLANKS).alias("w"), lines.alias("lines"))
    return out.select(
        "doc_id",
        "th",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("w").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def repeat_words(name: str) -> Column:
    """Words in windows of REPEAT_WINDOW words that the text has more than once.

    Sorting (hash, place) brings equal windows together; the places of those with an equal neighbour, sorted, give the words they cover.
    Texts whose windows all differ, which most are, are done after counting distinct hashes.
    """
    k = REPEAT_WINDOW
    hashes = F.when(F.size(name) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(name) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(name, i, k)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, a, b: F.get(p, a).h.eqNullSafe(F.get(p, b).h)
        twice = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(F.filter(p, lambda x, j: ((j > 0) & same(p, j, j - 1)) | same(p, j, j + 1)), lambda x: x.i)))[0]
        gaps = F.transform(F.array(twice), lambda t: F.aggregate(F.transform(t, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(t, j + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda a, x: a + x))
        return gaps[0]

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))[0]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def log_gamma(x: Column) -> Column:
    """Stirling's series, after a shift by 8 that makes it exact to 1e-12."""
    y = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = F.lit(1.0) / (y * 12) - F.lit(1.0) / (F.pow(y, 3) * 360) + F.lit(1.0) / (F.pow(y, 5) * 1260) - F.lit(1.0) / (F.pow(y, 7) * 1680)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most k of n) at this rate; 1 where k is beyond the mean.

    It is the incomplete beta function of n - k and k + 1 at 1 - rate, from its continued fraction by the modified Lentz method, whose steps
    grow with the square root of n at most; the fraction is taken of whichever tail it converges for.
    """
    a, b, x = n - k, k + 1.0, F.lit(1 - rate)
    front = F.exp(log_gamma(n + 1.0) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(p: Column, q: Column, y: Column) -> Column:
        steps = F.least(F.lit(STEPS), F.ceil(F.sqrt(F.greatest(p, q)) * 4 + 40)).cast("int")
        begin = F.lit(1.0) / safe(1 - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), begin.alias("d"), begin.alias("h"))

        def step(acc: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d1, c1 = 1 / safe(1 + even * acc.d), safe(1 + even / acc.c)
            d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (acc.h * d1 * c1 * d2 * c2).alias("h"))

        return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc.h)

    tail = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def cutoffs(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """lang and a column for each rule: its strictest admitted cutoff, null if none."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    good = marks.where("lo = 1 and hi = 1").select("label_id")
    one = scored.where(~base_failed()).select("doc_id", "lang", *RULES).dropDuplicates(["doc_id"])
    held = one.join(good, one.doc_id == good.label_id).drop("label_id")
    rate = ALPHA / len(RULES)
    counts = held.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS[r]])
    level = DELTA / (max(1, held.select("lang").distinct().count()) * len(RULES))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for i, c in enumerate(CUTOFFS[r])])
    tests = counts.select("lang", "n", F.inline(tests))
    tests = tests.withColumn("ok", binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), rate) <= level)
    fails = tests.groupBy("lang", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.array_sort(F.collect_list(F.struct("step", "cutoff"))).alias("steps"))
    last = F.get(F.col("steps.cutoff"), F.coalesce("stop", F.size("steps")) - 1)
    return fails.groupBy(F.col("lang").alias("stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.when(F.coalesce("stop", F.lit(1)) > 0, last))).alias(f"max_{r}") for r in RULES])


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of judge(), and th and lang."""
    scored = materialize(features(docs))
    scored = scored.select("*", *[F.expr(e).cast("double").alias(r) for r, e in RULES.items()])
    chosen = cutoffs(scored, labels)
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    out = scored.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left").withColumn("base_failed", base_failed())
    return out.select("doc_id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of docs (doc_id, text, lang)."""
    return _judged(docs, labels).drop("th", "lang")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns kept. A row is its id, text and language: others of its id, or without one, stand for themselves."""
    bad = _judged(docs.select("doc_id", "text", "lang"), labels).where("not kept").select("doc_id", "th", "lang").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["th"]) & docs["lang"].eqNullSafe(bad["lang"])
    return docs.join(bad, same, "left_anti")
