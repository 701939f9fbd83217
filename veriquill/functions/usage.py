"""Token counts, model names, metrics and copied texts of answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: names of models that think before they answer.
THINKING = "^(?:o[0-9]+|gpt-(?:[5-9]|1[0-9]))(?:[._-]|$)"
NO_SCORE = "No usable score for this answer (the judge found nothing to score)"


def is_thinking(model: Column) -> Column:
    return F.lower(model).rlike(THINKING)


def bare_model(model: Column) -> Column:
    """A model's name without the provider that some put before it."""
    return F.regexp_replace(F.trim(model), "^openai/", "")


def rough_tokens(text: Column) -> Column:
    """About how many tokens a text has: one for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def usage_of(response: Column) -> Column:
    """input, cached, written, output and thought of a response's usage (JSON text), however it names them; 0 for what is missing."""
    usage = F.get_json_object(response, "$.usage")
    whole = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}").try_cast("bigint") for p in paths], F.lit(0)).cast("long")
    return F.struct(
        whole("input_tokens", "prompt_tokens").alias("input"),
        whole("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens").alias("cached"),
        whole("input_tokens_details.cache_write_tokens", "prompt_tokens_details.cache_write_tokens").alias("written"),
        whole("output_tokens", "completion_tokens").alias("output"),
        whole("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens").alias("thought"),
    )


def metric_outcome(value: Column, error: Column) -> Column:
    """(value, error) of which one is set: a value that is no number has the standard error, an error no value."""
    usable = F.when(error.isNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.struct(usable.alias("value"), F.when(usable.isNull(), F.coalesce(error, F.lit(NO_SCORE))).alias("error"))


def errors_of(outcomes: Column) -> Column:
    """metric -> error of those outcomes (array<struct<metric, value, error>>) that have one."""
    return F.map_from_entries(F.transform(F.filter(outcomes, lambda o: o.error.isNotNull()), lambda o: F.struct(o.metric, o.error)))


def with_references(text: Column, cites: Column) -> Column:
    """Text to be copied: markers of cites (array<struct<n, name, page>>) as [name p.page], others gone, each with the blanks before it."""
    known = F.aggregate(cites, text, lambda t, c: F.regexp_replace(t, F.concat(F.lit("[ \\t]*\\[\\[c"), c.n.cast("string"), F.lit("\\]\\]")), F.concat(F.lit(" ["), c["name"], F.lit(" p."), c.page.cast("string"), F.lit("]"))))
    return F.regexp_replace(known, "[ \\t]*\\[\\[c[0-9]+\\]\\]", "")


def table_text(markdown: Column) -> Column:
    """Rows of a table in marks as lines of cells with tabs between; the rule under its head goes."""
    rows = F.filter(F.transform(F.split(markdown, "\\R"), F.trim), lambda r: r.startswith("|") & ~r.rlike("^[|\\s:-]+$"))
    cells = lambda r: F.transform(F.split(F.regexp_replace(r, "^\\||\\|$", ""), "\\|"), lambda c: F.trim(F.regexp_replace(c, "\\s+", " ")))
    return F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), "\t")), "\n")
