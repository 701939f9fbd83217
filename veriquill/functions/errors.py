"""What kind of failure an error is, by its statuses, names and words, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of errors about models, codes of accounts without credit, and words for models that are not there.
MODEL_ERRORS = ("notfounderror", "permissiondeniederror")
BILLING = ("insufficient_quota", "credit_balance_exhausted", "billing_hard_limit_reached", "organization_spend_limit_exceeded", "project_spend_limit_exceeded", "organization_usage_limit_exceeded")
NOT_THERE = ("does not exist", "not found", "no access", "do not have access", "not supported", "unsupported", "unknown model")
KEY_CODES, MODEL_CODES = ("invalid_api_key", "incorrect_api_key", "invalid_organization"), ("model_not_found", "unsupported_model")


def has(text: Column, *words: str) -> Column:
    """Whether a text has one of these words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The kind of the first rule that holds."""
    return F.coalesce(*[F.when(holds, F.lit(kind)) for kind, holds in rules], F.lit(otherwise))


def index_fault(statuses: Column, names: Column, message: Column, no_file: Column, own_provider: Column) -> Column:
    """Why a document could not be indexed: statuses (array<int>) and names of errors (array<string>, any capitals) of all errors in a chain, and their words.

    own_provider: a visitor's own key or another provider is in use, of which more words tell what is wrong; the rules of the stock provider
    hold for what these do not.
    """
    text, low = F.lower(F.coalesce(message, F.lit(""))), F.transform(names, F.lower)
    name = F.array_join(F.array_sort(low), " ")
    status = lambda *codes: F.arrays_overlap(statuses, F.array(*map(F.lit, codes)))
    down = F.exists(statuses, lambda s: s >= 500) | has(name, "connection", "timeout", "internalserver", "unavailable") | has(text, "connection error")
    limited = status(429) | has(name, "ratelimit") | has(text, "rate limit", "rate_limit")
    no_model = status(403, 404) | F.arrays_overlap(low, F.array(*map(F.lit, MODEL_ERRORS))) | has(text, "model_not_found")
    no_key = status(401) | has(name, "authentication") | has(text, "invalid_api_key", "incorrect api key", "no api key")
    named = has(text, "model")
    return first_rule(
        [
            ("scanned", has(text, "no text layer", "all pages are blank", "image-only")),
            ("no_outline", has(text, "no layout structure", "could not extract a structure")),
            ("encrypted", has(text, "password") & has(text, "pdf", "encrypt")),
            ("storage", no_file),
            ("quota", status(429) & (has(text, "insufficient_quota", "exceeded your current quota") | (own_provider & has(text, "quota", "credit", "billing", "balance")))),
            ("rate_limit", limited),
            ("auth", no_key | (has(text, "api_key client option") & ~own_provider)),
            ("model", no_model | (named & (has(text, "does not exist", "do not have access") | (own_provider & has(text, "not found"))))),
            ("upstream", down),
        ],
        "other",
    )


def answer_error(status: Column, code: Column, message: Column, own_provider: Column) -> Column:
    """The class of an error that ended an answer: openai_auth, openai_rate_limit, openai_model or agent_failed."""
    text, code = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(code, F.lit("")))
    is_ = lambda *codes: F.coalesce(status.isin(*codes), F.lit(False))
    no_tools = F.when(own_provider, is_(400) & has(text, "tool") & has(text, "support", "not allowed", "unsupported"))
    no_tools = F.coalesce(no_tools, has(text, "function tools with reasoning_effort") | (is_(400) & has(text, "tools") & has(text, "reasoning")))
    wrong_url = ~own_provider & is_(404) & has(text, "unknown request url", "invalid url")
    return first_rule(
        [
            ("openai_auth", is_(401, 403) | code.isin(*KEY_CODES)),
            ("openai_rate_limit", is_(429) | code.isin("rate_limit_exceeded", *BILLING)),
            ("openai_model", no_tools),
            ("agent_failed", wrong_url),
            ("openai_model", is_(404) | code.isin(*MODEL_CODES) | (is_(400) & has(text, "model") & has(text, *NOT_THERE))),
        ],
        "agent_failed",
    )


def answer_status(text: Column, pages_read: Column, n_cites: Column) -> Column:
    """error without text, answered with pages read and a cite, else no_sources."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "error").when((pages_read > 0) & (n_cites > 0), "answered").otherwise("no_sources")


def shown_score(state: Column, live: Column) -> Column:
    """A score that is pending or running without a task that works on it is shown as failed."""
    return F.when(state.isin("pending", "running") & ~F.coalesce(live, F.lit(False)), "failed").otherwise(state)
