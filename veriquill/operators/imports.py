"""Records that come as JSON text: whole chats, results of tools, settings in a header, lists of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import imported_id

# The format of exported chats, the longest header, the shape of a key, and what providers need.
FORMAT, LONGEST_HEADER, LONGEST_KEY = 1, 4096, 512
PROVIDERS = {p: True for p in "openai anthropic gemini openrouter groq mistral deepseek xai together".split()} | {"ollama": False, "custom": False}
DEFAULT_SESSION = "demo"


def get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def read_chats(files: DataFrame, session: Column | None = None) -> DataFrame:
    """session_id, title, at, message_id, role, text, n_contexts: the messages of exported chats (file_id, body), ids hashed anew.

    A body is one JSON object of format FORMAT, over any number of lines, with a title, a document and messages, each with its message and maybe
    contexts. Bodies that are no such object have no messages; a message without an id or role is left out.
    """
    parsed = files.select("file_id", F.try_parse_json("body").alias("v"), (F.lit(DEFAULT_SESSION) if session is None else session).alias("session_id"))
    known = parsed.where((get("v", "$.format", "bigint") == FORMAT) & get("v", "$.document", "variant").isNotNull())
    title = F.coalesce(F.nullif(get("v", "$.title", "string"), F.lit("")), get("v", "$.document.filename", "string"))
    each = known.select("file_id", "session_id", title.alias("title"), F.posexplode(get("v", "$.messages", "array<variant>")).alias("at", "m"))
    out = each.select(
        "file_id", "session_id", "title", "at", get("m", "$.message.id", "string").alias("old"), get("m", "$.message.role", "string").alias("role"),
        get("m", "$.message.text", "string").alias("text"), F.coalesce(F.size(get("m", "$.contexts", "array<variant>")), F.lit(0)).alias("n"),
    )
    out = out.where("old is not null and role is not null")
    return out.select("file_id", "session_id", "title", "at", imported_id(F.col("session_id"), F.col("old")).alias("message_id"), "role", "text", F.when(F.col("role") == "assistant", F.greatest("n", F.lit(0))).otherwise(0).alias("n_contexts"))


def write_chats(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """session_id, body: chats (session_id, seq, message_id, role, status, text) as read_chats() takes them, with the pages that answers read (message_id, page, text).

    Answers that are not finished stay out, and chats without one.
    """
    done = messages.where((F.col("role") != "assistant") | F.col("status").isin("answered", "no_sources"))
    pages = contexts.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.col("text").alias("said")))), lambda p: F.struct(p.page.alias("page"), p.said.alias("text"))).alias("contexts"))
    rows = done.join(pages, "message_id", "left")
    item = F.struct("seq", F.struct(F.struct(F.col("message_id").alias("id"), "role", "text").alias("message"), "contexts").alias("item"))
    chats = rows.groupBy("session_id").agg(F.max(F.col("role") == "assistant").alias("some"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x.item).alias("messages")).where("some")
    name = F.concat(F.lit("report "), "session_id", F.lit(".pdf"))
    return chats.select("session_id", F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.concat(F.lit("Chat "), "session_id").alias("title"), F.struct(name.alias("filename")).alias("document"), "messages")).alias("body"))


def tool_result(output: Column) -> Column:
    """The JSON object that a tool's result (JSON text) holds, as a variant: of an object its text, of a list its items' texts line by line, else the text itself; null if that is no object."""
    v = F.try_parse_json(output)
    text_of = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(get(x, "$.text", "string"), F.lit(""))).otherwise("")
    items = F.array_join(F.transform(get(v, "$", "array<variant>"), text_of), "\n")
    text = F.when(F.schema_of_variant(v).startswith("ARRAY"), items).when(v.isNotNull(), text_of(v)).otherwise(output)
    found = F.try_parse_json(text)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def model_choice(header: Column) -> Column:
    """error, provider, model of a header with settings in base64 of the URL kind, not padded: the first thing that is wrong with them, or null."""
    padded = F.rpad(F.trim(header), (F.ceil(F.length(F.trim(header)) / 4) * 4).cast("int"), F.lit("="))
    text = F.decode(F.try_to_binary(F.translate(padded, "-_", "+/"), F.lit("base64")), "UTF-8")
    v = F.try_parse_json(text)
    provider = F.lower(F.trim(F.coalesce(get(v, "$.provider", "string"), F.lit(""))))
    key = F.nullif(F.trim(F.coalesce(get(v, "$.api_key", "string"), F.lit(""))), F.lit(""))
    needs = F.coalesce(*[F.when(provider == p, F.lit(n)) for p, n in PROVIDERS.items()])
    error = (
        F.when(F.length(header) > LONGEST_HEADER, "too long")
        .when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not readable")
        .when(needs.isNull(), "unknown provider")
        .when(key.isNotNull() & ((F.length(key) > LONGEST_KEY) | ~key.rlike("^[\\x21-\\x7e]+$")), "bad key")
        .when(key.isNull() & needs, "no key")
    )
    model = F.nullif(F.trim(F.coalesce(get(v, "$.chat_model", "string"), F.lit(""))), F.lit(""))
    return F.when(F.coalesce(header, F.lit("")) != "", F.struct(error.alias("error"), F.when(error.isNull(), provider).alias("provider"), F.when(error.isNull(), model).alias("model")))


def question_list(text: Column) -> Column:
    """Questions of a setting, one a line or parted by ||; a backslash and n is a line's end too. Trimmed, without blank ones and repeats in any capitals."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r?\\n|\\|\\||\\\\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    low = lambda a: F.transform(a, F.lower)
    return F.transform(F.array(parts), lambda a: F.filter(a, lambda p, i: F.array_position(low(a), F.lower(p)) == i + 1))[0]
