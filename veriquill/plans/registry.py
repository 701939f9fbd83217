"""Where queries and their SQL are registered, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAGES = "pg AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"
SQUASH = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
NUMBERS = "list_transform(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', ''))"
