"""The registered queries of the reference's own operators, with the SQL that their results are checked against."""

from __future__ import annotations

from folioforge.plans import audio_queries, book_queries, catalog_queries, file_queries, import_queries, player_queries, stream_queries, text_queries, timeline_queries, word_queries  # noqa: F401  they register themselves
from folioforge.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
