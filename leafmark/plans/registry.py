"""All registered queries of the library's own operators."""

from __future__ import annotations

from leafmark.plans import apply_queries, chunk_queries, document_queries, edit_queries, markup_queries, package_queries, review_queries, section_queries, text_queries, tool_queries

FAMILIES = (text_queries, review_queries, edit_queries, markup_queries, document_queries, package_queries, apply_queries, chunk_queries, section_queries, tool_queries)


def queries() -> dict:
    return {name: run for family in FAMILIES for name, (run, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
