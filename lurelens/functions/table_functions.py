"""Table functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from lurelens.functions.html import form_fields

_FIELD = "ord int, tag string, type string, name_or_id string, nearby_label_text string"


@udtf(returnType=_FIELD)
class FormFields:
    """``form_fields(html)``: one row per field that a visitor would fill in, for ``lateral`` joins."""

    def eval(self, html: str) -> Iterator[tuple]:
        for i, field in enumerate(form_fields(html) if html else ()):
            yield i, field["tag"], field["type"], field["name_or_id"], field["nearby_label_text"]


@udtf(returnType="part string, form_pages int, n_fields int, passwords int")
class FieldCounts:
    """``field_counts(table(pages) partition by part)``: pages ``(part, html)`` with forms, and their fields, of each part."""

    def __init__(self) -> None:
        self.part, self.pages, self.fields, self.passwords = None, 0, 0, 0

    def eval(self, row: Row) -> None:
        self.part = row["part"]
        found = form_fields(row["html"]) if row["html"] else []
        self.pages += bool(found)
        self.fields += len(found)
        self.passwords += sum(field["type"] == "password" for field in found)

    def terminate(self) -> Iterator[tuple]:
        yield self.part, self.pages, self.fields, self.passwords


def register_table_functions(spark: SparkSession) -> None:
    """Make ``form_fields`` and ``field_counts`` known to SQL."""
    spark.udtf.register("form_fields", FormFields)
    spark.udtf.register("field_counts", FieldCounts)
