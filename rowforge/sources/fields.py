"""Field tables: CSV files of field specifications by category."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FieldValidationError
from ..functions.text import parse_list
from ..types import FieldSpec

NEEDED = ("Category", "Field", "Prompt")
OPTIONAL = ("Type", "Format", "Enum", "Examples", "Bad_Examples", "Default", "Instructions", "Guidance", "Data_Type")


def field_table(raw: DataFrame) -> DataFrame:
    """(category, field, prompt, type, format, enum, examples, bad_examples, default) of a field table's rows.

    The older columns Instructions and Guidance go to the end of the prompt; Data_Type stands in for Type. Blank cells are null.
    """
    if lacking := [c for c in NEEDED if c not in raw.columns]:
        raise FieldValidationError(f"the field table lacks {', '.join(lacking)}")
    for c in OPTIONAL:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    cell = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return raw.select(
        cell("Category").alias("category"), cell("Field").alias("field"), F.concat_ws("\n", cell("Prompt"), cell("Instructions"), cell("Guidance")).alias("prompt"),
        F.coalesce(cell("Type"), cell("Data_Type"), F.lit("String")).alias("type"), cell("Format").alias("format"), parse_list(F.col("Enum")).alias("enum"), parse_list(F.col("Examples")).alias("examples"),
        parse_list(F.col("Bad_Examples")).alias("bad_examples"), cell("Default").alias("default"),
    )


class FieldManager:
    def __init__(self, rows: list[dict[str, Any]]):
        if not rows:
            raise FieldValidationError("the field table is empty")
        self.categories: dict[str, dict[str, FieldSpec]] = {}
        for r in rows:
            if not r["category"] or not r["field"]:
                raise FieldValidationError("each row of a field table needs a category and a field")
            spec = {k: v for k, v in r.items() if k not in ("category", "field") and v is not None}
            self.categories.setdefault(r["category"], {})[r["field"]] = FieldSpec.of(spec)

    @classmethod
    def from_csv(cls, path: str, spark: SparkSession | None = None) -> FieldManager:
        spark = spark or SparkSession.builder.getOrCreate()
        raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
        return cls([r.asDict() for r in field_table(raw).collect()])

    def get_categories(self) -> list[str]:
        return list(self.categories)

    def get_category_fields(self, category: str) -> dict[str, FieldSpec]:
        if category not in self.categories:
            raise FieldValidationError(f"no category {category!r}; there are {', '.join(self.categories)}")
        return dict(self.categories[category])

    def validate_category(self, category: str) -> bool:
        return category in self.categories

    def get_field_count(self, category: str | None = None) -> int:
        return len(self.get_category_fields(category)) if category else sum(map(len, self.categories.values()))


def load_fields(path: str, category: str | None = None, spark: SparkSession | None = None) -> dict[str, dict[str, Any]]:
    """Specifications by field, of one category or all; of a field in several the last category's."""
    m = FieldManager.from_csv(path, spark)
    picked = [m.get_category_fields(category)] if category else m.categories.values()
    return {f: s.as_dict() for fields in picked for f, s in fields.items()}
