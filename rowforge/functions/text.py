"""Column functions: redaction, refusals, lengths, keys. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import REDACTED, SECRETS

#: A whole value that says nothing.
REFUSALS = (
    "unable to determine", "n/a", "not available", "not specified", "insufficient data", "unknown", "not enough information", "cannot determine", "no data",
    "no information", "not applicable", "data not available", "information not available",
)
#: A phrase anywhere in a longer value that declines to answer.
REFUSAL_PHRASE = (
    r"(?i)\bI cannot determine\b|\bI can[' ]?t determine\b|\binsufficient information\b|\bI don[' ]?t have\b"
    r"|\bunable to (?:determine|find|provide)\b|\bnot enough (?:information|context|data)\b|\bno (?:information|data) available\b"
)


def redact(c: Column) -> Column:
    """Text with secrets replaced."""
    for p in SECRETS:
        c = F.regexp_replace(c, p, REDACTED.replace("*", r"*"))
    return c


def redact_sql(name: str) -> str:
    """The same as an expression of SQL dialects with RE2's regexp_replace."""
    for p in SECRETS:
        name = f"regexp_replace({name}, '{p.replace(chr(39), chr(39) * 2)}', '{REDACTED}', 'g')"
    return name


def is_refusal(c: Column) -> Column:
    """True of null, blank, and the listed phrases, whatever their case and the white space around them."""
    return F.coalesce(F.lower(F.btrim(c, F.lit(" \t\n\r\f\x0b"))).isin("", *REFUSALS), F.lit(True))


def apply_default(c: Column, default: Any, enum: Iterable[str] | None = None) -> Column:
    """The default where the value is a refusal and no member of the enum."""
    gone = is_refusal(c)
    if enum:
        gone = gone & ~F.coalesce(F.lower(F.btrim(c, F.lit(" \t\n\r\f\x0b"))).isin(*[e.lower() for e in enum]), F.lit(False))
    return F.when(gone, F.lit(default)).otherwise(c)


def has_refusal_phrase(c: Column) -> Column:
    return c.rlike(REFUSAL_PHRASE)


def words(c: Column) -> Column:
    """How many words, white space being Unicode's."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("long")


def sentences(c: Column) -> Column:
    """Pieces between full stops, question and exclamation marks, the empty one at the end among them; 1 at least."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(c), r"[.!?]+"))).cast("long")


def tokens(c: Column) -> Column:
    """A quarter of the characters; 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def chars(c: Column) -> Column:
    return F.length(c).cast("long")


LENGTHS = {"word": (words, "words"), "sentence": (sentences, "sentences"), "token": (tokens, "tokens (approx)"), "char": (chars, "chars")}


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns, so missing values have one form."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_name(c: Column) -> Column:
    """A file name's characters: others become underscores."""
    return F.regexp_replace(c, r"[^\p{Alnum}_-]", "_")


def row_json(cols: Iterable[tuple[str, Column]]) -> Column:
    """JSON of named columns in the order of their names, nulls included."""
    parts = [c.alias(n) for n, c in sorted(cols, key=lambda x: x[0])]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}) if parts else F.lit("{}")


def cache_key(static: str, row: Column, prior: Column | None = None) -> Column:
    """SHA-256 of a step's static part, hashed once on the driver, and a row's JSON."""
    return F.sha2(F.concat_ws("|", F.lit(static), row, *([prior] if prior is not None else [])), 256)


def as_text(c: Column, t: T.DataType) -> Column:
    """A value's text for frequency tables: strings as they are, containers as JSON."""
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def parse_list(c: Column) -> Column:
    """A list cell of a field table: a JSON array of strings, else comma-separated; blanks are dropped."""
    by_comma = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    as_json = F.from_json(F.trim(c), "array<string>")
    return F.when(F.trim(c) == "", F.lit(None)).when(F.trim(c).startswith("["), F.coalesce(as_json, by_comma)).otherwise(by_comma)


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """``{field}`` replaced by columns, as they are; nulls are empty. A name that is unknown is an error."""
    import re

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and piece not in fields:
            raise ValueError(f"the template names {piece!r}, which the row lacks")
        parts.append(F.coalesce(fields[piece].cast("string"), F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*parts)
