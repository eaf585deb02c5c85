"""Results as files: by suffix, a single file for what fits one task and a folder of parts otherwise."""

from __future__ import annotations

import json
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = (".csv", ".json", ".parquet")


def save(df: DataFrame, path: str | Path, order: str | None = None) -> Path:
    """One file, .csv, .json (an array of records) or .parquet, in folders that are made where they are missing.

    ``order`` names a column to sort by that isn't written. One task writes .csv and .parquet, the driver .json, a record at a
    time; for a result too large for that, ``save_parts``.
    """
    path = Path(path)
    kind = path.suffix.lower()
    if kind not in FORMATS:
        raise ValueError(f"files are {', '.join(FORMATS)}, not {path.suffix!r}")
    path.parent.mkdir(parents=True, exist_ok=True)
    ordered = df.orderBy(order).drop(order) if order else df
    if kind == ".json":
        with open(path, "w") as f:
            f.write("[")
            for i, r in enumerate(ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
                record = json.dumps(json.loads(r["j"]), indent=2, ensure_ascii=False)
                f.write(("," if i else "") + "\n  " + record.replace("\n", "\n  "))
            f.write("\n]\n")
        return path
    folder = tempfile.mkdtemp(dir=path.parent)
    try:
        one = df.coalesce(1)
        save_parts(one.sortWithinPartitions(order).drop(order) if order else one, folder + "/parts" + kind)
        part = next(p for p in Path(folder + "/parts" + kind).iterdir() if p.name.startswith("part-"))
        shutil.move(part, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return path


def save_parts(df: DataFrame, path: str) -> None:
    """A folder of files, written in parallel."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema]
        df.select(*flat).write.option("header", "true").option("escape", '"').csv(path)
    elif kind == ".json":
        df.write.option("ignoreNullFields", "false").json(path)
    elif kind == ".parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"files are {', '.join(FORMATS)}, not {kind!r}")
