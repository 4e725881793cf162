"""Configuration text: `name = value` lines, `#` comments, and a counted list of `path = reference` routes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The entry that says how many route lines follow.
ROUTES = "n_ref"


@dataclass
class Settings:
    values: dict[str, str] = field(default_factory=dict)
    routes: list[tuple[str, str]] = field(default_factory=list)

    def number(self, name: str, default: int) -> int:
        return int(self.values.get(name, default))


def parse(text: str) -> Settings:
    """Raises ValueError where fewer routes follow than announced, or a line has no `=`."""
    lines = [line.split("#", 1)[0].strip() for line in text.split("\n")]
    entries = []
    for line in filter(None, lines):
        name, equals, value = line.partition("=")
        if not equals:
            raise ValueError(f"no `=` in {line!r}")
        entries.append((name.strip(), value.strip()))
    found, k = Settings(), 0
    while k < len(entries):
        name, value = entries[k]
        k += 1
        found.values[name] = value
        if name == ROUTES:
            some = entries[k : k + int(value)]
            if len(some) < int(value):
                raise ValueError(f"{value} routes announced, {len(some)} found")
            found.routes += some
            k += len(some)
    return found


def entries(lines: DataFrame) -> DataFrame:
    """The same for many texts in Spark: file_id, line_no, name, value from rows file_id, text."""
    rows = lines.select("file_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = rows.select("file_id", "line_no", F.trim(F.regexp_replace("line", "#.*$", "")).alias("x")).filter(F.col("x").contains("="))
    return bare.select("file_id", "line_no", F.trim(F.substring_index("x", "=", 1)).alias("name"), F.trim(F.regexp_replace("x", "^[^=]*=", "")).alias("value"))


def routes_table(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.createDataFrame(settings.routes, "prefix string, ref_id string")
