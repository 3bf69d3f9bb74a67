"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_line() -> WindowSpec:
    return Window.partitionBy("media_id").orderBy("line_ix")


def strip(text: Column) -> Column:
    """Trim white space of all kinds, the ideographic space too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def starts_with_any(text: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def ends_with_any(text: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.endswith(m)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value reckoned once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def seconds_text(ms: Column) -> Column:
    """m:ss.ss, hundredths rounded half up."""
    hundredths = F.floor((ms + 5) / 10).cast("long")
    second = F.floor(hundredths / 100).cast("long")
    return F.concat(F.floor(second / 60).cast("string"), F.lit(":"), F.lpad((second % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def media_of_file() -> Column:
    """A file's media: its ``media_id=`` folder, or else its name without the last suffix."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/media_id=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    # names come as in a URI, where a plus is a plus
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
