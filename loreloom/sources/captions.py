"""Caption files as running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markdown import strip


def flatten(raw: Column | str) -> Column:
    """Cue lines of a WebVTT text without headers, times, numbers and tags; a line that repeats the one before goes.

    Rolling captions repeat each line, so neighbours are compared, not all lines.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(x, r"<[^>]*>", "")))
    head = r"^(?:WEBVTT|Kind:|Language:|NOTE\b|STYLE\b|REGION\b).*"
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(head) & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    before = F.concat(F.array(F.lit("")), kept)
    single = F.filter(F.zip_with(kept, before, lambda x, b: F.when(x != b, x)), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(single, " "), r"\s+", " ")
