"""Passages of a chapter around given texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MARGIN, GAP, LOOSE = 300, 80, 80
#: Fixed value: what stands between texts that were not found and the beginning of the content.
FALLBACK = "\n\n--- 原章片段兜底 ---\n"


def _place(content: str, wanted: str) -> tuple[int, int] | None:
    """Start and end of a text in the content; if it isn't there, of its first LOOSE characters whatever the blanks between them."""
    at = content.find(wanted)
    if at >= 0:
        return at, at + len(wanted)
    compact = re.sub(r"\s+", "", wanted)[:LOOSE]
    found = re.search(r"\s*".join(map(re.escape, compact)), content) if compact else None
    return found.span() if found else None


def focus_passages(content: str | None, wanted: list[str | None] | None, most: int) -> str:
    """The paragraphs that hold the wanted texts with MARGIN characters on both sides, those closer than GAP joined, cut to `most`.

    A paragraph ends at a blank line; where there is none before or after, at a line end. Nothing wanted: the end of the content. Nothing found: the wanted texts themselves, a line
    that says so, then the beginning of the content. Null content: ''.
    """
    content = content or ""
    texts = [t.strip() for t in wanted if t and t.strip()] if wanted is not None else []
    if not content:
        return ""
    if not texts:
        return content[-most:] if most else ""
    spans = []
    for place in filter(None, (_place(content, t) for t in texts)):
        a, b = place
        start = next((at + 1 for mark in ("\n\n", "\n") if (at := content.rfind(mark, 0, a)) >= 0), 0)
        end = next((at for mark in ("\n\n", "\n") if (at := content.find(mark, b)) >= 0), -1)
        spans.append([max(0, start - MARGIN), min(len(content), (len(content) if end < 0 else end) + MARGIN)])
    if not spans:
        return ("\n".join(texts) + FALLBACK + content[:most])[:most]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + GAP:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return "\n\n---\n\n".join(p for a, b in merged if (p := content[a:b].strip()))[:most]


def passages(content: Column, wanted: Column, most: int) -> Column:
    @pandas_udf(StringType())
    def cut(contents: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([focus_passages(c, None if w is None else list(w), most) for c, w in zip(contents, lists)], dtype=object)

    return cut(content, wanted)
