"""Result documents: JSON, text and static HTML from collected rows."""

from __future__ import annotations

import html
import json
import math
from datetime import UTC, datetime
from enum import Enum

from pyspark.sql import DataFrame


def to_jsonable(x):
    """NaN and infinities become null, stamps ISO in UTC, enums their values."""
    if hasattr(x, "asDict"):  # a Row, which is a tuple too
        return to_jsonable(x.asDict(recursive=True))
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, datetime):
        return (x if x.tzinfo else x.replace(tzinfo=UTC)).astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [to_jsonable(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def document(kind: str, body: dict) -> str:
    return json.dumps({"result_kind": kind} | to_jsonable(body), sort_keys=True)


def refusal_document(refusal: Exception) -> str:
    return document("refusal", {"error_type": type(refusal).__name__, "cause": str(refusal)})


def rows_of(df: DataFrame, most: int = 1000) -> tuple[list[dict], int]:
    """The first rows of a result for a report, and how many were left out."""
    got = df.limit(most + 1).collect()
    return [to_jsonable(r) for r in got[:most]], max(0, df.count() - most) if len(got) > most else 0


def text_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [names, *([str(r[n]) for n in names] for r in rows)]
    width = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(c, width, strict=True)).rstrip() for c in cells)


def html_report(title: str, sections: dict[str, list[dict]]) -> str:
    esc = lambda x: html.escape(str(x))
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1>"]
    for name, rows in sections.items():
        heads = "".join(f"<th>{esc(k)}</th>" for k in (rows[0] if rows else {}))
        body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
        parts.append(f"<h2>{esc(name)}</h2><table><tr>{heads}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"
