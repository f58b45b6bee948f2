"""A plain HTML page of a result table; rows are collected, so it is for results, not for data."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def html_report(result: DataFrame, title: str, notes: tuple[str, ...] = (), most: int = 10_000) -> str:
    """The rows of a small result in its own order; more than `most` rows raise."""
    rows = result.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")

    def cell(value) -> str:
        return f"{value:.6g}" if isinstance(value, float) else "" if value is None else escape(str(value))

    head = "".join(f"<th>{escape(c)}</th>" for c in result.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    text = "".join(f"<p>{escape(n)}</p>" for n in notes)
    return f"<!DOCTYPE html><html lang=en><meta charset=utf-8><title>{escape(title)}</title><body><h1>{escape(title)}</h1>{text}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>"
