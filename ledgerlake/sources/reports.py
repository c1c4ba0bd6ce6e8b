"""Reports as text: bounded, ordered tables in Markdown or HTML. The same rows make the same bytes."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MOST_ROWS = 200


@dataclass
class Section:
    """A heading, notes, and a table in an order; rows beyond the limit are counted, not shown."""

    heading: str
    rows: DataFrame | None = None
    order: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    limit: int = MOST_ROWS
    none: str = "none"

    def table(self) -> tuple[list[str], list[list[str]], int]:
        """Columns, shown rows as text, and how many more there are. One row more than the limit is read, and counted only if it is there."""
        if self.rows is None:
            return [], [], 0
        found = [[plain(v) for v in r] for r in self.rows.orderBy(*self.order).limit(self.limit + 1).toLocalIterator()]
        more = self.rows.count() - self.limit if len(found) > self.limit else 0
        return self.rows.columns, found[: self.limit], more


def plain(value) -> str:
    """A value as text: null is empty, lists are separated by commas."""
    if value is None:
        return ""
    if isinstance(value, (list, tuple)):
        return ", ".join(plain(v) for v in value)
    if isinstance(value, bool):
        return "yes" if value else "no"
    return str(value)


def _cell(text: str) -> str:
    return text.replace("\r\n", " ").replace("\n", " ").replace("\r", " ").replace("|", "\\|")


def markdown(title: str, sections: list[Section]) -> str:
    out = [f"# {title}"]
    for s in sections:
        columns, rows, more = s.table()
        out += ["", f"## {s.heading}", ""] + [f"- {n}" for n in s.notes]
        if columns:
            out += [""] * bool(s.notes) + [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
            out += [f"| {' | '.join(map(_cell, r))} |" for r in rows] or [f"| {s.none} |{' |' * (len(columns) - 1)}"]
        if more:
            out += ["", f"{more} more."]
    return "\n".join(out) + "\n"


def page(title: str, sections: list[Section]) -> str:
    """The same as an HTML page without scripts or styles; all text is escaped."""
    e = lambda t: html.escape(t, quote=True)
    out = [f"<!doctype html><html><head><meta charset=utf-8><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for s in sections:
        columns, rows, more = s.table()
        out.append(f"<h2>{e(s.heading)}</h2>" + "".join(f"<p>{e(n)}</p>" for n in s.notes))
        if columns:
            out.append("<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in columns) + "</tr>")
            out += ["<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows] or [f"<tr><td colspan={len(columns)}>{e(s.none)}</td></tr>"]
            out.append("</table>" + (f"<p>{more} more.</p>" if more else ""))
    return "\n".join([*out, "</body></html>"]) + "\n"
