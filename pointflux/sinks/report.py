"""Audit tables as text: rows of CSV, Markdown or HTML, one string a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_cell(c: Column) -> Column:
    """A cell, quoted if it holds a quote, a comma or a line end; null is empty."""
    return F.when(_text(c).rlike("[\",\n]"), F.concat(F.lit("\""), F.replace(_text(c), F.lit("\""), F.lit("\"\"")), F.lit("\""))).otherwise(_text(c))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(_text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_cell(c: Column) -> Column:
    out = _text(c)
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.concat(F.lit("<td>"), out, F.lit("</td>"))


def lines(table: DataFrame, kind: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(line)`` for each row of ``table`` as ``csv``, ``markdown`` or ``html``."""
    names = list(columns or table.columns)
    if kind == "csv":
        line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in names])
    elif kind == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in names]), F.lit(" |"))
    elif kind == "html":
        line = F.concat(F.lit("<tr>"), *[html_cell(F.col(c)) for c in names], F.lit("</tr>"))
    else:
        raise ValueError(f"unknown kind {kind}")
    return table.select(line.alias("line"))


def head(names: Sequence[str], kind: str) -> str:
    """What stands above the rows."""
    return {
        "csv": ",".join(names),
        "markdown": "| " + " | ".join(names) + " |\n|" + "-|" * len(names),
        "html": "<table>\n<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>",
    }[kind]


def write(table: DataFrame, folder: str, kind: str, title: str = "") -> None:
    """Write a folder of text: the rows' lines by the tasks that hold them, and the head beside them in ``_head``."""
    from ..sources.files import open_output

    lines(table, kind).write.mode("overwrite").text(folder)
    above = {"csv": "", "markdown": f"# {title}\n\n", "html": f"<h1>{title}</h1>\n"}[kind] if title else ""
    with open_output(f"{folder.rstrip('/')}/_head") as f:
        f.write((above + head(table.columns, kind) + "\n").encode())
