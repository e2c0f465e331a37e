"""Reports of small results: JSON and a self-contained HTML page with SVG charts."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}.inconsistent{color:#a00}.consistent{color:#070}.inconclusive{color:#850}"


def to_json(rows: DataFrame) -> DataFrame:
    """Every row as a JSON string, written or collected as the caller likes."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def esc(value) -> str:
    return html.escape("" if value is None else str(value))


def table(rows: list[dict]) -> str:
    if not rows:
        return "<p>no rows</p>"
    head = "".join(f"<th>{esc(k)}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def page(title: str, *parts: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>{STYLE}</style></head><body><h1>{esc(title)}</h1>{''.join(parts)}</body></html>"


def verdict_html(verdict: dict, entries: list[dict]) -> str:
    """Page of one file's verdict and entries."""
    findings = [f if isinstance(f, dict) else f.asDict() for f in verdict.get("findings") or []]
    listed = "".join(f"<li class='{esc(f['kind'])}'><b>{esc(f['check'])}</b>: {esc(f['text'])}</li>" for f in findings)
    facts = {k: v for k, v in verdict.items() if k != "findings"}
    return page(str(verdict.get("path")), f"<p class='{esc(verdict.get('status'))}'>{esc(verdict.get('status'))}</p>", table([facts]), f"<ul>{listed}</ul>", "<h2>Entries</h2>", table(entries))


def evaluation_html(sections: dict[str, list[dict]]) -> str:
    return page("Evaluation", *(f"<h2>{esc(name)}</h2>{table(rows)}" for name, rows in sections.items()))


def bar_svg(labels: list[str], values: list[float], title: str = "", width: int = 480, height: int = 240) -> str:
    top, n = max([*values, 1e-12]), max(len(values), 1)
    step = (width - 40) / n
    bars = "".join(
        f"<rect x='{30 + i * step:.1f}' y='{height - 30 - v / top * (height - 60):.1f}' width='{step * 0.8:.1f}' height='{v / top * (height - 60):.1f}' fill='#469'/><text x='{30 + i * step:.1f}' y='{height - 14}' font-size='10'>{esc(k)}</text>"
        for i, (k, v) in enumerate(zip(labels, values))
    )
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'><text x='8' y='16'>{esc(title)}</text>{bars}</svg>"


def line_svg(xs: list[float], series: dict[str, list[float]], title: str = "", log_x: bool = False, width: int = 480, height: int = 240) -> str:
    place = [math.log10(max(x, 1e-12)) if log_x else x for x in xs]
    low, high = min(place, default=0), max(place, default=1)
    values = [v for s in series.values() for v in s]
    bottom, top = min([*values, 0]), max([*values, 1e-12])
    px = lambda x: 30 + (x - low) / ((high - low) or 1) * (width - 50)
    py = lambda v: height - 30 - (v - bottom) / ((top - bottom) or 1) * (height - 60)
    lines = "".join(f"<polyline fill='none' stroke='hsl({i * 67 % 360},60%,40%)' points='{' '.join(f'{px(x):.1f},{py(v):.1f}' for x, v in zip(place, s))}'/><text x='{width - 110}' y='{20 + 12 * i}' font-size='10'>{esc(k)}</text>" for i, (k, s) in enumerate(series.items()))
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'><text x='8' y='16'>{esc(title)}</text>{lines}</svg>"


def confusion_svg(matrix: list[list[float]], labels: list[str], title: str = "", normalise: bool = True, cell: int = 40) -> str:
    out = []
    for i, row in enumerate(matrix):
        total = sum(row) or 1
        for j, v in enumerate(row):
            share = v / total if normalise else v / (max(map(max, matrix)) or 1)
            out.append(f"<rect x='{90 + j * cell}' y='{40 + i * cell}' width='{cell}' height='{cell}' fill='rgba(40,90,160,{share:.3f})'/><text x='{94 + j * cell}' y='{64 + i * cell}' font-size='10'>{v:g}</text>")
        out.append(f"<text x='4' y='{64 + i * cell}' font-size='10'>{esc(labels[i])}</text>")
    side = 100 + cell * len(labels)
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{side}' height='{side}'><text x='8' y='16'>{esc(title)}</text>{''.join(out)}</svg>"


def as_json(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, default=str)
