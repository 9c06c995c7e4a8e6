"""Markup of documents: Markdown to HTML, nested lists to lines, rendered parts to a text."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLE = "body{max-width:50em;margin:auto;font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em}"
_INLINE = [
    (r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1">'),
    (r"\[([^\]]*)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>'),
    (r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"<strong>\1</strong>"),
    (r"\*(?=\S)(.+?)(?<=\S)\*", r"<em>\1</em>"),
    (r"~~(?=\S)(.+?)(?<=\S)~~", r"<s>\1</s>"),
]


def _inline(text: str) -> str:
    """Marks within a block; code and what a backslash escapes are kept aside."""
    kept: list[str] = []

    def aside(shown: str) -> str:
        kept.append(shown)
        return f"\u0001{len(kept) - 1}\u0002"

    text = re.sub(r"(`+)(.+?)\1", lambda m: aside(f"<code>{html.escape(m[2].strip(), quote=False)}</code>"), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: aside(html.escape(m[1], quote=False)), text)
    text = html.escape(text, quote=False)
    for pattern, form in _INLINE:
        text = re.sub(pattern, form, text)
    return re.sub("\u0001(\\d+)\u0002", lambda m: kept[int(m[1])], text)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_body(source: str) -> str:
    """Headings, paragraphs, lists, quotes, rules, fenced code and pipe tables as HTML."""
    lines, out, k = source.split("\n"), [], 0
    blank = lambda s: not s.strip()
    item = re.compile(r"^\s*(?:([-*+])|(\d+)[.)])\s+(.*)$")
    while k < len(lines):
        line = lines[k]
        if blank(line):
            k += 1
        elif m := re.match(r"^\s*(```+|~~~+)\s*(\S*)", line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            kind = f' class="language-{html.escape(m[2])}"' if m[2] else ""
            code = "".join(f"{html.escape(x, quote=False)}\n" for x in lines[k + 1 : end])
            out.append(f"<pre><code{kind}>{code}</code></pre>")
            k = end + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            k += 1
        elif re.match(r"^\s*([-*_])(?:\s*\1){2,}\s*$", line):
            out.append("<hr>")
            k += 1
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[k + 1]):
            head, k = _cells(line), k + 2
            rows = []
            while k < len(lines) and "|" in lines[k] and not blank(lines[k]):
                rows.append((_cells(lines[k]) + [""] * len(head))[: len(head)])
                k += 1
            row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in r) + "</tr>"
            out.append(f"<table><thead>{row('th', head)}</thead><tbody>{''.join(row('td', r) for r in rows)}</tbody></table>")
        elif item.match(line):
            tag, found = "ul" if item.match(line)[1] else "ol", []
            while k < len(lines) and (m := item.match(lines[k])) and bool(m[1]) == (tag == "ul"):
                found.append(m[3])
                k += 1
            out.append(f"<{tag}>" + "".join(f"<li>{_inline(x)}</li>" for x in found) + f"</{tag}>")
        elif line.lstrip().startswith(">"):
            end = next((j for j in range(k, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append(f"<blockquote>{markdown_body(chr(10).join(re.sub(r'^\s*> ?', '', x) for x in lines[k:end]))}</blockquote>")
            k = end
        else:
            end = next((j for j in range(k + 1, len(lines)) if blank(lines[j]) or re.match(r"^(#{1,6}\s|\s*(```|~~~|>))", lines[j]) or item.match(lines[j])), len(lines))
            out.append("<p>" + "\n".join(_inline(x.strip()) for x in lines[k:end]) + "</p>")
            k = end
    return "\n".join(out)


def markdown_page(source: str, title: str = "Markdown Document", style: str | None = None) -> str:
    """A whole HTML page with formulas left to MathJax."""
    return (
        f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<title>{html.escape(title)}</title>\n<style>{style if style is not None else STYLE}</style>\n'
        "<script>MathJax = {tex: {inlineMath: [['$', '$'], ['\\\\(', '\\\\)']], displayMath: [['$$', '$$'], ['\\\\[', '\\\\]']]}};</script>\n"
        f'<script src="https://cdn.jsdelivr.net/npm/mathjax@3/es5/tex-mml-chtml.js" async></script>\n</head>\n<body>\n{markdown_body(source)}\n</body>\n</html>'
    )


def flat_list(raw: str) -> str:
    """A nested list (JSON: attribute, ilevel, blocks of text or of lists) as lines with indents;
    an item's own prefix goes before its number or dash. Items without text leave no line."""
    lines: list[str] = []
    waiting = [iter([json.loads(raw)])] if raw else []
    state: list[tuple[str, bool, list[int]]] = [("", False, [0])]
    while waiting:
        block = next(waiting[-1], None)
        if block is None:
            waiting.pop()
            state.pop()
        elif "blocks" in block:
            waiting.append(iter(block["blocks"]))
            state.append(("    " * block.get("ilevel", 0), block.get("attribute") == "ordered", [0]))
        elif text := (block.get("text") or "").strip() and block["text"]:
            indent, ordered, count = state[-1]
            prefix = (block.get("prefix") or "").strip()
            if not prefix and ordered:
                count[0] += 1
                prefix = f"{count[0]}."
            lines.append(f"{indent}{prefix or '-'} {text}")
    return "\n".join(lines)


def join_parts(parts: Column) -> Column:
    """Rendered parts of a paragraph (array of struct kind, shown, raw, wrapped) as one text. A
    formula stands between spaces; where a wrapped part ends in a mark and a letter follows, a space
    keeps the two apart, unless a link or formula follows. Native."""
    sign = r"[\p{P}\p{S}]"
    empty = F.struct(F.lit("").alias("kind"), F.lit("").alias("shown"), F.lit("").alias("raw"), F.lit(False).alias("wrapped"))
    start = F.struct(F.lit("").alias("text"), empty.alias("last"), F.lit(0).alias("n"))

    def step(s, p):
        last, formula = s["last"], p["kind"] == "inline_equation"
        apart = (s["n"] > 0) & last["wrapped"] & ~p["kind"].isin("hyperlink", "inline_equation", "interline_equation") & last["raw"].rlike(sign + "$") & p["raw"].rlike(r"^[^\s\p{P}\p{S}]")
        gap = F.when(formula & (s["text"] != "") & ~F.endswith(s["text"], F.lit(" ")), " ").when(~formula & apart, " ").otherwise("")
        after = F.when(formula & (s["n"] + 1 < F.size(parts)), " ").otherwise("")
        kept = F.struct(p["kind"].alias("kind"), p["shown"].alias("shown"), p["raw"].alias("raw"), p["wrapped"].alias("wrapped"))
        return F.struct(F.concat(s["text"], gap, p["shown"], after).alias("text"), kept.alias("last"), (s["n"] + 1).alias("n"))

    return F.aggregate(parts, start, step, lambda s: s["text"])


#: Categories of annotated pages by what they count as.
KINDS = {
    None: ["text_mask", "chart_mask", "table_mask", "unknown_mask", "organic_chemical_formula_mask", "need_mask", "algorithm_mask", "list_group", "equation_semantic", "line", "text_span", "inline_formula", "equation_inline", "subscript", "superscript"],
    "discarded": ["abandon", "page_number", "page_footnote", "page_header", "page_footer", "header", "footer", "watermark"],
    "equation": ["equation_isolated", "equation", "formula", "isolate_formula"],
    "table": ["table"],
    "image": ["figure", "image", "chart"],
    "text": ["text_block", "title", "text", "paragraph", "list", "index", "code_txt", "code_txt_caption", "reference", "table_caption", "table_footnote", "figure_caption", "image_caption", "figure_footnote", "image_footnote", "code_caption", "equation_caption", "equation_explanation"],
}


def kind_of(category: Column) -> Column:
    """What a category counts as; null for what takes no part."""
    low = F.lower(F.coalesce(category, F.lit("")))
    some = lambda words: F.regexp_like(low, F.lit("|".join(words)))
    out = F.when(some(["mask", "span", "inline"]), F.lit(None)).when(some(["text", "title", "caption", "footnote"]), F.lit("text"))
    for kind, names in reversed(KINDS.items()):
        out = F.when(low.isin(names), F.lit(kind)).otherwise(out)
    return out


def item_fields(item: Column) -> dict[str, Column]:
    """Type, text, page and whether it is LaTeX, of a content item in JSON, with what stands in."""
    got = lambda key: F.nullif(F.get_json_object(item, f"$.{key}"), F.lit(""))
    kind = F.coalesce(F.get_json_object(item, "$.type"), F.lit("unknown"))
    page = F.get_json_object(item, "$.page_idx")
    return {
        "kind": kind,
        "body": F.coalesce(F.when(kind == "table", F.coalesce(got("table_body"), got("html"))).otherwise(F.coalesce(got("text"), got("content"))), F.lit("")),
        "page": F.when(F.regexp_like(page, F.lit(r"^-?\d+(\.\d+)?$")), page.cast("double").cast("int")).otherwise(F.lit(0)),
        "latex": (kind == "equation") | (F.coalesce(F.get_json_object(item, "$.text_format"), F.lit("")) == "latex"),
    }
