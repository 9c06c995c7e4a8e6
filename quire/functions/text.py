"""Text, path, hash and number functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and the ASCII characters they stand for.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
FULL_ALNUM = "".join(c for c, h in zip(FULL, HALF) if h.isalnum())
HALF_ALNUM = "".join(h for h in HALF if h.isalnum())
#: Hyphens that may end a line.
HYPHENS = "\\-\u00ad\u2010\u2011\u2043"
#: Ligatures and the letters they stand for.
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st"}
#: Marks of a table that goes on.
CONTINUED_ENDS = ["(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)", "(…continued)", "续表"]
CONTINUED_ANYWHERE = ["(continued)"]


def full_to_half(s: Column) -> Column:
    return F.translate(s, FULL, HALF)


def full_to_half_alnum(s: Column) -> Column:
    return F.translate(s, FULL_ALNUM, HALF_ALNUM)


def ends_in_hyphen(s: Column) -> Column:
    """A word broken at the line's end, by any hyphen."""
    return s.rlike(f"[A-Za-z][{HYPHENS}]\\s*$")


def replace_ligatures(s: Column) -> Column:
    for one, many in LIGATURES.items():
        s = F.replace(s, F.lit(one), F.lit(many))
    return s


def replace_controls(s: Column) -> Column:
    """CR LF goes, STX stands for a hyphen."""
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("")), F.lit("\u0002"), F.lit("-"))


def escape_markdown(s: Column) -> Column:
    return F.regexp_replace(s, r"([*`~])", r"\\$1")


def title_level(level: Column) -> Column:
    """Default 1; above 4 is 4, below 1 is 0."""
    n = F.coalesce(level, F.lit(1))
    return F.when(n > 4, F.lit(4)).when(n < 1, F.lit(0)).otherwise(n)


def squeeze(s: Column) -> Column:
    """Runs of white space (Unicode) to one space, none at the ends; null to empty."""
    return F.btrim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def style_markdown(s: Column, styles: Column) -> Column:
    """Bold and italic inside, strikethrough around them, underline outermost."""
    has = lambda name: F.array_contains(styles, name)
    mark = F.when(has("bold") & has("italic"), "***").when(has("bold"), "**").when(has("italic"), "*").otherwise("")
    out = F.concat(mark, s, mark)
    out = F.when(has("strikethrough"), F.concat(F.lit("~~"), out, F.lit("~~"))).otherwise(out)
    out = F.when(has("underline"), F.concat(F.lit("<u>"), out, F.lit("</u>"))).otherwise(out)
    return F.when((F.size(styles) == 0) | (s == ""), s).otherwise(out)


def plain_markdown(s: Column) -> Column:
    """Markdown and HTML to words: tags, images and marks become spaces."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"<[^>]*>", " ")
    s = F.regexp_replace(s, r"!\[[^\]]*\]\([^)]+\)", " ")
    s = F.regexp_replace(s, r"[#*_`~|>\-\[\](){}:;.,!?/\\]+", " ")
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def has_content(s: Column) -> Column:
    return plain_markdown(s).rlike("[A-Za-z0-9\u00c0-\uffff]")


def needs_space(left: Column, right: Column) -> Column:
    """Whether a space belongs between two pieces of recognised text."""
    last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    cjk = "[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"
    closed = last.rlike(cjk) | first.rlike(cjk) | last.rlike(r"[(\[{\"'`\-]") | first.rlike(r"[)\]}\"'`.,;:!?%]")
    return F.when((F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == ""), F.lit(False)).otherwise(~closed)


def escape_html(s: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(mark), F.lit(code))
    return s


def strip_fence(s: Column) -> Column:
    """Without a code fence around it, and without display delimiters."""
    s = F.regexp_replace(s, r"^\s*```[A-Za-z0-9_+-]*\n?|\n?```\s*$", "")
    return F.btrim(F.regexp_replace(s, r"^\\\[|\\\]$", ""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    base = basename(path)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def parent(path: Column) -> Column:
    flat = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    up = F.regexp_extract(flat, r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(flat, "/") == 0, ".").when(up == "", "/").otherwise(up)


def is_url(path: Column) -> Column:
    return path.rlike(r"^https?://[^/\s]+")


def store_path(path: Column) -> dict[str, Column]:
    """Bucket, key and byte range (offset, length) of s3://bucket/key?bytes=offset,length."""
    bare = F.split_part(path, F.lit("?"), F.lit(1))
    span = r"\?bytes=(\d+),(-?\d+)"
    number = lambda k: F.when(path.rlike(span), F.regexp_extract(path, span, k).cast("long"))
    return {
        "bucket": F.regexp_extract(bare, r"^s3a?://([^/]+)/", 1),
        "key": F.regexp_extract(bare, r"^s3a?://[^/]+/(.*)$", 1),
        "start": number(1),
        "length": number(2),
    }


def column_name(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, however many letters it takes; below 0 none."""
    abc, n = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), index.cast("long") + 1

    def letter(k: int) -> Column:
        # A name has a k-th letter from the right on from 1 + 26 + ... + 26^k; fourteen hold any long.
        least = (26 ** (k + 1) - 1) // 25
        at = F.call_function("div", n - least, F.lit(26**k)) % 26
        return F.when(n >= least, F.substring(abc, (at + 1).cast("int"), F.lit(1))).otherwise(F.lit(""))

    return F.concat(*(letter(k) for k in reversed(range(14))))


def letter_number(value: Column) -> Column:
    """1 to a, 26 to z, 27 to aa; below 1 counts as 1."""
    return F.lower(column_name(F.greatest(value, F.lit(1)) - 1))


def roman_number(value: Column) -> Column:
    """Up to 3999 in Roman numerals, others as digits."""
    digit = lambda n, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), (n + 1).cast("int"))
    v = value.cast("long")
    many = F.repeat(F.lit("M"), F.floor(v / 1000).cast("int"))
    roman = F.concat(many, digit(F.floor(v / 100) % 10, "C", "D", "M"), digit(F.floor(v / 10) % 10, "X", "L", "C"), digit(v % 10, "I", "V", "X"))
    return F.when((v > 0) & (v < 4000), roman).otherwise(v.cast("string"))


def excel_date(serial: Column, from_1904: bool = False) -> Column:
    """Serial day number to ISO date, or date and time if it has a part of a day. Years of more than
    four digits have no sign."""
    # The 1900 calendar counts a 29 February 1900 that never was.
    whole = F.floor(serial).cast("int")
    days = whole if from_1904 else F.when(whole < 60, whole + 1).otherwise(whole)
    day = F.date_add(F.lit("1904-01-01" if from_1904 else "1899-12-30").cast("date"), days)
    seconds = F.floor((serial - F.floor(serial)) * 86400 + 0.5).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), (seconds % 60).cast("int"))
    date = F.ltrim(F.date_format(day, "yyyy-MM-dd"), F.lit("+"))
    return F.when(seconds == 0, date).otherwise(F.concat(date, F.lit(" "), clock))


def edit_rate(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, 0 if both are empty (NED); natively, for short texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / F.when(n > 0, n))


def given(body, **columns: Column) -> Column:
    """body of a struct of the columns, each worked out once and not again for each element of an array."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))), body)[0]


def token_coverage(target: Column, candidate: Column) -> Column:
    """Share of the target's tokens (longer than one character) that the candidate has."""
    tokens = lambda s: F.filter(F.split(s, r"\s+"), lambda t: F.length(t) > 1)
    def share(s):
        hits = F.size(F.filter(s["t"], lambda x: F.array_contains(s["c"], x)))
        return F.when((F.size(s["t"]) == 0) | (F.size(s["c"]) == 0), F.lit(0.0)).otherwise(hits / F.when(F.size(s["t"]) > 0, F.size(s["t"])))
    return given(share, t=tokens(target), c=tokens(candidate))


def comparable(s: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def ordered_coverage(target: Column, candidate: Column) -> Column:
    """Share of the target's tokens met by the candidate's in the target's order."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("at"))
    def share(both):
        t = both["t"]
        def step(state, token):
            found = F.array_position(F.slice(t, state["at"] + 1, F.greatest(F.size(t) - state["at"], F.lit(0))), token).cast("int")
            return F.when(found > 0, F.struct((state["hits"] + 1).alias("hits"), (state["at"] + found).alias("at"))).otherwise(state)
        return F.aggregate(both["c"], start, step, lambda s: s["hits"]) / F.size(t)
    shared = given(share, t=F.split(comparable(target), " "), c=F.split(comparable(candidate), " "))
    return F.when((comparable(target) == "") | (comparable(candidate) == ""), F.lit(0.0)).otherwise(shared)


#: Macros that only space or size.
LATEX_DROP = [
    "\\left", "\\right", "\\bigl", "\\bigr", "\\Bigl", "\\Bigr", "\\big", "\\Big", "\\bigg", "\\Bigg", "\\,", "\\;", "\\:", "\\!", "\\quad",
    "\\qquad", "\\displaystyle", "\\textstyle", "\\scriptstyle", "\\limits", "\\nolimits", "\\mathrm", "\\mathbf", "\\boldsymbol",
]
#: Macros that mean the same as another.
LATEX_SAME = {
    "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\rightarrow": "\\to", "\\longrightarrow": "\\to", "\\ge": "\\geq",
    "\\le": "\\leq", "\\ne": "\\neq", "\\cdot": "*", "\\times": "*", "\\ast": "*",
}


def latex_tokens(s: Column) -> Column:
    """Commands, braces and single symbols of a formula, in canonical form."""
    bare = F.coalesce(s, F.lit(""))
    for mark in _LATEX_MARK:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    tokens = F.regexp_extract_all(bare, F.lit(r"(\\[a-zA-Z]+|\\.|[^\s])"))
    kept = F.filter(tokens, lambda t: ~t.isin(LATEX_DROP))
    same = F.create_map(*(F.lit(v) for kv in LATEX_SAME.items() for v in kv))
    return F.transform(kept, lambda t: F.coalesce(same[t], t))


#: Commands, as in the JVM's pattern: a dot is no end of a line. All else but ASCII white space is single.
_LATEX_COMMAND = re.compile(r"(\\[a-zA-Z]+|\\[^\n\r\x85\u2028\u2029])")
_LATEX_SPACE = str.maketrans("", "", " \t\n\x0b\f\r")
_LATEX_DROPPED = frozenset(LATEX_DROP)
_LATEX_MARK = ("$$", "$", "\\(", "\\)", "\\[", "\\]")


def latex_words(s: str) -> list[str]:
    """latex_tokens of one string, in Python."""
    for mark in _LATEX_MARK:
        s = s.replace(mark, "")
    tokens = []
    for k, part in enumerate(_LATEX_COMMAND.split(s)):
        if k % 2 == 0:
            tokens.extend(part.translate(_LATEX_SPACE))
        elif part not in _LATEX_DROPPED:
            tokens.append(LATEX_SAME.get(part, part))
    return tokens


def normal_latex(s: Column) -> Column:
    return F.array_join(latex_tokens(s), "")


def cell_text(s: Column) -> Column:
    return F.regexp_replace(full_to_half(s), r"(?U)\s+", "")


def is_continuation(s: Column) -> Column:
    """A caption that says its table goes on."""
    low = F.lower(full_to_half(F.btrim(s)))
    out = F.lit(False)
    for mark in CONTINUED_ENDS:
        out = out | F.endswith(low, F.lit(mark.lower()))
    for mark in CONTINUED_ANYWHERE:
        out = out | F.contains(low, F.lit(mark))
    return out


def cells(html: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(html, F.lit(""))), F.lit("<t[dh]"))


def table_rows(html: Column) -> Column:
    """Rows of cell texts of a plain HTML table."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"))
    return F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>")))


def table_markdown(html: Column) -> Column:
    """A plain HTML table as a pipe table: the first row is its head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.flatten(F.transform(table_rows(html), lambda r, i: F.when(i == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r)))))
    return F.array_join(lines, "\n")


def language(s: Column) -> Column:
    """A language by the words that only it has most of; zh, ja or ko by script; '' for nothing."""
    marks = {
        "en": "the|and|of|to|in|is|that|for|with|was",
        "de": "der|die|und|das|ist|nicht|von|mit|den|auf",
        "fr": "le|les|des|et|est|que|une|pour|dans|avec",
        "es": "el|los|las|que|y|en|del|por|con|una",
    }
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}]+", "  "), F.lit(" "))
    votes = [F.struct(F.regexp_count(low, F.lit(f" (?:{words}) ")).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("lang")) for k, (name, words) in enumerate(marks.items())]
    best = F.array_max(F.array(*votes))
    script = F.when(low.rlike("[\u3040-\u30ff]"), "ja").when(low.rlike("[\uac00-\ud7af]"), "ko").when(low.rlike("[\u3400-\u9fff]"), "zh")
    return F.coalesce(script, F.when(best["n"] > 0, best["lang"]).otherwise(""))


def magic_suffix(content: Column, path: Column) -> Column:
    """File type by its first bytes, else by the path."""
    head = lambda hexa: F.hex(F.substring(content, 1, len(hexa) // 2)) == hexa
    by_bytes = F.when(head("25504446"), "pdf").when(head("89504E47"), "png").when(head("FFD8FF"), "jpg").when(head("504B0304"), "zip").when(head("47494638"), "gif")
    return F.coalesce(by_bytes, F.lower(F.replace(suffix(path), F.lit("."), F.lit(""))))
