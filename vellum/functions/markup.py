"""Titles and plain text of lightweight markups, line by line with built-in functions.

A text is an array of lines. Each format says, in words: which line is a title, which lines are dropped (comments, rules,
fields, directives), which mark in front of a line goes, and which inline marks go. The rules are made of a few parts:

* a rule is a line that repeats its first character;
* a field is a line `:name: ...`;
* a headline is a run of one mark, then blanks, then text.

Inline forms are patterns, kept together as fixed values. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as X

EXTENSIONS = {"adoc": "asciidoc", "asciidoc": "asciidoc", "rst": "rst", "rest": "rst", "textile": "textile", "org": "org"}

#: Fixed values, which results must equal: inline forms of each format, and what stays of them.
INLINE = {
    "rst": [(r"`([^`<]+?)[ \t]*<[^>]*>`_", "$1"), (r":[A-Za-z][A-Za-z0-9_+.-]*:", "")],
    "textile": [(r'"([^"]+)":\S+', "$1")],
    "org": [(r"\[\[[^\]]*\]\[([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1")],
}
#: Characters beside which a mark stands at the edge of a word.
BEFORE_WORD, AFTER_WORD = r"\s(\[", r"\s).,;:!?\]"
#: AsciiDoc's block delimiters, a character and the least count; a table's and an open block's.
DELIMITERS, TABLE, OPEN_BLOCK = {"-": 4, "=": 4, ".": 4, "*": 4, "+": 4, "_": 4}, "|===", "--"
#: Textile's signatures of headings and of other blocks.
HEADS, BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6"], ["bq", "p"]

BLANKS = " \t"


def _starts_blank(c: Column) -> Column:
    return c.startswith(" ") | c.startswith("\t")


def _rule(line: Column) -> tuple[Column, Column]:
    """(its character, how often) of a line that repeats one character; count 0 for any other."""
    mark, n = F.substring(line, 1, 1), F.char_length(line)
    return mark, F.when((n > 0) & (F.repeat(mark, n) == line), n).otherwise(0)


def _field(line: Column) -> Column:
    """The name in `:name: ...`; null for any other line."""
    parts = F.split(line, ":", 3)
    return F.when((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == ""), F.get(parts, F.lit(1)))


def _headline(line: Column, mark: str) -> tuple[Column, Column]:
    """(level, text) of a run of the mark, blanks and text; level 0 for any other line."""
    rest = F.ltrim(line, F.lit(mark))
    return F.when(_starts_blank(rest), F.char_length(line) - F.char_length(rest)).otherwise(0), F.ltrim(rest, F.lit(BLANKS))


def _first(lines: Column, pick: Callable[[Column], Column]) -> Column:
    """The first line's text that `pick` gives and that is not blank; null without one."""
    return F.get(F.filter(F.transform(lines, lambda s: X.strip(pick(s))), lambda t: t != ""), F.lit(0))


def _body(lines: Column, dropped: Callable[[Column], Column], reduce_: Callable[[Column], Column]) -> Column:
    kept = F.filter(lines, lambda s: ~F.coalesce(dropped(s), F.lit(False)))
    return X.strip(F.array_join(F.transform(kept, reduce_), "\n"))


def _inline(c: Column, name: str, anywhere: str, at_edges: str = "") -> Column:
    """Without the format's inline forms, marks that go anywhere, and marks at the edges of words."""
    for pattern, stays in INLINE.get(name, []):
        c = F.regexp_replace(c, pattern, stays)
    c = F.translate(c, anywhere, "")
    return unwrap(c, at_edges) if at_edges else c


def unwrap(c: Column, marks: str) -> Column:
    """Emphasis marks at word edges go; marks within words stay."""
    return F.regexp_replace(c, rf"(?<=^|[{BEFORE_WORD}])[{marks}]+(?=\S)|(?<=\S)[{marks}]+(?=[{AFTER_WORD}]|$)", "")


def asciidoc(lines: Column) -> tuple[Column, Column]:
    """Title: the first headline of level one. Dropped: comments, attributes, block delimiters."""

    def title(s: Column) -> Column:
        level, text = _headline(s, "=")
        return F.when(level == 1, text)

    def dropped(s: Column) -> Column:
        t = X.strip(s)
        mark, n = _rule(t)
        delimiter = (t == OPEN_BLOCK) | (t.startswith(TABLE) & (F.rtrim(t, F.lit("=")) == "|"))
        for c, least in DELIMITERS.items():
            delimiter |= (mark == c) & (n >= least)
        name = F.coalesce(_field(t), F.lit(""))
        return t.startswith("//") | delimiter | ((name != "") & ~name.rlike(r"\s"))

    def reduce_(s: Column) -> Column:
        level, text = _headline(F.ltrim(s, F.lit(BLANKS)), "=")
        return _inline(F.when(level > 0, text).otherwise(s), "asciidoc", "*`", "_")

    return _first(lines, title), _body(lines, dropped, reduce_)


def _underline(s: Column) -> Column:
    """Length of a line of one punctuation character, twice and more; 0 for any other."""
    mark, n = _rule(F.rtrim(s, F.lit(BLANKS)))
    return F.when((n >= 2) & mark.rlike(r"^\p{Punct}$"), n).otherwise(0)


def rst(lines: Column) -> tuple[Column, Column]:
    """Title: the first line whose next one is an underline as long as it, at least. Dropped: underlines, directives."""
    below = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), _underline)
    pairs = F.arrays_zip(lines.alias("line"), below.alias("below"))

    def title(p: Column) -> Column:
        text = X.strip(p["line"])
        return F.when((_underline(p["line"]) == 0) & (p["below"] > 0) & (p["below"] >= F.char_length(text)), text)

    def dropped(s: Column) -> Column:
        after = F.substring(F.ltrim(s, F.lit(BLANKS)), 3, 1)
        return (F.ltrim(s, F.lit(BLANKS)).startswith("..") & ((after == "") | after.rlike(r"\s"))) | (_underline(s) > 0)

    return _first(pairs, title), _body(lines, dropped, lambda s: _inline(s, "rst", "*`"))


def textile(lines: Column) -> tuple[Column, Column]:
    """Title: the first heading. A block's signature, a dot and blanks go from in front of its text."""

    def block(s: Column) -> tuple[Column, Column]:
        rest = F.substring(s, F.instr(s, ".") + 1, F.char_length(s))
        return F.when(_starts_blank(rest) & s.contains("."), F.substring_index(s, ".", 1)), F.ltrim(rest, F.lit(BLANKS))

    def title(s: Column) -> Column:
        kind, text = block(s)
        return F.when(kind.isin(HEADS), text)

    def reduce_(s: Column) -> Column:
        kind, text = block(s)
        return _inline(F.when(kind.isin(HEADS + BLOCKS), text).otherwise(s), "textile", "*@", "_")

    return _first(lines, title), _body(lines, lambda s: F.lit(False), reduce_)


def org(lines: Column) -> tuple[Column, Column]:
    """Title: the keyword's, else the first headline's. Dropped: keywords and drawers."""
    keyword = "#+title:"

    def named(s: Column) -> Column:
        return F.when(F.lower(F.substring(s, 1, len(keyword))) == keyword, F.substring(s, len(keyword) + 1, F.char_length(s)))

    def headline(s: Column) -> Column:
        level, text = _headline(s, "*")
        return F.when(level > 0, text)

    def dropped(s: Column) -> Column:
        t = F.ltrim(s, F.lit(BLANKS))
        return t.startswith("#+") | _field(t).rlike("^[A-Za-z][A-Za-z0-9_-]*$")

    return F.coalesce(_first(lines, named), _first(lines, headline)), _body(lines, dropped, lambda s: _inline(F.coalesce(headline(s), s), "org", "*~", "/_=+"))


REDUCERS = {"asciidoc": asciidoc, "rst": rst, "textile": textile, "org": org}


def plain(path: Column, content: Column) -> tuple[Column, Column]:
    """(title, body) of a page by its extension; other markups keep their text, and the file name stands in for a title."""
    ext = F.lower(F.substring_index(path, ".", -1))
    title, body = F.lit(None).cast("string"), content
    for name, reduce_ in REDUCERS.items():
        own = ext.isin([e for e, n in EXTENSIONS.items() if n == name])
        t, b = reduce_(F.split(content, "\n"))
        title, body = F.when(own, t).otherwise(title), F.when(own, b).otherwise(body)
    return F.coalesce(title, F.regexp_replace(X.base_name(path), r"\.[^.]*$", "")), body
