"""Visible text of HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkweave.functions.text import let, strip

HIDDEN = ["script", "style", "noscript"]
#: Named characters, in the order in which they are replaced; the ampersand comes last.
NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("hellip", "…"), ("ndash", "–"),
         ("mdash", "—"), ("laquo", "«"), ("raquo", "»"), ("ldquo", "“"), ("rdquo", "”"), ("lsquo", "‘"), ("rsquo", "’"), ("bull", "•"), ("times", "×"), ("amp", "&")]


def _between_text() -> str:
    """Everything that stands between two pieces of visible text: comments, declarations, hidden elements, tags."""
    hidden = [f"<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)" for tag in HIDDEN]
    tag = "</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-z][^>]*>"
    return "(?is)" + "|".join(["<!--.*?(?:-->|\\z)", "<[!?][^>]*>", *hidden, tag])


def _numbered(part: Column) -> Column:
    """A piece that follows ``&#``: the character of its number, then the rest."""
    code = F.regexp_extract(part, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", 1)
    number = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
    usable = (code != "") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(usable, F.concat(char, F.regexp_replace(part, "^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", ""))).otherwise(F.concat(F.lit("&#"), part))


def unescape(c: Column) -> Column:
    """Named and numbered character references as characters; the closing semicolon may be missing."""
    parts = F.transform(F.split(c, "&#"), lambda p, i: F.when(i == 0, p).otherwise(_numbered(p)))
    c = F.when(F.contains(c, F.lit("&#")), F.array_join(parts, "")).otherwise(c)
    for name, char in NAMED:
        c = F.regexp_replace(c, f"&{name};?", char.replace("$", "\\$"))
    return c


def html_to_text(c: Column) -> Column:
    """Visible pieces of text, one a line; without scripts, styles and comments. NULL counts as empty."""
    pieces = F.split(F.coalesce(c, F.lit("")), _between_text())
    shown = F.transform(pieces, lambda p: let(unescape(p), strip))
    return F.array_join(F.filter(shown, lambda p: p != ""), "\n")
