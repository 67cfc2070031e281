"""Small builders for the SQL twins (DuckDB dialect)."""

from __future__ import annotations

import re

from talkweave.functions.text import BLANK, CJK, KEY_PUNCTUATION


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def strip(x: str) -> str:
    return sub(x, f"^[{BLANK}]+|[{BLANK}]+\\z")


def one_space(x: str, to: str = " ") -> str:
    return sub(x, f"[{BLANK}]+", to)


def cjk_count(x: str) -> str:
    return f"length({sub(x, f'[^{CJK}]')})"


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def normalize_text(x: str) -> str:
    x = sub(x, "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]")
    x = sub(x, "\\r\\n?", "\n")
    x = sub(x, "[ \\t]+\\n", "\n")
    return strip(sub(x, "\\n{3,}", "\n\n"))


def clean_title(x: str) -> str:
    return strip(sub(normalize_text(x), f"(?s)[{BLANK}]*[|｜].*"))


def sanitize_filename(x: str, cap: int = 72) -> str:
    x = sub(x, "[\\x{10000}-\\x{10ffff}\\x{2600}-\\x{27bf}\\x{fe0f}\\x{200d}]")
    x = sub(x, "[\\\\/:*?\"<>|\\r\\n]")
    x = sub(one_space(strip(x), "-"), "-{2,}", "-")
    x = sub(x, "^[- .]+|[- .]+\\z")
    cut = sub(f"substr(s, 1, {cap})", "[\\-的了吗呢]+\\z")
    return f"(SELECT coalesce(nullif(CASE WHEN length(s) > {cap} THEN {cut} ELSE s END, ''), '未命名') FROM (SELECT {x} AS s))"


def plain_filename(x: str) -> str:
    return sub(one_space(sub(x, "[\\\\/:*?\"<>|\\r\\n]"), ""), "^[. ]+|[. ]+\\z")


def question_key(x: str) -> str:
    return f"lower({sub(one_space(x, ''), f'[{KEY_PUNCTUATION}]')})"


def link_key(x: str) -> str:
    x = sub(sub(strip(x), "\\.md\\z"), "-[0-9a-f]{6,8}\\z")
    return f"lower({sub(one_space(x, ''), f'[{KEY_PUNCTUATION}\\-_/]+')})"


URI = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?"


def uri(x: str, part: int) -> str:
    return f"regexp_extract({x}, {q(URI)}, {part})"


def host(x: str) -> str:
    return f"lower({sub(sub(uri(x, 2), '^.*@'), ':[^:]*\\z')})"


def find_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def distinct_in_order(x: str) -> str:
    return f"(SELECT list_filter(l, lambda v, i: list_position(l, v) = i) FROM (SELECT {x} AS l))"


def is_noise(x: str, patterns: list[str], min_chars: int) -> str:
    s = strip(f"coalesce({x}, '')")
    extra = f" OR {hit(s, any_of(patterns))}" if patterns else ""
    return f"(length({s}) < {min_chars} OR lower({s}) = 'nan' OR {hit(s, '^(\\[[^\\]]+\\])+$')}{extra})"


def is_polite(x: str, patterns: list[str]) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"({s} = '' OR {hit(s, '^(\\[[^\\]]+\\])+$')} OR {hit(s, any_of(patterns))})"


def keywords(x: str, stop: list[str], cap: int = 40) -> str:
    stop_list = "[" + ", ".join(q(s) for s in stop) + "]"
    run_grams = " || ".join(
        f"(CASE WHEN length(r) >= {max(n, 3)} THEN list_transform(range(1, length(r) - {n} + 2), lambda i: substr(r, i::INT, {n})) "
        f"ELSE CAST([] AS VARCHAR[]) END)" for n in (2, 3, 4))
    cjk = f"flatten(list_transform({find_all(strip(x), f'[{CJK}]{{2,}}')}, lambda r: [r] || {run_grams}))"
    latin = find_all(strip(x), "[A-Za-z][A-Za-z0-9_.-]+")
    kept = (f"list_filter(list_transform({cjk} || {latin}, lambda t: lower(t)), "
            f"lambda t: length(t) >= 2 AND NOT list_contains({stop_list}, t))")
    return f"({distinct_in_order(kept)})[1:{cap}]"




def filled(template: str, **values: str) -> str:
    """``template`` with each ``{name}`` replaced by an SQL expression; null becomes empty."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [q(p) if i % 2 == 0 else f"coalesce(CAST({values[p]} AS VARCHAR), '')" for i, p in enumerate(parts)]
    return "(" + " || ".join(cells) + ")"
