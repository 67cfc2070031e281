"""Text expressions: cleaning, message predicates, keys and captions.

Every function maps Columns to a Column and stays inside the JVM. Regex classes are
written out (no bare ``\\w``; explicit blank set) so that they mean the same on any
regex engine and cover full-width text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from talkweave import rules

BLANK = "\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WORD = "\\p{L}\\p{N}_"
CJK = "\\x{4e00}-\\x{9fff}"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
KEY_PUNCTUATION = "？?！!。．.,，、；;：:\"'“”【】\\[\\]()（）"


#: The members of ``BLANK`` as characters.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip_chars(c: Column, chars: str) -> Column:
    """Drop any run of the given regex-class members from the end."""
    return F.regexp_replace(c, f"[{chars}]+\\z", "")


def collapse_blanks(c: Column, to: str = " ") -> Column:
    return F.regexp_replace(c, f"[{BLANK}]+", to)


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def any_of(patterns: list[str]) -> str:
    """One case-insensitive alternation for a list of patterns."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{CJK}]"))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a function of one Column).

    Without this, an expression used inside a lambda is computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- cleaning --------------------------------------------------------------------

def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was decoded as Latin-1, when that yields CJK characters."""
    latin = c.rlike("^[\\x00-\\x{FF}]*\\z")
    hinted = c.rlike("[ÃÂâæåèéêë].")
    raw = F.encode(F.when(latin & hinted, c).otherwise(F.lit("")), "ISO-8859-1")
    fixed = F.try_validate_utf8(raw.cast("string"))
    return F.when(latin & hinted & fixed.rlike(f"[{CJK}]"), fixed).otherwise(c)


def normalize_text(c: Column) -> Column:
    c = repair_mojibake(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]", "")
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "[ \\t]+\\n", "\n")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return strip(c)


def clean_page_title(c: Column) -> Column:
    return strip(F.regexp_replace(normalize_text(c), f"(?s)[{BLANK}]*[|｜].*", ""))


def sanitize_filename(c: Column, max_len: int = 72) -> Column:
    c = F.regexp_replace(c, "[\\x{10000}-\\x{10ffff}\\x{2600}-\\x{27bf}\\x{fe0f}\\x{200d}]", "")
    c = F.regexp_replace(c, "[\\\\/:*?\"<>|\\r\\n]", "")
    c = F.regexp_replace(collapse_blanks(strip(c), "-"), "-{2,}", "-")
    c = F.regexp_replace(c, "^[- .]+|[- .]+\\z", "")
    c = F.when(F.length(c) > max_len, rstrip_chars(head(c, max_len), "\\-的了吗呢")).otherwise(c)
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("未命名"))


def sanitize_filename_text(c: Column) -> Column:
    c = collapse_blanks(F.regexp_replace(c, "[\\\\/:*?\"<>|\\r\\n]", ""), "")
    return F.regexp_replace(c, "^[. ]+|[. ]+\\z", "")


def truncate_text(c: Column, n: int = 48) -> Column:
    c = strip(collapse_blanks(c))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(head(c, n - 1), F.lit("…")))


def clip_marked(c: Column, n: int, mark: str = "\n\n…（已截断）") -> Column:
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit(mark))).otherwise(c)


def doc_summary(c: Column, max_len: int = 300) -> Column:
    c = strip(collapse_blanks(F.regexp_replace(c, "[#*`\\[\\]()\\-_]", " ")))
    return F.when(F.length(c) > max_len, F.concat(head(c, max_len), F.lit("..."))).otherwise(c)


def first_line_summary(title: Column, c: Column) -> Column:
    title = strip(F.coalesce(title, F.lit("")))
    trimmed = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    good = F.filter(trimmed, lambda s: (F.length(s) >= 20) & ~s.startswith("#"))
    first = F.get(good, F.lit(0))
    short = F.when(F.length(first) > 120, F.concat(head(first, 120), F.lit("…"))).otherwise(first)
    return F.concat(title, F.lit("："), F.coalesce(short, F.lit("平台帮助文档，介绍相关功能与操作步骤。")))


def strip_code_blocks(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)```.*?```", "")


# --- message predicates ----------------------------------------------------------

def is_noise(c: Column, patterns: list[str] | None = None, min_chars: int = 2, stripped: bool = False) -> Column:
    """``stripped``: the text is known to have no blanks at its ends."""
    s = c if stripped else strip(F.coalesce(c, F.lit("")))
    patterns = rules.NOISE_PATTERNS if patterns is None else patterns
    checks = [F.length(s) < min_chars, F.lower(s) == "nan", s.rlike(rules.EMOJI_ONLY)]
    if patterns:
        checks.append(s.rlike(any_of(patterns)))
    return reduce(lambda a, b: a | b, checks)


def is_politeness_only(c: Column, patterns: list[str] | None = None, stripped: bool = False) -> Column:
    s = c if stripped else strip(F.coalesce(c, F.lit("")))
    patterns = rules.POLITENESS_PATTERNS if patterns is None else patterns
    hit = (s == "") | s.rlike(rules.EMOJI_ONLY)
    return hit | s.rlike(any_of(patterns)) if patterns else hit


def is_substantive(c: Column, noise: list[str] | None = None, polite: list[str] | None = None,
                   min_chars: int = 4) -> Column:
    return ~is_noise(c, noise) & ~is_politeness_only(c, polite) & (F.length(c) >= min_chars)


def substantive_score(role: Column, c: Column, visitor_cjk: int = 5, agent_cjk: int = 6, min_chars: int = 10,
                      agent: str = rules.AGENT, visitor: str = rules.VISITOR) -> Column:
    from talkweave.functions.urls import extract_urls

    n = cjk_count(c)
    return (
        F.when(F.size(extract_urls(c)) > 0, 2)
        .when((role == visitor) & (n >= visitor_cjk), 1)
        .when((role == agent) & (n >= agent_cjk), 1)
        .when(F.length(c) >= min_chars, 1)
        .otherwise(0)
    )


def _kept_lines(c: Column) -> Column:
    trimmed = F.transform(lines(F.coalesce(c, F.lit(""))), strip)
    return F.filter(
        trimmed,
        lambda s: (s != "")
        & ~s.startswith("_fetched_at:")
        & ~s.startswith("## 图片文字识别")
        & ~s.startswith("_未识别")
        & ~s.startswith(">"),
    )


def is_meaningful_text(c: Column, min_chars: int = 20, noise: list[str] | None = None,
                       polite: list[str] | None = None) -> Column:
    def carries_content(s: Column) -> Column:
        content = (
            (cjk_count(s) >= 4)
            | s.rlike("[A-Za-z]{4,}")
            | ((F.length(s) >= 12) & s.rlike(f"[{CJK}A-Za-z0-9]"))
        )
        return content & ~is_noise(s, noise) & ~is_politeness_only(s, polite)

    def judge(kept: Column) -> Column:
        body = F.array_join(kept, "\n")
        return (F.length(body) >= min_chars) & ~body.rlike(any_of(rules.OCR_LOW_VALUE_PATTERNS)) & F.exists(kept, carries_content)

    return let(_kept_lines(c), judge)


def is_meaningful_ocr_text(c: Column, min_chars: int = 15) -> Column:
    low_value = "|".join(f"(?:{p})" for p in rules.OCR_LOW_VALUE_PATTERNS)
    trimmed = F.transform(lines(F.coalesce(c, F.lit(""))), strip)
    kept = F.filter(trimmed, lambda s: (s != "") & ~s.rlike(low_value))
    return F.length(strip(F.array_join(kept, "\n"))) >= min_chars


def labelled_ocr_text(c: Column) -> Column:
    """OCR text with the note that fits how much was recognised."""
    s = strip(F.coalesce(c, F.lit("")))
    few = F.concat(F.lit("（本地 OCR 仅识别到少量文字）\n"), s,
                   F.lit("\n\n说明：本地 OCR 无法解析标注含义；若图中有圈选/箭头，请以客户文字为准。"))
    rich = F.concat(s, F.lit("\n\n说明：以上为本地 OCR 提取的文字；若图中有客户标注（箭头、框选等），请结合客户描述理解。"))
    none = F.lit("（本地 OCR 未识别到有效文字；截图中的箭头/框选标注需结合客户文字说明理解）")
    return F.when(s == "", none).when(is_meaningful_ocr_text(s), rich).otherwise(few)


# --- keys and captions -----------------------------------------------------------

def normalize_question(c: Column) -> Column:
    return F.lower(F.regexp_replace(collapse_blanks(c, ""), f"[{KEY_PUNCTUATION}]", ""))


def faq_core_title(c: Column, max_len: int = 42) -> Column:
    q = rstrip_chars(strip(c), "？?！!。.")
    q = F.regexp_replace(
        q, f"(?iu)^(你好|您好|请问|麻烦|想问|老师|应用支持工程师|人工客服)[，,、{BLANK}]*", "")
    q = F.regexp_replace(q, f"^[@＠][^{BLANK}]+[，,、{BLANK}]*", "")
    q = sanitize_filename_text(q)
    q = F.when(F.length(q) > max_len, rstrip_chars(head(q, max_len), "，、的了吗呢")).otherwise(q)
    return F.coalesce(F.nullif(q, F.lit("")), F.lit("未命名问题"))


def norm_link_key(c: Column) -> Column:
    c = F.regexp_replace(strip(c), "\\.md\\z", "")
    c = collapse_blanks(F.regexp_replace(c, "-[0-9a-f]{6,8}\\z", ""), "")
    return F.lower(F.regexp_replace(c, f"[{KEY_PUNCTUATION}\\-_/]+", ""))


def norm_faq_key(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(strip(c), "\\.md\\z", ""), "-[0-9a-f]{6,8}\\z", "")
    c = collapse_blanks(F.replace(c, F.lit("问答-"), F.lit("")), "")
    return F.lower(F.regexp_replace(c, f"[{KEY_PUNCTUATION}\\-_/]+", ""))


def alias_key(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(strip(c), "\\.md\\z", ""), "[ \\x{3000}]", "")
    return F.regexp_replace(c, "[-_]{2,}", "-")


def soft_alias_key(c: Column) -> Column:
    return F.regexp_replace(alias_key(c), f"[^{WORD}\\-（）()]+", "")


def session_slug(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("."), F.lit("-")), f"[^{WORD}\\-]+", "-")
    return head(F.lower(F.regexp_replace(c, "^-+|-+\\z", "")), 72)


def safe_session_id(c: Column) -> Column:
    return head(F.regexp_replace(c, f"[^{WORD}\\-]", "-"), 64)


def extraction_session_id(stem: Column) -> Column:
    """``session_<uuid>-<stamp>`` becomes ``<uuid>``; other names keep their rest."""
    rest = F.regexp_replace(stem, "^session_", "")
    parts = F.split(rest, "-")
    dated = stem.startswith("session_") & (F.size(parts) >= 6)
    return F.when(dated, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-")).otherwise(rest)


def category_slug(c: Column) -> Column:
    c = F.regexp_replace(c, "[（(]([^）)]+)[）)]", "-$1")
    return sanitize_filename_text(F.regexp_replace(c, f"[/{BLANK}]+", "-"))


def taxonomy_id(c: Column) -> Column:
    c = F.regexp_replace(F.lower(strip(c.cast("string"))), f"[^{WORD}\\-]", "-")
    return F.regexp_replace(c, "^-+|-+\\z", "")


def role_label(sender_type: Column) -> Column:
    label = F.lit(rules.OTHER_ROLE)
    for code, name in rules.ROLE_LABELS.items():
        label = F.when(sender_type == code, name).otherwise(label)
    return label


# --- splitting -------------------------------------------------------------------

def punct_segments(c: Column, max_run: int = 120, boundaries: str = rules.SEGMENT_BOUNDARIES) -> Column:
    """Speakable pieces: cut after every boundary mark; a tail without marks is cut by length."""
    group = "".join("\\" + ch if ch in "[]()" else ch for ch in boundaries)
    pieces = F.regexp_extract_all(c, F.lit(f"[^{group}]*[{group}]|[^{group}]{{1,{max_run}}}"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def sentences_by_stop(c: Column, stop: str = "。", default: str = "收到你的问题。") -> Column:
    parts = F.filter(F.transform(F.split(c, f"[{stop}]"), strip), lambda s: s != "")
    return F.when(strip(c) == "", F.array(F.lit(default))).otherwise(parts)


def first_line(c: Column) -> Column:
    return F.regexp_extract(c, "^[^\\n]*", 0)


def md_section(c: Column, heading: str) -> Column:
    """Text between ``## heading`` and the next second-level heading."""
    return strip(F.regexp_extract(c, f"(?s){heading}\\s*\\n+(.*?)(?=\\n##\\s|\\z)", 1))


def standard_answer(c: Column) -> Column:
    return md_section(c, rules.ANSWER_HEADING)


# --- time bounds -----------------------------------------------------------------

def parse_time_bound(c: Column, end_of_day: bool = False) -> Column:
    """Day or ISO text to a UTC instant; blank gives NULL, malformed text raises."""
    s = strip(c)
    day = F.to_timestamp(F.concat(s, F.lit(" 23:59:59" if end_of_day else " 00:00:00")), "yyyy-MM-dd HH:mm:ss")
    zoned = s.rlike("(Z|[+-]\\d{2}:\\d{2})\\z")
    moment = F.when(zoned, s).otherwise(F.concat(s, F.lit("Z"))).cast("timestamp")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("timestamp")).when(F.length(s) == 10, day).otherwise(moment)
