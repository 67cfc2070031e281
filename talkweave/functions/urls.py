"""URL expressions. Parts follow the generic URI split, so odd characters never yield NULL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from talkweave import rules
from talkweave.functions.text import BLANK, WORD, CJK, sanitize_filename, clean_page_title

URI = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?"
URL_IN_MESSAGE = f"(?i)https?://[^{BLANK}\\]<>)\"'{CJK}，。；、]+"
URL_IN_QUESTION = f"(?i)https?://[^{BLANK}\\]\\)\"'<>，。；、]+"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, URI, 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(c, URI, 2)


def path(c: Column) -> Column:
    return F.regexp_extract(c, URI, 3)


def query(c: Column) -> Column:
    return F.regexp_extract(c, URI, 4)


def host(c: Column) -> Column:
    name = F.regexp_replace(authority(c), "^.*@", "")
    name = F.when(name.startswith("["), F.regexp_extract(name, "^\\[([^\\]]*)\\]", 1)).otherwise(
        F.regexp_replace(name, ":[^:]*\\z", ""))
    return F.lower(name)


def drop_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)#.*", "")


def unquote(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), c)


def extract_urls(c: Column) -> Column:
    """Links of a chat message in order, duplicates kept; stops at CJK text."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL_IN_MESSAGE), F.lit(0))
    cut = F.transform(found, lambda u: F.regexp_replace(u, "[.,;:)】」]+\\z", ""))
    return F.filter(cut, lambda u: u.startswith("http"))


def extract_urls_distinct(c: Column) -> Column:
    """Links of a question in order of first sight, each once."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL_IN_QUESTION), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?）)\\]}]+\\z", "")))


def front_matter_urls(c: Column) -> Column:
    """The ``file_urls`` list of a session document's front matter."""
    matter = F.regexp_extract(c, "(?s)^---(.*?)---", 1)
    block = F.regexp_extract(matter, "(?m)^\\s*file_urls:\\s*\\n((?:  .*\\n?)*)", 1)
    items = F.regexp_extract_all(block, F.lit("(?m)^  - (.*)$"), F.lit(1))
    cleaned = F.transform(items, lambda u: F.regexp_replace(F.trim(u), "^[\"']+|[\"']+\\z", ""))
    return F.filter(cleaned, lambda u: u.startswith("http"))


def session_urls(c: Column) -> Column:
    """Front-matter links first, then links of the text that were not listed there."""
    listed = front_matter_urls(c)
    return F.concat(listed, F.array_except(extract_urls(c), listed))


def url_extension(c: Column) -> Column:
    by_path = F.regexp_extract(F.lower(unquote(path(c))), "(\\.[a-z0-9]+)(?:\\?|\\z)", 1)
    q = F.concat(F.lit("&"), query(c))

    def named(key: str) -> Column:
        value = F.regexp_extract(q, f"&{key}=([^&]+)", 1)
        return F.regexp_extract(F.lower(unquote(unquote(value))), "(\\.[a-z0-9]+)\\z", 1)

    choices = [by_path] + [named(k) for k in ("fileName", "filename", "file_name")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in choices], F.lit(""))


def is_image_url(c: Column, content_type: Column | None = None) -> Column:
    hit = url_extension(c).isin(rules.IMAGE_EXTENSIONS)
    return hit if content_type is None else hit | F.coalesce(content_type, F.lit("")).startswith("image/")


def url_kind(c: Column, content_type: Column | None = None) -> Column:
    """``image`` by path suffix, host hint or content type; otherwise ``page``."""
    p, h = F.lower(path(c)), host(c)
    checks = [p.endswith(s) for s in rules.IMAGE_SUFFIXES] + [F.contains(h, F.lit(x)) for x in rules.IMAGE_HOST_HINTS]
    if content_type is not None:
        checks.append(F.coalesce(content_type, F.lit("")).startswith("image/"))
    return F.when(reduce(lambda a, b: a | b, checks), "image").otherwise("page")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _private_ipv4(h: Column) -> Column:
    """Private, loopback, link-local and reserved ranges, compared as one number."""
    quads = F.array(*[F.regexp_extract(h, "^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\z", i).try_cast("long") for i in range(1, 5)])
    number = F.aggregate(quads, F.lit(0).cast("long"), lambda n, q: F.when((q >= 0) & (q <= 255), n * 256 + q))
    ranges = [
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
        ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
        ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
    ]

    def inside(n: Column, base: str, bits: int) -> Column:
        low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
        return n.between(low, low + (1 << (32 - bits)) - 1)

    return F.coalesce(_once(number, lambda n: reduce(lambda a, b: a | b, [inside(n, *r) for r in ranges])), F.lit(False))


def _private_ipv6(h: Column) -> Column:
    return F.contains(h, F.lit(":")) & h.rlike("^(::1?\\z|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:|100::)")


def is_safe_url(c: Column) -> Column:
    """http(s) with a host that is neither local nor in a private address range."""
    def safe(h: Column) -> Column:
        local = h.isin("localhost", "127.0.0.1", "::1") | h.endswith(".local")
        return scheme(c).isin("http", "https") & (h != "") & ~local & ~_private_ipv4(h) & ~_private_ipv6(h)

    return _once(host(c), safe)


def url_slug(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "(?s)\\?.*", ""), "/+\\z", "")
    last = F.regexp_extract(bare, "[^/]*\\z", 0)
    slug = F.regexp_replace(F.regexp_replace(last, f"[^{WORD}\\-]+", "-"), "^-+|-+\\z", "")
    name = F.coalesce(F.nullif(F.lower(slug), F.lit("")), F.lit("url"))
    return F.concat(name, F.lit("-"), F.substring(F.md5(c), 1, 10))


def segment_label(c: Column) -> Column:
    """Label of one path segment: dictionary entry, else camelCase split with hyphens."""
    seg = F.regexp_replace(c, "(?i)\\.html?\\z", "")
    pairs = F.create_map(*[F.lit(x) for kv in rules.PATH_LABELS.items() for x in kv])
    kebab = F.replace(F.regexp_replace(seg, "([a-z])([A-Z])", "$1-$2"), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(pairs, F.lower(seg)), kebab)


def url_path_label(c: Column) -> Column:
    parts = F.filter(F.split(path(c), "/"), lambda p: (p != "") & ~F.lower(p).isin(rules.PATH_BOILERPLATE))
    last_two = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(parts) == 0, "首页").otherwise(F.array_join(F.transform(last_two, segment_label), "-"))


def crawlable_url(c: Column, base: Column, prefix: str = "", allow_query: bool = False) -> Column:
    """Keep http(s) links of the same host that are neither files nor sign-in pages."""
    p, low = F.lower(path(c)), F.lower(c)
    bad = [p.endswith(e) for e in rules.CRAWL_SKIP_EXTENSIONS]
    bad += [F.contains(low, F.lit(s)) for s in rules.CRAWL_SKIP_SEGMENTS]
    if not allow_query:
        bad.append(query(c) != "")
    ok = ~reduce(lambda a, b: a | b, bad) & (authority(c) == authority(base)) & c.startswith("http")
    return ok & path(c).startswith(prefix) if prefix else ok


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``, without the fragment."""
    href = drop_fragment(F.trim(href))
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*\\z", "")
    raw = F.when(path(href).startswith("/"), path(href)).otherwise(
        F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), path(href)))
    steps = F.aggregate(
        F.split(raw, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    clean = F.array_join(steps, "/")
    tail = F.when(query(href) != "", F.concat(F.lit("?"), query(href))).otherwise("")
    return (
        F.when(href == "", drop_fragment(base))
        .when(scheme(href) != "", href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(path(href) == "", F.concat(root, path(base), tail))
        .otherwise(F.concat(root, clean, tail))
    )


def page_core_name(title: Column, h2: Column, url: Column) -> Column:
    """File name that says what a page is about: title with section or path hint."""
    core, h2 = clean_page_title(title), F.coalesce(h2, F.lit(""))
    hint = segment_label(F.regexp_extract(F.regexp_replace(path(url), "/+\\z", ""), "[^/]*\\z", 0))
    base = (
        F.when((h2 != "") & ~F.contains(core, h2),
               F.when(core != "", F.concat(core, F.lit("-"), h2)).otherwise(h2))
        .when((hint != "") & (hint != core) & (hint != "html") & (core != ""), F.concat(core, F.lit("-"), hint))
        .when(core != "", core)
        .otherwise(url_path_label(url))
    )
    return sanitize_filename(base)


def url_category(c: Column) -> Column:
    """First ordered path rule that matches."""
    u = F.lower(F.coalesce(c, F.lit("")))
    result = F.lit(rules.URL_CATEGORY_DEFAULT)
    for area, fragments, category in reversed(rules.URL_CATEGORY_RULES):
        test = F.contains(u, F.lit(area))
        if fragments:
            any_hit = [reduce(lambda a, b: a & b, [F.contains(u, F.lit(x)) for x in f]) for f in fragments]
            test = test & reduce(lambda a, b: a | b, any_hit)
        result = F.when(test, category).otherwise(result)
    return result
