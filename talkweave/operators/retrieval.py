"""Keyword and link-graph retrieval for a whole table of questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkweave import rules
from talkweave.functions import scoring as sc
from talkweave.functions import text as tx
from talkweave.operators.graph import link_closure, resolve_page
from talkweave.operators.ordering import top_rows
from talkweave.operators.substring import contains_join, keyword_scores
from talkweave.session import cut_lineage

Q = "question_id"
TYPE_ORDER = ["category", "concept", "faq", "overview", "page"]


def question_keywords(questions: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Questions with their keyword list and its size."""
    kw = questions.withColumn("keywords", sc.extract_keywords(F.col("question"), stop_words))
    return kw.withColumn("n_keywords", F.size("keywords"))


def keyword_matches(kw: DataFrame, pages: DataFrame, title: Column, text: Column, page_key: str = "stem") -> DataFrame:
    """Per question and page the number of keywords in title and text, for pages with any.

    Each page is searched once for all questions together.
    """
    searched = pages.select(F.col(page_key).alias("page"), F.lower(title).alias("title"), F.lower(text).alias("text"))
    found = keyword_scores(searched, kw.select(F.col(Q).alias("question"), "keywords"))
    return found.withColumnsRenamed({"question": Q, "page": page_key})


def title_matches(questions: DataFrame, pages: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Pairs of question and page whose title matches, by shared bigrams or words."""
    t = F.lower("title")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - 1, F.lit(1))), lambda i: F.col("_t").substr(i, F.lit(2)))
    by_pair = F.filter(pairs, lambda p: (F.length(p) == 2) & p.rlike(f"[{tx.CJK}]"))
    by_word = F.filter(F.split("_t", "\\s+"), lambda w: F.length(w) > 2)
    pieces = F.when(F.col("_t").rlike(f"[{tx.CJK}]"), by_pair).otherwise(by_word)
    words = pages.select(page_key, t.alias("_t")).select(page_key, F.explode(F.array_distinct(pieces)).alias("needle"))
    needles = words.select("needle").distinct().select(F.col("needle").alias("needle_id"), "needle")
    hay = questions.select(F.col(Q).alias("text_id"), F.lower("question").alias("text"))
    found = contains_join(needles, hay, shortest=2)
    return words.join(found, words["needle"] == found["needle_id"]).select(F.col("text_id").alias(Q), page_key).distinct()


# --- rankings over one kind of page -----------------------------------------------------

def _first_by(df: DataFrame, order: list[str], k: int, key: str) -> Column:
    """The first ``k`` keys as an array from a scalar subquery; ``k`` is a small page count."""
    first = df.orderBy(*order).limit(k).agg(F.sort_array(F.collect_list(F.struct(*order, key))).alias("a"))
    return first.scalar()


def rank_categories(kw: DataFrame, cats: DataFrame, k: int = 2, include_question: bool = True) -> DataFrame:
    """Best ``k`` categories per question (category_id, ord, blob), the first ones when nothing scores.

    With ``include_question`` the question is part of the scored text, so every keyword
    counts for every category and dictionary order decides.
    """
    fill = _first_by(cats, ["ord"], k, "category_id")
    filler = kw.withColumn("_f", F.explode(fill)).select(Q, F.col("_f.category_id").alias("category_id"), F.lit(0.0).alias("score"))
    if include_question:
        n = kw.select(Q, "n_keywords")
        scored = filler.join(n, Q).select(Q, "category_id", F.col("n_keywords").cast("double").alias("score"))
    else:
        found = keyword_matches(kw, cats, F.lit(""), F.col("blob"), "category_id").select(Q, "category_id", F.col("content_score").alias("score"))
        scored = found.unionByName(filler).groupBy(Q, "category_id").agg(F.max("score").alias("score"))
    ranked = scored.join(cats.select("category_id", "ord"), "category_id")
    return top_rows(ranked, [Q], [F.desc("score"), F.col("ord")], k)


def rank_concepts(kw: DataFrame, concepts: DataFrame, k: int = 2, text_chars: int | None = None) -> DataFrame:
    """Concept pages with a positive score, best ``k`` per question."""
    text = F.col("text") if text_chars is None else tx.clip_marked(F.col("text"), text_chars)
    found = keyword_matches(kw, concepts, F.col("stem"), F.concat_ws(" ", "stem", text)).withColumn("score", F.col("content_score"))
    return top_rows(found.select(Q, "stem", "score"), [Q], [F.desc("score"), F.col("stem")], k)


def rank_faqs(kw: DataFrame, faqs: DataFrame, preferred: DataFrame, k: int = 5, include_question: bool = True,
              text_chars: int | None = None, preferred_chars: int | None = None) -> DataFrame:
    """Preferred pages (+2), then name hits, then content hits (x0.8) only where too few were found.

    ``preferred``: question_id, stem. Content hits are taken in name order up to 4k candidates.
    With ``include_question`` the question counts as part of every text.
    """
    def clip(n: int | None) -> Column:
        return F.col("text") if n is None else tx.clip_marked(F.col("text"), n)

    sizes = kw.select(Q, F.col("n_keywords").cast("double").alias("_n"))
    pref = preferred.select(Q, "stem").distinct()
    if include_question:
        first = pref.join(sizes, Q).select(Q, "stem", (F.col("_n") + 2.0).alias("score"))
    else:
        named = F.regexp_replace("stem", "^问答-", "")
        hits = keyword_matches(kw, faqs, F.lit(""), F.concat_ws(" ", named, clip(preferred_chars)))
        first = pref.join(hits, [Q, "stem"], "left").select(Q, "stem", (F.coalesce("content_score", F.lit(0.0)) + 2.0).alias("score"))
    all_hits = keyword_matches(kw, faqs, F.col("stem"), clip(text_chars))
    by_name = all_hits.filter("title_score > 0").join(pref, [Q, "stem"], "left_anti").select(Q, "stem", F.col("title_score").alias("score"))
    staged = first.unionByName(by_name)
    have = staged.groupBy(Q).agg(F.count(F.lit(1)).alias("_have"))
    short = kw.select(Q, "n_keywords").join(have, Q, "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter(F.col("_have") < k)
    if include_question:
        pool = _first_by(faqs, ["stem"], 6 * k, "stem")  # enough even if every staged page is among them
        content = short.filter("n_keywords > 0").withColumn("_p", F.explode(pool)).select(
            Q, F.col("_p.stem").alias("stem"), (F.col("n_keywords") * 0.8).alias("score"), "_have")
    else:
        content = all_hits.filter("content_score > 0").join(short, Q).select(Q, "stem", (F.col("content_score") * 0.8).alias("score"), "_have")
    content = content.join(staged.select(Q, "stem"), [Q, "stem"], "left_anti")
    content = top_rows(content, [Q], [F.col("stem")], 4 * k, "_i").filter(F.col("_i") <= 4 * k - F.col("_have")).select(Q, "stem", "score")
    return top_rows(staged.unionByName(content), [Q], [F.desc("score"), F.col("stem")], k)


# --- buckets -----------------------------------------------------------------------------------

def bucket_of(hit_type: Column) -> Column:
    return F.when(hit_type == "faq", "faq").when(hit_type == "concept", "concept").otherwise("category")


def _type_rank(hit_type: Column) -> Column:
    rank = F.lit(len(TYPE_ORDER))
    for i, t in enumerate(TYPE_ORDER):
        rank = F.when(hit_type == t, i).otherwise(rank)
    return rank


def bucket_hits(hits: DataFrame, max_pages: int = 10, caps: dict[str, int] | None = None, settled: bool = False) -> DataFrame:
    """Best score per page, the best pages overall, then the best of each bucket.

    ``hits``: question_id, stem, hit_type, score, route. Ties follow page type, then name. ``settled`` says that rows
    of one page, type and route have one score: then only the first pages of each route, among which are the
    first overall, are shuffled.
    """
    caps = caps or {"category": 2, "faq": 5, "concept": 2}
    if settled:
        by_route = Window.partitionBy(Q, "route").orderBy(F.desc("score"), _type_rank(F.col("hit_type")), F.col("stem"), F.col("hit_type"))
        hits = hits.withColumn("_n", F.dense_rank().over(by_route)).filter(F.col("_n") <= max_pages).drop("_n")
    best = hits.groupBy(Q, "stem", "hit_type").agg(F.max("score").alias("score"), F.max_by("route", "score").alias("route"))
    order = [F.desc("score"), _type_rank(F.col("hit_type")), F.col("stem")]
    top = top_rows(best, [Q], order, max_pages, "page_rank").withColumn("bucket", bucket_of(F.col("hit_type")))
    ranked = top_rows(top, [Q, "bucket"], order, max(caps.values()), "rank")
    fits = F.lit(False)
    for b, n in caps.items():
        fits = fits | ((F.col("bucket") == b) & (F.col("rank") <= n))
    return ranked.filter(fits)


# --- index routing ---------------------------------------------------------------------------------


def index_sections(index_pages: DataFrame) -> DataFrame:
    """Third-level sections of the index: heading, bullet texts, and the first typed link of each line."""
    chunks = F.split(F.concat(F.lit("\n"), "text"), "\\n###\\s+")
    rows = index_pages.select(F.posexplode(chunks).alias("_i", "chunk")).filter("_i > 0")
    # a section is known by its content, which stays the same when a task is repeated
    rows = rows.select(F.md5("chunk").alias("no"), F.transform(tx.lines(tx.strip(F.col("chunk"))), lambda s: s).alias("rows"))
    title = tx.strip(F.get("rows", F.lit(0)))
    rest = F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1)))
    bullets = F.transform(F.filter(F.transform(rest, tx.strip), lambda s: s.startswith("- ")), lambda s: F.substring(s, 3, 1 << 30))
    links = F.filter(F.transform(rest, lambda s: F.regexp_extract(s, "\\[\\[((?:分类|问答|概念)-[^\\]]+)\\]\\]", 1)), lambda s: s != "")
    return rows.select("no", title.alias("title"), rest.alias("rest"), bullets.alias("bullets"), links.alias("links"))


def parse_index_sections(index_pages: DataFrame) -> DataFrame:
    """Category entries of the index: title, overview, category link and frequent questions."""
    s = index_sections(index_pages)
    link = F.get(F.filter("links", lambda x: x.startswith("分类-")), F.lit(0))
    marked = F.transform("rest", lambda x, i: F.when(F.contains(x, F.lit("高频问题")), i))
    start = F.coalesce(F.array_min(marked), F.lit(1 << 30))
    after = F.filter("rest", lambda x, i: (i > start) & tx.strip(x).startswith("- "))
    asked = F.filter(F.transform(after, lambda x: tx.strip(F.substring(tx.strip(x), 3, 1 << 30))), lambda x: (x != "") & ~x.startswith("主题页"))
    told = F.filter("rest", lambda x, i: (i < start) & (tx.strip(x) != "") & ~x.startswith("-") & ~x.startswith("[["))
    return s.select("no", "title", F.array_join(F.transform(told, tx.strip), " ").alias("overview"), link.alias("category_link"),
                    asked.alias("questions")).filter(F.col("category_link").isNotNull())


def index_route(kw: DataFrame, index_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Category and concept pages behind the index sections and links that a keyword matches."""
    s = index_sections(index_pages)
    lines = s.select("no", F.explode(F.concat(F.array("title"), "bullets")).alias("line"))
    found = keyword_matches(kw, lines.withColumn("_k", F.concat_ws("\u0000", "no", "line")).select("_k", "line").distinct(), F.lit(""), F.col("line"), "_k")
    matched = found.filter("content_score > 0").select(Q, F.split_part("_k", F.lit("\u0000"), F.lit(1)).alias("no")).distinct()
    links = s.select("no", F.explode("links").alias("link"))
    typed = links.withColumn("page_type", F.when(F.col("link").startswith("分类-"), "category").when(F.col("link").startswith("概念-"), "concept")).filter(
        "page_type IS NOT NULL")
    resolved = resolve_page(typed, pages)
    by_section = matched.join(typed, "no").join(resolved, ["page_type", "link"]).select(Q, "stem")
    # Markdown links match by their label
    md = index_pages.select(F.explode(F.regexp_extract_all("text", F.lit("\\[([^\\]]+)\\]\\(/*(?:categories|concepts)/[^)]+\\)"), F.lit(0))).alias("m"))
    md = md.select(F.regexp_extract("m", "^\\[([^\\]]+)\\]", 1).alias("label"), F.regexp_extract("m", "/([^/)]*?)(?:\\.md)?\\)$", 1).alias("stem"))
    by_label = keyword_matches(kw, md.select("label").distinct(), F.lit(""), F.col("label"), "label").filter("content_score > 0")
    by_link = by_label.join(md, "label").join(pages.select("stem"), "stem", "left_semi").select(Q, "stem")
    return by_section.unionByName(by_link).distinct()


# --- the whole path ------------------------------------------------------------------------------------

def page_title(pages: DataFrame) -> Column:
    return F.regexp_replace("stem", "^(问答|概念|分类)-", "")


def retrieve(
    questions: DataFrame,
    pages: DataFrame,
    edges: DataFrame,
    index_pages: DataFrame,
    depth: int = 2,
    max_pages: int = 10,
    caps: dict[str, int] | None = None,
    stop_words: list[str] | None = None,
    scan_chars: int | None = None,
    fallback_selector: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked pages per question: index route, else all category and concept pages; then linked pages.

    ``edges`` are typed, resolved links (:func:`talkweave.operators.graph.typed_edges`).

    Questions with an index match follow their own links. All others share one seed set,
    so its closure is computed once and only pages with a keyword, plus the few best
    pages without one, are ranked per question. ``fallback_selector`` maps questions
    without any hit to rows (question_id, answer) holding a JSON list of page paths.
    """
    caps = caps or {"category": 2, "faq": 5, "concept": 2}
    kw = question_keywords(questions, stop_words)
    text = F.col("text") if scan_chars is None else tx.clip_marked(F.col("text"), scan_chars)
    # both feed several joins below and are written once
    seeds = cut_lineage(index_route(kw, index_pages, pages))
    routed = seeds.select(Q).distinct()
    scores = cut_lineage(keyword_matches(kw, pages, page_title(pages), text))
    n_kw = kw.select(Q, "n_keywords")

    # questions with an index match
    own = link_closure(seeds, edges, pages, depth, [Q])
    direct = seeds.join(pages.select("stem", "page_type"), "stem").select(Q, "stem", "page_type", F.lit("index_exact").alias("route"), F.lit(0.0).alias("boost"))
    linked = own.filter(F.col("page_type").isin("category", "concept", "faq")).select(Q, "stem", "page_type", F.lit("link_traversal").alias("route"), _boost())
    routed_hits = direct.unionByName(linked).join(scores, [Q, "stem"], "left")

    # questions without: one shared closure of all category and concept pages
    everything = pages.filter(F.col("page_type").isin("category", "concept")).select("stem")
    shared = link_closure(everything, edges, pages, depth).filter(F.col("page_type").isin("category", "concept", "faq")).select(
        "stem", "page_type", F.lit("link_traversal").alias("route"), _boost())
    others = n_kw.join(routed, Q, "left_anti")
    scanned = scores.join(others.select(Q), Q, "left_semi").join(shared, "stem")
    filler = top_rows(shared, ["page_type"], [F.col("stem")], max_pages, "_n").drop("_n")
    packed = filler.agg(F.collect_list(F.struct("stem", "page_type", "route", "boost")))
    rest = others.select(Q).withColumn("_p", F.explode(packed.scalar())).select(Q, "_p.*")
    rest = rest.join(scanned.select(Q, "stem"), [Q, "stem"], "left_anti").withColumns({c: F.lit(None).cast("double") for c in ("title_score", "content_score", "score")})
    cols = [Q, "stem", "page_type", "route", "boost", "title_score", "content_score"]
    hits = routed_hits.select(*cols).unionByName(scanned.select(*cols)).unionByName(rest.select(*cols)).join(n_kw, Q)
    zero = F.lit(0.0)
    scored = hits.select(
        Q, "stem", F.col("page_type").alias("hit_type"), "route",
        sc.hit_confidence(F.col("n_keywords"), F.coalesce("title_score", zero), F.coalesce("content_score", zero), F.col("route"), F.col("page_type"), F.col("boost")).alias("score"))
    out = bucket_hits(scored, max_pages, caps, settled=True).join(routed.withColumn("_r", F.lit(True)), Q, "left").withColumn(
        "note", F.when(F.col("_r"), "index_match").otherwise("global_scan")).drop("_r")
    if fallback_selector is None:
        return out
    missed = questions.join(out.select(Q).distinct(), Q, "left_anti")
    picked = parse_selection(fallback_selector(missed), pages)
    more = picked.join(scores, [Q, "stem"], "left").join(n_kw, Q).select(
        Q, "stem", F.col("page_type").alias("hit_type"), F.lit("index_llm_select").alias("route"),
        sc.hit_confidence(F.col("n_keywords"), F.coalesce("title_score", zero), F.coalesce("content_score", zero), F.lit("index_llm_select"), F.col("page_type")).alias("score"))
    return out.unionByName(bucket_hits(more, max_pages, caps).withColumn("note", F.lit("index_llm_select")))


def _boost() -> Column:
    return F.when(F.col("page_type") == "faq", F.lit(0.10)).otherwise(F.lit(0.05)).alias("boost")


def parse_selection(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (question_id, answer JSON list of paths) to existing pages in listed order."""
    raw = F.regexp_replace(F.regexp_replace(tx.strip(F.col("answer")), "^```(?:json)?\\s*", ""), "\\s*```\\z", "")
    listed = answers.select(Q, F.posexplode(F.from_json(raw, "array<string>")).alias("ord", "item"))
    rel = F.regexp_replace(F.replace("item", F.lit("\\"), F.lit("/")), "^/+", "")
    return listed.select(Q, "ord", rel.alias("rel_path")).join(pages.select("rel_path", "stem", "page_type"), "rel_path")


def excerpts(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with path, title and the excerpt shown for their page type."""
    t = F.col("text")
    answer = tx.standard_answer(t)
    faq = F.when(answer != "", F.concat(F.lit("## 客户问法\n（见原文）\n\n## 标准回答\n\n"), answer)).otherwise(F.substring(t, 1, 4000))
    kind = F.col("hit_type")
    body = F.when(kind == "faq", faq).when(kind == "concept", tx.clip_marked(t, 2500)).when(kind == "category", t).otherwise(tx.clip_marked(t, 4000))
    title = F.when(kind == "overview", "知识库总览").otherwise(page_title(pages))
    return hits.join(pages.select("stem", "rel_path", "text"), "stem").withColumn("title", title).withColumn("excerpt", body).drop("text")


def prompt_context(questions: DataFrame, hits: DataFrame, chars: dict[str, int] | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """One rendered context per question from its (at most nine) hits.

    ``hits`` is the output of :func:`excerpts`.
    """
    chars = chars or {"category": 6000, "faq": 4000, "concept": 2000}
    heads = {"category": "## 主题页", "faq": "## FAQ 标准答", "concept": "## 相关概念"}
    marks = {"category": "\n\n…（主题页已截断）", "faq": "\n\n…（FAQ 已截断）", "concept": "\n\n…（概念页已截断）"}
    body, order = F.lit(None).cast("string"), F.lit(9)
    for i, b in enumerate(heads):
        body = F.when(F.col("bucket") == b, tx.clip_marked(F.col("excerpt"), chars[b], marks[b])).otherwise(body)
        order = F.when(F.col("bucket") == b, i).otherwise(order)
    block = F.concat(F.lit("### "), "title", F.lit(" ["), "route", F.lit("]\n来源：`"), "rel_path", F.lit("`\n\n"), body, F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), "rank", "bucket", block.alias("block"), "rel_path")))
    packed = hits.groupBy(Q).agg(rows.alias("rows"), F.max("note").alias("note"))
    parts = []
    for b, h in heads.items():
        mine = F.transform(F.filter("rows", _in_bucket(b)), lambda r: r["block"])
        parts.append(F.when(F.size(mine) > 0, F.concat(F.lit(h + "\n"), F.array_join(mine, "\n"))))
    sources = F.concat(F.lit("## Sources\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- `"), r["rel_path"], F.lit("`"))), "\n"))
    kw = question_keywords(questions, stop_words).join(packed, Q, "left")
    words = F.when(F.col("n_keywords") > 0, F.array_join("keywords", ", ")).otherwise("（无）")
    top = F.concat(F.lit("# 客服知识库检索结果（程序已检索，请据此合成答复）\n用户问题："), "question", F.lit("\n检索关键词："), words,
                   F.coalesce(F.concat(F.lit("\n检索说明："), "note"), F.lit("")),
                   F.lit("\n\n要求：先给结论，再简短步骤；口径以「标准回答」为准；注明来源路径；无依据则说明未收录。\n"))
    found = F.array_join(F.array_compact(F.array(*parts, sources)), "\n")
    none = F.lit("（未命中 wiki 内容，请明确告知用户知识库未收录该问题。）")
    return kw.select(Q, tx.strip(F.concat(top, F.lit("\n"), F.when(F.col("rows").isNotNull(), found).otherwise(none))).alias("context"))


def _in_bucket(name: str):
    return lambda r: r["bucket"] == name


def retrieval_audit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per turn: whether the tool ran, and distinct sources and notes in order of first sight.

    ``hits``: keys, call, ord, rel_path, note. A call returns at most nine pages; sources
    are merged before they are gathered.
    """
    def firsts(column: str, name: str) -> DataFrame:
        seen = hits.filter(F.coalesce(column, F.lit("")) != "").groupBy(*keys, column).agg(F.min(F.struct("call", "ord")).alias("_f"))
        packed = F.sort_array(F.collect_list(F.struct("_f", column)))
        return seen.groupBy(*keys).agg(F.transform(packed, lambda x: x[column]).alias(name))

    turns = hits.select(*keys).distinct().withColumn("tool_called", F.lit(True))
    return turns.join(firsts("rel_path", "wiki_sources"), keys, "left").join(firsts("note", "retrieval_notes"), keys, "left")
