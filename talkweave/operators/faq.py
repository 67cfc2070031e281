"""Question-and-answer entries: extraction from sessions, merging, concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.operators.messages import CHINESE, KEY, MessageRules, substantive_messages
from talkweave.operators.ordering import collect_in_order, first_distinct, in_parts, top_rows, with_ordinal
from talkweave.operators.rulematch import best_category, category_rules, concept_rules, match_rules, rule_ids

STRINGS = "array<string>"
LIST_CAPS = {"variants": 12, "steps": 10, "links": 10, "tags": 8, "related_wikilinks": 12}


def _none() -> Column:
    return F.array().cast(STRINGS)


# --- link sections ------------------------------------------------------------------

def clean_link_body(c: Column) -> Column:
    kept = F.filter(
        F.transform(tx.lines(c), tx.strip),
        lambda s: (s != "") & ~s.startswith("_fetched_at:") & ~s.startswith("## 图片文字识别") & ~s.startswith("_未识别")
        & (s != "​"))
    return F.array_join(kept, "\n")


def parse_link_blocks(c: Column, max_body: int | None = None, min_chars: int = 20) -> Column:
    """Blocks of a link section as (url, title, body, kind); only meaningful bodies are kept.

    Bodies are whole unless ``max_body`` is given.
    """
    header = "### \\[(?:网页|图片 OCR)\\][^\\n]*"
    chunks = F.split(F.coalesce(c, F.lit("")), f"(?m)^(?=[ \\t]*{header}$)")

    def block(chunk: Column) -> Column:
        kind = F.coalesce(F.nullif(F.regexp_extract(chunk, "\\A\\s*### \\[(网页|图片 OCR)\\]", 1), F.lit("")), F.lit("网页"))
        title = tx.strip(F.regexp_extract(chunk, "\\A\\s*### \\[(?:网页|图片 OCR)\\]\\s*([^\\n]+)", 1))
        rows = F.transform(tx.lines(chunk), tx.strip)
        named = F.filter(rows, lambda s: s.startswith("来源:"))
        source = tx.strip(F.regexp_replace(F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")), "来源:", ""))
        url = F.coalesce(F.nullif(source, F.lit("")), title)
        body = clean_link_body(F.array_join(F.filter(rows, lambda s: ~s.startswith("来源:") & ~s.startswith("#")), "\n"))
        return F.struct(url.alias("url"), F.coalesce(F.nullif(title, F.lit("")), url).alias("title"), body.alias("body"), kind.alias("kind"))

    blocks = F.filter(F.transform(chunks, block),
                      lambda b: b["url"].startswith("http") & tx.is_meaningful_text(b["body"], min_chars))
    if max_body is None:
        return blocks
    return F.transform(blocks, lambda b: F.struct(
        b["url"].alias("url"), b["title"].alias("title"), F.substring(b["body"], 1, max_body).alias("body"), b["kind"].alias("kind")))


def steps_from_blocks(blocks: Column, cap: int = 12, pattern: str = rules.STEP_WORDS_BLOCK) -> Column:
    rows = F.flatten(F.transform(blocks, lambda b: F.transform(tx.lines(b["body"]), tx.strip)))
    return F.slice(F.array_distinct(F.filter(rows, lambda s: (F.length(s) >= 6) & s.rlike(f"(?iu){pattern}"))), 1, cap)


def normalize_steps(steps: Column, cap: int = 10) -> Column:
    tidy = F.filter(F.transform(steps, lambda s: tx.collapse_blanks(tx.strip(s))), lambda s: F.length(s) >= 6)
    cut = F.transform(tidy, lambda s: F.when(F.length(s) > 160, F.concat(F.substring(s, 1, 157), F.lit("…"))).otherwise(s))
    return F.slice(F.array_distinct(cut), 1, cap)


def synthesize_answer(answer: Column, blocks: Column) -> Column:
    """Replace a bare link by lines of the linked page, and top up a short answer."""
    answer = tx.strip(F.coalesce(answer, F.lit("")))
    blocks = F.coalesce(blocks, F.array().cast("array<struct<url:string,title:string,body:string,kind:string>>"))
    urls = F.array_distinct(F.regexp_extract_all(answer, F.lit("https?://[^\\s]+"), F.lit(0)))

    def trimmed(b: Column) -> Column:
        return F.transform(F.split(b["body"], "\n"), tx.strip)

    def tip(b: Column) -> Column:
        good = F.filter(trimmed(b), lambda s: F.length(s).between(20, 200) & ~s.startswith("#"))
        return F.substring(F.get(good, F.lit(0)), 1, 180)

    def extra(b: Column) -> Column:
        return F.slice(F.filter(trimmed(b), lambda s: F.length(s).between(25, 160)), 1, 2)

    parts = tx.let(blocks, lambda bs: F.struct(
        F.array_compact(F.transform(F.slice(bs, 1, 2), tip)).alias("tips"),
        F.flatten(F.transform(F.slice(bs, 1, 1), extra)).alias("extra")))

    def compose(x: Column) -> Column:
        cited = F.concat(F.array_join(x["tips"], "；"), F.lit("\n\n参考："), F.array_join(F.slice(F.array_sort(x["urls"]), 1, 3), "\n"))
        bare = (F.length(x["answer"]) < 30) & (F.size(x["urls"]) > 0) & (F.size(x["tips"]) > 0)
        told = F.when(bare, cited).otherwise(x["answer"])
        short = (F.length(told) < 80) & (F.size(x["extra"]) > 0)
        return F.when(short, tx.strip(F.concat(told, F.lit("\n\n"), F.array_join(x["extra"], "\n")))).otherwise(told)

    return tx.let(parts, lambda p: tx.let(
        F.struct(answer.alias("answer"), urls.alias("urls"), p["tips"].alias("tips"), p["extra"].alias("extra")), compose))


# --- extraction from sessions ---------------------------------------------------------

def _category_masks(c: Column, dictionary: list[tuple[str, list[str]]]) -> list[Column]:
    """Per category one number whose bits say which patterns were seen; OR-able across messages."""
    masks = []
    for _, patterns in dictionary:
        bits = F.lit(0).cast("bigint")
        for i, p in enumerate(patterns):
            bits = bits + F.when(F.lower(c).rlike(tx.any_of([p])), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        masks.append(bits)
    return masks


def _is_strong(r: MessageRules) -> Column:
    c = F.col("content")
    strong = (F.size(ux.extract_urls(c)) > 0) | (tx.cjk_count(c) >= r.answer_cjk)
    return strong | c.rlike(r.answer_pattern) if r.answer_pattern else strong


def strong_answers(cleaned: DataFrame, r: MessageRules = CHINESE) -> DataFrame:
    """Agent messages with links or long text, each text once per session."""
    picked = substantive_messages(cleaned, rules.AGENT, r).filter(_is_strong(r))
    return picked.groupBy(*KEY, "content").agg(F.min(F.struct("created_at", "msg_id")).alias("_f")).select(
        *KEY, "content", F.col("_f.created_at").alias("created_at"), F.col("_f.msg_id").alias("msg_id"))


def answer_parts(answers: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Whole answers, one row per ``rows_per_part`` messages of a session."""
    placed = with_ordinal(answers, KEY, [F.col("created_at"), F.col("msg_id")], F.date_trunc("hour", "created_at"), "pos")
    parts = in_parts(placed, KEY, "pos", rows_per_part)
    return collect_in_order(parts, [*KEY, "part"], "pos", "content", "_t").select(
        *KEY, "part", F.array_join("_t", "\n\n").alias("answer"))


def _session_picks(cleaned: DataFrame, r: MessageRules) -> DataFrame:
    """First questions, last replies and step messages of each session, from one scan.

    Every message is tagged with the lists it may enter; one capped ranking serves all lists.
    """
    c, role = F.col("content"), F.col("role")
    at, mid = F.unix_micros(F.col("created_at").cast("timestamp")), F.col("msg_id")
    tag = F.array_compact(F.array(
        F.when(role == rules.VISITOR, F.struct(F.lit("ask").alias("kind"), at.alias("a"), mid.alias("b"))),
        F.when(role == rules.AGENT, F.struct(F.lit("last").alias("kind"), (-at).alias("a"), (-mid).alias("b"))),
        F.when((role == rules.AGENT) & c.rlike(r.message_step_pattern), F.struct(F.lit("step").alias("kind"), at.alias("a"), mid.alias("b"))),
    ))
    rows = cleaned.filter(r.is_substantive(c)).select(*KEY, "content", F.explode(tag).alias("t")).select(*KEY, "content", "t.*")
    top = top_rows(rows, [*KEY, "kind"], [F.col("a"), F.col("b")], 10, "_n").filter(
        (F.col("kind") == "step") | ((F.col("kind") == "ask") & (F.col("_n") <= 4)) | (F.col("_n") <= 2))

    def listed(kind: str) -> Column:
        packed = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("_n", "content"))))
        return F.transform(packed, lambda x: x["content"])

    return top.groupBy(*KEY).agg(listed("ask").alias("_asks"), F.reverse(listed("last")).alias("_last"), listed("step").alias("steps"))


def extract_faq(cleaned: DataFrame, r: MessageRules = CHINESE, link_sections: DataFrame | None = None) -> DataFrame:
    """One entry per session with a usable question and answer.

    The answer is made of the strong agent messages, else of the last two, and is whole:
    parts of bounded size are made first and joined, one row per part.
    """
    c = F.col("content")
    picks = _session_picks(cleaned, r).withColumn("ask", F.get("_asks", F.lit(0)))
    picks = picks.filter((F.length("ask") >= 4) & ~F.col("ask").rlike(r.question_block) & (F.size("_last") > 0))
    strong = strong_answers(cleaned, r)
    dictionary = category_rules(r.categories)
    seen = strong.groupBy(*KEY).agg(
        (F.sum(F.length("content") + 2) - 2).alias("_chars"),
        *[F.bit_or(m).alias(f"_m{i}") for i, m in enumerate(_category_masks(c, dictionary))])
    firsts = collect_in_order(answer_parts(strong), KEY, "part", "answer", "_t").select(*KEY, F.array_join("_t", "\n\n").alias("_strong"))
    linked = strong.filter(F.contains(F.lower(c), F.lit("http"))).select(*KEY, "created_at", "msg_id", F.posexplode(ux.extract_urls(c)).alias("_i", "url"))
    links = first_distinct(linked, KEY, "url", ["created_at", "msg_id", "_i"], 10, "_text_links")

    out = picks.join(firsts, KEY, "left").join(seen, KEY, "left").join(links, KEY, "left")
    if link_sections is not None:
        out = out.join(link_sections, KEY, "left")
    else:
        out = out.withColumn("link_section", F.lit(""))
    section = F.coalesce("link_section", F.lit(""))
    weak = F.array_join(F.array_distinct("_last"), "\n\n")
    out = out.withColumn("answer", F.coalesce("_strong", weak)).withColumn(
        "answer_chars", F.coalesce("_chars", F.length("answer").cast("bigint"))).withColumn("link_blocks", parse_link_blocks(section))
    # strong messages were tested one by one above; the rest of the text is tested here
    out = out.withColumn("_rest", F.concat("ask", F.lit(" "), F.when(F.col("_strong").isNull(), weak).otherwise(""), F.lit(" "), section))
    scores = []
    for i, ((cid, _), m) in enumerate(zip(dictionary, _category_masks(F.col("_rest"), dictionary))):
        known = F.coalesce(f"_m{i}", F.lit(0).cast("bigint"))
        scores.append(F.struct(F.bit_count(known.bitwiseOR(m)).alias("n"), F.lit(-i).alias("o"), F.lit(cid).alias("id")))
    best = F.array_max(F.filter(F.array(*scores), lambda x: x["n"] > 0))["id"] if scores else F.lit(None).cast("string")
    out = out.withColumn("category_id", F.coalesce(best, F.lit("general")))
    out = out.filter((F.col("answer_chars") >= 10) | (F.size("link_blocks") > 0))
    block_links = F.transform("link_blocks", lambda b: b["url"])
    weak_links = F.when(F.col("_strong").isNull(), ux.extract_urls(weak)).otherwise(_none())
    all_links = F.concat(ux.extract_urls(F.col("ask")), F.coalesce("_text_links", _none()), weak_links, ux.extract_urls(section), block_links)
    more_steps = F.filter(steps_from_blocks(F.col("link_blocks")), lambda x: ~F.array_contains("steps", x))
    return out.select(
        *KEY,
        F.concat(tx.rstrip_chars(F.col("ask"), "？?"), F.lit("？")).alias("question"),
        F.slice("_asks", 2, 3).alias("question_variants"), "answer", "answer_chars", "category_id",
        F.slice(F.concat("steps", more_steps), 1, 10).alias("steps"),
        F.slice(F.array_distinct(all_links), 1, 10).alias("links"),
        "link_blocks",
    )


def enrich_extractions(ext: DataFrame, r: MessageRules = CHINESE, category_pages: dict[str, str] | None = None,
                       concept_links: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Final form of an extraction: question mark, category title, steps, summary, links, tags, source id."""
    titles = {cid: title for cid, title, _ in r.categories}
    title = F.lit(titles.get("general", "general"))
    for cid, name in titles.items():
        title = F.when(F.col("category_id") == cid, name).otherwise(title)
    answer = synthesize_answer(F.col("answer"), F.col("link_blocks"))
    out = ext.withColumn("answer", answer).filter((F.length("answer") >= 8) | (F.size("link_blocks") > 0))
    sid = F.col("session_id").cast("string")
    first = F.substring(tx.strip(tx.first_line(F.regexp_replace("answer", "https?://\\S+", ""))), 1, 100)
    bare = tx.rstrip_chars(F.col("question"), "？?")
    summary = F.concat(F.lit("会话 "), F.substring(sid, 1, 8), F.lit("…：访客问「"), F.substring(bare, 1, 50), F.lit("」；"),
                       F.coalesce(F.nullif(first, F.lit("")), F.lit("客服已给出指引。")))
    blob = F.concat("question", "answer")
    return out.select(
        "session_id", F.concat(bare, F.lit("？")).alias("question"), "question_variants", "answer", "category_id",
        title.alias("category_title"), normalize_steps(F.col("steps")).alias("steps"), summary.alias("summary"),
        related_wikilinks(blob, F.col("category_id"), category_pages or {}, concept_links).alias("related_wikilinks"),
        _none().alias("tags"), sid.alias("source_session_id"))


def related_wikilinks(blob: Column, category_id: Column, category_pages: dict[str, str],
                      concept_links: list[tuple[str, list[str]]] | None = None, cap: int = 12) -> Column:
    """The category's page, then concepts whose pattern or literal text occurs."""
    if concept_links is None:
        concept_links = [(f"概念-{t}", p) for _, t, _, p in rules.CONCEPTS]
    page = F.lit(None).cast("string")
    for cid, stem in category_pages.items():
        page = F.when(category_id == cid, stem).otherwise(page)
    concepts = rule_ids(blob, concept_links)
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(page), concepts))), 1, cap)


# --- merging -----------------------------------------------------------------------------

def merge_link_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Longest body per link, in order of first sight. Input rows: keys, ord, url, title, body, kind;
    an optional column ``pos`` orders the blocks of one ``ord``."""
    link = F.coalesce(F.nullif("url", F.lit("")), F.nullif("title", F.lit("")))
    pos = F.col("pos") if "pos" in blocks.columns else F.lit(0)
    rows = blocks.withColumn("_link", link).withColumn("_pos", pos).filter(F.col("_link").isNotNull())
    g = rows.groupBy(*keys, "_link").agg(
        F.min_by(F.struct("url", "title", "body", "kind"), F.struct(-F.length("body"), "ord", "_pos")).alias("_b"),
        F.min(F.struct("ord", "_pos")).alias("_f"))
    return g.select(*keys, F.col("_f.ord").alias("first_ord"), F.col("_f._pos").alias("first_pos"), "_b.*")


def merge_faq_groups(faqs: DataFrame, key: str, caps: dict[str, int | None] | None = None) -> DataFrame:
    """One entry per group: longest answer, strongest question, ordered unions of the lists.

    Winners are found on narrow rows; the long answers are joined in by position.
    Lists are cut to their caps (``caps``, by default ``LIST_CAPS``; None keeps all) before they are
    gathered, so group size does not matter. Where entries have ``link_blocks``, the longest body of
    each link stays, and links of blocks follow the other links.
    """
    caps = LIST_CAPS if caps is None else caps
    g = faqs.groupBy(key).agg(
        F.max(F.struct(F.length("answer").alias("n"), F.col("source_count").alias("c"), (-F.col("ord")).alias("o"))).alias("_primary"),
        F.max(F.struct(F.length("answer").alias("n"), (-F.col("ord")).alias("o"))).alias("_longest"),
        F.sum("source_count").alias("source_count"),
        F.min(F.when(F.coalesce("file_name", F.lit("")) != "", F.struct("ord", "file_name"))).alias("_named"),
        F.min("ord").alias("ord"),
    )
    heads = g.select(key, "source_count", "ord", F.coalesce("_named.file_name", F.lit("")).alias("file_name"),
                     (-F.col("_primary.o")).alias("_p"), (-F.col("_longest.o")).alias("_l"))
    question = faqs.select(F.col("ord").alias("_p"), "question", "category_id")
    answer = faqs.select(F.col("ord").alias("_l"), "answer")
    heads = heads.join(question, "_p").join(answer, "_l").drop("_p", "_l")

    def listed(kind: str, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), values.alias("vals"))

    lists = F.array(
        listed("variants", F.concat(F.array("question"), F.coalesce("variants", _none()))),
        *[listed(k, F.coalesce(k, _none())) for k in ("steps", "links", "tags", "related_wikilinks")])
    long = faqs.select(key, "ord", F.explode(lists).alias("l")).select(key, "ord", F.lit(0).alias("late"), "l.kind", F.posexplode("l.vals").alias("i", "v"))
    blocks = None
    if "link_blocks" in faqs.columns:
        rows = faqs.select(key, "ord", F.posexplode("link_blocks").alias("pos", "b")).select(key, "ord", "pos", "b.url", "b.title", "b.body", "b.kind")
        blocks = merge_link_blocks(rows, [key])
        long = long.unionByName(blocks.select(key, F.col("first_ord").alias("ord"), F.lit(1).alias("late"), F.lit("links").alias("kind"), F.col("first_pos").alias("i"), F.col("url").alias("v")))
    seen = long.filter(F.coalesce("v", F.lit("")) != "").groupBy(key, "kind", "v").agg(F.min(F.struct("late", "ord", "i")).alias("_f"))
    primary = heads.select(key, F.lit("variants").alias("kind"), F.col("question").alias("v"))
    seen = seen.join(primary, [key, "kind", "v"], "left_anti")
    most = [caps.get(k) for k in LIST_CAPS]
    top = top_rows(seen, [key, "kind"], [F.col("_f")], max(m or 0 for m in most) if all(most) else (1 << 31) - 1, "_n")
    fits = F.lit(False)
    for kind, cap in zip(LIST_CAPS, most):
        fits = fits | ((F.col("kind") == kind) & (F.lit(True) if cap is None else F.col("_n") <= cap))
    packed = [
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("_n", "v")))), lambda x: x["v"]).alias(k)
        for k in LIST_CAPS
    ]
    out = heads.join(top.filter(fits).groupBy(key).agg(*packed), key, "left")
    if blocks is None:
        return out
    block = F.struct("url", "title", "body", "kind").alias("b")
    told = blocks.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first_ord", "first_pos", block))), lambda x: x["b"]).alias("link_blocks"))
    return out.join(told, key, "left").withColumn("link_blocks", F.coalesce("link_blocks", F.array().cast(faqs.schema["link_blocks"].dataType)))


def collect_raw_faqs(ext: DataFrame, key_chars: int | None = None) -> DataFrame:
    """Usable extractions, merged when their normalised questions agree (their first ``key_chars``, if given)."""
    rows = ext.filter(
        (tx.strip(F.coalesce("question", F.lit(""))) != "")
        & ((F.length(tx.strip(F.coalesce("answer", F.lit("")))) >= 12) | (F.size(F.coalesce("link_blocks", F.array())) > 0))
    ) if "link_blocks" in ext.columns else ext.filter(
        (tx.strip(F.coalesce("question", F.lit(""))) != "") & (F.length(tx.strip(F.coalesce("answer", F.lit("")))) >= 12))
    if "skip" in ext.columns:
        rows = rows.filter(~F.coalesce("skip", F.lit(False)))
    key = tx.normalize_question(F.col("question"))
    keyed = rows.withColumn("question", tx.strip(F.col("question"))).withColumn("answer", tx.strip(F.col("answer"))).withColumn(
        "faq_key", key if key_chars is None else F.substring(key, 1, key_chars)).withColumn(
        "variants", F.slice(F.filter("variants", lambda v: v != ""), 1, 5)).withColumn(
        "steps", F.filter("steps", lambda x: F.length(x) >= 5))
    return merge_faq_groups(keyed, "faq_key")


def faqs_from_extractions(ext: DataFrame) -> DataFrame:
    """Shape session extractions as entries for merging; ``ord`` follows the session id."""
    return ext.select(
        F.col("session_id").alias("ord"), "question", "answer", "category_id", F.col("question_variants").alias("variants"),
        "steps", "links", _none().alias("tags"), _none().alias("related_wikilinks"), F.lit(1).cast("bigint").alias("source_count"),
        F.lit("").alias("file_name"), *[c for c in ("link_blocks",) if c in ext.columns])


# --- roll-ups ---------------------------------------------------------------------------------

def top_faqs(faqs: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(faqs, ["category_id"], [F.desc("source_count"), F.col("ord")], k)


def faq_by_category(faqs: DataFrame, k: int = 5) -> DataFrame:
    """Entries and entries with steps per category, with the most frequent questions."""
    counts = faqs.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("steps") > 0).alias("with_steps"))
    return counts.join(collect_in_order(top_faqs(faqs, k), ["category_id"], "rank", "question", "top_questions"), "category_id")


def concept_matches(faqs: DataFrame, dictionary: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per concept and matching entry."""
    blob = F.concat("question", "answer", F.array_join(F.coalesce("variants", _none()), " "))
    return match_rules(faqs, blob, dictionary or concept_rules()).withColumnRenamed("rule_id", "concept_id")


def extract_concepts(faqs: DataFrame, dictionary: list[tuple[str, list[str]]] | None = None, cap: int = 8) -> DataFrame:
    """Concepts that any entry mentions, with distinct first lines as points and sorted categories."""
    hits = concept_matches(faqs, dictionary).withColumn("point", F.nullif(F.substring(tx.first_line(F.col("answer")), 1, 120), F.lit("")))
    cats = hits.groupBy("concept_id").agg(F.sort_array(F.collect_set("category_id")).alias("category_ids"), F.count(F.lit(1)).alias("n_faqs"))
    points = first_distinct(hits, ["concept_id"], "point", ["ord"], cap, "points")
    return cats.join(points, "concept_id", "left")


def concept_faq_links(faqs: DataFrame, dictionary: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Linked entry names of each concept, long form."""
    return concept_matches(faqs, dictionary).select("concept_id", "file_name", "ord").distinct()


def infer_category(c: Column, categories: list | None = None) -> Column:
    return best_category(c, category_rules(categories))
