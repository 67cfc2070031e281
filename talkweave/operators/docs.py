"""Website documents: deduplication, taxonomy joins, upserts and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.operators.ordering import collect_in_order, first_distinct, id_bucket, top_rows, with_ordinal
from talkweave.operators.rulematch import keyword_ids
from talkweave.session import cut_lineage


def _winners(df: DataFrame, key: Column, best: Column, row_id: str) -> DataFrame:
    """Rows whose ``row_id`` wins its key; only ids travel through the aggregate."""
    picked = df.groupBy(key.alias("_k")).agg(F.max(F.struct(best.alias("b"), (-F.col(row_id)).alias("i"))).alias("_w"))
    return df.join(picked.select((-F.col("_w.i")).alias(row_id)), row_id, "left_semi")


def dedupe_by_url_largest(docs: DataFrame, url: str, size: Column, row_id: str) -> DataFrame:
    """One row per URL: the largest, the earliest on ties. Rows without URL stay."""
    key = F.coalesce(F.nullif(F.col(url), F.lit("")), F.concat(F.lit("row:"), F.col(row_id)))
    return _winners(docs, key, size, row_id)


def dedupe_keep_first(docs: DataFrame, key: Column, row_id: str) -> DataFrame:
    return _winners(docs, key, F.lit(0), row_id)


def usable_docs(docs: DataFrame, min_chars: int = 80) -> DataFrame:
    return docs.filter((F.coalesce("title", F.lit("")) != "") & (F.length("content") >= min_chars))


def skipped_docs(docs: DataFrame, min_chars: int = 80) -> DataFrame:
    ok = (F.coalesce("title", F.lit("")) != "") & (F.length("content") >= min_chars)
    return docs.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def position_numbering(df: DataFrame, order: str, bucket: Column, name: str = "doc_index") -> DataFrame:
    """0-based place of each row in the order of one column, without a global sort in one task."""
    placed = with_ordinal(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(order)], bucket, name)
    return placed.withColumn(name, F.col(name) - 1).drop("_all")


def taxonomy_request(docs: DataFrame, order: str, max_docs: int = 200) -> DataFrame:
    """Numbered listing of the first documents for a taxonomy request."""
    first = docs.orderBy(order).limit(max_docs)
    placed = position_numbering(first, order, id_bucket(order))
    line = F.format_string("%d. [%s] %s\n   %s", "doc_index", "source_site", "title", F.substring("summary", 1, 220))
    return placed.select("doc_index", F.concat(line, F.when(F.col("source_url") != "", F.concat(F.lit("\n   source_url: "), "source_url")).otherwise("")).alias("line"))


# --- taxonomy -----------------------------------------------------------------------------

def assign_categories(docs: DataFrame, assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """Category by URL, else by position, else the existing one; unknown ids become the fallback.

    The fallback is ``general`` where that category exists, else the first category.
    """
    by_url = assignments.filter("source_url IS NOT NULL").groupBy("source_url").agg(F.max_by("category_id", "ord").alias("_by_url"))
    by_index = assignments.filter("doc_index IS NOT NULL").groupBy("doc_index").agg(F.max_by("category_id", "ord").alias("_by_index"))
    general = F.max(F.when(F.col("id") == "general", F.col("id")))
    fallback = categories.agg(F.coalesce(general, F.min_by("id", "ord")))
    known = categories.select(F.col("id").alias("_cid"), F.lit(True).alias("_known")).distinct()
    own = F.nullif("category_id", F.lit("")) if "category_id" in docs.columns else F.lit(None).cast("string")
    joined = docs.join(by_url, "source_url", "left").join(by_index, "doc_index", "left")
    joined = joined.withColumn("_cid", F.coalesce("_by_url", "_by_index", own))
    joined = joined.join(known, "_cid", "left")
    return joined.withColumn(
        "category_id", F.when(F.col("_known"), F.col("_cid")).otherwise(fallback.scalar())).drop("_cid", "_known", "_by_url", "_by_index")


def apply_doc_enrichments(docs: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Override summaries where given and add page names of related URLs in listed order."""
    own = enrichments.groupBy("source_url").agg(
        F.max(F.when(F.col("summary") != "", F.struct("ord", "summary"))).alias("_s"))
    listed = enrichments.select("source_url", "ord", F.posexplode("related_doc_urls").alias("i", "rel_url"))
    names = docs.filter(F.coalesce("file_name", F.lit("")) != "").select(F.col("source_url").alias("rel_url"), F.col("file_name").alias("name"))
    found = listed.join(names, "rel_url").groupBy("source_url", "name").agg(F.min(F.struct("ord", "i")).alias("_f"))
    # a document keeps at most as many related names as its own enrichment rows list
    related = found.groupBy("source_url").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_f", "name"))), lambda x: x["name"]).alias("_new"))
    old = F.coalesce("related_doc_names", F.array().cast("array<string>")) if "related_doc_names" in docs.columns else F.array().cast("array<string>")
    out = docs.join(own, "source_url", "left").join(related, "source_url", "left")
    return out.withColumn("summary", F.coalesce("_s.summary", "summary")).withColumn(
        "related_doc_names", F.array_distinct(F.concat(old, F.coalesce("_new", F.array().cast("array<string>"))))).drop("_s", "_new")


def concept_docs(concepts: DataFrame, docs: DataFrame, cap: int = 20) -> DataFrame:
    """Page names, category ids and points of the documents a concept lists by position."""
    listed = concepts.select("id", F.posexplode("related_doc_indices").alias("_i", "doc_index"))
    joined = listed.join(docs, "doc_index")
    lines = F.transform(F.slice(F.split("content", "\n"), 1, 15), tx.strip)
    good = F.filter(lines, lambda s: F.length(s).between(25, 140) & ~s.startswith("#"))
    names = first_distinct(joined.filter(F.coalesce("file_name", F.lit("")) != ""), ["id"], "file_name", ["_i"], cap, "doc_names")
    cats = joined.groupBy("id").agg(F.sort_array(F.collect_set(F.nullif("category_id", F.lit("")))).alias("category_ids"))
    points = joined.select("id", "_i", F.posexplode(good).alias("_j", "p")).withColumn("point", F.substring("p", 1, 120))
    points = first_distinct(points, ["id"], "point", ["_i", "_j"], 8, "points")
    return concepts.select("id").join(cats, "id", "left").join(names, "id", "left").join(points, "id", "left")


def site_taxonomy(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One category per source site, and each document's category."""
    site = F.coalesce(F.nullif("source_site", F.lit("")), F.lit("unknown"))
    cid = F.regexp_replace(F.lower(site), f"[^{tx.WORD}\\-]", "-")
    cats = docs.select(cid.alias("id"), site.alias("site")).groupBy("id").agg(F.max("site").alias("site"), F.count(F.lit(1)).alias("n_docs"))
    cats = cats.select("id", F.concat("site", F.lit(" 文档集")).alias("title"),
                       F.concat(F.lit("来自 "), "site", F.lit(" 的抓取文档（规则回退）。")).alias("overview"), "n_docs")
    return cats, docs.withColumn("category_id", cid)


def doc_concepts(docs: DataFrame, dictionary=None, head_chars: int | None = None) -> DataFrame:
    """Concepts of each document by keywords in title and content.

    ``head_chars`` limits the content looked at; ``None`` looks at all of it.
    """
    content = F.col("content") if head_chars is None else F.substring("content", 1, head_chars)
    return docs.withColumn("concept_ids", keyword_ids(F.concat("title", content), dictionary or rules.DOC_CONCEPT_KEYWORDS))


def taxonomy_rollup(docs: DataFrame, concept_cap: int = 30) -> dict[str, DataFrame]:
    """Documents per category with their sites, and the first documents of each concept."""
    per_cat = docs.groupBy("category_id", "source_site").agg(F.count(F.lit(1)).alias("n"))
    cats = per_cat.groupBy("category_id").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sites"))
    hits = docs.select("doc_index", F.explode("concept_ids").alias("concept_id"))
    first = top_rows(hits, ["concept_id"], [F.col("doc_index")], concept_cap)
    concepts = collect_in_order(first, ["concept_id"], "rank", "doc_index", "doc_indices")
    return {"categories": cats, "concepts": concepts, "sites": per_cat}


def longest_docs(docs: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(docs, ["category_id"], [F.desc(F.length("content")), F.col("doc_id")], k)


# --- upserts --------------------------------------------------------------------------------

def upsert_docs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By URL: new content replaces old, the page name stays; the rest is kept or added."""
    cols = [c for c in incoming.columns if c != "source_url"]
    old = existing.select("source_url", F.struct(*cols).alias("_old"))
    new = incoming.select("source_url", F.struct(*cols).alias("_new"))
    both = old.join(new, "source_url", "full_outer")
    out = []
    for c in cols:
        o, n = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c == "file_name":
            out.append(F.coalesce(F.nullif(o, F.lit("")), n).alias(c))
        else:
            out.append(F.when(F.col("_new").isNotNull(), n).otherwise(o).alias(c))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update")
    return both.select("source_url", *out, action.alias("action"))


def merge_concepts(existing: DataFrame, new: DataFrame, web: bool = False, cap: int = 8) -> DataFrame:
    """Union of points and sorted categories per concept; the old name stays.

    The web form prefers non-empty new fields and keeps list order instead.
    """
    none = F.array().cast("array<string>")
    o, n = existing.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.concept_id") == F.col("n.concept_id"), "full_outer")

    def arr(side: str, c: str) -> Column:
        return F.coalesce(f"{side}.{c}", none)

    def text(c: str) -> Column:
        return F.coalesce(F.nullif(f"n.{c}", F.lit("")), F.col(f"o.{c}"))

    union = F.array_distinct(F.concat(arr("o", "points"), F.filter(arr("n", "points"), lambda p: p != "")))
    both_lists = F.col("o.concept_id").isNotNull() & F.col("n.concept_id").isNotNull()
    cats = F.array_distinct(F.concat(arr("o", "category_ids"), arr("n", "category_ids")))
    if web:
        points = F.when(F.size(arr("n", "points")) > 0, arr("n", "points")).otherwise(arr("o", "points"))
    else:
        points = F.when(both_lists, F.slice(union, 1, cap)).otherwise(union)
        cats = F.array_sort(cats)
    return both.select(
        F.coalesce("n.concept_id", "o.concept_id").alias("concept_id"),
        text("title").alias("title"), text("definition").alias("definition"),
        F.coalesce(F.nullif("o.file_name", F.lit("")), F.col("n.file_name")).alias("file_name"),
        points.alias("points"), cats.alias("category_ids"))


def unique_names(df: DataFrame, base: Column, seed: Column, row_id: str, name: str = "file_name",
                 reserved: DataFrame | None = None) -> DataFrame:
    """Collision-free names: base, else base with six hash digits, else a counter behind, else more digits of its own.

    Earlier rows (by ``row_id``) win. ``reserved`` holds names (column ``name``) already in use.
    """
    rows = df.withColumn("_base", F.coalesce(F.nullif(base, F.lit("")), F.lit("未命名"))).withColumn("_seed", seed)
    first = rows.groupBy("_base").agg(F.min(row_id).alias("_first"))
    taken = first.select(F.col("_base").alias("_cand"))
    if reserved is not None:
        used = reserved.select(F.col("name").alias("_base"), F.lit(True).alias("_used")).distinct()
        first = first.join(used, "_base", "left").withColumn("_first", F.when(F.col("_used"), F.lit(None)).otherwise(F.col("_first"))).drop("_used")
        taken = taken.unionByName(reserved.select(F.col("name").alias("_cand"))).distinct()
    rows = rows.join(first, "_base")
    winner = F.coalesce(F.col(row_id) == F.col("_first"), F.lit(False))
    plain = rows.filter(winner).withColumn(name, F.col("_base"))
    rest = rows.filter(~winner).withColumn("_cand", F.concat("_base", F.lit("-"), F.substring(F.md5("_seed"), 1, 6)))
    rest = with_ordinal(rest, ["_cand"], [F.col(row_id)], id_bucket(row_id), "_n")
    rest = rest.join(taken.withColumn("_shift", F.lit(1)), "_cand", "left")
    n = F.col("_n") + F.coalesce("_shift", F.lit(0))
    rest = rest.withColumn(name, F.concat("_cand", F.when(n > 1, n.cast("string")).otherwise(""))).drop("_cand", "_n", "_shift")
    named = cut_lineage(plain.unionByName(rest))
    used = taken.select(F.col("_cand").alias(name), F.lit(True).alias("_used"))
    digits = 8
    while True:  # a counter may still spell a name of another base: later rows then get digits of their own
        owner = named.groupBy(name).agg(F.max(F.col(name) == F.col("_base")).alias("_plain"), F.min(F.when(F.col(name) != F.col("_base"), F.col(row_id))).alias("_low"))
        marked = named.join(owner, name).join(used, name, "left")
        made = F.col(name) != F.col("_base")
        lost = made & (F.coalesce("_used", F.lit(False)) | F.col("_plain") | (F.col(row_id) != F.col("_low")))
        if marked.filter(lost).isEmpty():
            return named.drop("_base", "_seed", "_first")
        again = F.concat("_base", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "_seed", F.col(row_id).cast("string")), 256), 1, digits))
        named = cut_lineage(marked.withColumn(name, F.when(lost, again).otherwise(F.col(name))).drop("_plain", "_low", "_used"))
        digits += 4


def parse_pages(pages: DataFrame) -> DataFrame:
    """Title, Markdown body and first content heading of crawled pages (url, html)."""
    from talkweave.functions.pandas_udfs import PAGE_TEXT_SCHEMA, parse_page_batches

    raw = pages.select("url", tx.repair_mojibake(F.col("html")).alias("html")).mapInPandas(parse_page_batches, PAGE_TEXT_SCHEMA)
    listed = F.coalesce(F.nullif(tx.normalize_text(F.col("raw_title")), F.lit("")), ux.path(F.col("url")))
    title = F.coalesce(F.nullif(tx.clean_page_title(listed), F.lit("")), ux.url_path_label(F.col("url")))
    staged = raw.withColumn("title", title).withColumn("_body", tx.normalize_text(F.col("raw_body")))
    # a leading heading that repeats the title goes, as often as it is repeated
    head = F.concat(F.lit("# "), F.col("title"))
    staged = staged.withColumn("_body", F.when(F.col("_body").startswith(head),
                                               F.regexp_replace(F.col("_body").substr(F.length(head) + 1, F.length("_body")), "^\\s+", "")).otherwise(F.col("_body")))
    repeated = F.concat(F.lit("(?iu)\\A(?:#+\\s*\\Q"), F.replace("title", F.lit("\\E"), F.lit("")), F.lit("\\E\\s*\\n)+"))
    body = tx.strip(F.regexp_replace(F.col("_body"), repeated, F.lit("")))
    in_body = F.transform(F.filter(F.transform(tx.lines(F.col("body")), tx.strip), lambda s: s.rlike("^##\\s+\\S")),
                          lambda s: tx.clean_page_title(F.regexp_replace(s, "^##\\s+", "")))
    in_page = F.transform("headings", tx.clean_page_title)
    useful = F.filter(F.concat(in_body, in_page), lambda h: (h != "") & ~h.isin(rules.NAV_HEADINGS))
    return staged.withColumn("body", body).select("url", "title", "body", F.get(useful, F.lit(0)).alias("h2"))


def usable_pages(parsed: DataFrame, min_chars: int = 50) -> DataFrame:
    return parsed.filter(F.length(tx.strip(F.col("body"))) >= min_chars)
