"""Writers: page files, exports, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave.sources.pagefiles import write_page_files


def write_pages_markdown(pages: DataFrame, folder: str, full_rebuild: bool = False) -> None:
    """One Markdown file per page (rel_path, text); see :mod:`talkweave.sources.pagefiles`.

    Files of the same name are overwritten; others stay unless it is a full rebuild.
    """
    write_page_files(pages.sparkSession, pages, folder, full_rebuild)


def assemble_fragments(fragments: DataFrame) -> DataFrame:
    """Fragments (rel_path, part, frag, text) to pages; part n > 0 becomes ``name.part<n>.md``."""
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frag", "text"))), lambda x: x["text"]), "")
    name = F.when(F.col("part") == 0, F.col("rel_path")).otherwise(
        F.concat(F.regexp_replace("rel_path", "\\.md\\z", ""), F.lit(".part"), F.col("part").cast("string"), F.lit(".md")))
    return fragments.groupBy("rel_path", "part").agg(packed.alias("text")).select(name.alias("rel_path"), "text")


def write_page_table(pages: DataFrame, path: str, full_rebuild: bool = False) -> None:
    """Pages as a table partitioned by type; only a full rebuild removes what is there."""
    pages.write.mode("overwrite" if full_rebuild else "append").partitionBy("page_type").parquet(path)


def export_turns_csv(rows: DataFrame, path: str) -> None:
    """CSV export of prepared rows (at most a few thousand, newest first) with a header."""
    rows.write.mode("overwrite").option("header", "true").option("quoteAll", "false").csv(path)


def write_report(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def append_run_log(stats: DataFrame, path: str, label: str) -> None:
    """Add one run's counts to the log."""
    stats.withColumn("label", F.lit(label)).withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def taxonomy_document(categories: DataFrame, concepts: DataFrame, source: str, generated_at: Column | None = None) -> DataFrame:
    """Categories and concepts as one JSON document. Both are dictionaries, not data."""
    cats = categories.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "title", "overview"))).alias("c"))
    cons = concepts.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "title", "definition", "related_doc_indices"))).alias("k"))
    both = cats.withColumn("k", cons.scalar())
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if generated_at is None else generated_at
    doc = F.to_json(F.struct(
        stamp.alias("generated_at"), F.lit(source).alias("source"),
        F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["overview"].alias("overview"))).alias("categories"),
        F.transform("k", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["definition"].alias("definition"),
                                                      x["related_doc_indices"].alias("related_doc_indices"))).alias("concepts")))
    return both.select(doc.alias("value"))


def write_taxonomy(categories: DataFrame, concepts: DataFrame, path: str, source: str = "cursor-agent") -> None:
    taxonomy_document(categories, concepts, source).write.mode("overwrite").text(path)
