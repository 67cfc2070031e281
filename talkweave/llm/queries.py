"""One query per operator over the whole tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm import alignment, exact, fingerprints, hardnegatives, language, lines, mixing, ordinal, packing, simhash, suffix, tokens, toxicity
from talkweave.llm.common import kept, shared_folder
from talkweave.session import configure

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")  # texts may be long


def query(name: str, sql: str | None = None):
    def register(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op10_content_sort", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark, read):
    return exact.exact_groups(read("documents"), keep="largest").drop("row")


def number_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids, and sequences numbered throughout."""
    digests = kept(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.number_sequences(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")


@query("op2_packing")
def op2(spark, read):
    return number_digests(packing.pack_pieces(read("documents"), TOKENIZER))


@query("op4_token_files")
def op4(spark, read):
    path = shared_folder(spark)
    tokens.write_tokens(read("documents"), path, TOKENIZER)
    return tokens.token_digests(spark, path)


@query("op3_fingerprints")
def op3(spark, read):
    return fingerprints.neighbour_fingerprints(read("documents"))


@query("op7_source_mix", """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap / weight < level THEN cap::DOUBLE
         ELSE least(weight * max(CASE WHEN cap / weight >= level THEN level END) OVER (), cap::DOUBLE) END AS target
  FROM l),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
r AS (
  SELECT o.doc_id, o.size, t.source_size, t.target, o.before, floor(floor(t.target) / greatest(t.source_size, 1)) AS whole
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::BIGINT AS taken
FROM r
""")
def op7(spark, read):
    return mixing.mix(read("documents"), mixing.cyclic_weights([3, 1, 2])).drop("source")


@query("op6_simhash")
def op6(spark, read):
    return simhash.near_duplicates(read("documents")).drop("digest")


@query("op5_toxicity")
def op5(spark, read):
    return toxicity.score_documents(read("documents"), read("labels"))


@query("op1_line_dedup", """
WITH m AS (SELECT doc_id, coalesce(text, '') AS text,
                  string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(\\n)', '\\1' || chr(1), 'g'), '([.!?] )', '\\1' || chr(1), 'g'), chr(1)) AS units
           FROM documents),
b AS (SELECT doc_id, unnest(units) AS whole, generate_subscripts(units, 1) AS place FROM m),
d AS (SELECT doc_id, place, CASE WHEN len(string_split(trim(regexp_replace(whole, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ')) > 50
             THEN string_split(regexp_replace(whole, '([acegikmoqsuwyACEGIKMOQSUWY02468][\\x20\\x09-\\x0D])', '\\1' || chr(1), 'g'), chr(1)) ELSE [whole] END AS pieces FROM b),
u AS (SELECT doc_id, unnest(pieces) AS unit, place::BIGINT * 1000000000 + generate_subscripts(pieces, 1) AS pos FROM d),
n AS (SELECT *, trim(regexp_replace(lower(unit), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM u WHERE unit <> ''),
c AS (SELECT *, CASE WHEN len(string_split(norm, ' ')) < 5 THEN concat(chr(10), coalesce(lag(norm) OVER w, ''), chr(10), norm, chr(10), coalesce(lead(norm) OVER w, '')) ELSE norm END AS key
      FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) = 1 AS keep FROM c),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (NOT keep) AS n_removed, coalesce(sum(length(unit)) FILTER (NOT keep), 0)::BIGINT AS removed_chars,
             coalesce(string_agg(unit, '' ORDER BY pos) FILTER (keep), '') AS left_text
      FROM k GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
       sha256(coalesce(left_text, '')) AS kept_sha256
FROM m LEFT JOIN g USING (doc_id)
""")
def op1(spark, read):
    return lines.remove_repeats(read("documents")).select("doc_id", "n_units", "n_removed", "removed_chars", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_ordinal_quality")
def op9(spark, read):
    # Grades: 0 poor, 1 good but toxic, 2 good.
    labels = read("labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    return ordinal.grade_documents(read("documents"), ratings, 3).select(
        "doc_id", "held_out", "expected_grade", F.element_at("tails", 1).alias("p_good"), F.element_at("tails", 2).alias("p_best"), "selected")


@query("op8_suffix_blocks")
def op8(spark, read):
    found = suffix.remove_repeated_substrings(read("documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query("op11_token_alignment")
def op11(spark, read):
    return alignment.align_corpus(read("documents"), TOKENIZER, PIECES).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_language_id")
def op12(spark, read):
    return language.identify(read("documents"))


@query("op13_hard_negatives", """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (
  SELECT *, row_number() OVER () AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS n FROM s WHERE same) WHERE n <= 5),
m AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.w ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 10
""")
def op13(spark, read):
    return hardnegatives.mine(read("embeddings"))
