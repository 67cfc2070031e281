"""Page files and the audit table: whole or not at all, and nothing twice."""

import pytest
from pyspark.sql import functions as F

from talkweave.sources import pagefiles
from talkweave.sources.pagefiles import PageFilesWriter, write_page_files
from talkweave.streaming import audittable as at


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def pages(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, text string").repartition(3, "rel_path")


def test_pages_are_replaced_by_name(spark, tmp_path):
    root = tmp_path / "kb"
    write_page_files(spark, pages(spark, [("a.md", "one"), ("faqs/b [x].md", "zwei\n漢"), ("c.md", None)]), str(root))
    (root / "own.txt").write_text("mine")
    write_page_files(spark, pages(spark, [("a.md", "new"), ("d/e/f.md", "deep")]), f"file://{root}")
    assert files(root) == {"a.md": "new", "faqs/b [x].md": "zwei\n漢", "c.md": "", "d/e/f.md": "deep", "own.txt": "mine"}
    write_page_files(spark, pages(spark, [("a.md", "last")]), str(root), full_rebuild=True)
    assert files(root) == {"a.md": "last", "own.txt": "mine"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = tmp_path / "kb"
    write_page_files(spark, pages(spark, [("a.md", "old")]), str(root))
    bad = pages(spark, [("a.md", "new"), ("b.md", "new"), ("../out.md", "outside")])
    with pytest.raises(Exception):
        write_page_files(spark, bad, str(root))
    assert files(root) == {"a.md": "old"} and not (tmp_path / "out.md").exists()


def test_only_reported_attempts_count(tmp_path):
    import pyarrow as pa

    writer = PageFilesWriter(str(tmp_path / "kb"), overwrite=False)

    def batches(text, fails):
        yield pa.RecordBatch.from_pydict({"rel_path": ["a.md"], "text": [text]})
        if fails:
            raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(batches("half", True))
    writer.commit([writer.write(batches("whole", False)), None])
    assert files(tmp_path / "kb") == {"a.md": "whole"}
    for name in (None, "", "/etc/x", "a//b", "_staging-1/x"):
        with pytest.raises(ValueError):
            pagefiles._checked(name)


ROWS = "id bigint, session_id string, turn_id string, text string"


def test_a_turn_is_kept_once_however_late(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = at.audit_table(path, buckets=4, max_folders=3)

    def rows(*values):
        return spark.createDataFrame([(i, s, t, f"{i}") for i, s, t in values], ROWS)

    write(rows((2, "s", "t1"), (1, "s", "t1"), (3, "s", "t2"), (4, None, "t1")), 1)
    for epoch in range(2, 9):
        write(rows((epoch * 10, "s", f"u{epoch}"), (epoch * 10 + 1, "s", "t2")), epoch)
    write(rows((900, "s", "t1"), (901, None, "t1"), (902, "z", "t1")), 9)
    want = {1, 3, 4, *(e * 10 for e in range(2, 9)), 902}
    assert sorted(r.id for r in at.read_audit(spark, path, ROWS).collect()) == sorted(want)
    write(rows((900, "s", "t1"), (902, "z", "t1")), 9)  # a repeated epoch
    write(spark.createDataFrame([], ROWS), 10)
    assert {r.id: r.text for r in at.read_audit(spark, path, ROWS).collect()} == {i: str(i) for i in want}
    known = at.manifest(spark, path)
    assert max(sum(1 for b, _ in known if b == x) for x, _ in known) <= 4  # crowded buckets were folded
    assert [r.id for r in at.read_audit(spark, path, ROWS, ["z"]).collect()] == [902]


def test_an_epoch_that_stopped_half_way_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = at.audit_table(path, buckets=2)
    write(spark.createDataFrame([(1, "s", "t", "x")], ROWS), 0)
    spark.createDataFrame([(2, "s", "u", "x", 0)], ROWS + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/epoch=1")  # no manifest
    assert [r.id for r in at.read_audit(spark, path, ROWS).collect()] == [1]
    write(spark.createDataFrame([(3, "s", "u", "x")], ROWS), 1)
    assert sorted(r.id for r in at.read_audit(spark, path, ROWS).collect()) == [1, 3]


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = at.audit_table(path, buckets=16)
    write(spark.range(200).select("id", F.lit("s").alias("session_id"), F.concat(F.lit("t"), "id").alias("turn_id"), F.lit("x").alias("text")), 0)
    before = at.manifest(spark, path)
    write(spark.createDataFrame([(500, "s", "new", "x")], ROWS), 1)
    after = at.manifest(spark, path)
    assert len(before) == 16 and len(set(after) - set(before)) == 1 and set(before) <= set(after)


def test_audit_stream(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "audit")
    for values in ([(1, "s", "t1", "a"), (2, "s", "t2", "b")], [(3, "s", "t1", "c")], [(4, "s", "t3", "d"), (5, "s", "t2", "e")]):
        spark.createDataFrame(values, ROWS).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream.writeStream.foreachBatch(at.audit_table(path, buckets=4)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert len(at.read_audit(spark, path, ROWS).collect()) == 3
