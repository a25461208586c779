"""Unfinished archives do not stay in the shared folder."""

import pytest
from pyspark.sql import functions as F

from scholarspark.llm import warc_chunks


def test_unfinished_files_go(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>" + "a" * 200 * k) for k in range(2000)], "page_id long, url string, html string")
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "another-call.warc.gz.part").write_text("still being written")
    chunks = warc_chunks.chunked(warc_chunks.with_decisions(pages, "page_id", "url", "html"))
    broken = chunks.withColumn("data", F.when(F.col("id") == 1990, F.raise_error(F.lit("disk")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="disk"):
        warc_chunks.write_archives(broken.coalesce(1), str(folder))
    files = warc_chunks.write_archives(chunks, str(folder))
    assert sum(r.records for r in files.collect()) == 2000
    assert [p.name for p in folder.glob("*.part")] == ["another-call.warc.gz.part"]
    named = {r.file for r in files.collect()}
    assert named <= {p.name for p in folder.glob("*.warc.gz")}  # of the failed call none is named
