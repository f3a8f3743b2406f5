"""Incremental dedup of arriving files with Structured Streaming."""

import os

from markhive import KeyOptions
from markhive.streaming.watch import watch_dedup

DOC = """<DL><p><DT><A HREF="http://a">a</A><DT><A HREF="https://a">a</A><DT><A HREF="http://b">b</A></DL><p>"""


def test_watch_dedup_processes_new_files_once(spark, tmp_dir):
    src = f"{tmp_dir}/incoming"
    os.makedirs(src)
    with open(f"{src}/one.html", "w") as f:
        f.write(DOC)
    out, ckpt = f"{tmp_dir}/kept", f"{tmp_dir}/ckpt"
    q = watch_dedup(spark, src, out, KeyOptions(), batch_mode="url", checkpoint=ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    with open(f"{src}/two.html", "w") as f:
        f.write(DOC)
    q = watch_dedup(spark, src, out, KeyOptions(), batch_mode="url", checkpoint=ckpt)
    q.awaitTermination(120)
    kept = spark.read.parquet(out)
    assert kept.count() == 4  # the first file was not read again
    assert sorted({os.path.basename(r.file_id) for r in kept.collect()}) == ["one.html", "two.html"]
