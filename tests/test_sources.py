"""Files in, incremental ingest, page layout, streams and the command line."""

import json
import shutil

from corvane import cli
from corvane.operators.chunk import ChunkConfig
from corvane.operators.ingest import ingest
from corvane.plans import registry
from corvane.sources import files
from corvane.streaming import chunk_stream


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Title</h1><p>Some <b>bold</b> text</p><table><tr><th>a</th><td>1</td></tr></table><ul><li>x</ul><script>no()</script></body></html>"
    assert files.html_content(page) == ("# Title\n\nSome bold text\n\n| a | 1 |\n\n- x", False)
    row = files.html_documents(spark.createDataFrame([("u", page)], "url string, html string")).head()
    assert "menu" not in row.text and row.media_type == "text/html" and row.warnings == []


def test_pages(spark):
    block = lambda p, x0, y0, x1, t: ("d", p, 100.0, 100.0, x0, y0, x1, y0 + 5, t)
    rows = [block(1, 5.0, 30.0, 45.0, "l2"), block(1, 5.0, 20.0, 45.0, "l1"), block(1, 55.0, 20.0, 95.0, "r1"), block(1, 55.0, 30.0, 95.0, "r2"), block(1, 5.0, 5.0, 95.0, "top"), block(1, 5.0, 90.0, 95.0, "end"), block(2, 5.0, 5.0, 20.0, " ")]
    schema = "source string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string"
    got = {r.page: r for r in files.page_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].raw == "top\nl1\nl2\nr1\nr2\nend" and got[1].first_warnings == ["two_column_layout_detected"] and got[2].first_warnings == ["no_text_layer"]
    pages = [block(p, 5.0, y, 90.0, t) for p in (1, 2, 3) for y, t in ((1.0, f"Report  Page {p}"), (50.0, f"body number {p}"), (95.0, "Footer"))]
    docs = files.page_documents(spark.createDataFrame(pages, schema)).orderBy("page").collect()
    assert [d.text for d in docs] == ["body number 1", "body number 2", "body number 3"] and "repeated_header_footer_removed" in docs[0].warnings


def test_ingest(spark, tmp_path):
    root, store, config = tmp_path / "in", str(tmp_path / "store"), ChunkConfig("fixed", 8, 2)
    root.mkdir()
    text = lambda a: " ".join(f"{a}{i}" for i in range(12))
    (root / "a.txt").write_text(text("a"))
    (root / "b.txt").write_text(text("a"))
    (root / "c.md").write_text(text("c"))
    (root / "skip.bin").write_text("x")
    first = ingest(spark, str(root), store, config)
    assert (first["files_seen"], first["files_changed"], first["documents"], first["duplicates_removed"], first["chunks_reused"]) == (3, 3, 2, 1, 0)
    again = ingest(spark, str(root), store, config)
    assert again["files_changed"] == 0 and again["chunks_rebuilt"] == 0 and again["chunks_reused"] == first["chunks"]
    (root / "a.txt").unlink()
    (root / "c.md").write_text(text("d"))
    third = ingest(spark, str(root), store, config)
    assert (third["files_deleted"], third["files_changed"], third["documents"]) == (1, 1, 2)  # the copy of a.txt comes back
    assert {r.source.rsplit("/", 1)[1] for r in spark.read.parquet(f"{store}/chunks").collect()} == {"b.txt", "c.md"}
    other = ingest(spark, str(root), store, ChunkConfig("fixed", 8, 1))
    assert other["chunks_reused"] == 0
    found = json.loads(cli.main(["search", store, "d3 d4", "--top-k", "1"], spark))
    assert found[0]["source"].endswith("c.md")
    assert json.loads(cli.main(["ask", store, "d3"], spark))[0]["cited"] == [1]


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    files.replace_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), path)
    files.replace_jsonl(spark.createDataFrame([(2, "x"), (3, None)], "a int, b string"), path)
    assert sorted(r.a for r in files.read_jsonl(spark, path, "a int, b string").collect()) == [2, 3]


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([("s1", "one two three")], "source string, text string").write.parquet(source)
    run = lambda: chunk_stream(spark, source, "source string, text string", out, str(tmp_path / "state"), ChunkConfig("fixed", 8)).awaitTermination()
    run()
    spark.createDataFrame([("s2", "four")], "source string, text string").write.mode("append").parquet(source)
    run()
    assert {r.text for r in spark.read.parquet(out).collect()} == {"one two three", "four"}
    shutil.rmtree(out)


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 40
