import io
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from gaugeworks.operators import parse
from gaugeworks.sources import provider, repository, store
from gaugeworks.streaming import streams

CODE = '''
import os
from .pkg import mod as m
LIMIT: int = 3

class A(Base):
    """Doc."""
    async def run(self, x, *, y=1):
        # helper()
        return helper(x).go()

def outer():
    def inner(): pass
    inner()
'''


def test_python_symbols(spark):
    df = spark.createDataFrame([(1, "a.py", CODE), (1, "b.js", "// class No\nclass Yes {}\nconst x = 'function not()';\nfunction f() {}"), (2, "c.py", "def broken(:"), (3, "d.py", None), (3, "e.unknown", "x")], "p bigint, file string, text string")
    rows = parse.symbols(df, ["p"], "file", "text").collect()
    got = {(r.file, r.kind, r.name) for r in rows}
    assert {("a.py", "class", "A"), ("a.py", "async_function", "A.run"), ("a.py", "function", "outer.inner"), ("a.py", "import", "os"), ("a.py", "import_from", ".pkg"), ("a.py", "variable", "LIMIT"), ("b.js", "declaration", "Yes"), ("b.js", "declaration", "f"), ("c.py", "error", "SyntaxError")} <= got
    assert ("b.js", "declaration", "No") not in got and ("b.js", "declaration", "not") not in got
    run = next(r for r in rows if r.name == "A.run")
    assert (run.names, run.calls) == (["x", "y"], ["go", "helper"])
    assert ("a.py::outer", "inner") in {(r.caller, r.callee) for r in parse.calls(parse.symbols(df, ["p"], "file", "text"), ["p"]).collect()}


def test_strip_comments():
    assert parse.strip_comments('a = "// no"; // yes\n/* x\ny */ b', "c") == 'a = "// no"; \n\n b'
    assert parse.strip_python_comments('x = "# no"  # yes\n') == 'x = "# no"\n'
    assert parse.strip_comments("select '--no' -- yes", "sql") == "select '--no' "


def test_repository(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("print(1)\n")
    (tmp_path / "README.md").write_text("# Hello")
    (tmp_path / "requirements.txt").write_text("numpy>=1 # n\n-r other.txt\npandas[x]==2\n")
    (tmp_path / "node_modules" / "x" / "i.js").write_text("x")
    (tmp_path / "a.min.js").write_text("x")
    (tmp_path / "photo.png").write_bytes(b"\x89")
    files = repository.read_tree(spark, str(tmp_path))
    assert sorted(r.path for r in repository.scan(files).collect()) == ["README.md", "requirements.txt", "src/a.py"]
    r = repository.prune_report(files).first()
    assert (r.kept, r.removed) == (3, 3)
    assert repository.within_limit(files, 1.0).first().accepted
    assert [x.dependency for x in repository.dependencies(repository.scan(files)).orderBy("dependency").collect()] == ["numpy", "pandas"]
    assert repository.readme(repository.scan(files)).first().path == "README.md"


def test_archives_and_documents(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("top/a.py", "x = 1")
        z.writestr("top/../../evil.py", "no")
        z.writestr("top/b/c.txt", "hi")
    df = spark.createDataFrame([("u.zip", bytearray(buffer.getvalue())), ("bad.zip", bytearray(b"nope"))], "path string, content binary")
    assert sorted(r.path for r in repository.unzip(df).collect()) == ["a.py", "b/c.txt"]
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:d>')
    files = spark.createDataFrame([("a.docx", 1, bytearray(docx.getvalue())), ("b.md", 1, bytearray(b"x  y\r\n\r\n\r\n\r\nz\xff")), ("c.bin", 1, bytearray(b"x"))], "path string, length bigint, content binary")
    assert {r.path: r.text for r in repository.documents(files).collect()} == {"a.docx": "One\nTwo", "b.md": "x y\n\nz\ufffd"}


def test_notebooks(spark):
    nb = {"metadata": {"kernelspec": {"language": "R"}}, "cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "c"}, {"cell_type": "code", "source": []}]}
    rows = repository.notebook_cells(spark.createDataFrame([("n.ipynb", json.dumps(nb)), ("bad.ipynb", "{")], "path string, text string")).orderBy("cell").collect()
    assert [(r.cell, r.language, r.source) for r in rows] == [(1, "R", "a\nb"), (2, "R", "c")]


def test_budget(spark):
    rows = [(1, "b.py", "x" * 40), (1, "README.md", "x" * 30), (1, "a.py", "x" * 60), (1, "tests/t.py", "x" * 20), (1, "c.py", "x" * 35)]
    got = repository.select_within_budget(spark.createDataFrame(rows, "g bigint, path string, text string"), "g", 100).orderBy("position").collect()
    assert [r.path for r in got] == ["README.md", "b.py", "tests/t.py"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.execute("create table questions (id integer primary key, stem text)")
    con.executemany("insert into questions values (?, ?)", [(i, f"s{i}") for i in range(1, 50)])
    con.commit()
    con.close()
    df = store.read_sqlite(spark, path, "questions", "id bigint, stem string", parts=4)
    assert df.count() == 49
    changes = spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (99, "add", 1)], "id bigint, stem string, o int")
    state = store.upsert(df, changes, "id", "o")
    assert {r.id: r.stem for r in state.where("id in (1, 2, 99)").collect()} == {1: "newer", 2: "s2", 99: "add"}
    assert store.delete(state, changes, "id").count() == 48
    q = spark.createDataFrame([(1, "<b>", [("A", "x & y")], ["A"])], "id int, stem string, options array<struct<key:string,text:string>>, answer array<string>")
    assert store.print_view(q).first().html == "<p>&lt;b&gt;</p><ol><li>A. x &amp; y</li></ol>"


def test_provider(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None)], "k bigint, p string")
    assert {r.k: json.loads(r.answer)["n_words"] for r in provider.complete(df, "k", "p").collect()} == {1: 2, 2: 0}
    assert provider.outermost_object('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and provider.outermost_object("{bad") is None


def events(spark):
    rows = [(i, 1_000_000 * t, u, k) for i, (t, u, k) in enumerate([(0, 1, "bad"), (1, 1, "bad"), (2, 1, "bad"), (3, 1, "bad"), (11, 1, "bad"), (12, 1, "good"), (13, 1, "bad"), (0, 2, "good"), (5, 2, "bad")])]
    return spark.createDataFrame(rows, "e bigint, t bigint, u bigint, k string").withColumn("ts", F.timestamp_micros("t"))


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    batch = streams.failure_throttle(events(spark), "u", "ts", "e", "k", "bad", "good", limit=2, seconds=10)
    want = {r.e: r.blocked for r in batch.collect()}
    assert want == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False}
    src = str(tmp_path / "in")
    events(spark).select("e", "u", "t", F.col("k").alias("kind")).repartition(1).write.parquet(src)
    stream = spark.readStream.schema("e bigint, u bigint, t bigint, kind string").parquet(src)
    out = streams.run_to_end(streams.failure_throttle_stream(stream, "u", "e", "bad", "good", limit=2, seconds=10), "throttled", str(tmp_path / "cp"), "append")
    assert {r.e: r.blocked for r in out.collect()} == want


def test_windows_in_stream_and_batch_agree(spark, tmp_path):
    df = events(spark).withColumn("value", F.lit(1.0))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = streams.run_to_end(streams.tumbling(stream, "ts", "5 seconds", ["k"], "1 minute"), "tumbled", str(tmp_path / "cp"))
    want = streams.tumbling(df, "ts", "5 seconds", ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_states(spark):
    steps = spark.createDataFrame([(1, 0, 0, False), (1, 1, 1, True), (1, 2, 2, False), (2, 0, 0, False), (2, 1, 3, True), (2, 2, 1, False), (2, 3, 2, False), (2, 4, 3, False), (3, 0, 1, True)], "r bigint, o int, attempt int, ok boolean")
    assert {x.r: (x.state, x.attempts) for x in streams.run_states(steps, "r", "o").collect()} == {1: ("complete", 2), 2: ("rejected", 4), 3: ("running", 0)}
