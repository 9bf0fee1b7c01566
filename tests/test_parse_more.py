import pytest

from gaugeworks.operators import entities, parse
from gaugeworks.sources import repository, store
from pyspark.sql import functions as F


def rows(text, suffix=".ts"):
    return [r[:7] for r in parse._PARSERS[suffix](text)]


def test_braced_languages():
    text = """// Counts what is left.
export function left(a: number[], b = { x: 1 }): number {
  const s = "class InString { }"; // class InComment {}
  return a.filter((x) => keep(x)).length;
}

/**
 * Keeps rows.
 */
public class Store extends Base {
    /* one row */
    public int add(final Row row, int n) {
        if (check(row)) { save(row); }
        return super.add(row);
    }
}
const quick = async (q) => { run(q); };
"""
    got = {r[1]: r for r in rows(text)}
    assert set(got) == {"left", "Store", "Store.add", "quick"}
    assert got["left"][2:4] == (2, 5) and got["left"][4] == ["a", "b"] and got["left"][5] == "Counts what is left." and got["left"][6] == ["filter", "keep"]
    assert got["Store"][2:4] == (10, 16) and got["Store"][5] == "Keeps rows."
    assert got["Store.add"][4] == ["row", "n"] and got["Store.add"][5] == "one row" and got["Store.add"][6] == ["add", "check", "save"]
    assert got["quick"][6] == ["run"]
    assert rows("int main(void) {\n  return work(1);\n", ".c")[0][1:4] == ("main", 1, 2)
    assert rows("let t = `class InString {}`;\nif (a) { b(); }") == [] and rows("") == []


def test_declarations_by_language():
    assert [r[1] for r in rows("# class NotOne\ncurl http://x/y # sub\nf2 <- function(x) x\n", ".r")] == ["f2"]
    assert [r[1] for r in rows("-- create table no\ncreate table yes_1 (a int);\n", ".sql")] == ["yes_1"]
    assert parse.strip_comments("a=${x#y} # note\n", "hash") == "a=${x#y} \n"


def test_conditions_to_show_and_change():
    code = "def f(x, y):\n    if x is None:\n        raise ValueError\n    assert y > 0\n    for i in y:\n        if i < 3:\n            go(i)\n    return y\n"
    assert entities.requirements_of(code) == ["x is not None", "y > 0"] and entities.requirements_of("def (") == []
    assert [entities.mutated(c) for c in ("a < b and c", "x == 1", "f(x)", "(")] == ["a <= b and c", "x != 1", None, None]
    pieces = {(p["start"], p["lines"]): p["condition"] for p in entities.snippets_of(code)}
    assert pieces == {(1, 8): True, (2, 2): True, (5, 3): True, (6, 2): True}
    assert all(p["lines"] <= entities.SHOWN_LINES for p in entities.snippets_of("def g():\n" + "    a = 1\n" * 40 + "    if a:\n        b()\n"))


def test_display_pick(spark):
    src = spark.createDataFrame([(1, "c1", "def load_rows(t):\n    return t\n"), (1, "c2", "def other(t):\n    if t:\n        return 1\n"), (1, "c3", "def load_rows(t):\n    if t:\n        return rows(t)\n"), (2, "c1", "x = 1"), (3, "c9", None)], "p int, chunk_id string, code string")
    names = spark.createDataFrame([(1, "load rows"), (2, "x"), (3, None)], "p int, context string")
    got = [(r.p, r.chunk_id, r.start, r.lines) for r in entities.display_pick(src, names, "p").collect()]
    assert got == [(1, "c3", 1, 3)]
    plain = entities.display_pick(src, names, "p", F.lit(False)).collect()
    assert [(r.p, r.chunk_id) for r in plain] == [(1, "c1")]


def test_repository_names_and_snapshots(spark):
    urls = ["https://github.com/a-b/c.d.git", "https://github.com/a/b/", "http://github.com/a/b", "https://github.com/a/b/c", "https://example.invalid/a/b", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.n for r in df.select(repository.repository_name(F.col("u")).alias("n")).collect()] == ["a-b/c.d", "a/b", None, None, None, None]
    commit = "0123456789abcdef0123456789abcdef01234567"
    tree = lambda *fs: spark.createDataFrame([(p, bytearray(c.encode())) for p, c in fs], "path string, content binary")
    assert repository.checked_out(tree((".git/HEAD", "ref: refs/heads/main\n"), (".git/refs/heads/main", commit + "\n"), ("a.py", "x"))) == commit[:12]
    assert repository.checked_out(tree((".git/HEAD", "ref: refs/heads/main\n"), (".git/packed-refs", f"# pack\n{commit} refs/heads/main\n"))) == commit[:12]
    assert repository.checked_out(tree((".git/HEAD", commit))) == commit[:12] and repository.checked_out(tree(("a.py", "x"))) is None


def test_documents_of_more_kinds():
    assert repository.document_text("a.tsv", b"a\tb") == "a b" and repository.document_text("b.xml", b"<a>x</a>") == "<a>x</a>"
    assert repository.document_text("c.pdf", b"not a pdf") is None and repository.document_text("d.bin", b"x") is None


def test_lookups_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 5), (3, "a", 6)], "id bigint, k string, n int")
    assert store.lookup(df, k="a") == {"id": 1, "k": "a", "n": 5} and store.lookup(df, n=None)["id"] == 2 and store.lookup(df, k="z") is None
    assert [r.id for r in store.rows_where(df, "k = :k and n > :low", {"k": "a", "low": 4}).collect()] == [3, 1]
    assert [r.id for r in store.rows_where(df, order=[F.col("k"), F.col("id")]).collect()] == [1, 3, 2]
    log = str(tmp_path / "log")
    store.append_log(df, log)
    store.append_log(df.limit(1), log)
    assert spark.read.parquet(log).count() == 4
    with pytest.raises(ValueError):
        store.append_log(spark.readStream.schema(df.schema).parquet(log), str(tmp_path / "out"))
    q = store.append_log(spark.readStream.schema(df.schema).parquet(log), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
