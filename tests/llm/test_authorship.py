import json
import random

import numpy as np

from gaugeworks.llm import authorship as A
from gaugeworks.llm import grammar as G

rnd = random.Random(7)
HAND = "def load(rows):\n    if not rows:\n        return []\n    total = 0\n    for r in rows:\n        total += r['n']\n    return [total]\n\nclass Store:\n    def save(self, path, mode='w'):\n        with open(path, mode) as f:\n            f.write(str(self))\n"


def judge(path, code, source="s1", pid=1, stats=None):
    rows = [(pid, source, json.dumps([{"id": "c0", "file": path, "text": code, "start_line": 1}]), json.dumps(stats) if stats else None)]
    out = A.judge(rows)
    return next((r for r in out[3] if r), None) if out else None


def test_grammar_by_hand():
    g = G.infer(np.array([1, 2, 1, 2, 1, 2, 1, 2], np.uint64), np.zeros(8, np.int64), 1)
    assert g.terminals[0] == 8 and g.size()[0] <= 6 and g.reused[0] == 8
    g = G.infer(np.arange(10, dtype=np.uint64), np.zeros(10, np.int64), 1)
    assert g.rules[0] == 0 and g.start[0] == 10
    g = G.infer(np.array([5] * 9, np.uint64), np.zeros(9, np.int64), 1)
    assert g.size()[0] < 9
    assert len(G.infer(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0).terminals) == 0


def test_grammar_of_a_text_does_not_depend_on_its_block():
    texts = [[rnd.randrange(6) for _ in range(rnd.randrange(3, 200))] for _ in range(30)]
    flat, owner = np.array(sum(texts, []), np.uint64), np.repeat(np.arange(30), list(map(len, texts)))
    for block in (1, 500, 1 << 20):
        g = G.infer(flat, owner, 30, block)
        for i, t in enumerate(texts):
            one = G.infer(np.array(t, np.uint64), np.zeros(len(t), np.int64), 1)
            assert (g.start[i], g.rules[i], g.whole[i]) == (one.start[0], one.rules[0], one.whole[0])


def test_kinds():
    fields = "\n".join(f"_F{i} = DESCRIPTOR.fields[{i}]; _F{i}._start={i * 7}" for i in range(9))
    numbers = "X = [\n" + "\n".join("  " + ", ".join(str(rnd.randrange(65000)) for _ in range(10)) + "," for _ in range(20)) + "\n]"
    blob = 'X = "" +\n' + " +\n".join('  "' + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(76)) + '"' for _ in range(9))
    minified = "!function(a){a.b=1}(c);" * 60
    assert judge("src/x.py", fields) == "generated"
    assert judge("src/x.c", numbers) == "data" and judge("x.js", blob) == "data"
    assert judge("assets/x.js", minified) == "minified"
    assert judge("lib/x.sql", "\n".join(f"INSERT INTO t VALUES ({i}, {i * 3}, 'w{i}', 1.5);" for i in range(40))) == "data"
    assert judge("src/x.go", "// Code generated by foo v1.2. DO NOT EDIT.\n\n" + HAND) == "generated"
    assert judge("src/x.js", "/*! kit v2.1.0 | (c) 2014 kit contributors | MIT License */\n" + HAND) == "vendored"
    assert judge("src/x.py", "#!/usr/bin/env python\n# Automatisch erzeugt durch foo, bitte nicht bearbeiten.\n" + HAND) == "generated"


def test_hand_written():
    assert judge("src/x.py", HAND) is None
    assert judge("tools/w.py", 'HEADER = "# Generated by w.py, do not edit"\n' + HAND) is None
    assert judge("src/x.py", "# builds the weekly report; generated pages go to out/\n" + HAND) is None
    assert judge("src/x.js", "/*\n * a module of our course project\n * Copyright 2025 the project team, licensed under the MIT License\n */\n" + HAND) is None
    assert judge("settings.toml", "\n".join(f'key_{i} = "{i}"' for i in range(40))) is None
    assert judge("big.ipynb", "x = [1, 2, 3]\n" * 500) is None
    assert judge("src/vendors/pay.py", HAND) is None and judge("src/x.py", "LIMITS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]") is None


def test_paths():
    for p in ("vendor/x/all.js", "node_modules/a/b.js", "proto/x_pb2.py", "static/x.min.js", "a/x.designer.cs", "web/x.bundle.js", "src/form-8.24.7.js", "third_party/k/a.c", "public/app.76f4312e.css"):
        assert A.by_path(p), p
    for p in ("src/bundle_x.js", "src/vendors/a.py", "external_api/a.py", "builders/a.py", "notebooks/n.ipynb", "src/report_v2.py", "min.js"):
        assert A.by_path(p) is None, p


def test_frame(spark):
    shared = HAND + "\n\ndef more(a, *, b=None):\n    while a:\n        a -= 1\n        if b is None or a in b:\n            yield a, {b: a}\n"
    project = lambda pid, source, path, code: (pid, source, json.dumps([{"id": "c0", "file": path, "text": code}]), json.dumps({"skipped_files": [f"static/p{pid}.min.js (5.2 MB)", "nb/x.ipynb (60.1 MB)"]}), "clash")
    rows = [project(1, "a", "util.py", shared), project(2, "b", "lib/u.py", "# my own copy\n" + shared), project(3, "c", "u.py", shared), project(4, "c", "mine.py", HAND)]
    rows += [rows[0], (5, None, None, None, ""), (None, "a", rows[0][2], None, ""), (6, "d", "[", '{"skipped_files": ', "")]
    df = spark.createDataFrame(rows, "id bigint, source string, chunks_json string, stats_json string, file string")
    got = sorted((r.project_id, r.file, r.reason) for r in A.not_hand_written(df).collect())
    assert got == [
        (1, "static/p1.min.js", "minified"), (1, "util.py", "vendored"), (2, "lib/u.py", "vendored"), (2, "static/p2.min.js", "minified"),
        (3, "static/p3.min.js", "minified"), (3, "u.py", "vendored"), (4, "static/p4.min.js", "minified"),
    ]
    assert A.not_hand_written(df.where("source = 'a'")).where("file = 'util.py'").count() == 0
    assert A.not_hand_written(df.limit(0)).count() == 0


def test_patched_copies(spark):
    gen = random.Random(19)
    name = lambda: "".join(gen.choice("abcdefghij") for _ in range(6))
    line = lambda: gen.choice(["{0} = {1}[{2}]", "{0}({1}, {2})", "{0} = {1} + {2} * {3}", "{0}.{1} = [{2}]", "assert {0} in {1}", "{0} = {{'{1}': {2}, '{3}': {0}}}", "del {0}[{1}:{2}]", "{0} = {1}({2}).{3}"]).format(*(name() for _ in range(4)))
    block = lambda n: "\n".join([f"def {name()}({name()}):"] + ["    " + line() for _ in range(n - 1)])
    body = [block(4) for _ in range(10)]
    code = "\n".join(body)
    copies = [code, "# our header\n" + code.replace(body[2], body[2] + "  # patched"), code.replace(body[5], "x = 1"), "import os\n\n" + "\n".join(body[:8])]
    rows = [(i, f"repo{i}", json.dumps([{"id": "c0", "file": f"p{i}.py", "text": x}]), None) for i, x in enumerate(copies)]
    # seen through other chunks
    rows.append((8, "repo8", json.dumps([{"id": f"c{k}", "file": "p8.py", "text": "\n".join(body[k : k + 5]), "start_line": 1 + 4 * k} for k in (0, 5)]), None))
    # one block of a file that is otherwise its own, two repositories only, and a repeat of a project
    own = "\n".join(block(6) for _ in range(6))
    two = "\n".join(block(6) for _ in range(6))
    rows += [(10 + i, f"repo{i % 2}", json.dumps([{"id": "c0", "file": "two.py", "text": two}]), None) for i in range(4)] + rows[:1]
    # the same check over and over is no copy
    idiom = "\tif rows == nil {\n\t\treturn nil\n\t}\n" * 3
    rows += [(20 + i, f"repo{i}", json.dumps([{"id": "c0", "file": "i.go", "text": f"func {name()}(rows []string) []string {{\n{idiom}\treturn nil\n}}\n"}]), None) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, source string, chunks_json string, stats_json string")
    got = sorted(map(tuple, A.not_hand_written(df).collect()))
    assert got == [(i, f"p{i}.py", "vendored") for i in (0, 1, 2, 3, 8)]


def test_marks_below_a_licence():
    licence = [
        "Licensed to the Foundation under one or more agreements; see the NOTICE file.", "You may obtain a copy of the License at", "", "    https://licences.example/LICENSE-2.0", "",
        "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an AS IS basis,", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "The contents of the NOTICE file are for information only and", "do not modify the License.", "See the License for the specific language governing permissions and", "limitations under the License.", "",
    ]
    slashes = "\n".join(f"// {x}" for x in licence) + "\n"
    block = "/*\n" + "\n".join(licence) + "\n*/\n\n"
    for head in (slashes, slashes * 3, block, "/*\n * " + "\n * ".join(licence) + "\n */\n"):
        assert judge("src/x.go", head + HAND) is None
        for mark in ("// Code generated by client-gen. DO NOT EDIT.", "// This file was automatically generated by foo v1", "/* @generated */", "// Automatisch erzeugt durch foo.", "// NOTE: this file is generated by protogen"):
            assert judge("src/x.go", head + mark + "\n\n" + HAND) == "generated", (head, mark)
        for said in ("// lists the pages generated by the weekly job", "// Readers should see the file generated by w.go", "// the code here must not change: callers do not edit rows"):
            assert judge("src/x.go", head + said + "\n" + HAND) is None, said
    assert judge("src/x.js", block.replace("*/", "kit v2.1.0, Copyright 2014 the kit team\n*/") + HAND) == "vendored"
