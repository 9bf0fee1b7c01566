import json

from gaugeworks.llm import docpairs as D

LONG = "Decides whether the route may be renamed while it is local."

CASES = {
    ".js": f"// {LONG}\nfunction one() {{ if (x) {{ y = \"}}\"; }} }}\n\n/**\n * {LONG}\n * @param a b\n */\nexport const two = async (a) => {{\n  return `}}`;\n}};\n\n// {LONG}\n\nfunction apart() {{}}\n\n/* TODO */\nfunction three() {{}}\n",
    ".java": f"  /** {LONG} */\n  @Override\n  public List<String> one(List<String> a) {{ return '}}'; }}\n\n  /**\n   * Trim x.\n   * @param a the long list of many different words here\n   */\n  private int three() {{ return 0; }}\n\n  // {LONG}\n  static void two() {{\n",
    ".go": f"// {LONG}\nfunc (t *T) one(a []string) (int, error) {{\n\treturn 0\n}}\n\n// {LONG}\nfunc two() {{}}\n\n//\nfunc three() {{}}\n",
    ".R": f"#' {LONG}\n#' @export\none <- function(a) {{\n  \"}}\"\n}}\n\n# {LONG}\ntwo = function(a, b) {{}}\n\n#' docstring\nthree <- function() {{}}\n",
    ".sh": f"# {LONG}\none() {{\n  echo \"${{x}}\"\n}}\n\n# {LONG}\nfunction two {{\n  :\n}}\n\n# See above.\nthree() {{ :; }}\n",
    ".sql": f"-- {LONG}\nCREATE OR REPLACE FUNCTION one(a INTEGER) RETURNS INTEGER AS $$\n SELECT 1;\n$$ LANGUAGE sql;\n\n/* {LONG} */\ncreate function two() returns int as $$ select 2 $$ language sql;\n\n-- pass\nCREATE FUNCTION three() AS $$ $$;\n",
    ".c": f"/*\n * {LONG}\n */\nstatic int one(int a) {{ if (a) {{ }} return 0; }}\n\n// {LONG}\nvoid two(void) {{ }}\n\n/** Two words. */\nlong three(int a) {{ }}\n",
    ".cs": f"  /// <summary>\n  /// {LONG}\n  /// </summary>\n  public void one() {{ }}\n\n  // {LONG}\n  [Obsolete]\n  private static int two(List<int> a) {{ }}\n\n  /// <summary>\n  /// pass\n  /// </summary>\n  public void three() {{ }}\n",
    ".py": f'def one(a="()"):\n    """{LONG}\n\n    :param a: x\n    """\n    return 1\n\n# {LONG}\n@cached\nasync def two(a, b):\n    return 2\n\ndef three():\n    x = 1\n    "{LONG}"\n\n# {LONG}\n\ndef four():\n    r\'\'\'TODO: write down what this does one day soon\'\'\'\n',
}


def names(text, file):
    return sorted({p[0] for p in D.pairs(text, file)})


def test_languages():
    for suffix, code in CASES.items():
        assert names(f"X file a{suffix} (9 lines).\nContent (lines 1-9):\n{code}", f"a{suffix}") == ["one", "two"], suffix


def test_chunk_documentation_line():
    text = f"Async function A.run in a.py (lines 1-2).\nParameters: x.\nDocstring: {LONG}\nCode:\nasync def run(self, x):\n    return x"
    assert D.pairs(text, "a.py") == [("run", LONG, "async def run(self, x):", "async def run(self, x):\n    return x")]
    assert names(text.replace(LONG, "none"), "a.py") == []


def test_balanced_bodies():
    (_, _, sig, code), *_ = D.pairs(CASES[".js"], "a.js")
    assert sig == "function one()" and code.endswith('"}"; } }')
    cut = D.pairs(f"// {LONG}\nfunction cut() {{ if (x) {{\n", "a.js")
    assert cut[0][0] == "cut"


def test_descriptions():
    assert D.describe("/**\n * One.\n * @param x the thing\n *   that goes on\n *\n * Two.\n */") == "One.\nTwo."
    assert D.describe("# ---- section ----") == ""
    assert not D.says_something("build the route meter build route meter", "buildRouteMeterThe")
    assert D.says_something("检查输入是否完整并返回有效的行", "f")
    assert not D.says_something("return compute(a, b, c, d, e, f);", "g")


def test_slow_inputs_end():
    for text in ("// a b c d e f g\nfunction f(" + "(" * 20_000, "/*" + "*" * 50_000, "// x y z a b c d\n" * 5_000, '"' * 30_000, "#' " * 10_000, "{" * 30_000):
        for suffix in CASES:
            D.pairs(text, "a" + suffix)


def test_frame(spark):
    c = json.dumps([{"id": "c0", "text": CASES[".go"], "file": "a.go"}, {"id": "c1", "text": "", "file": "a.go"}, {"id": "c2", "text": CASES[".go"], "file": None}])
    df = spark.createDataFrame([(1, c, "x")] * 2 + [(2, None, "x"), (3, "[", "x")], "id bigint, chunks_json string, function_name string")
    assert sorted(map(tuple, D.documented_functions(df).collect())) == [(1, "c0", "one"), (1, "c0", "two")]
    assert D.code_description_pairs(df).count() == 2
    assert D.documented_functions(df.limit(0)).count() == 0


def test_functions_in_bodies():
    for suffix, code in {
        ".js": f"// setup\nfunction make() {{\n  // {LONG}\n  function inner(a) {{ return a; }}\n\n  /** {LONG} */\n  const other = (b) => {{\n    return b;\n  }};\n  return inner;\n}}\n",
        ".go": f"// setup\nfunc outer() {{\n// {LONG}\nfunc inner() {{\n}}\n}}\n",
        ".R": f"# setup\nouter <- function(a) {{\n  # {LONG}\n  inner <- function(b) {{ b }}\n  inner\n}}\n",
        ".sh": f"# setup\nouter() {{\n  # {LONG}\n  inner() {{\n    :\n  }}\n}}\n",
        ".cs": f"// setup\npublic int outer() {{\n  // {LONG}\n  int inner(int a) {{ return a; }}\n  return inner(1);\n}}\n",
    }.items():
        assert names(code, "a" + suffix) == (["inner", "other"] if suffix == ".js" else ["inner"]), suffix


def test_languages_by_content():
    for suffix in (".js", ".java", ".go", ".R", ".sh", ".sql", ".c", ".cs", ".py"):
        assert names(CASES[suffix], "a.inc") == ["one", "two"], suffix
    for suffix in (".R", ".js"):
        assert names(f"Notebook a.ipynb, code cell 1 (cells 1-1):\n{CASES[suffix]}", "a.ipynb") == ["one", "two"], suffix
    assert names("The function of this text is to say something, and no more than that.\n", "a.md") == []
