"""JavaScript and PHP units against a character-by-character reading, and by hand."""

import random
import re

import pytest

from lodestone.operators import script_units

JS = """// function no(req) {
const a = require('x');
function one(req, res) { if (x) { return "}"; } /* } */ }
async function two(a) {
  const s = `}${'{'}`, t = '\\'}';
  fs.readFile(a, function (e) { three(e); });
}
const four = async (x, y) => {
  return two(x); // }
};
let five = (z) => z.map(one);
function six(context)
{
  while (go()) { }
"""


def test_javascript_by_hand(spark):
    rows = script_units.javascript_functions(spark.createDataFrame([(1, JS), (2, None), (3, "x = 1"), (4, "function f()")], "file_id long, content string")).collect()
    got = {r["symbol"]: (r["file_id"], r["unit_type"], r["start_line"], r["end_line"], r["calls"]) for r in rows}
    assert got == {
        "one": (1, "handler", 3, 3, ["one"]), "two": (1, "function", 4, 7, ["fs.readFile", "readFile", "three", "two"]), "four": (1, "function", 8, 10, ["two"]),
        "five": (1, "function", 11, 11, []), "six": (1, "handler", 12, 15, ["go", "six"]),
    }
    assert next(r["code"] for r in rows if r["symbol"] == "two") == JS[JS.index("async function two") : JS.index("const four")].rstrip()


def test_very_long_tokens(spark):
    """Strings with many escapes and comments with many stars, an unbroken word, many braces."""
    parts = ['"' + '\\"' * 100_000 + '}"', "/*" + "*} " * 100_000 + "*/", "w" * 300_000, "{" * 20_000 + "}" * 20_000]
    files = [(i, f"function a(req) {{\n{x}\n}}\nfunction b() {{}}") for i, x in enumerate(parts)]
    rows = script_units.javascript_functions(spark.createDataFrame(files, "file_id long, content string")).collect()
    assert sorted((r["file_id"], r["symbol"], r["start_line"], r["end_line"]) for r in rows) == [(i, *u) for i in range(4) for u in (("a", 1, 3), ("b", 4, 4))]


def brute(text):
    """name, start and end line of each named function, reading character by character."""
    closed, stack, i, state, out = {}, [], 0, "", []
    heads = {}
    while i < len(text):
        two, c = text[i : i + 2], text[i]
        if state == "":
            if two in ("//", "/*"):
                state, i = two, i + 2
                continue
            m = re.compile(r"function\s+(\w+)\s*\([^)]*\)").match(text, i)
            if m and (i == 0 or not re.match(r"[\w$]", text[i - 1])):
                heads[i] = (m[1], m.end())
                i = m.end()
                continue
            if c in "\"'`":
                state = c
            elif c == "{":
                stack.append(i)
            elif c == "}" and stack:
                closed[stack.pop()] = i
        elif state == "//" and c == "\n" or state == "/*" and two == "*/":
            i += state == "/*"
            state = ""
        elif state in "\"'`" and c == "\\":
            i += 1
        elif state == c:
            state = ""
        i += 1
    opens = sorted([*closed, *stack])
    for at, (name, end) in heads.items():
        o = next((x for x in opens if x >= end), None)
        if o is not None:
            out.append((name, text.count("\n", 0, at) + 1, text.count("\n", 0, closed.get(o, len(text))) + 1))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_braces_against_reading(spark, seed):
    """Pieces in any order. Closing braces never outnumber opening ones."""
    r = random.Random(seed)
    pieces = ["{", "{\n", "x\n", "'}'", '"{\\""', "`{\n}`", "/* } \n*/", "// {\n", "a / b", "function f%d(a) {\n", "function g%d(){", "}", "\n}", "fn$", "; "]
    files = []
    for i in range(40):
        text, depth = "", 0
        for k in range(r.randint(1, 40)):
            p = r.choice(pieces)
            p = p % k if "%" in p else p
            if p.strip() == "}" and depth == 0:
                continue
            depth += (p.strip() != "// {" and p.strip().endswith("{") and p[0] not in "'\"`/") - (p.strip() == "}")
            text += p + r.choice(["", " "])
        files.append((i, text))
    got = {}
    for u in script_units.javascript_functions(spark.createDataFrame(files, "file_id long, content string")).collect():
        got.setdefault(u["file_id"], []).append((u["symbol"], u["start_line"], u["end_line"]))
    assert {i: sorted(got.get(i, [])) for i, _ in files} == {i: brute(t) for i, t in files}


def test_php(spark):
    files = [
        (1, "web/a.php", "<html>\n<?php echo strlen($_GET['q']); ?>\n<b>\n<?= $x->run(1) ?>\n</b>\n"),
        (2, "b.php", "\n<?php\n# }\nif (a()) { b(); }"),
        (3, "c.php", "<?php\nclass A {\n  public static function go($x) {\n    if ($x) { return \"}\"; }\n  }\n}\nfunction top() { }\n"),
        (4, "d.php", "<b>no code</b>"),
        (5, "e.php", "<?php interface I {}\nclass E {}"),
    ]
    rows = script_units.php_units(spark.createDataFrame(files, "file_id long, path string, content string")).collect()
    got = sorted((r["file_id"], r["symbol"], r["unit_type"], r["start_line"], r["end_line"], r["calls"]) for r in rows)
    assert got == [
        (1, "<script:a.php>", "handler", 2, 4, ["run", "strlen"]), (2, "<script:b.php>", "function", 2, 4, ["a", "b"]),
        (3, "go", "function", 3, 5, ["go"]), (3, "top", "function", 7, 7, ["top"]),
    ]


def test_tokens_are_not_shuffled(spark):
    """Nothing is exchanged or sorted: a file's tokens stay in its row; braces that close nothing don't pair with later ones."""
    files = spark.createDataFrame([(1, "a.js", "} }\nfunction f(x) { { }\n const g = (y) => y;\n}\n{ function h(z)"), (2, "b.php", "<?php } function k() { if (1) { } } ?>")], "file_id long, path string, content string")
    for found in (script_units.javascript_functions(files), script_units.php_units(files)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan
    rows = {(r["file_id"], r["symbol"]): (r["start_line"], r["end_line"], r["code"]) for r in script_units.javascript_functions(files).collect()}
    assert rows[1, "f"] == (2, 4, "function f(x) { { }\n const g = (y) => y;\n}") and rows[1, "g"] == (3, 3, "const g = (y) =>") and (1, "h") not in rows
    assert [(r["symbol"], r["code"]) for r in script_units.php_units(files).where("file_id = 2").collect()] == [("k", "function k() { if (1) { } }")]
