"""Ignore rules of nested folders."""

import re

import pytest

from lodestone.operators import ignore_rules


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.pyc", ["a.pyc", "x/y.pyc"], ["a.py", "a.pyc/x"]),
        ("/top", ["top"], ["a/top"]),
        ("a/b", ["a/b"], ["x/a/b", "a/x/b"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["b"]),
        ("**/b", ["b", "x/b"], ["xb"]),
        ("a/**", ["a/x", "a/x/y"], ["a"]),
        ("f?[0-9].t*", ["fx3.txt", "d/fy0.t"], ["f/3.txt", "fxx.txt"]),
        ("[!a]x", ["bx"], ["ax"]),
        ("a.b+(c)", ["a.b+(c)"], ["aXb+(c)"]),
        ("\\!x", ["!x"], ["x"]),
        ("build/", ["build", "x/build"], ["build2"]),
        ("[x", ["[x"], ["x"]),
    ],
)
def test_patterns(pattern, yes, no):
    rule = re.compile(ignore_rules.rule_regex(pattern))
    assert all(rule.search(p) for p in yes) and not any(rule.search(p) for p in no)


RULES = {
    "": "# all\n*.log\n\nbuild/\n/only.txt\n!keep.log\n  \n",
    "src": "!*.log\nbad.log\ngen\n",
    "src/deep": "*.py\n!yes.py\r\n",
    "build": "!*\n",
    "vendor": "*\n!*/\n!ok.py\n",
}
REASONS = {
    "a.log": "ignored", "keep.log": "extension", "x/y/b.log": "ignored", "only.txt": "ignored", "x/only.txt": None,
    "src/a.log": "extension", "src/bad.log": "ignored", "src/x/bad.log": "ignored", "src/gen/a.py": "ignored", "src/a.py": None,
    "src/deep/no.py": "ignored", "src/deep/yes.py": None, "src/deep/x/yes.py": None, "src/deep/x/a.log": "extension",
    # What lies below an ignored folder doesn't come back; a file called build is no folder.
    "build/a.py": "ignored", "x/build/a.py": "ignored", "x/build": "extension", "vendor/no.py": "ignored", "vendor/ok.py": None, "vendor/x/ok.py": None, "vendor/x/no.py": "ignored",
    "lib/__pycache__/m.py": "ignored", ".git/hooks/x.py": "ignored", "a.pyc": "ignored", "big.py": "size",
}


def test_scan(spark):
    files = spark.createDataFrame([(p, 2_000_000 if p == "big.py" else 10, "more") for p in REASONS] + [(None, 1, "x")], "path string, length long, hit2 string")
    rules = spark.createDataFrame([*RULES.items(), ("none", None)], "folder string, content string")
    got = {r["path"]: r["reason"] for r in ignore_rules.scan(files, rules, (".py", ".txt"), 1000).collect()}
    got.pop(None)
    assert got == REASONS


def test_no_rules_no_files(spark):
    files = spark.createDataFrame([("a.py", 1)], "path string, length long")
    none = spark.createDataFrame([], "folder string, content string")
    assert [r["reason"] for r in ignore_rules.scan(files, none, (".py",), 1, defaults=()).collect()] == [None]
    assert ignore_rules.scan(files.limit(0), none, (".py",), 1).count() == 0
