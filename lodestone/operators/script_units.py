"""Functions of JavaScript and PHP files by matching braces, without a parser.

One expression cuts a text into tokens that make it up: strings and comments are whole tokens, so braces in them don't count. A file's tokens are
gone through once, in its own row: they are neither rows nor shuffled, and a file gives a row for each function only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings (with escapes), comments, and an unfinished one of either up to the end.
_QUOTED = "|".join(rf"{q}(?:.*?(?<!\\)(?:\\\\)*{q}|.*+)" for q in "\"'`") + r"|//[^\n]*+|/\*.*?(?:\*/|\z)"
NAMED = r"(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
ARROW = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"
PHP_FUNCTION = r"(?:(?:public|private|protected)\s+)?(?:static\s+)?function\s+(\w+)\s*\(([^)]*)\)"
#: Arguments of handlers, and what a script reads its user's input from.
REQUEST_WORDS = r"req|res|request|response|ctx|context"
SUPERGLOBALS = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES")
#: Words before a parenthesis that call nothing.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "new", "typeof", "async", "await", "foreach", "elseif")
_CALL = r"(?<!\w)((?:\w++\.)++\w++|(?<!\.)\w++)\s*\("


def _count(text: Column | str, part: str) -> Column:
    """How often a part of one character stands in a text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.char_length(t) - F.char_length(F.replace(t, F.lit(part), F.lit("")))


FOUND = "file_id long, path string, content string, units array<struct<symbol string, arguments string, kind string, start_line int, end_line int, code string>>"


def token_expression(heads: list[tuple[str, str]], comment: str = "") -> re.Pattern:
    """Tokens that make up a text. heads (kind, expression): tokens that are kept whole where a word begins, in a group of their kind."""
    rest = "" if not comment else f"|{comment}"
    of = "|".join(f"(?P<{kind}>{p})" for kind, p in heads)
    return re.compile(rf"(?s:{_QUOTED}{rest}|(?:{of})|[{{}}]|[\w$]+|[^\"'`/{{}}\w$#]++|.)".replace(r"\z", r"\Z"), re.ASCII)


def functions_of(content: str, tokens: re.Pattern, heads: list[tuple[str, str]]) -> list[tuple]:
    """symbol, arguments, kind, start_line, end_line, code of the functions that heads begin, in order."""
    out, line, opened, waiting, last = [], 1, [], [], None
    closes: dict[int, tuple[int, int]] = {}  # of an opening brace: the place and line of the one that closes it
    for m in tokens.finditer(content):
        token, start = m[0], m.start()
        if last is not None and token.strip(" \t\r\n\f\v"):
            last["next"], last = token, None
        if token == "{":
            for w in waiting:
                w["open"] = start
            waiting = []
            opened.append(start)
        elif token == "}" and opened:
            closes[opened.pop()] = (start, line)
        elif m.lastgroup is not None:
            last = {"kind": m.lastgroup, "token": token, "start": start, "line": line, "open": None, "next": ""}
            waiting.append(last)
            out.append(last)
        line += token.count("\n")
    return [u for f in out if (u := _function(content, f, closes, line, dict(heads)[f["kind"]]))]


def _function(content: str, f: dict, closes: dict, lines: int, pattern: str) -> tuple | None:
    """An arrow without braces ends where it begins; a head that no brace follows is no function; what isn't closed goes on to the end."""
    symbol, arguments = re.fullmatch(pattern, f["token"], re.ASCII).groups()
    if f["kind"] == "arrow" and f["next"] != "{":
        stop, end = f["start"] + len(f["token"]), f["line"] + f["token"].count("\n")
    elif f["open"] is None:
        return None
    else:
        stop, end = closes.get(f["open"], (len(content) - 1, lines))
        stop += 1
    return symbol, arguments, f["kind"], f["line"], end, content[f["start"] : stop]


def _found(files: DataFrame, heads: list[tuple[str, str]], comment: str = "") -> DataFrame:
    """files(file_id, path, content) with their units, the functions that heads (kind, expression) begin."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = token_expression(heads, comment)
        names = ("symbol", "arguments", "kind", "start_line", "end_line", "code")
        for rows in batches:
            yield rows.assign(units=[[dict(zip(names, u, strict=True)) for u in functions_of(t, tokens, heads)] for t in rows["content"]])

    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path")
    return files.where("content is not null").select("file_id", path, "content").mapInPandas(find, FOUND)


def called_names(code: str | Column) -> Column:
    """The names before parentheses, sorted: dotted ones in full and by their last part."""
    found = F.regexp_extract_all(code, F.lit(_CALL), F.lit(1))
    both = F.flatten(F.transform(found, lambda n: F.array(n, F.element_at(F.split(n, r"\."), -1))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda n: ~n.isin(*NOT_CALLS))))


def javascript_functions(files: DataFrame) -> DataFrame:
    """file_id, symbol, unit_type, start_line, end_line, calls, code: named functions, handlers where an argument names a request or response, and arrow
    functions, which are never handlers."""
    units = _found(files, [("named", NAMED), ("arrow", ARROW)]).select("file_id", F.inline("units"))
    handler = (F.col("kind") == "named") & F.col("arguments").rlike(rf"\b(?:{REQUEST_WORDS})")
    return units.select("file_id", "symbol", F.when(handler, "handler").otherwise("function").alias("unit_type"), "start_line", "end_line", called_names("code").alias("calls"), "code")


def php_units(files: DataFrame) -> DataFrame:
    """The same of PHP files(file_id, path, content): functions, or for a file without any and without a class the unit <script:file> of all its
    blocks, a handler if it reads its user's input."""
    found = _found(files, [("named", PHP_FUNCTION)], r"\#[^\n]*+")
    plain = (F.size("units") == 0) & ~F.col("content").rlike(r"\bclass\s+\w+")
    blocks = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"(?is)<\?(?:php)?\s*(.*?)(?:\?>|\z)"), F.lit(1)), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    code = F.array_join("blocks", "\n")
    reads = F.lit(False)
    for name in SUPERGLOBALS:
        reads = reads | F.contains(code, F.lit(name))
    behind = F.substring_index("content", "?>", -1)  # what follows the last block, if that is closed
    closed = ~F.contains(behind, F.lit("<?")) & F.contains("content", F.lit("?>"))
    end = _count("content", "\n") + 1 - F.when(closed, _count(behind, "\n")).otherwise(0)
    start = _count(F.substring_index("content", "<?", 1), "\n") + 1
    unit = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("symbol", "unit_type", "start_line", "end_line", "code"), strict=True)))
    name = F.concat(F.lit("<script:"), F.substring_index("path", "/", -1), F.lit(">"))
    script = unit(name, F.when(reads, "handler").otherwise("function"), start.cast("int"), end.cast("int"), code)
    functions = F.transform("units", lambda u: unit(u["symbol"], F.lit("function"), u["start_line"], u["end_line"], u["code"]))
    rows = found.withColumn("blocks", F.when(plain, blocks)).select("file_id", F.inline(F.when(F.size("blocks") > 0, F.array(script)).otherwise(functions)))
    return rows.select("file_id", "symbol", "unit_type", "start_line", "end_line", called_names("code").alias("calls"), "code")
