"""Code property graphs: nodes of parsed files, and their edges by joins and windows over the node table.

A parser gives a row for each statement, with what it defines and uses; it is the only part that looks at a file as a whole. All edges follow from
the rows: control by what stands next in a block, data by the definition that comes before a use. Typed paths expand over chosen
kinds of edges only, and only towards nodes that an end can be reached from.

No edge leaves a file. What is asked of a file alone (file_data_edges, file_paths) is therefore found in its row, without a row for each node.
"""

from __future__ import annotations

import ast
import re
from bisect import insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from keyword import iskeyword

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import stored
from .graph import reach
from .parsing import frames

NODE = "file_id long, node_id int, parent_id int, branch string, node_type string, name string, line int, defines array<string>, uses array<string>"
DATA = ("data_flow", "data_use", "call_arg")
CONTROL = ("control_flow", "control_true", "control_false", "control_return")


def _read(node: ast.AST | None) -> list[str]:
    """The variables that an expression reads, each once. The name of a called function is none, the object of a called method is."""
    names, todo = {}, [node] if node is not None else []
    while todo:
        n = todo.pop(0)
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            names[n.id] = None
        called = n.func if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) else None
        todo += [c for c in ast.iter_child_nodes(n) if c is not called]
    return list(names)


def _bound(target: ast.AST) -> list[str]:
    return [n.id for n in ast.walk(target) if isinstance(n, ast.Name)]


def _callee(call: ast.Call) -> str:
    f = call.func
    if isinstance(f, ast.Attribute):
        return f"{f.value.id}.{f.attr}" if isinstance(f.value, ast.Name) else f.attr
    return getattr(f, "id", "")


def _described(s: ast.stmt) -> tuple[str, str, list[str], list[str]]:
    """node_type, name, defines, uses of a statement."""
    if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return "function", s.name, [], []
    if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        names = [n for t in targets for n in (_bound(t) if isinstance(t, (ast.Name, ast.Tuple, ast.List)) else [])]
        again = names if isinstance(s, ast.AugAssign) else []
        return "assignment", ", ".join(names) or "assign", names, list(dict.fromkeys([*_read(s.value), *again]))
    if isinstance(s, ast.If):
        return "if", "if", [], _read(s.test)
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return "loop", "for", _bound(s.target), _read(s.iter)
    if isinstance(s, ast.While):
        return "loop", "while", [], _read(s.test)
    if isinstance(s, ast.Return):
        return "return", "return", [], _read(s.value)
    if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
        return "call", _callee(s.value), [], _read(s.value)
    return {"ClassDef": "class", "Try": "try"}.get(type(s).__name__, "other"), getattr(s, "name", type(s).__name__.lower()), [], []


def _parameters(s: ast.stmt) -> list[ast.arg]:
    return [*s.args.posonlyargs, *s.args.args] if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) else []


_BLOCKS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.If, ast.For, ast.AsyncFor, ast.While)


def _by_tree(file_id: int, content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    todo = [(s, None, "body") for s in reversed(tree.body)]
    while todo:
        s, parent, branch = todo.pop()
        me = len(out)
        kind, name, defines, uses = _described(s)
        out.append((file_id, me, parent, branch, kind, name, s.lineno, defines, uses))
        out += [(file_id, me + i, me, None, "parameter", a.arg, a.lineno, [a.arg], []) for i, a in enumerate(_parameters(s), 1)]
        blocks = [("body", s.body)] if isinstance(s, _BLOCKS) else []
        blocks += [("else", s.orelse)] if isinstance(s, ast.If) else []
        todo += [(x, me, name) for name, body in reversed(blocks) for x in reversed(body)]
    return out


#: Printable text without quotes, comments, joined lines or several statements in a line: there, a line that parses by itself is a statement, or its head.
_PLAIN = re.compile(r"[\n !$-&(-:<-\[\]-~]*")
_DEF = re.compile(r"def +([A-Za-z_]\w*)", re.ASCII)
#: Levels of blocks beyond which a file is parsed as a whole.
DEEP = 50


@lru_cache(50_000)
def _line(text: str) -> tuple | None:
    """What a line describes, its parameters and whether it opens a block; None for what a line by itself doesn't tell."""
    opens = text.endswith(":")
    try:
        found = ast.parse(text + " pass" if opens else text).body
    except (SyntaxError, ValueError, RecursionError):
        return None
    s = found[0] if len(found) == 1 else None
    if s is None or isinstance(s, _BLOCKS) != opens or (not opens and hasattr(s, "body")) or (isinstance(s, ast.ImportFrom) and s.module == "__future__"):
        return None
    return (*_described(s), [a.arg for a in _parameters(s)], opens)


def _by_lines(file_id: int, content: str) -> list[tuple] | None:
    """The nodes of a file whose lines tell them one by one, as most lines have been seen before; None where they don't, which need not be a fault."""
    if not _PLAIN.fullmatch(content):
        return None
    out: list[tuple] = []
    levels, begun = [[0, None, "body", None]], None  # indentation, parent, branch and the branch that an else may follow; the block that a line has to begin
    for number, line in enumerate(content.split("\n"), 1):
        text = line.strip(" ")
        if not text:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if begun is not None:
            if indent <= levels[-1][0]:
                return None
            levels.append([indent, *begun, None])
            begun = None
        while indent < levels[-1][0]:
            levels.pop()
        level = levels[-1]
        if indent != level[0] or len(levels) > DEEP:
            return None
        if text == "else:":
            if level[3] is None:
                return None
            begun, level[3] = (level[3], "else"), None
            continue
        head = _DEF.match(text)  # each function has another name
        found = _line("def f" + text[head.end() :]) if head and not iskeyword(head[1]) else _line(text)
        if found is None:
            return None
        kind, name, defines, uses, parameters, opens = found
        me = len(out)
        out.append((file_id, me, level[1], level[2], kind, head[1] if head else name, number, defines, uses))
        out += [(file_id, me + i, me, None, "parameter", p, number, [p], []) for i, p in enumerate(parameters, 1)]
        level[3] = me if kind == "if" else None
        begun = (me, "body") if opens else None
    return None if begun is not None else out


def statement_nodes(file_id: int, content: str | None) -> list[tuple]:
    """The functions, parameters and statements of a Python file in the order of their text. A file that can't be parsed has none. Bodies
    of classes and of try and with statements are part of one node."""
    found = _by_lines(file_id, content or "")
    return _by_tree(file_id, content or "") if found is None else found


def graph_nodes(files: DataFrame) -> DataFrame:
    """The nodes of files(file_id, content), numbered within a file in the order of its text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in frames(batches, statement_nodes, NODE):
            yield found.astype({"parent_id": "Int32"})

    return files.select("file_id", "content").mapInPandas(parse, NODE)


def per_file(files: DataFrame, rows_of: Callable[[int, str | None], Iterable[tuple]], schema: str, most: int = 10_000) -> DataFrame:
    """What rows_of(file_id, content) gives for each file, some rows at a time, however many a batch of files has."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (r for i, t in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist(), strict=True) for r in rows_of(i, t))
            while some := list(islice(found, most)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("file_id", "content").mapInArrow(rows, schema)


def control_edges(nodes: DataFrame) -> DataFrame:
    """file_id, src, dst, kind: from each statement to the next of its block, and from a function, branch or loop to the first of its blocks."""
    statements = nodes.where("branch is not null")
    block = Window.partitionBy("file_id", "parent_id", "branch").orderBy("node_id")
    before = statements.withColumn("before", F.lag("node_id").over(block))
    # Sizes are estimated from the files that nodes are parsed from, so Spark would broadcast all of them.
    kinds = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    first = before.where("before is null and parent_id is not null").join(kinds.hint("merge"), ["file_id", "parent_id"])
    kind = F.when(F.col("parent_type") == "function", "control_flow").when(F.col("branch") == "else", "control_false").otherwise("control_true")
    entered = first.select("file_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), kind.alias("kind"))
    return before.where("before is not null").select("file_id", F.col("before").alias("src"), F.col("node_id").alias("dst"), F.lit("control_flow").alias("kind")).unionByName(entered)


def data_edges(nodes: DataFrame, reaching: bool = True) -> DataFrame:
    """file_id, src, dst, kind, variable: from a definition to each use of its variable within a function. reaching: the definition is the last that
    stands before the use (a statement uses before it defines); else the last of all, whatever its place, as a table of one definition
    for each variable has it. A use without a definition has no edge, and none leads from a node to itself."""
    scope = Window.partitionBy("file_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    scoped = nodes.withColumn("scope", F.coalesce(F.last(F.when((F.col("node_type") == "function") & F.col("parent_id").isNull(), F.col("node_id")), ignorenulls=True).over(scope), F.lit(-1)))
    seen = scoped.select("file_id", "scope", "node_id", F.lit(1).alias("turn"), F.explode("defines").alias("variable")).unionByName(scoped.select("file_id", "scope", "node_id", F.lit(0).alias("turn"), F.explode("uses").alias("variable")))
    order = Window.partitionBy("file_id", "scope", "variable").orderBy("node_id", "turn")
    order = order.rowsBetween(Window.unboundedPreceding, -1 if reaching else Window.unboundedFollowing)
    by = seen.withColumn("src", F.last(F.when(F.col("turn") == 1, F.col("node_id")), ignorenulls=True).over(order))
    return by.where("turn = 0 and src is not null and src <> node_id").select("file_id", "src", F.col("node_id").alias("dst"), F.lit("data_flow").alias("kind"), "variable").distinct()


def graph_edges(nodes: DataFrame, reaching: bool = True) -> DataFrame:
    """file_id, src, dst, kind, variable (of data edges): children of the syntax, control and data."""
    child = nodes.where("parent_id is not null").select("file_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("ast_child").alias("kind"), F.lit(None).cast("string").alias("variable"))
    return child.unionByName(control_edges(nodes).withColumn("variable", F.lit(None).cast("string"))).unionByName(data_edges(nodes, reaching))


def _control(nodes: list[tuple]) -> Iterator[tuple]:
    """src, dst, kind of a file's nodes, as control_edges has them."""
    last: dict = {}
    for _, node, parent, branch, *_ in nodes:
        if branch is None:
            continue
        before, last[parent, branch] = last.get((parent, branch)), node
        if before is not None:
            yield before, node, "control_flow"
        elif parent is not None:
            yield parent, node, "control_flow" if nodes[parent][4] == "function" else "control_false" if branch == "else" else "control_true"


def _data(nodes: list[tuple], reaching: bool) -> Iterator[tuple]:
    """src, dst, variable of a file's nodes, as data_edges has them."""
    last, uses, scope = {}, [], -1
    for _, node, parent, _, kind, _, _, defined, used in nodes:
        scope = node if kind == "function" and parent is None else scope
        for v in dict.fromkeys(used):
            if not reaching:
                uses.append((scope, v, node))
            elif (scope, v) in last:
                yield last[scope, v], node, v
        last |= dict.fromkeys([(scope, v) for v in defined], node)
    for scope, v, node in uses:
        if last.get((scope, v), node) != node:
            yield last[scope, v], node, v


def file_data_edges(files: DataFrame, reaching: bool = True) -> DataFrame:
    """file_id, src, dst, kind, variable: the data_edges of files(file_id, content), one row for each file_id. No row leaves its file's task."""

    def edges(file_id: int, content: str | None) -> Iterator[tuple]:
        return ((file_id, src, dst, "data_flow", v) for src, dst, v in _data(statement_nodes(file_id, content), reaching))

    return per_file(files, edges, "file_id long, src int, dst int, kind string, variable string")


def file_paths(files: DataFrame, start: Callable[[str, str], bool], end: Callable[[str, str], bool], kinds: Sequence[str] | None = None, max_nodes: int = 10, most: int = 10, with_end: bool = False) -> DataFrame:
    """file_id, start, end, path: the typed_paths over the graph_edges of files(file_id, content), from nodes for which start(node_type, name) holds to
    those for which end does. Of each pair no more paths are kept than asked for, and files without a start or an end make no edges."""

    def paths(file_id: int, content: str | None) -> Iterator[tuple]:
        nodes = statement_nodes(file_id, content)
        starts, ends = ([n[1] for n in nodes if chosen(n[4], n[5])] for chosen in (start, end))
        if not starts or not ends:
            return
        edges = [*((n[2], n[1], "ast_child") for n in nodes if n[2] is not None), *_control(nodes), *((a, b, "data_flow") for a, b, _ in _data(nodes, True))]
        allowed = [e for e in edges if kinds is None or e[2] in kinds]
        first: dict[tuple, list] = {}
        for w in simple_walks([e[0] for e in allowed], [e[1] for e in allowed], starts, ends, max_nodes):
            insort(kept := first.setdefault((w[0], w[-1]), []), (len(w), w))
            del kept[most:]
        for (a, b), kept in first.items():
            yield from ((file_id, a, b, list(w if with_end else w[:-1])) for _, w in kept)

    return per_file(files, paths, "file_id long, start int, end int, path array<int>")


def typed_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, kinds: Sequence[str] | None = None, max_nodes: int = 10, most: int = 10, with_end: bool = False, within: str | None = None) -> DataFrame:
    """start, end, path: simple paths from starts(id) to ends(id) over edges(src, dst, kind) of the given kinds (None: all), with at most max_nodes
    nodes before the end; of each pair the first most, shorter ones first. The path has the end only if asked for. A path may go through
    other ends, and a start that is an end has no path to itself. within: a column of all three that names a part of the graph which no edge
    leaves and a task can hold, such as a file; the edges of a part are brought together once, in place of a join for each step."""
    allowed = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    found = _hits(allowed, starts, ends, max_nodes) if within is None else _hits_within(allowed, starts, ends, max_nodes, within)
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("start", "last").orderBy(F.size("path"), "path"))).where(F.col("place") <= most)
    path = F.col("path") if with_end else F.expr("slice(path, 1, size(path) - 1)")
    return first.select("start", F.col("last").alias("end"), path.alias("path"))


def _hits(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_nodes: int) -> DataFrame:
    """start, last, path of all paths, by a join for each step."""
    allowed = stored(edges.select("src", "dst").distinct())
    goals = ends.select(F.col("id").alias("last")).distinct()
    # Only what leads to an end: else each step would hold all ways to nowhere.
    back = allowed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    useful = stored(reach(back, goals.select(F.col("last").alias("id")), max_nodes).select(F.col("id").alias("dst")).distinct())
    allowed = stored(allowed.join(useful.hint("merge"), "dst", "left_semi"))
    open_ = starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.col("id").alias("last")).distinct()
    found = None
    for _ in range(max_nodes):
        longer = open_.join(allowed.hint("merge"), F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        open_ = stored(longer.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        hits = open_.join(goals.hint("merge"), "last", "left_semi")
        found = hits if found is None else found.unionByName(hits)
        if open_.isEmpty():
            break
    return found


def simple_walks(src: Sequence, dst: Sequence, starts: Sequence, ends: Sequence, max_nodes: int) -> Iterator[tuple]:
    """Simple paths from each start to each end, of at most max_nodes edges; one at a time."""
    after, back = {}, {}
    for a, b in set(zip(src, dst, strict=True)):
        after.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    # The fewest edges from a node to an end: where too few are left, a path isn't gone on with.
    far, front = dict.fromkeys(ends, 0), list(set(ends))
    for d in range(1, max_nodes + 1):
        front = [a for a in {a for b in front for a in back.get(b, ())} if a not in far]
        far |= dict.fromkeys(front, d)
    for start in set(starts):
        path, on, todo = [start], {start}, [iter(after.get(start, ()))]
        while todo:
            for b in todo[-1]:
                if b in on or far.get(b, max_nodes) > max_nodes - len(path):
                    continue
                if far[b] == 0:
                    yield (*path, b)
                if len(path) < max_nodes:
                    path.append(b)
                    on.add(b)
                    todo.append(iter(after.get(b, ())))
                    break
            else:
                todo.pop()
                on.discard(path.pop())


def _hits_within(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_nodes: int, part: str) -> DataFrame:
    """start, last, path of all paths. A part's edges, starts and ends are one row; its paths are given out some at a time, however many they are."""
    none = F.lit(None).cast(edges.schema["src"].dataType)
    mark = lambda df, role: df.select(part, F.lit(role).alias("role"), F.col("id").alias("src"), none.alias("dst"))
    rows = edges.select(part, F.lit("edge").alias("role"), "src", "dst").unionByName(mark(starts, "start")).unionByName(mark(ends, "end"))
    of = lambda role, x: F.collect_list(F.when(F.col("role") == role, x))
    parts = rows.groupBy(part).agg(of("edge", F.struct("src", "dst")).alias("e"), of("start", F.col("src")).alias("starts"), of("end", F.col("src")).alias("ends"))
    parts = parts.where("size(starts) > 0 and size(ends) > 0").select("e.src", "e.dst", "starts", "ends")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (w for row in zip(*(batch[c] for c in batch.columns), strict=True) for w in simple_walks(*(x.tolist() for x in row), max_nodes))
            while some := list(islice(found, 10_000)):
                yield pd.DataFrame({"start": [w[0] for w in some], "last": [w[-1] for w in some], "path": [list(w) for w in some]})

    kind = edges.schema["src"].dataType.simpleString()
    return parts.mapInPandas(walk, f"start {kind}, last {kind}, path array<{kind}>")
