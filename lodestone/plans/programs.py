"""Queries over programs whose statements come from lineitem: a file with a function for each order, a statement for each of its lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import property_graph as P
from ..operators import routes, script_units, taint
from .query import dealt, query, table

#: Lines of an order in a total order; the numbers that a statement is made of.
_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
LINES_SQL = f"""ls as materialized (
  select l_orderkey as o, row_number() over (partition by l_orderkey order by {_LINES}) as k, l_partkey % 5 as t, 'v' || (l_suppkey % 3) as a, 'v' || (l_quantity::int % 3) as b, l_suppkey % 4 as s from lineitem)"""


def order_lines(spark, sf):
    place = Window.partitionBy("l_orderkey").orderBy(*_LINES.split(", "))
    rows = dealt(table(spark, sf, "lineitem").select(*_LINES.split(", "), "l_orderkey"), "l_orderkey").withColumn("k", F.row_number().over(place))
    return rows.select(F.col("l_orderkey").alias("o"), "k", (F.col("l_partkey") % 5).alias("t"), F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("a"), F.concat(F.lit("v"), F.col("l_quantity").cast("int") % 3).alias("b"), (F.col("l_suppkey") % 4).alias("s"))


def programs(spark, sf):
    """file_id, content: assignments from a request or from variables, calls, branches and loops, as the lines have it."""
    a, b, send = (F.coalesce(c, F.lit("null")) for c in (F.col("a"), F.col("b"), F.col("s").cast("string")))
    of = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    text = (
        F.when(F.col("t") == 0, of("    ", a, " = request.args"))
        .when(F.col("t") == 1, of("    ", a, " = ", b, " + limit"))
        .when(F.col("t") == 2, of("    send_", send, "(", b, ")"))
        .when(F.col("t") == 3, of("    if ", b, " > limit:\n        ", a, " = ", b, "\n    else:\n        log(", a, ")"))
        .otherwise(of("    for item in ", b, ":\n        ", a, " = item"))
    )
    # The lines of an order are sorted already: a window over them gathers what grouping would sort again.
    lines = order_lines(spark, sf).select("o", "k", text.alias("x"))
    whole = Window.partitionBy("o").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    body = lines.withColumn("body", F.collect_list("x").over(whole)).where("k = 1")
    return body.select(F.col("o").alias("file_id"), of("def order_", F.coalesce(F.col("o").cast("string"), F.lit("null")), "(request, limit):\n", F.array_join("body", "\n"), "\n    return v0\n").alias("content"))


#: The graph that the lines give, without a parser: nodes n, edges e. Two parameters follow the function; a branch has three nodes, a loop two.
GRAPH_SQL = f"""{LINES_SQL},
st as materialized (select *, (3 + coalesce(sum(case t when 3 then 3 when 4 then 2 else 1 end) over (partition by o order by k rows between unbounded preceding and 1 preceding), 0))::int as i, case t when 3 then 3 when 4 then 2 else 1 end as w from ls),
n as materialized (
  select distinct o, 0 as i, null::int as p, 'body' as br, 'function' as ty, 'order_' || o as nm, []::varchar[] as ds, []::varchar[] as us from ls
  union all select distinct o, 1, 0, null, 'parameter', 'request', ['request'], [] from ls union all select distinct o, 2, 0, null, 'parameter', 'limit', ['limit'], [] from ls
  union all select o, i, 0, 'body', case t when 0 then 'assignment' when 1 then 'assignment' when 2 then 'call' when 3 then 'if' else 'loop' end, case t when 0 then a when 1 then a when 2 then 'send_' || s when 3 then 'if' else 'for' end,
    case t when 0 then [a] when 1 then [a] when 4 then ['item'] else [] end, case t when 0 then ['request'] when 1 then [b, 'limit'] when 3 then [b, 'limit'] else [b] end from st
  union all select o, i + 1, i, 'body', 'assignment', a, [a], [b] from st where t = 3 union all select o, i + 2, i, 'else', 'call', 'log', [], [a] from st where t = 3
  union all select o, i + 1, i, 'body', 'assignment', a, [a], ['item'] from st where t = 4
  union all select o, (max(i + w))::int, 0, 'body', 'return', 'return', [], ['v0'] from st group by o),
sq as (select o, i, p, br, lag(i) over (partition by o, p, br order by i) as before from n where br is not null),
du as (select o, i, 1 as turn, unnest(ds) as x from n union all select o, i, 0, unnest(us) from n),
re as (select o, i, turn, x, last_value(case when turn = 1 then i end ignore nulls) over (partition by o, x order by i, turn rows between unbounded preceding and 1 preceding) as d,
  last_value(case when turn = 1 then i end ignore nulls) over (partition by o, x order by i, turn rows between unbounded preceding and unbounded following) as z from du),
e as materialized (
  select o, p as src, i as dst, 'ast_child' as kind, null as x from n where p is not null
  union all select o, before, i, 'control_flow', null from sq where before is not null
  union all select sq.o, sq.p, sq.i, case when f.ty = 'function' then 'control_flow' when sq.br = 'else' then 'control_false' else 'control_true' end, null from sq join n f on f.o = sq.o and f.i = sq.p where before is null
  union all select distinct o, d, i, 'data_flow', x from re where turn = 0 and d is not null and d <> i)"""


@query("l16_graph_nodes", f"with {GRAPH_SQL} select o as file_id, i as node_id, p as parent_id, ty as node_type, nm as name, array_to_string(ds, ',') as defines, array_to_string(us, ',') as uses from n")
def l16_nodes(spark, sf):
    n = P.graph_nodes(programs(spark, sf))
    return n.select("file_id", "node_id", "parent_id", "node_type", "name", F.array_join("defines", ",").alias("defines"), F.array_join("uses", ",").alias("uses"))


@query("l16_graph_edges", f"with {GRAPH_SQL} select o as file_id, src, dst, kind, x as variable from e")
def l16_edges(spark, sf):
    return P.graph_edges(P.stored(P.graph_nodes(programs(spark, sf))))


@query("l16_definition_table", f"with {GRAPH_SQL} select distinct o as file_id, z as src, i as dst, x as variable from re where turn = 0 and z is not null and z <> i")
def l16_table(spark, sf):
    return P.file_data_edges(programs(spark, sf), reaching=False).select("file_id", "src", "dst", "variable")


def _shown(found):
    """start, end, path with nodes numbered over all files: a file has fewer than a thousand here."""
    over_all = lambda node: F.col("file_id") * 1000 + node
    return found.select(over_all(F.col("start")).alias("start"), over_all(F.col("end")).alias("end"), F.array_join(F.transform("path", over_all), ">").alias("path"))


def _paths_sql(kinds: str, start: str, end: str, shown: str) -> str:
    return f"""with recursive {GRAPH_SQL}, g as materialized (select distinct o * 1000 + src as src, o * 1000 + dst as dst from e where kind in ({kinds})),
goal as materialized (select o * 1000 + i as id from n where {end}),
walk(start, path, last) as (
  select o * 1000 + i, [o * 1000 + i], o * 1000 + i from n where {start}
  union all select start, list_append(path, dst), dst from walk join g on last = src where not list_contains(path, dst) and len(path) <= 10),
hit as (select *, row_number() over (partition by start, last order by len(path), path) as r from walk where last in (select id from goal) and len(path) > 1)
select start, last as "end", array_to_string({shown}, '>') as path from hit where r <= 10"""


@query("l17_data_flow_paths", _paths_sql("'data_flow', 'data_use', 'call_arg'", "ty = 'parameter' and nm = 'request'", "ty = 'call' and starts_with(nm, 'send')", "path[1:len(path) - 1]"))
def l17_data(spark, sf):
    return _shown(P.file_paths(programs(spark, sf), lambda kind, name: kind == "parameter" and name == "request", lambda kind, name: kind == "call" and name.startswith("send"), P.DATA))


@query("l17_control_flow_paths", _paths_sql("'control_flow', 'control_true', 'control_false', 'control_return'", "ty = 'function'", "ty in ('call', 'return')", "path[1:len(path) - 1]"))
def l17_control(spark, sf):
    return _shown(P.file_paths(programs(spark, sf), lambda kind, name: kind == "function", lambda kind, name: kind in ("call", "return"), P.CONTROL))


@query("l17_all_edge_paths", _paths_sql("'ast_child', 'control_flow', 'control_true', 'control_false', 'data_flow'", "ty = 'loop'", "ty = 'return'", "path"))
def l17_all(spark, sf):
    return _shown(P.file_paths(programs(spark, sf), lambda kind, name: kind == "loop", lambda kind, name: kind == "return", with_end=True))


# Functions that call one another: one for each order, whose lines are calls, sinks and sanitizers.

_ARGUMENT = ("first", "second", "other", "7")


def _argument(n):
    return F.element_at(F.array(*map(F.lit, _ARGUMENT)), (n % 4 + 1).cast("int"))


def calling_heads(spark, sf):
    """unit_id, language, symbol of all calling units."""
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id")).distinct()
    return ids.select("unit_id", F.lit("python").alias("language"), F.format_string("fn_%d", "unit_id").alias("symbol"))


def calling_units(spark, sf, only=None):
    """unit_id, language, symbol, signature, code: every ninth function takes a request as its first argument. only(unit_id): the units that are made."""
    place = Window.partitionBy("l_orderkey").orderBy(*_LINES.split(", "))
    o, q, y = F.col("l_orderkey"), F.col("l_quantity").cast("int"), F.col("l_suppkey")
    one, two = (F.when((a == "first") & (o % 9 == 0), "request").otherwise(a) for a in (_argument(q), _argument(F.floor(q / 4))))
    call = F.format_string("    fn_%d(%s, %s)", o + y % 50 - 25, one, two)
    text = F.when(F.col("l_partkey") % 4 == 0, call).when(F.col("l_partkey") % 4 == 1, F.format_string("    %s(%s, 1)", F.when(y % 3 == 0, "system").otherwise("execute"), one)).when(F.col("l_partkey") % 4 == 2, F.format_string("    other = quote(%s)", one)).otherwise(F.format_string("    note(%s)", one))
    lines = table(spark, sf, "lineitem").select(*_LINES.split(", "), "l_orderkey")
    if only is not None:
        lines = lines.join(only.select(F.col("unit_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = dealt(lines, "l_orderkey").select(o.alias("unit_id"), F.row_number().over(place).alias("k"), text.alias("x"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "\n")
    units = rows.groupBy("unit_id").agg(code.alias("body"))
    signature = F.format_string("def fn_%d(%s, second: str = None)", "unit_id", F.when(F.col("unit_id") % 9 == 0, "request").otherwise("first"))
    return units.select("unit_id", F.lit("python").alias("language"), F.format_string("fn_%d", "unit_id").alias("symbol"), signature.alias("signature"), F.concat(signature, F.lit(":\n"), "body").alias("code"))


SINKS = (("execute", "sql", "high"), ("system", "command", "critical"))

#: The flows that the lines give: of statements f, arguments x1, x2; a request stands for the first parameter of every ninth function.
CALLS_SQL = f"""args as materialized (
  select l_orderkey as o, row_number() over (partition by l_orderkey order by {_LINES}) as k, l_partkey % 4 as t, l_orderkey + l_suppkey % 50 - 25 as callee, case when l_suppkey % 3 = 0 then 'system' else 'execute' end as sink,
    (['first', 'second', 'other', '7'])[1 + l_quantity::int % 4] as r1, (['first', 'second', 'other', '7'])[1 + (l_quantity::int // 4) % 4] as r2 from lineitem),
f as materialized (select o, k, t, callee, sink, case when r1 = 'first' and o % 9 = 0 then 'request' else r1 end as x1, case when r2 = 'first' and o % 9 = 0 then 'request' else r2 end as x2 from args),
flows as materialized (
  select distinct o as su, x1 as sn, callee as du, case when callee % 9 = 0 then 'request' else 'first' end as dn from f where t = 0 and callee in (select o from f)
  union select distinct o, x2, callee, 'second' from f where t = 0 and callee in (select o from f)),
known(u, n, origin, depth) as (
  select o, 'request', o, 0 from (select distinct o from f where o % 9 = 0)
  union select du, dn, origin, depth + 1 from known join flows on su = u and sn = n where depth < 10),
least as (select u, n, min(depth) as depth from known group by u, n)"""


@query("l14_argument_taint", f"with recursive {CALLS_SQL} select u as unit_id, n as name, depth::int as depth from least")
def l14_arguments(spark, sf):
    units = P.stored(calling_units(spark, sf))
    return taint.spread(units, taint.request_parameters(units)).select("unit_id", "name", "depth")


@query("l15_argument_sinks", f"""with recursive {CALLS_SQL},
text as (select o, 0 as k, 'def fn_' || o || '(' || case when o % 9 = 0 then 'request' else 'first' end || ', second: str = None):' as x from (select distinct o from f)
  union all select o, k, case t when 0 then '    fn_' || callee || '(' || x1 || ', ' || x2 || ')' when 1 then '    ' || sink || '(' || x1 || ', 1)' when 2 then '    other = quote(' || x1 || ')' else '    note(' || x1 || ')' end from f),
hit as (select distinct l.u, l.n, l.depth, f.sink from least l join f on f.o = l.u and f.t = 1 and f.x1 = l.n),
clean as (select distinct h.u, h.n from hit h join text s on s.o = h.u and contains(s.x, 'quote(') join text w on w.o = h.u and abs(w.k - s.k) <= 1 and contains(w.x, h.n)),
r as (select h.*, c.u is not null as sanitized from hit h left join clean c on c.u = h.u and c.n = h.n)
select u as unit_id, n as name, depth::int as depth, sink, case when sink = 'system' then 'command' else 'sql' end as category, case when sanitized then 'low' when sink = 'system' then 'critical' else 'high' end as risk_level, sanitized,
  round(least(greatest((((0.6::double + 0.2::double) + case when sink = 'system' then 0.15::double else 0.1::double end) * case when depth + 1 > 3 then pow(0.9::double, depth + 1 - 3) else 1.0::double end
    + case when depth > 0 then 0.05::double else 0.0::double end) * case when sanitized then 0.3::double else 1.0::double end, 0.1::double), 0.95::double), 6) as confidence from r""")
def l15_sinks(spark, sf):
    units = P.stored(calling_units(spark, sf))
    return taint.cross_function_sinks(units, taint.request_parameters(units), SINKS, r"\bquote\(").drop("origin")


# Files that declare routes: a file for each order, of one of six frameworks, with a route for most of its lines.


def route_files(spark, sf):
    """file_id, content."""
    kind, t, k = F.col("o") % 6, F.col("t") % 3, F.col("k")
    line = lambda text, *c: F.format_string(text, *c)
    flask = F.when(t == 0, line("@app.route('/%s/<id>', methods=['GET', 'post'])\ndef h%d(id):\n    pass", "a", "k")).when(t == 1, line('@bp.post("/b%d/{key}")\n@login\nasync def h%d():\n    pass', "s", "k")).otherwise(line("@app.route('/c%d')\n#\n#\n#\n#\n#\ndef late%d():", "k", "k"))
    express = F.when(t == 0, line("app.all('/x%d/:id/:%s', h%d)", "s", "a", "k")).when(t == 1, line('router.delete("/y%d", (req, res) => {', "s")).otherwise("app.use(z)")
    nest = F.when(t == 0, line("  @Get(':id')\n  async m%d() {", "k")).when(t == 1, line("  @Post()\n  if (x) {\n  m%d(", "k")).otherwise(line("  @Patch(\"/p%d/\")\n\n\n\n  m%d() {", "s", "k"))
    spring = F.when(t == 0, line('  @GetMapping("/u%d/{id}")\n  public String m%d(int id) {', "s", "k")).when(t == 1, line("  @RequestMapping()\n  @Auth\n  void m%d()", "k")).otherwise("  // nothing")
    django = line("    path('p%d/<int:pk>/', view%d),", "s", "k")
    gin = F.when(t == 0, line('r.PATCH("/g%d/:id/*rest", h%d)', "s", "k")).otherwise(line('v1.HEAD("/h%d", func(c) {', "s"))
    text = F.when(kind == 0, flask).when(kind == 1, express).when(kind == 2, nest).when(kind == 3, spring).when(kind == 4, django).otherwise(gin)
    rows = order_lines(spark, sf).select(F.col("o").alias("file_id"), "k", text.alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "\n")
    which = F.col("file_id") % 6
    head = F.when(which == 0, "app = Flask(__name__)").when(which == 1, "const app = express();").when(which == 2, line("@Controller('/c%d/')", "file_id")).when(which == 3, line('@RequestMapping("api%d")\npublic class A {', "file_id")).when(which == 4, "urlpatterns = [").otherwise("r := gin.Default()")
    return rows.groupBy("file_id").agg(body.alias("body")).select("file_id", F.concat(head, F.lit("\n"), "body").alias("content"))


#: The lines with the number of text lines each has, and the text line at which it begins.
ROUTES_SQL = f"""{LINES_SQL},
w as (select *, o % 6 as kind, t % 3 as u, case o % 6 when 0 then (case t % 3 when 0 then 3 when 1 then 4 else 7 end) when 2 then (case t % 3 when 0 then 2 when 1 then 3 else 5 end) when 3 then (case t % 3 when 0 then 2 when 1 then 3 else 1 end) else 1 end as n from ls),
r as (select *, (case kind when 3 then 3 else 2 end + coalesce(sum(n) over (partition by o order by k rows between unbounded preceding and 1 preceding), 0))::int as line, bool_or(u = 1) over (partition by o order by k) as bare from w)"""


@query("c9_file_frameworks", f"""with {ROUTES_SQL} select distinct o as file_id, (['flask', 'express', 'nestjs', 'spring', 'django', 'gin'])[kind + 1] as framework from r
union select distinct o, 'koa' from r where kind = 1 and u = 1 union select distinct o, 'spring' from r where kind = 2""")
def c9_files(spark, sf):
    return routes.detect_frameworks(route_files(spark, sf))


@query("c10_framework_routes", f"""with {ROUTES_SQL}
select o as file_id, 'flask' as framework, line, case u when 0 then '/' || a || '/<id>' when 1 then '/b' || s || '/{{key}}' else '/c' || k end as path, case u when 0 then 'GET,POST' when 1 then 'POST' else 'GET' end as methods,
  case u when 2 then 'unknown' else 'h' || k end as handler, case u when 0 then 'id' when 1 then 'key' else '' end as params from r where kind = 0
union all select o, 'express', line, case u when 0 then '/x' || s || '/:id/:' || a else '/y' || s end, case u when 0 then 'GET,POST,PUT,DELETE,PATCH' else 'DELETE' end, case u when 0 then 'h' || k else 'res' end, case u when 0 then 'id,' || a else '' end from r where kind = 1 and u < 2
union all select o, 'nestjs', line, '/c' || o || case u when 0 then '/:id' when 1 then '/' else '/p' || s end, case u when 0 then 'GET' when 1 then 'POST' else 'PATCH' end, case when u < 2 then 'm' || k else 'unknown' end, case u when 0 then 'id' else '' end from r where kind = 2
union all select distinct o, 'spring', 1, '/api' || o || '/api' || o, 'GET,POST', coalesce(arg_min(case when u < 2 and line + u <= 5 then 'm' || k end, k) over (partition by o), 'unknown'), '' from r where kind = 3
union all select o, 'spring', line, case when bare then '' else '/api' || o end || case u when 0 then '/u' || s || '/{{id}}' else '/' end, case u when 0 then 'GET' else 'GET,POST' end, 'm' || k, case u when 0 then 'id' else '' end from r where kind = 3 and u < 2
union all select o, 'django', line, '/p' || s || '/<int:pk>', 'GET,POST', 'view' || k, 'pk' from r where kind = 4
union all select o, 'gin', line, case u when 0 then '/g' || s || '/:id/*rest' else '/h' || s end, case u when 0 then 'PATCH' else 'HEAD' end, case u when 0 then 'h' || k else 'anonymous' end, case u when 0 then 'id,rest' else '' end from r where kind = 5""")
def c10_routes(spark, sf):
    files = route_files(spark, sf)
    kinds = F.element_at(F.array(*map(F.lit, ("flask", "express", "nestjs", "spring", "django", "gin"))), (F.col("file_id") % 6 + 1).cast("int"))
    found = routes.routes(files.withColumn("framework", kinds))
    return found.select("file_id", "framework", "line", "path", F.array_join("methods", ",").alias("methods"), "handler", F.array_join("params", ",").alias("params"))


# Script files: JavaScript for even orders, PHP functions or script blocks for odd ones.


def script_files(spark, sf):
    """file_id, path, content."""
    o, t = F.col("o"), F.col("t") % 3
    js = F.when(t == 0, F.format_string('function f%d(req, x) { s%d.run("}"); }', "k", "s")).when(t == 1, F.format_string("async function g%d(a) {\n  const q = '{';\n  go%d(q); // }\n}", "k", "s")).otherwise(F.format_string("const h%d = (res) => {\n  return call%d(1);\n};", "k", "s"))
    php = F.when(o % 4 == 1, F.format_string("<?php t%d($_GET['x']); ?>", "k")).otherwise(F.format_string("public static function m%d($x) {\n  return x%d($x); # }\n}", "k", "s"))
    rows = order_lines(spark, sf).select("o", "k", F.when(o % 2 == 0, js).otherwise(php).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "\n")
    head = F.when(F.col("file_id") % 2 == 0, "").when(F.col("file_id") % 4 == 1, "<b>\n").otherwise("<?php\n")
    path = F.concat(F.lit("web/o"), "file_id", F.when(F.col("file_id") % 2 == 0, ".js").otherwise(".php"))
    return rows.groupBy(F.col("o").alias("file_id")).agg(body.alias("body")).select("file_id", path.alias("path"), F.concat(head, "body", F.lit("\n")).alias("content"))


@query("c3_script_units", f"""with {LINES_SQL},
w as (select *, t % 3 as u, case when o % 2 = 1 then case when o % 4 = 1 then 1 else 3 end else [1, 4, 3][t % 3 + 1] end as n from ls),
r as (select *, (case when o % 2 = 0 then 1 else 2 end + coalesce(sum(n) over (partition by o order by k rows between unbounded preceding and 1 preceding), 0))::int as line from w)
select o as file_id, (['f', 'g', 'h'])[u + 1] || k as symbol, case u when 0 then 'handler' else 'function' end as unit_type, line as start_line, (line + n - 1)::int as end_line,
  case u when 0 then 'f' || k || ',run,s' || s || '.run' when 1 then 'g' || k || ',go' || s else 'call' || s end as calls from r where o % 2 = 0
union all select o, 'm' || k, 'function', line, (line + 2)::int, 'm' || k || ',x' || s from r where o % 4 = 3
union all select o, '<script:o' || o || '.php>', 'handler', 2::int, (1 + count(*))::int, array_to_string(list_sort(list('t' || k)), ',') from r where o % 4 = 1 group by o""")
def c3_units(spark, sf):
    files = script_files(spark, sf)
    js = script_units.javascript_functions(files.where("path like '%.js'"))
    php = script_units.php_units(files.where("path like '%.php'"))
    return js.unionByName(php).select("file_id", "symbol", "unit_type", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))
