"""Web frameworks of source files, and the routes that they declare.

Files are lines; a route is a line that matches its framework's pattern. What a route needs of other lines are windows over the lines of its file:
the next function within a few lines, and the last prefix of a controller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: What the code of each framework holds.
SIGNATURES = (
    ("flask", (r"@app\.route", r"Flask\(__name__\)")),
    ("django", (r"urlpatterns", r"path\(", r"re_path\(")),
    ("fastapi", (r"@app\.(get|post|put|delete|patch)", r"FastAPI\(\)")),
    ("express", (r"express\(\)", r"app\.(get|post|put|delete|patch|use)")),
    ("koa", (r"new Koa\(\)", r"router\.(get|post|put|delete)")),
    ("fastify", (r"fastify\(\)", r"fastify\.(get|post|put|delete)")),
    ("nestjs", (r"@Controller", r"@Get\(", r"@Post\(", r"@Injectable")),
    ("laravel", (r"Route::(get|post|put|delete)", r"extends Controller")),
    ("symfony", (r"#\[Route\(", r"@Route\(")),
    ("spring", (r"@RestController", r"@Controller", r"@RequestMapping", r"@GetMapping", r"@PostMapping", r"@SpringBootApplication")),
    ("gin", (r"gin\.Default\(\)", r"gin\.New\(\)", r"\.(GET|POST|PUT|DELETE)\(")),
    ("echo", (r"echo\.New\(\)", r"e\.(GET|POST|PUT|DELETE)\(")),
    ("fiber", (r"fiber\.New\(\)", r"app\.(Get|Post|Put|Delete)\(")),
    ("chi", (r"chi\.NewRouter\(\)", r"r\.(Get|Post|Put|Delete)\(")),
)
#: How each framework declares a route. Of a line, the first pattern that matches counts.
FLASK_ROUTE = r"@(?:app|blueprint|bp)\.route\(['\"]([^'\"]+)['\"](?:,\s*methods=\[([^\]]+)\])?"
FLASK_VERB = r"@(?:app|blueprint|bp)\.(get|post|put|delete|patch)\(['\"]([^'\"]+)['\"]\)"
FASTAPI_VERB = r"@(?:app|router)\.(get|post|put|delete|patch|options|head)\(['\"]([^'\"]+)['\"]\)"
DJANGO_PATH = r"path\(['\"]([^'\"]+)['\"],\s*(\w+)"
EXPRESS_VERB = r"(?:app|router)\.(get|post|put|delete|patch|all)\(['\"]([^'\"]+)['\"]"
NEST_PREFIX, NEST_VERB = r"@Controller\(['\"]?([^'\")\s]*)['\"]?\)", r"@(Get|Post|Put|Delete|Patch)\(['\"]?([^'\")\s]*)['\"]?\)"
SPRING_PREFIX, SPRING_VERB = r"@RequestMapping\(['\"]?([^'\")\s]*)['\"]?\)", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(['\"]?([^'\")\s]*)['\"]?\)"
GIN_VERB = r"\w+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(['\"]([^'\"]+)['\"]"
PYTHON_FUNCTION = r"(?:async\s+)?def\s+(\w+)"
SCRIPT_METHOD = r"(?:async\s+)?(\w+)\s*\("
JAVA_METHOD = r"(?:public|private|protected)?\s*\w+\s+(\w+)\s*\("
NOT_METHODS = ("if", "for", "while", "function")


def detect_frameworks(files: DataFrame) -> DataFrame:
    """file_id, framework of files(file_id, content): each framework of which the code holds one pattern."""
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in SIGNATURES]))
    return files.select("file_id", F.explode(found).alias("framework"))


def _group(pattern: str, k: int) -> Column:
    return F.regexp_extract("line", pattern, k)


def _stripped(path: Column) -> Column:
    return F.btrim(path, F.lit("/"))


def _next(pattern: str, within: int, never: tuple[str, ...] = ()) -> Column:
    """The first name that the lines behind this one declare, of so many lines."""
    name = F.regexp_extract("line", pattern, 1)
    ahead = Window.partitionBy("file_id", "framework").orderBy("i").rowsBetween(1, within)
    return F.coalesce(F.first(F.when((name != "") & ~name.isin(*never), name), ignorenulls=True).over(ahead), F.lit("unknown"))


def _prefix(pattern: str) -> Column:
    so_far = Window.partitionBy("file_id", "framework").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(F.col("line").rlike(pattern), F.concat(F.lit("/"), _stripped(_group(pattern, 1)))), ignorenulls=True).over(so_far), F.lit(""))


def _methods(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _params(path: Column, pattern: str) -> Column:
    return F.regexp_extract_all(path, F.lit(pattern), F.lit(1))


def _handler_here() -> Column:
    name = F.regexp_extract("line", r",\s*(\w+)\s*[,)]", 1)
    return F.when(name == "", "anonymous").otherwise(name)


def routes(files: DataFrame) -> DataFrame:
    """file_id, framework, line (from 1), path, methods, handler, params of files(file_id, framework, content). Handlers: the next function or method
    within five lines (three in nestjs), or the name in the line itself (express, gin, django). Controllers' paths go before those of their
    methods; in spring a mapping of the class is a route too."""
    rows = files.select("file_id", "framework", F.posexplode(C.lines("content")).alias("i", "line"))
    of = lambda name: rows.where(F.col("framework") == name)
    upper = F.upper(_group(FLASK_VERB, 1))
    named = lambda path: F.transform(F.regexp_extract_all(path, F.lit(r"<\w+(?::\w+)?>|\{\w+"), F.lit(0)), lambda x: F.regexp_extract(x, r"(\w+)", 1))

    def rest(df: DataFrame, pattern: str, path: Column, methods: Column, handler: Column, params) -> DataFrame:
        found = df.withColumn("handler", handler).withColumn("path", path).where(F.col("line").rlike(pattern))
        return found.select("file_id", "framework", (F.col("i") + 1).alias("line_no"), "path", methods.alias("methods"), "handler", params(F.col("path")).alias("params"))

    listed = F.transform(F.regexp_extract_all(_group(FLASK_ROUTE, 2), F.lit(r"['\"](\w+)['\"]"), F.lit(1)), F.upper)
    script = lambda path: _params(path, r":(\w+)")
    verb = F.upper(_group(EXPRESS_VERB, 1))
    spring = _group(SPRING_VERB, 1)
    found = [
        rest(of("flask"), FLASK_ROUTE, _group(FLASK_ROUTE, 1), F.when(_group(FLASK_ROUTE, 2) == "", _methods("GET")).otherwise(listed), _next(PYTHON_FUNCTION, 5), named),
        rest(of("flask"), FLASK_VERB, _group(FLASK_VERB, 2), F.array(upper), _next(PYTHON_FUNCTION, 5), named),
        rest(of("fastapi"), FASTAPI_VERB, _group(FASTAPI_VERB, 2), F.array(F.upper(_group(FASTAPI_VERB, 1))), _next(PYTHON_FUNCTION, 5), named),
        rest(of("django"), DJANGO_PATH, F.concat(F.lit("/"), _stripped(_group(DJANGO_PATH, 1))), _methods("GET", "POST"), _group(DJANGO_PATH, 2), lambda path: _params(path, r"<\w+:(\w+)>")),
        rest(of("express"), EXPRESS_VERB, _group(EXPRESS_VERB, 2), F.when(verb == "ALL", _methods("GET", "POST", "PUT", "DELETE", "PATCH")).otherwise(F.array(verb)), _handler_here(), script),
        rest(of("nestjs"), NEST_VERB, F.concat(_prefix(NEST_PREFIX), F.lit("/"), _stripped(_group(NEST_VERB, 2))), F.array(F.upper(_group(NEST_VERB, 1))), _next(SCRIPT_METHOD, 3, NOT_METHODS), script),
        rest(of("spring"), SPRING_VERB, F.replace(F.concat(_prefix(SPRING_PREFIX), F.lit("/"), _stripped(_group(SPRING_VERB, 2))), F.lit("//"), F.lit("/")), F.when(spring == "Request", _methods("GET", "POST")).otherwise(F.array(F.upper(spring))), _next(JAVA_METHOD, 5), lambda path: _params(path, r"\{(\w+)\}")),
        rest(of("gin"), GIN_VERB, _group(GIN_VERB, 2), F.array(_group(GIN_VERB, 1)), F.when(F.regexp_extract("line", r",\s*(\w+)\s*\)", 1) == "", "anonymous").otherwise(F.regexp_extract("line", r",\s*(\w+)\s*\)", 1)), lambda path: _params(path, r"[:*](\w+)")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("line_no", "line")
