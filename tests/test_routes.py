"""Frameworks and routes of small files."""

from lodestone.operators import routes

FILES = {
    "flask": "from flask import Flask\napp = Flask(__name__)\n\n@app.route('/birds', methods=['GET', 'post'])\ndef birds():\n    return 1\n\n@bp.delete(\"/birds/<name:int>/{leg}\")\n@login_required\nasync def fly(name):\n    pass\n@app.route('/far')\n#\n#\n#\n#\n#\ndef later(): ...",
    "fastapi": "api = FastAPI()\n@router.head('/ping/{host}')\nasync def ping(host): ...\n@app.get('/last')",
    "django": "urlpatterns = [\n    path('nests/<int:pk>/eggs/<slug:kind>/', views_eggs),\n    path('', home),\n]",
    "express": "const app = express();\napp.get('/reeds', list);\nrouter.all(\"/reeds/:id\", auth, (q) => {\n})\napp.use(log)\napp.post('/x', function() {})",
    "nestjs": "@Controller('ponds')\nexport class Ponds {\n  @Get(':id/frogs/:frog')\n  async frog() {}\n  @Put()\n  if (x) {\n  }\n  save() {}\n@Controller()\n  @Delete('/a/')\n  x\n",
    "spring": "@RestController\n@RequestMapping(\"/api/\")\npublic class Api {\n    @GetMapping(\"/users/{id}\")\n    @Valid\n    public User all(int id) {\n    }\n    @PostMapping\n    void none() {\n    @PatchMapping()\n    private void patch() {",
    "gin": "r := gin.Default()\nr.GET(\"/otter/:name/*rest\", show)\nv.OPTIONS('/otter', func(c *gin.Context) {",
    "plain": "x = 1",
}


def frame(spark):
    return spark.createDataFrame([(n, n, t) for n, t in FILES.items()] + [("none", "flask", None)], "file_id string, framework string, content string")


def test_frameworks(spark):
    found = {}
    for r in routes.detect_frameworks(frame(spark)).collect():
        found.setdefault(r["file_id"], set()).add(r["framework"])
    assert found == {
        "flask": {"flask"}, "fastapi": {"fastapi", "express"}, "django": {"django"}, "express": {"express"}, "nestjs": {"nestjs", "spring"}, "spring": {"spring"}, "gin": {"gin"},
    }


def test_routes(spark):
    got = sorted((r["framework"], r["line"], r["path"], ",".join(r["methods"]), r["handler"], ",".join(r["params"])) for r in routes.routes(frame(spark)).collect())
    assert got == sorted([
        ("flask", 4, "/birds", "GET,POST", "birds", ""), ("flask", 8, "/birds/<name:int>/{leg}", "DELETE", "fly", "name,leg"), ("flask", 12, "/far", "GET", "unknown", ""),
        ("fastapi", 2, "/ping/{host}", "HEAD", "ping", "host"), ("fastapi", 4, "/last", "GET", "unknown", ""),
        ("django", 2, "/nests/<int:pk>/eggs/<slug:kind>", "GET,POST", "views_eggs", "pk,kind"),
        ("express", 2, "/reeds", "GET", "list", ""), ("express", 3, "/reeds/:id", "GET,POST,PUT,DELETE,PATCH", "auth", "id"), ("express", 6, "/x", "POST", "anonymous", ""),
        ("nestjs", 3, "/ponds/:id/frogs/:frog", "GET", "frog", "id,frog"), ("nestjs", 5, "/ponds/", "PUT", "save", ""), ("nestjs", 10, "//a", "DELETE", "unknown", ""),
        ("spring", 2, "/api/api", "GET,POST", "all", ""), ("spring", 4, "/api/users/{id}", "GET", "all", "id"), ("spring", 10, "/api/", "PATCH", "patch", ""),
        ("gin", 2, "/otter/:name/*rest", "GET", "show", "name,rest"), ("gin", 3, "/otter", "OPTIONS", "anonymous", ""),
    ])
