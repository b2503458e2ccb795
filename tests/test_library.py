import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, scalars
from quarry.operators import candidates, changes, files, ranking, sessions
from quarry.plans import describe, parsers, render
from quarry.sources import languages, ledger, trees


def routes(language, source, path="x"):
    return [f"{r['method']} {r['path']}" for r in parsers.REGISTRY[language](source, path, "m") if r["kind"] == "endpoint"]


JAVA = '''@RestController
@RequestMapping("/api/v1")
public class PetController {
    @GetMapping("/pets")
    public List<Pet> allPets() { return List.of(); }
    @GetMapping("/pets/{id}")
    public Pet onePet(@PathVariable Long id) { return null; }
    @PostMapping("/pets")
    public Pet newPet(@RequestBody Pet p) { return p; }
    @RequestMapping(value = "/pets/{id}", method = RequestMethod.PUT)
    public Pet putPet(Long id) { return null; }
    public void helper() { }
}'''
GO = '''package main
func main() {
	mux.HandleFunc("GET /beds", a)
	mux.Handle("PUT wards.example.com/beds/{id}", b)
	mux.HandleFunc("HEAD /health", c)
	mux.HandleFunc("/old", d)
	r.HandleFunc("/rooms", e).Methods("POST")
	x := ctx.Header.Get("Accept")
	m.Group("/admin", func() {
		m.Get("/users", list)
		m.Delete("/users/:id", gone)
	})
}'''
RUST = '''/// All.
#[get("/cups")]
async fn cups() -> impl Responder { x }
#[route("/cups/{id}", method = "PATCH")]
async fn cup() -> impl Responder { x }
fn app() { Router::new().route("/mugs", get(mugs).post(new_mug)).route("/jars", delete(no_jar)); }
pub fn helper() {}
'''
CSHARP = '''[ApiController]
[Route("api/[controller]")]
public class TicketController : ControllerBase {
    [HttpGet]
    public IActionResult All() => Ok();
    [HttpDelete("{id}")]
    public IActionResult Gone(int id) => NoContent();
}
app.MapPost("/mini", () => 1);'''
TYPESCRIPT = '''const router = express.Router();
/** All. */
router.get('/jobs', (req, res) => {
  res.json([]);
});
router.patch("/jobs/:id", (req, res) => { res.send(); });
const x = cache.get('key');
'''
PYTHON = '''import os
class Cat(BaseModel):
    """A cat."""
    name: str
    age: int
@app.post("/cats")
async def new_cat(cat: Cat) -> Cat:
    """Make — a “cat” 🐈."""
    return cat
@bp.route("/dogs", methods=["PUT"])
def put_dog(): pass
def free(a, b=1):
    def inner(): pass
    return os.getenv("HOME")
def _private(): pass
'''


def test_routes_by_language():
    assert routes("java", JAVA) == ["GET /api/v1/pets", "GET /api/v1/pets/{id}", "POST /api/v1/pets", "PUT /api/v1/pets/{id}"]
    assert routes("go", GO) == ["GET /beds", "PUT /beds/{id}", "GET /old", "POST /rooms", "GET /users", "DELETE /users/:id"]
    assert routes("rust", RUST) == ["GET /cups", "PATCH /cups/{id}", "GET /mugs", "POST /mugs", "DELETE /jars"]
    assert routes("csharp", CSHARP) == ["GET /api/ticket", "DELETE /api/ticket/{id}", "POST /mini"]
    assert routes("typescript", TYPESCRIPT) == ["GET /jobs", "PATCH /jobs/:id"]
    assert routes("python", PYTHON) == ["POST /cats", "PUT /dogs"]
    assert [r["qualname"] for r in parsers.REGISTRY["java"](JAVA, "", "") if r["kind"] == "function"] == ["helper"]
    rows = parsers.parse_python(PYTHON, "", "m")
    assert [r["qualname"] for r in rows if r["kind"] == "function"] == ["free", "inner"]
    assert json.loads(rows[2]["payload"]) == {"name": "", "age": 0}
    assert routes("typescript", """app.route('/p').get(h).post((a) => { x(')') }).del(z)
fastify.route({ method: 'PUT', url: '/f', handler() {} })""") == ["GET /p", "POST /p", "DELETE /p", "PUT /f"]
    assert routes("rust", '#[rocket::get("/r")]\nfn r() {}') == ["GET /r"]


def test_python_routes_follow_the_first_decorator_that_is_one():
    source = """@app.route("/x", methods=[GET])
def a(): pass
@app.get()
def no_path(): pass
@app.route("/h", methods=["HEAD"])
def c(): pass
@cache("/c")
@app.post("/d")
@app.get("/e")
def d(item: Item, id: int, request: Request): pass
@app.get("/p")
def _private(): pass
@get("/n")
async def n():
    '''  One
         two  '''
    def not_seen(): pass
class Item(BaseModel):
    name: str = "x"
    _hidden: int
    tags: List[str]
    price: float = Field(1)
    def total(self): return 1
"""
    rows = parsers.parse_python(source, "", "m")
    assert [f"{r['method']} {r['path']}" for r in rows if r["kind"] == "endpoint"] == ["GET /x", "GET /h", "POST /d", "GET /n"]
    assert json.loads(rows[3]["payload"]) == {"name": "x", "tags": [], "price": 0.0}
    assert next(r for r in rows if r["qualname"] == "n")["docstring"] == "One\n         two"
    assert [r["qualname"] for r in rows if r["kind"] == "function"] == ["no_path"]
    assert [r["qualname"] for r in rows if r["kind"] in ("class", "method")] == ["Item", "Item.total"]


def test_extract_isolates_failures(spark):
    rows = [("a.py", "python", "a", PYTHON), ("b.py", "python", "b", "def ("), ("c.go", "go", "c", GO), ("d.x", "none", "", None)]
    found = parsers.extract(spark.createDataFrame(rows, "rel_path string, language string, module string, source string"))
    got = found.groupBy("rel_path").agg(F.min("parse_ok").alias("ok"), F.count("*").alias("n")).collect()
    assert {r.rel_path: r.ok for r in got} == {"a.py": True, "b.py": False, "c.go": True}


HOSTILE = ["@app.route('/x', methods=[GET])\ndef a(): pass", "def a(): pass\rdef b(): pass\r", "(" * 5000, "x = " + "-" * 100_000 + "1", "\0", "def é(a: 'ü' = 'ß'): pass", "class A:\n  x: int = (", "\ufeffx = 1", "@\ndef f(): pass", "import", "\f\ndef g(): pass",
           "'use strict'\n`", '"' * 9999, "{" * 50_000, "fn" * 9999, "/*", '@GetMapping("', "@RequestMapping", "[HttpGet(", '.route("/x", get(' * 200, ".route({" * 300]


@pytest.mark.parametrize("language", sorted(parsers.REGISTRY))
def test_no_file_ends_a_scan(spark, language):
    rows = [(f"{k}", language, "m", t) for k, t in enumerate([*HOSTILE, "fine", None])]
    files_ = spark.createDataFrame(rows, "rel_path string, language string, module string, source string")
    found = parsers.extract(files_.coalesce(1)).collect()
    assert {r.rel_path for r in found} <= {r[0] for r in rows}
    if language == "python":
        assert {r.rel_path for r in found if r.parse_ok} >= {"0", "1", "5"} and {r.rel_path for r in found if not r.parse_ok} >= {"2", "6"}
        assert describe.chunks(files_).where("parse_ok").count() >= 4 and describe.function_info(files_).where("not parse_ok").count() >= 2


def test_functions_with_parameters():
    source = """class A:
    @route("/x")
    async def run(self, a: int, /, b=2, *args: str, c: "T" = None, **kw) -> Dict[str, int]:
        'Runs.'
    @property
    def size(self): pass
    def is_ok(self): pass
    def plain(self): pass
def testing(): pass
def free(x): pass
"""
    rows = describe.functions_of(source)
    assert [(r["name"], r["endpoint_type"]) for r in rows] == [("run", "flask"), ("plain", "method"), ("free", "function")]
    assert rows[0]["signature"] == 'async def run(a: int, b = 2, *args: str, c: "T" = None, **kw) -> Dict[str, int]'
    assert rows[0]["param_defaults"] == [None, None, "2", None, "None", None] and rows[0]["docstring"] == "Runs."
    assert [(c["kind"], c["name"]) for c in describe.chunks_of(source)][:2] == [("class", "A"), ("function", "run")]


def test_verified_files(spark):
    rows = [("ok.py", "from pkg.a import f\nimport os\nfrom other import z"), ("bad.py", "from pkg.a import g\nfrom pkg.b import f"), ("cut.py", "def (")]
    items = spark.createDataFrame([("pkg.a", "f")], "module string, qualname string")
    table = spark.createDataFrame(rows, "rel_path string, source string")
    got = {tuple(r) for r in describe.verified(table, items, "pkg").collect()}
    assert got == {("bad.py", "import_audit", "unknown item pkg.a g"), ("bad.py", "import_audit", "unknown module pkg.b f"), ("cut.py", "parse", "the file does not parse")}
    assert describe.verified(table, items, "").count() == 1


@pytest.mark.parametrize("text,lines", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("\n\n", 2), (None, 0)])
def test_line_count(spark, text, lines):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.line_count("t")).first()[0] == lines


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(scalars.clip(lit("abcd"), 3)) == "abc…"
    assert get(scalars.tool_name(lit("POST"), lit("/a/{id}"), lit("handler"), "python")) == "create_a_by_id"
    assert get(scalars.tool_name(lit("GET"), lit("/a/:id"), lit("listAll"))) == "listAll"
    assert get(scalars.tool_name(lit("DELETE"), lit("/"), lit(""))) == "delete_route"
    assert get(scalars.display_name(lit("get_ALL__x"))) == "Get ALL X"
    assert get(scalars.module_name(lit("a/b/__init__.py"))) == "a.b"
    assert get(scalars.module_name(lit("a/b/c.rs"), "rust")) == "a::b::c"
    assert get(scalars.module_name(lit("a/b/c.go"), "go")) == "b"
    assert get(scalars.decorator_name(lit("@a.b.c(1)"))) == "c"
    assert tuple(get(scalars.decorator_route(lit('@app.route("/x", methods=["POST"])')))) == ("POST", "/x")
    assert tuple(get(scalars.go_pattern(lit("POST h.example/x")))) == ("POST", "/x")
    assert get(scalars.go_pattern(lit("HEAD /x")))["method"] is None
    assert get(scalars.version_newer(lit("1.10.0"), lit("1.9"))) is True
    assert get(scalars.path_parameters(lit("/a/{x}/{y_1}"))) == ["x", "y_1"]
    assert get(scalars.environment_names(lit('os.getenv("A") os.getenv("A") os.getenv("B")'))) == ["A", "B"]
    assert get(scalars.indent(lit("a\n\nb"), 2)) == "  a\n\n  b"
    assert get(scalars.headers(lit('[{"key":"a","value":"b"}]')))[0]["key"] == "a"
    assert get(scalars.headers(lit("bad"))) == []
    assert get(scalars.human_number(lit(1_200_000))) == "1.2M"
    assert get(scalars.backoff_seconds(lit(3.0), retry_after=lit(90))) == 20.0
    assert get(scalars.backoff_seconds(lit(3.0), retry_after=lit(0.01))) == 0.01
    assert [get(scalars.identifier(lit(t))) for t in ("1 a-b", "  Get  User!Name ", "", "--")] == ["_1_a_b", "get_user_name", "tool", "tool"]
    assert [get(scalars.relative_time(lit(ms))) for ms in (59_600, 89_600, 90_000, 3_599_999)] == ["60s ago", "1m ago", "2m ago", "60m ago"]
    assert get(scalars.session_id(lit("12345678"), lit(36**3), lit("abcdef"))) == "sess_12345678_1000_abcdef"
    assert get(scalars.literal_pattern(lit("a.b(c)"))) == r"a\.b\(c\)" and scalars.word_pattern("x").endswith("(?![A-Za-z0-9_])")
    assert get(scalars.redacted(lit("abcdefghij"))) == "abcde" + "*" * 15 and get(scalars.same_json(lit('{"a":1}'), lit('{"a": 2}'))) is False
    assert get(files.underscore_folder(lit("a/_b/c.py"))) is True and get(files.underscore_folder(lit("a/b/_c.py"))) is False
    import base64

    token = "syn_live_k." + base64.urlsafe_b64encode(b'{"api_key_id":"id7"}').decode().rstrip("=") + ".s"
    assert get(scalars.key_id(lit(token))) == "id7"
    assert [get(scalars.key_id(lit(t))) for t in ("bad", token[9:], token + ".x")] == [None, None, None]


def test_classification(spark):
    cases = {"gRPC error: 16: x": "AUTH_INVALID", "gRPC error: NOPE: x": "SERVER_ERROR", '{"error_code":"NEW_CODE"}': "NEW_CODE", "ECONNREFUSED": "BACKEND_UNAVAILABLE",
             '{"error_code":"LLM_OUTPUT_INVALID","technical":"KeyError: x"}': "LLM_OUTPUT_INVALID", "network is slow": "SERVER_ERROR", "request timed out": "BACKEND_UNAVAILABLE", "Missing API key": "MISSING_API_KEY", "{broken": "SERVER_ERROR"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", classify.error_code("raw").alias("c"))
    assert {r.raw: r.c for r in df.collect()} == cases
    assert spark.range(1).select(classify.retryable_http(F.lit(500), F.lit("Prompt is too long"))).first()[0] is False


def test_tree(spark, tmp_path):
    for name, text in {"go.mod": "module x", "main.go": GO, "vendor/v.go": "x", "tools/lint.py": "print(1)\n", "tests/t.py": "def x(): pass", "app/web.py": PYTHON, "README.md": "Hello " * 900}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    listed = trees.listing(spark, str(tmp_path)).drop("content")
    assert files.detect_language(listed).first()[0] == "go"
    assert files.detect_language(listed.limit(0)).first()[0] is None
    found = trees.repo(spark, str(tmp_path), ["py"], ["@app."], ["def "])
    assert [r.rel_path for r in found.select("rel_path").collect()] == ["app/web.py"]
    assert [r.rel_path for r in trees.scan(spark, str(tmp_path), "python").select("rel_path").collect()] == ["app/web.py"]
    assert {r.rel_path for r in trees.scan(spark, str(tmp_path), "python", functions=True).select("rel_path").collect()} == {"app/web.py"}
    assert [r.rel_path for r in trees.scan(spark, str(tmp_path), "go").select("rel_path").collect()] and trees.walk(spark, str(tmp_path), "go").count() == 1
    assert [r.framework for r in files.frameworks(trees.walk(spark, str(tmp_path), "go").select("rel_path", F.decode("content", "utf-8").alias("source")), "source", languages.hints("go"), ["rel_path"]).collect()] == []
    assert [r.line for r in trees.tree_lines(listed).orderBy("sort_key").collect()] == ["app/", "    web.py", "tests/", "    t.py", "tools/", "    lint.py", "vendor/", "    v.go", "README.md", "go.mod", "main.go"]
    assert trees.modified_index(spark, str(tmp_path)).count() == 3
    cut = trees.snippets(spark.createDataFrame([("app/web.py", 2, 3), ("no.py", 1, 2)], "file_path string, start_line int, end_line int"), trees.sources(found, "python"))
    assert {r.file_path: r.snippet for r in cut.collect()} == {"app/web.py": "\n".join(PYTHON.split("\n")[1:3]), "no.py": ""}
    parsed = parsers.extract(trees.sources(found, "python")).where("kind = 'endpoint'")
    assert [(r.method, r.module) for r in parsed.orderBy("ord").collect()] == [("POST", "app.web"), ("PUT", "app.web")]
    assert {r.folder for r in trees.folders(listed).collect()} == {"vendor", "tools", "tests", "app"}
    tree = listed.sparkSession.createDataFrame([("README.md", "x" * 5000), ("CONTEXT.md", "y" * 5000)], "rel_path string, source string")
    assert [len(r.source) for r in trees.documents(tree).orderBy("place").collect()] == [3000, 3000]
    env = spark.createDataFrame([("# c",), ("A='1 2'",), ("B = x",), ("nonsense",)], "value string")
    assert {tuple(r) for r in trees.dotenv(env).collect()} == {("A", "1 2"), ("B", "x")}
    names = spark.createDataFrame([("a_server.py",), ("a_server_2.py",)], "n string")
    assert trees.free_name(names, "n", "a", "py") == "a_server_3.py"
    assert trees.free_name(names, "n", "b", "py") == "b_server.py"


def test_ledger(spark, tmp_path):
    lines = [{"type": "session_open", "repo_hash": "r"}, {"type": "file_scanned", "path": "a", "sha": "1", "endpoints": [], "functions": []}, {"type": "file_scanned", "path": "a", "sha": "2", "endpoints": [{"method": "GET"}], "functions": []},
             {"type": "file_skipped", "path": "b", "reason": "big"}, {"type": "session_paused", "reason": "user"}]
    (tmp_path / "s1.jsonl").write_text("\n".join([json.dumps(x) for x in lines[:2]] + ["{bad", ""] + [json.dumps(x) for x in lines[2:]]))
    (tmp_path / "s2.jsonl").write_text(json.dumps(lines[0]) + "\n" + json.dumps({"type": "session_done"}))
    log = ledger.read(spark, str(tmp_path))
    assert {r.session_id: r.bytes for r in ledger.expired(log, 2 * 10**12, "r").collect()} == {f"s{k}": (tmp_path / f"s{k}.jsonl").stat().st_size for k in (1, 2)}
    assert ledger.expired(log, 0, "r").count() == 0 and ledger.expired(log, 2 * 10**12, "q").count() == 0
    one, paths = sessions.resume_state(log)
    assert {r.session_id: (r.completed, r.paused) for r in one.collect()} == {"s1": (False, "user"), "s2": (True, None)}
    assert {(r.path, r.sha, r.skip_reason) for r in paths.collect()} == {("a", "2", None), ("b", None, "big")}
    assert {r.session_id: r.state for r in sessions.terminal_state(log, "session_id", "type", "line_no", ledger.TERMINAL).collect()} == {"s1": "paused", "s2": "done"}
    assert [r.session_id for r in sessions.resumable(log, "session_id", "type", "line_no", "session_open", "session_done").collect()] == ["s1"]
    assert {r.session_id: (r.scanned, r.skipped, r.endpoints) for r in ledger.counts(log).collect()}["s1"] == (2, 1, 1)


def test_cache_guard(spark, tmp_path):
    good = {"version": ledger.VERSION, "repo_hash": "r", "language": "go", "files": {"a": {"sha": "1", "endpoints": [], "functions": []}}}
    for k, (text, rows) in enumerate([(json.dumps(good), 1), ("null", 0), ("[]", 0), ("{", 0), (json.dumps(good | {"version": 1}), 0), (json.dumps(good | {"files": {"a": {"sha": "1"}}}), 0), (json.dumps(good | {"repo_hash": "q"}), 0)]):
        (tmp_path / f"{k}.json").write_text(text)
        assert ledger.read_cache(spark, str(tmp_path / f"{k}.json"), "r").count() == rows


def test_appended_records_are_read_back_in_order(spark, tmp_path):
    (tmp_path / "z.jsonl").write_text(json.dumps({"type": "session_open", "repo_hash": "r"}) + "\n" + json.dumps({"type": "file_scanned", "path": "a", "sha": "0"}))
    kinds = "session_id string, type string, path string, sha string, reason string"
    for k in (1, 2, 3):
        ledger.append(spark.createDataFrame([("z", "file_scanned", "a", f"{k}x", None), ("z", "file_scanned", "a", f"{k}", None), ("y", "session_paused", None, None, f"r{k}")], kinds), str(tmp_path))
    log = ledger.read(spark, str(tmp_path))
    one, paths = sessions.resume_state(log)
    assert {r.session_id: (r.repo_hash, r.paused, r.scanned) for r in one.collect()} == {"z": ("r", None, 7), "y": (None, "r3", 0)}
    assert {(r.session_id, r.path, r.sha) for r in paths.collect()} == {("z", "a", "3")}


def test_resume_state_against_a_replay(spark):
    from quarry import queries

    rows = [tuple(r) for r in queries._ledger(spark, "/root/testdata/sf0.001").select("session_id", "line_no", "type", "path", "repo_hash", "sha", "reason").collect()]
    state = {}
    for session, _, kind, path, repo, sha, reason in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(session, {"repo_hash": None, "paused": None, "completed": False, "scanned": 0, "skipped": 0})
        s["repo_hash"] = repo if kind == "session_open" else s["repo_hash"]
        s["paused"] = reason if kind == "session_paused" else s["paused"]
        s["completed"] |= kind == "session_done"
        s["scanned"] += kind == "file_scanned"
        s["skipped"] += kind == "file_skipped"
    got = {r.session_id: {k: r[k] for k in ("repo_hash", "paused", "completed", "scanned", "skipped")} for r in queries.resume_state(spark, "/root/testdata/sf0.001").collect()}
    assert got == state


def test_snapshot_round_trip(spark, tmp_path):
    doc = {"version": ledger.VERSION, "repo_hash": "r", "language": "go", "framework": "gin", "files": {"a": {"sha": "1", "endpoints": [{"method": "GET"}], "functions": []}, "b": {"sha": "2", "endpoints": [], "functions": []}}}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    first = ledger.read_cache(spark, str(tmp_path / "one.json"), "r")
    ledger.write_cache(first, str(tmp_path / "w"), "r", 5)
    again = ledger.read_cache(spark, str(tmp_path / "w"), "r")
    assert again.columns == first.columns and sorted(again.collect()) == sorted(first.collect()) and again.count() == 2
    assert ledger.read_cache(spark, str(tmp_path / "w"), "q").count() == 0
    assert changes.usable_cache(again, F.size("endpoints"), F.size("functions"), False).first()[:] == (True, False)


def test_chosen_functions(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3)], "name string, ord int")
    wanted = lambda *names: spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, place int")
    get = lambda w, k: [(r.name, r.ord) for r in candidates.chosen(rows, w, k, "name", "ord").orderBy("place").collect()]
    assert get(wanted("c", "a"), wanted("b")) == [("c", 3), ("a", 2)]
    assert get(wanted("x"), wanted("b", "a")) == [("b", 1), ("a", 2)]
    assert get(wanted("x"), wanted("y")) == [("b", 1), ("a", 2), ("c", 3)]
    none = spark.createDataFrame([], "name string, band string")
    assert ranking.kept_verdicts(rows, none, "name").count() == 4 and ranking.kept_verdicts(rows, none.union(spark.createDataFrame([("a", "HIGH")], none.schema)), "name").count() == 2


def test_source_of_truth(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert [r.v for r in sessions.source_of_truth(t(), t(1), t(2), t(3)).collect()] == [1]
    assert [r.v for r in sessions.source_of_truth(t(), t(), t(), t(3)).collect()] == [3]
    assert sessions.latest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string"), ["k"], "o", "v").first()["last"] == "y"


def test_steps_are_applied_in_order(spark):
    steps = spark.createDataFrame([("remove", "e1", None), ("unchanged", "e0", 0), ("update", "e2", 1), ("create", None, 2)], "action string, id string, ord int")
    assert [r.action for r in changes.apply_order(steps).collect()] == ["create", "update", "remove"]


def test_endpoint_tools_compile(spark):
    df = spark.createDataFrame([("get x", "GET", "/a/{id}", None, None, [("K", "${T}"), ("L", 'q"')], 0), ("get x", "POST", "/b", "Makes", '{"n": 1, "m": 2}', [], 1), ("", "DELETE", "/c/{id}", "", '{"n": 1}', None, 2)],
                               "name string, method string, path string, description string, payload string, headers array<struct<key:string,value:string>>, ord int")
    made = render.server(df, 'a "server"').first()
    compile(made.source, "x", "exec")
    assert made.variables == ["ENDPOINT_BASE_URL", "T"]
    assert all(x in made.source for x in ("def get_x(id: Any = None)", "def get_x_2(n: Any = None, m: Any = None)", "def delete__c_id(id: Any = None)", "json=payload", '"DELETE /c/{id}"', 'os.environ.get("T", "")'))


def plan(spark, old, new, partial=False):
    e = spark.createDataFrame([(f"e{k}", *r, k) for k, r in enumerate(old)], "id string, method string, url string, headers string, payload string, display_order int")
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(new)], "method string, url string, headers string, payload string, display_order int")
    d, e = d.withColumn("ord", F.col("display_order")), e
    out = changes.sync_plan(e, d, ["method", "url"], ["headers", "payload", "display_order"], "display_order", "ord", "id", "payload", partial)
    return sorted((r.action, r.id, r.ord, tuple(r.fields)) for r in out.collect()) if not any(r.id is None or r.ord is None for r in out.collect()) else sorted((r.action, r.id or "", -1 if r.ord is None else r.ord, tuple(r.fields)) for r in out.collect())


def test_sync_plan(spark):
    rows = [("GET", "/a", "h", None), ("POST", "/b", "h", "{}"), ("GET", "/a", "h", None)]
    assert [r[0] for r in plan(spark, rows, rows)] == ["unchanged"] * 3
    swapped = [rows[1], ("GET", "/a", "x", None), rows[2]]
    assert [(r[0], r[3]) for r in plan(spark, rows, swapped)] == [("unchanged", ()), ("update", ("headers", "display_order")), ("update", ("display_order",))]
    assert sorted(r[0] for r in plan(spark, rows[1:2], [("POST", "/b", "h", None)])) == ["create", "remove"]
    assert [r[0] for r in plan(spark, rows, rows[:1], partial=True)] == ["unchanged"]


def test_select_tokens(spark):
    e = spark.createDataFrame([("GET", "/p", "list_p"), ("POST", "/p", "create_p"), ("GET", "/p/{id}", "get_p"), ("DELETE", "/p/{id}", "delete_p")], "method string, path string, name string")
    pick = lambda spec: [({r.name for r in a.collect()}, [r.token for r in b.orderBy("place").collect()]) for a, b in [changes.select_tokens(e, "method", "path", "name", spec)]][0]
    assert pick("get /p, POST  /p") == ({"list_p", "create_p"}, [])
    assert pick("/p/{id},list_p") == ({"list_p", "get_p", "delete_p"}, [])
    assert pick("list_p,GET /p,/nope") == ({"list_p"}, ["/nope"])


def test_state_operators(spark):
    b = spark.createDataFrame([("9", "x", None), ("-5", "3.7", "2"), ('"8"', "true", "[4]")], "a string, b string, c string")
    assert [r[0] for r in b.select(sessions.baseline("a", "b", "c")).collect()] == [9, 3, 0]
    t = spark.createDataFrame([("u", 1, "old", 1)], "k string, created int, v string, updated int")
    r = spark.createDataFrame([("u", 5, "new", 5), ("w", 5, "new", 5)], "k string, created int, v string, updated int")
    assert sorted(tuple(x) for x in sessions.upsert(t, r, ["k"], "created", "updated").collect()) == [("u", 1, "new", 5), ("w", 5, "new", 5)]
    v = spark.createDataFrame([("a", "", "x"), ("b", "", "x"), ("c", "", "y")], "n string, h string, m string")
    assert [(c.cluster, c.n, c.confidence) for c in ranking.clusters(v, "h", "m", "n").collect()] == [("x_workflow", 2, 0.6)]


def test_render(spark):
    df = spark.createDataFrame([("do it", ["a"], ["int"], "Says hi", "x = 1\nreturn x", None)], "name string, p array<string>, t array<string>, purpose string, body string, opt string")
    text = df.select(render.tool("name", "p", "t", "purpose", "body")).first()[0]
    compile(text, "x", "exec")
    assert "def do_it(a: int):" in text
    assert json.loads(df.select(render.wire(["name", "opt"])).first()[0]) == {"name": "do it", "opt": None}
    assert json.loads(df.select(render.wire(["name", "opt"], optional=("opt",))).first()[0]) == {"name": "do it"}


def test_streaming_equals_batch(spark, tmp_path):
    from quarry.streaming.degradation import degradation

    rows = [("s", k, o, t) for k, (o, t) in enumerate([("overloaded", "generate")] * 2 + [("ok", "verify")] + [("overloaded", "triage")] * 3 + [("overloaded", "verify"), ("ok", "verify")])]
    df = spark.createDataFrame(rows, "session string, ord long, outcome string, task string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = degradation(stream).writeStream.format("memory").queryName("degraded").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sessions.streaks(df, "session", "ord", "outcome", "task").select("session", "ord", "streak", "degraded")
    assert sorted(map(tuple, spark.table("degraded").collect())) == sorted(map(tuple, want.collect()))


def test_growth_stream_equals_batch(spark, tmp_path):
    from quarry.streaming.degradation import growth, matched_lines

    rows = [("s", k, t, a) for k, (t, a) in enumerate([(10, False), (12, True), (11, True), (20, False), (25, True), (24, True)])]
    df = spark.createDataFrame(rows, "key string, ord long, total long, accepted boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = growth(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sessions.high_water(df, "key", "ord", "total", F.col("accepted")).select("key", "ord", "baseline", "delta")
    assert sorted(map(tuple, spark.table("grown").collect())) == sorted(map(tuple, want.collect()))
    texts = spark.createDataFrame([("a\nb", "x"), ("zz", "x"), ("a", "y")], "t string, k string")
    assert {r.k: (r.matched, r.lines) for r in matched_lines(texts, "t", ["a"], "k").collect()} == {"x": (1, 2), "y": (1, 1)}
