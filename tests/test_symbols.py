from pyspark.sql import functions as F

from tallyloom.operators import symbols as S

FILES = {
    "A.java": ("java", """package x;
/** outer */
public class Outer<T> extends Base {
  private int n = compute(1); // count
  /* makes it */
  public Outer(int a) { this.n = a; if (a > 0) { run(); } }
  static class Inner {
    @Override
    public String toString() throws IOException { return "class Fake { void no() {} }"; }
  }
  abstract int later(String s);
}
interface Shape { double area(); }
enum E { A(1), B(2); E(int x) {} }
"""),
    "b.kt": ("kotlin", """package y
data class Point(
    val x: Int,
    val y: Int
)
/** twice */
fun twice(a: Int) = a * 2
object Single {
  // not a doc
  fun <T> id(t: T): T {
    return t
  }
  companion object {
    fun String.shout() = this + "}"
  }
}
"""),
    "c.js": ("javascript", """// greet
export function greet(name) {
  const s = `hi ${name} {`;
  if (s) { return s }
  return items.map(function (x) { return x })
}
class Box extends Base {
  /* get it */
  get value() { return this.v }
  static async load(url) {
    for (const x of y) { await x }
  }
}
const arrow = (x) => { return x }
"""),
    "d.ts": ("typescript", """export interface Shape {
  area(scale: number): number;
  name: string
}
abstract class Hidden { run(): void { } }
export class Circle implements Shape {
  constructor(private r: number) { }
  // doc
  public area(scale: number): number { return 3 * this.r }
}
"""),
    "e.cpp": ("cpp", """#include <x.h>
#define M(a) { a
namespace n {
class Foo : public Bar {
public:
  int inside() const { return 1; }
};
}
struct Fwd;
// doc
static int add(int a, int b) { int c(a); return c + b; }
int Foo::outside(int q) { return q; }
int declared(int);
"""),
    "f.rs": ("rust", """use std::fmt;
#[derive(Debug)]
pub struct P(i32);
enum Kind { A, B }
impl fmt2 for P { }
impl Display for P {
    /// shows
    // more
    fn fmt<'a>(&'a self) -> i32 { let c = '{'; 1 }
}
impl P { pub fn new() -> P { P(1) } }
trait T { fn sig(&self); fn with_body(&self) { } }
"""),
    "g.py": ("python", '''class A:
    class B:
        @deco
        def inner(self):
            """own doc"""
            def nested():
                pass
    async def run(self): pass
def free():
    return "é"
'''),
    "bad.py": ("python", "def broken(:\n"),
}


def rows(spark):
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in FILES.items()], "path string, language string, content string")
    found, errors = S.extract(df)
    out = S.with_source(S.with_owner(found), df).orderBy("path", "start_byte").collect()
    return out, errors.collect()


def test_symbols_of_every_language(spark):
    out, errors = rows(spark)
    got = {}
    for r in out:
        got.setdefault(r.path, []).append((r.kind, r.name, r.class_name, r.line_start, r.line_end, r.doc_comment, r.is_extension))
        assert r.source == FILES[r.path][1].encode()[r.start_byte:r.end_byte].decode()
    assert got["A.java"] == [
        ("class", "Outer", "Outer", 3, 12, "", False),
        ("method", "Outer", "Outer", 6, 6, "/* makes it */", False),
        ("class", "Inner", "Inner", 7, 10, "", False),
        ("method", "toString", "Outer", 8, 9, "", False),
        ("method", "later", "Outer", 11, 11, "", False),
        ("method", "area", "", 13, 13, "", False),
        ("method", "E", "", 14, 14, "", False),
    ]
    assert got["b.kt"] == [
        ("class", "Point", "Point", 2, 5, "", False),
        ("method", "twice", "", 7, 7, "/** twice */", False),
        ("class", "Single", "Single", 8, 16, "", False),
        ("method", "id", "Single", 10, 12, "", False),
        ("method", "shout", "Single", 14, 14, "", False),
    ]
    assert got["c.js"] == [
        ("method", "greet", "", 2, 6, "// greet", False),
        ("class", "Box", "Box", 7, 13, "", False),
        ("method", "value", "Box", 9, 9, "/* get it */", False),
        ("method", "load", "Box", 10, 12, "", False),
    ]
    assert got["d.ts"] == [
        ("class", "Shape", "Shape", 1, 4, "", False),
        ("method", "area", "Shape", 2, 2, "", False),
        ("method", "run", "", 5, 5, "", False),
        ("class", "Circle", "Circle", 6, 10, "", False),
        ("method", "constructor", "Circle", 7, 7, "", False),
        ("method", "area", "Circle", 9, 9, "// doc", False),
    ]
    assert got["e.cpp"] == [
        ("class", "Foo", "Foo", 4, 7, "", False),
        ("method", "inside", "Foo", 6, 6, "", True),
        ("class", "Fwd", "Fwd", 9, 9, "", False),
        ("method", "add", "", 11, 11, "// doc", False),
        ("method", "outside", "", 12, 12, "", True),
        ("method", "declared", "", 13, 13, "", False),
    ]
    assert got["f.rs"] == [
        ("class", "P", "P", 3, 3, "", False),
        ("class", "Kind", "Kind", 4, 4, "", False),
        ("class", "fmt2", "fmt2", 5, 5, "", False),
        ("class", "Display", "Display", 6, 10, "", False),
        ("method", "fmt", "Display", 9, 9, "/// shows\n// more", False),
        ("method", "new", "", 11, 11, "", False),
        ("class", "T", "T", 12, 12, "", False),
        ("method", "with_body", "T", 12, 12, "", False),
    ]
    assert got["g.py"] == [
        ("class", "A", "A", 1, 8, "", False),
        ("class", "B", "B", 2, 7, "", False),
        ("method", "inner", "A", 4, 7, "own doc", False),
        ("method", "nested", "A", 6, 7, "", False),
        ("method", "run", "A", 8, 8, "", False),
        ("method", "free", "", 9, 10, "", False),
    ]
    assert [e.path for e in errors] == ["bad.py"]


def test_class_members_cover_nested_classes(spark):
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in FILES.items()], "path string, language string, content string")
    found, _ = S.extract(df.where(F.col("language").isin("python", "java")))
    got = {(r.path, r.class_name): r.methods for r in S.class_members(found).collect()}
    assert got[("g.py", "A")] == ["inner", "nested", "run"]
    assert got[("g.py", "B")] == ["inner", "nested"]
    assert got[("A.java", "Outer")] == ["Outer", "toString", "later"]
    assert got[("A.java", "Inner")] == ["toString"]


ORDINARY = {
    "Note.java": ("java", """class Note {
  @SuppressWarnings({"a", "b"})
  void quiet() { }
  Runnable r() { return new Runnable() { public void run() { go(); } }; }
}
enum Op {
  PLUS { int apply(int a) { return a; } },
  MINUS(2) { int apply(int a) { return -a; } };
}
"""),
    "ops.cpp": ("cpp", """int f(int a = 1) { return a; }
struct V {
  V operator+(const V& o) const { return o; }
  bool operator==(const V& o) const;
  int at(int i = 0, int j = f(2)) { return i; }
};
"""),
    "re.js": ("javascript", """class R {
  test(s) { return /}/.test(s); }
  next() {      return     /re{/; }
  last() { }
}
"""),
    "c.kt": ("kotlin", "fun f(a: Int, /*1*/ /*2*/ /*3*/ /*4*/\n b: Int) = a\n"),
}


def test_ordinary_code(spark):
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in ORDINARY.items()], "path string, language string, content string")
    got = {}
    for r in S.with_owner(S.extract(df)[0]).orderBy("path", "start_byte").collect():
        got.setdefault(r.path, []).append((r.name, r.class_name, r.line_start, r.line_end))
    assert [x[:2] for x in got["Note.java"]] == [("Note", "Note"), ("quiet", "Note"), ("r", "Note"), ("run", "Note"), ("apply", ""), ("apply", "")]
    assert [x[0] for x in got["ops.cpp"]] == ["f", "V", "operator+", "operator==", "at"]
    assert got["re.js"] == [("R", "R", 1, 5), ("test", "R", 2, 2), ("next", "R", 3, 3), ("last", "R", 4, 4)]
    assert got["c.kt"] == [("f", "", 1, 2)]


def test_very_long_tokens_are_handled(spark):
    n = 200_000
    files = {
        "min.js": ("javascript", "var a = /" + "x" * n + "\nvar b = '" + "\\'" * n + "';\n" + "// c\n" * 3000 + "function f() { }\n"),
        "attr.rs": ("rust", "#[doc(" + "y " * n + ")]\n/* " + "z\n" * n + "*/\nfn g() { }\n"),
        "data.cpp": ("cpp", "int t[] = { " + "1, " * n + "};\n#define X " + "q \\\n" * 3000 + "\nint h() { return 1; }\n"),
        "text.java": ("java", 'class A { String s = """\n' + 'w "{" \n' * n + '"""; void k() { } }\n'),
        "deep.ts": ("typescript", "class B {\n" + "  // note\n" * 4000 + "  m(): void { " + "{" * 300 + "}" * 300 + " }\n}\n"),
    }
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in files.items()], "path string, language string, content string")
    found = S.with_source(S.with_owner(S.extract(df)[0]), df).collect()
    got = {(r.path, r.kind, r.name): (r.line_start, r.line_end) for r in found}
    assert got[("min.js", "method", "f")] == (3003, 3003)
    assert got[("attr.rs", "method", "g")] == (n + 3, n + 3)
    assert got[("data.cpp", "method", "h")] == (3003, 3003)
    assert got[("text.java", "method", "k")] == (n + 2, n + 2)
    assert got[("deep.ts", "method", "m")] == (4002, 4002)
    assert len(got) == 7
    for r in found:
        assert r.source == files[r.path][1][r.start_byte:r.end_byte]


DEEP = {
    "Api.java": ("java", """class Api {
  @ApiResponses(value = { @ApiResponse(code = 404, ref = {1, 2}), @ApiResponse(code = 500, ref = {f({3})}) })
  // why
  /* doc */
  public Foo getFoo(@Param(names = {"a", "b"}) int id) {
    for (int i = 0; i < 3; i++) { pool.submit(new Task() { public void run() { go("}"); } }); }
  }
  static class Deep { class Deeper { void low() { } } void mid() { } }
  Foo getFoo() { return null; }
}
"""),
    "deep.kt": ("kotlin", """/* a /* nested fun no() {} */ still */
class View(val onClick: () -> Unit = { run { } }, val n: Int) {
  @Suppress(["a"])
  fun draw(block: () -> Unit = { }, s: String = "${ if (x) "}" else "{" }") {
    inner()
  }
  class In { fun low() = 1 }
  fun draw() = """ + '"""' + "raw ${ map { it } } }" + '"""' + """
}
"""),
    "deep.js": ("javascript", """class Pick extends mixin({ a() { } }) {
  pull({ a, b: { c } }, d = {}, [e, { f }] = []) { return `x ${ `${ { g: 1 } }` + '}' } {` }
  after() { return a / b / c }
}
function top({ h } = { i: [1, { j: 2 }] }) { if (ready({ k() { } })) { } }
"""),
    "deep.ts": ("typescript", """class Typed<T extends { a: number }> {
  field: { x: number; y: { z: string } } = { x: 1, y: { z: '' } };
  take(x: { a: number; b: string }, y?: { c: { d: 1 } }): void { }
  give(): { a: number } { return { a: 1 } }
  @Log({ level: { deep: 1 } })
  last(cb: (v: { w: number }) => void): Array<{ q: string }> { return [] }
}
interface Port { open(o: { p: number }): { q: string }; close(): void }
"""),
    "deep.cpp": ("cpp", """struct Init : public Base {
  Init(int x) : a{x}, b{{1, 2}}, c(f({3})) { run([](int y) { return y; }); }
  explicit Init(std::vector<int> v = {1, 2}) noexcept;
  int a;
private:
  void hid(Opt o = {}) const { if (auto k = g({1}); k) { } }
};
template <typename T> T pick(T a, std::pair<T, T> b = {}) { return a; }
int after(int z = g({1, 2})) { return z; }
"""),
    "deep.rs": ("rust", """/* a /* b */ fn hidden() {} */
fn main() { let s = r##"fn no() { "# "##; }
#[cfg(any(feature = "a", doc = "]"))]
pub fn attr<'a, T: Into<String>>(x: &'a T) -> [u8; { 1 + 1 }] where T: Copy { [0; 2] }
mod m { impl Show for super::P { fn show(&self) { match 1 { _ => {} } } } }
"""),
    "deep.py": ("python", """class A:
    class B:
        def low(self, x={'a': (1, 2)}): return {1}
    def mid(self): pass
    def mid(self, y): pass
"""),
}


def test_depth(spark):
    """Brackets, comments and templates in each other, in every language: nothing is lost and nothing invented."""
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in DEEP.items()], "path string, language string, content string")
    found = S.with_source(S.with_owner(S.extract(df)[0]), df).orderBy("path", "start_byte").collect()
    got = {}
    for r in found:
        assert r.source == DEEP[r.path][1].encode()[r.start_byte:r.end_byte].decode()
        got.setdefault(r.path, []).append((r.kind[0], r.name, r.class_name, r.line_start, r.line_end, r.doc_comment))
    assert got["Api.java"] == [
        ("c", "Api", "Api", 1, 10, ""), ("m", "getFoo", "Api", 2, 7, ""), ("m", "run", "Api", 6, 6, ""), ("c", "Deep", "Deep", 8, 8, ""),
        ("c", "Deeper", "Deeper", 8, 8, ""), ("m", "low", "Api", 8, 8, ""), ("m", "mid", "Api", 8, 8, ""), ("m", "getFoo", "Api", 9, 9, "")]
    assert got["deep.kt"] == [
        ("c", "View", "View", 2, 9, ""), ("m", "draw", "View", 3, 6, ""), ("c", "In", "In", 7, 7, ""), ("m", "low", "View", 7, 7, ""), ("m", "draw", "View", 8, 8, "")]
    assert [x[:5] for x in got["deep.js"]] == [
        ("c", "Pick", "Pick", 1, 4), ("m", "pull", "Pick", 2, 2), ("m", "after", "Pick", 3, 3), ("m", "top", "", 5, 5)]
    assert [x[:5] for x in got["deep.ts"]] == [
        ("c", "Typed", "Typed", 1, 7), ("m", "take", "Typed", 3, 3), ("m", "give", "Typed", 4, 4), ("m", "last", "Typed", 6, 6),
        ("c", "Port", "Port", 8, 8), ("m", "open", "Port", 8, 8), ("m", "close", "Port", 8, 8)]
    assert [x[:5] for x in got["deep.cpp"]] == [
        ("c", "Init", "Init", 1, 7), ("m", "Init", "Init", 2, 2), ("m", "Init", "Init", 3, 3), ("m", "hid", "Init", 6, 6), ("m", "pick", "", 8, 8), ("m", "after", "", 9, 9)]
    assert [x[:5] for x in got["deep.rs"]] == [("m", "main", "", 2, 2), ("m", "attr", "", 4, 4), ("c", "Show", "Show", 5, 5), ("m", "show", "Show", 5, 5)]
    assert [x[:5] for x in got["deep.py"]] == [
        ("c", "A", "A", 1, 5), ("c", "B", "B", 2, 3), ("m", "low", "A", 3, 3), ("m", "mid", "A", 4, 4), ("m", "mid", "A", 5, 5)]


def test_owners_by_join(spark):
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in (FILES | DEEP).items()], "path string, language string, content string")
    found = S.extract(df)[0].cache()
    rows = lambda out: sorted((r.path, r.start_byte, r.name, r.class_name) for r in out.where("kind = 'method' AND class_name <> ''").collect())
    assert rows(S.outermost_owners(found)) == rows(S.with_owner(found))


def test_no_exchange_before_owners(spark):
    df = spark.createDataFrame([(p, l, c) for p, (l, c) in DEEP.items()], "path string, language string, content string")
    plan = S.extract(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_files(spark):
    """Unended strings, comments and brackets, and texts of nothing, are read to their end."""
    texts = ["", None, "{", "}", "((((", "))))}", "/*", "//", "'", '"', "`${", "`${`${`${" * 100, "class A { void f(", "@X(", "#", "r#\"", 'R"(', "\x00{\x01", "é{ü", "class \n{"]
    df = spark.createDataFrame([(f"{l}{i}", l, t) for l in S.BRACE_LANGUAGES for i, t in enumerate(texts)], "path string, language string, content string")
    for r in S.with_source(S.with_owner(S.extract(df)[0]), df).collect():
        assert 0 <= r.start_byte <= r.end_byte and r.line_start <= r.line_end and r.name
