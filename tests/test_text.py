from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.functions import textops as T
from fathom.functions.lexing import extract_functions, mask

TS = '''import { a } from "./a";

/** Makes a session. */
export async function createSession(user: User, options = {}): Promise<Session> {
  const s = "} not code {"; // }
  return { user };
}

export class Store {
  /**
   * Reads one.
   * @param id the id
   */
  private read(id: string): number { return /[{]/.test(id) ? 1 : 2; }
}
export const go = async (x: number) => {
  return x;
};
'''

CS = '''namespace A;
/// <summary>Keeps users.</summary>
public sealed class UserController
{
    public int Count { get; init; }

    /// <summary>Finds one.</summary>
    [HttpGet]
    public async Task<User?> Find(int id) => await _store.Get(id);
}
'''


def test_symbols_of_typescript():
    got = [(n, k, s, e, d) for n, k, s, e, _, d in T.extract_symbols("a/b.ts", TS)]
    assert got == [("createSession", "function", 4, 7, "Makes a session."), ("Store", "class", 9, 15, None), ("read", "method", 14, 14, "Reads one."), ("go", "function", 16, 18, None)]


def test_functions_end_where_their_braces_close():
    src = "function a(x: S): boolean {\n  return x > 1;\n}\n\nfunction b(): { c: number } {\n  return { c: 1 };\n}\n"
    assert [(f["name"], src[f["start"] : f["end"]].count("\n")) for f in extract_functions(src, False)] == [("a", 2), ("b", 2)]


def test_symbols_of_csharp():
    got = {n: (k, d) for n, k, _, _, _, d in T.extract_symbols("a/B.cs", CS)}
    assert got == {"UserController": ("class", "Keeps users."), "Count": ("property", None), "Find": ("route", "Finds one.")}


def test_no_symbols():
    assert T.extract_symbols("a.md", TS) == T.extract_symbols("a.ts", "") == T.extract_symbols("a.ts", None) == []


@given(st.text(alphabet="ab{}()\"'`/*\n \\=;", max_size=60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_mask_keeps_offsets(text, csharp):
    code, comments = mask(text, csharp)
    assert len(code) == len(text) and code.count("\n") == text.count("\n")
    assert all(0 <= s <= e <= len(text) for s, e in comments)
    extract_functions(text, csharp)


def test_strip_comment_lines():
    assert T.strip_comment_lines("a\nb") == ("a\nb", False)
    assert T.strip_comment_lines("// x\na; // keep\n/* y\n z */\n\n\nb") == ("a; // keep\n\nb", True)
    assert T.strip_comment_lines("") == ("", False)


def test_hunks():
    assert T.line_hunks("a\nb", "a\r\nb\r\n") == []
    old = "\n".join(str(i) for i in range(60))
    assert [h[:2] for h in T.line_hunks(old, old.replace("3\n", "x\n", 1))] == [(2, 5)]
    far = old.split("\n")
    far[3], far[40] = "x", "y"
    assert len(T.line_hunks(old, "\n".join(far))) == 2
    near = old.split("\n")
    near[3], near[6] = "x", "y"
    assert len(T.line_hunks(old, "\n".join(near))) == 1
    assert T.line_hunks("", "a")[0][4] == "+a"


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_hunks_apply(a, b):
    out, at = [], 0
    for start, n, _, _, text in T.line_hunks("\n".join(a), "\n".join(b)):
        out += a[at : start - 1] + [x[1:] for x in text.split("\n") if x[:1] in (" ", "+")]
        at = start - 1 + n
    want = "\n".join(b).split("\n") if b else []
    assert out + a[at:] == (want if "\n".join(b) else [])


def test_tokens_and_escapes():
    assert T.PatternTokens().count("") == 0
    assert T.PatternTokens().count("a b  c") == 4
    assert T.json_escaped("a\"<b>'+é") == "a\\u0022\\u003Cb\\u003E\\u0027\\u002B\\u00e9"


def test_shortest_edits():
    import random

    from fathom.functions.textops import shortest_edits

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def edits(ops):
        return sum(i2 - i1 + j2 - j1 for i1, i2, j1, j2 in ops)

    assert edits(shortest_edits(list("ABCABBA"), list("CBABAC"), 99)) == 5
    assert shortest_edits(list("abc"), list("xyz"), 5) is None and shortest_edits([], [], 0) == []
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        ops = shortest_edits(a, b, 99)
        out, at = [], 0
        for i1, i2, j1, j2 in ops:
            out += a[at:i1] + b[j1:j2]
            at = i2
        assert out + a[at:] == b and edits(ops) == len(a) + len(b) - 2 * common(a, b)


def test_long_texts_take_time_in_proportion():
    import time

    from fathom.functions.textops import extract_symbols

    for path, text in (
        ("a.js", "function f(a){return a(b)};" * 20_000), ("a.js", "`${a} " * 60_000), ("a.cs", "public int P { get; set; }\n" * 10_000), ("a.cs", "class A { void F() { } }\n" * 10_000), ("a.ts", "a(b);" * 60_000), ("a.js", "f(" * 100_000),
    ):
        began = time.time()
        extract_symbols(path, text)
        assert time.time() - began < 15
    attributes = "[Route(\"x\")]\n" * 60 + "[ApiController]\npublic class Shop\n{\n    public int Get(int id) { return 1; }\n}\n"
    assert [s[1] for s in extract_symbols("a.cs", attributes)] == ["class", "route"]
    signature = extract_symbols("a.js", "function long(" + ", ".join(f"argument{i}" for i in range(600)) + ") { }")[0][4]
    assert signature.endswith("argument599)")
