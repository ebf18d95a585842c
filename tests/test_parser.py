"""Spans of symbols where strings and comments hold braces, quotes and names."""

import pytest

from tracegrain.sources.parser import code_alone, extract

RUST = '''/* a } /* nested { */ fn not_me() { */
fn first<'a>(x: &'a str) -> char {
    let s = "}} \\" fn nor_me() {"; // } }
    let r = r#"raw " } "#; let b = b'{'; let c = '\\'';
    '}'
}
struct After;
'''
JAVA = '''class A {
    String s = "{ \\" }"; // {{{
    /* } class NotMe { */
    char c = '{';
    String t = """
        } " {
        """;
    int get(int x) { return x; /* } */ }
}
class B { }
'''
KOTLIN = '''class A {
    /* } /* { */ } */
    val s = "{ }}"
    val t = """ } \\ " }"""
    fun get(x: Int): Int { return x } // }
}
fun after() { }
'''
JAVASCRIPT = '''function first(a) {
  const t = `}} ${ a.map((x) => { return `{${x}"}"}` }) } {`;
  const r = /[/}]{2}\\/}/g; // }
  return a / 2 + "}" + '{' /* } */;
}
class After { }
'''
PYTHON = '''def first(a):
    """def not_me():
col zero } text
    """
    b = 'it"s' + f"{a}"  # def nor_me():
    return "end"
# not part of it
def after():
    return \'\'\'x
y\'\'\'
'''


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("a.rs", RUST, {"first": "'}'\n}", "After": "struct After;"}),
        ("a.java", JAVA, {"A": "/* } */ }\n}", "get": "/* } */ }", "B": "class B { }"}),
        ("a.kt", KOTLIN, {"A": "// }\n}", "get": "{ return x }", "after": "fun after() { }"}),
        ("a.js", JAVASCRIPT, {"first": "/* } */;\n}", "After": "class After { }"}),
        ("a.ts", JAVASCRIPT, {"first": "/* } */;\n}", "After": "class After { }"}),
        ("a.py", PYTHON, {"first": 'return "end"', "after": "y'''"}),
    ],
)
def test_braces_in_strings_and_comments_move_no_span(path, source, want):
    found = {name: source[start:end] for _, name, start, end in extract(path, source)}
    assert set(found) == set(want)
    assert all(found[name].endswith(tail) for name, tail in want.items()), found


def test_places_stay():
    for language, source in (("rust", RUST), ("java", JAVA), ("kotlin", KOTLIN), ("javascript", JAVASCRIPT), ("python", PYTHON)):
        code = code_alone(source, language)
        assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
        assert "me" not in code
    for odd in ('fn f() { "never', "/* never", "'", "`${", "`${`", 'r##"x"#', '"""', "\\", "x = /a"):
        for language in ("rust", "java", "kotlin", "javascript", "python"):
            assert len(code_alone(odd, language)) == len(odd)
