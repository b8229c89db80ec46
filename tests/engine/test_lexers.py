"""Lexers: literals that look like code, generated nestings with known spans, linear time."""

import random
import time

import pytest

from slatework.operators import extract
from slatework.operators.lexers import mask_ruby, mask_script


def spans(rows):
    return [(s.snippet_type, s.name, s.start_line, s.end_line) for s in rows]


@pytest.mark.parametrize(
    "source, want",
    [
        ("const re = /[{\"']/;\nfunction a() {\n  return 1\n}\nfunction b() {}\n", [("module_constant", "re", 1, 1), ("function", "a", 2, 4), ("function", "b", 5, 5)]),
        ("function f(s) {\n  return s.replace(/{/g, '')\n}\nfunction g() {\n  return 2\n}\n", [("function", "f", 1, 3), ("function", "g", 4, 6)]),
        ("export default class extends B {\n  m() { return 1 }\n}\nfunction k() {}\n", [("function", "m", 2, 2), ("class", "default", 1, 3), ("function", "k", 4, 4)]),
        ("const t = `a ${[1].map((x) => `{${x}`)} }`\nfunction g() { return 1 }\n", [("module_constant", "t", 1, 1), ("function", "g", 2, 2)]),
        ("function A() {\n  return <p>Don't {x} it's</p>\n}\nfunction B() {\n  return <br />\n}\n", [("function", "A", 1, 3), ("function", "B", 4, 6)]),
        ("const a = b / c / d\nfunction g() { return x / 2 }\nconst s = 'it\\'s {'\n", [("module_constant", "a", 1, 1), ("function", "g", 2, 2), ("module_constant", "s", 3, 3)]),
        ("/* { */ // {\nfunction g() { if (/}/.test(x)) return '}' }\nclass C {\n  x = /[/}]/\n  m() { return `}` }\n}\n", [("function", "g", 2, 2), ("function", "m", 5, 5), ("class", "C", 3, 6)]),
    ],
)
def test_script(source, want):
    assert spans(extract.script_snippets(source)) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("def a\n  x = <<~SQL\n    select end from if\n    def\n  SQL\n  x\nend\ndef b\n  1\nend\n", [("function", "a", 1, 7), ("function", "b", 8, 10)]),
        ("=begin\ndef no\n  class\n=end\ndef yes\n  1\nend\n", [("function", "yes", 5, 7)]),
        ("def a\n  %w[if end do] + %i(def) + [%q{end {if}}]\n  s = \"#{m { |y| \"end #{y}\" }} if\"\n  s =~ /end (if/ and :end\nend\ndef b\n  x / y / z\nend\n", [("function", "a", 1, 5), ("function", "b", 6, 8)]),
        ("class A\n  class << self\n    def m\n      'end'\n    end\n  end\n  def o\n    split /if/\n  end\nend\n", [("function", "m", 3, 5), ("function", "o", 7, 9), ("class", "A", 1, 10)]),
        ("def a(x)\n  run(<<-ONE, <<~'TWO')\n  if #{x} then\n  ONE\n    end\n  TWO\nend\ndef b; end\n__END__\ndef no\n", [("function", "a", 1, 7), ("function", "b", 8, 8)]),
        ("def a\n  list << VALUE\n  x = ?# # end\nend\ndef b\n  1\nend\n", [("function", "a", 1, 4), ("function", "b", 5, 7)]),
    ],
)
def test_ruby(source, want):
    assert spans(extract.ruby_snippets(source)) == want


JS_LINES = ["const q = '}{'", 'let q = "{" + "\\"}"', "x = /[{}]/g.exec(y)", "// }", "/* { */", "if (a) { b() }", "for (const k of z) {\n  k()\n}", "t = `{${a + `}${b}`}`", "return x / y / z", "call({ a: 1, b: [2, { c: 3 }] })", "s.replace(/\\/{/, '{')", "y = a ? /{/ : /}/"]
RB_LINES = ['q = "end #{x} if"', "q = 'def'", "# end", "x = y / z", "list.each do |i|\n  i\nend", "if a\n  b\nend", "z = %w[end if]", "w = <<~T\n  end if #{a}\nT", "r = /end/", "t = x ? 1 : 2", "return 1 unless x", "s = :end", 'u = "#{h["end"]} #{"if #{1}"}"']


@pytest.mark.parametrize("seed", range(200))
def test_generated(seed):
    rng = random.Random(seed)
    for lines, kind, head, tail in ((JS_LINES, extract.script_snippets, "function f{}(x) {{", "}"), (RB_LINES, extract.ruby_snippets, "def f{}(x)", "end")):
        source, want = [], []
        for n in range(rng.randint(1, 6)):
            first = len(source) + 1
            source.append(head.format(n))
            for _ in range(rng.randint(0, 7)):
                source += ["  " + x if not x.startswith(("T", "=")) else x for x in rng.choice(lines).split("\n")]
            source.append(tail)
            want.append(("function", f"f{n}", first, len(source)))
        assert spans(kind("\n".join(source) + "\n")) == want, "\n".join(source)


@pytest.mark.parametrize("mask, pieces", [(mask_script, ["`${", "/", "'a", "{", "/*", "a / b\n", "`x`", "(/[", '"\\'])]
                         + [(mask_ruby, ["x <<~A\n", "/", "%w[", "'a", '"#{', "=begin\n", "a /b\n", "%(", "?a ", "<<A"])])
def test_linear_time(mask, pieces):
    for piece in pieces:
        took = []
        for n in (10_000, 40_000):
            began = time.perf_counter()
            assert len(mask(piece * n)) == len(piece) * n
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * max(took[0], 0.03), (piece, took)
