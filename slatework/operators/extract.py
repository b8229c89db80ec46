"""Snippet extraction from source files: Python by its syntax tree, JavaScript/TypeScript and Ruby by small scanners.

``extract`` runs one file per row in ``mapInPandas``; a file that cannot be parsed becomes one whole-file snippet and
says so in ``error``, so a bad file never stops a job.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from slatework.functions.text import LANGUAGES
from slatework.operators.lexers import mask_ruby, mask_script

SCHEMA = "file_path string, snippet_type string, name string, content string, start_line long, end_line long, language string, docstring string, error string"
#: Part of the memo key of incremental builds: raise it when the rules change.
VERSION = "3"


@dataclass
class Snippet:
    """One row of the extractor; lines are 1-based and inclusive."""

    snippet_type: str
    name: str
    content: str
    start_line: int
    end_line: int
    docstring: str | None = None


def _lines(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first - 1 : last])


def _begin(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _python_class(node: ast.ClassDef, lines: list[str]) -> Snippet:
    """Header, docstring and one-line method signatures; a class on one line has no body row and so no header."""
    first, body = _begin(node), node.body[0].lineno
    parts = [_lines(lines, first, body - 1)] if body > node.lineno else []
    doc = ast.get_docstring(node, clean=False)
    if doc is not None and body > node.lineno:
        parts.append(_lines(lines, node.body[0].lineno, node.body[0].end_lineno))
    methods = [f"    {lines[m.lineno - 1].strip()}" for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    if methods:
        parts.append("\n".join(["    # Methods:", *methods]))
    return Snippet("class", node.name, "\n\n".join(p for p in parts if p.strip()), first, max(first, body - 1), ast.get_docstring(node))


def python_snippets(source: str) -> list[Snippet]:
    """Top-level functions (async too, decorators included), classes with their direct methods, imports and assignments."""
    lines, out = source.split("\n"), []
    kinds = ast.FunctionDef | ast.AsyncFunctionDef
    for node in ast.parse(source).body:
        last = node.end_lineno or node.lineno
        if isinstance(node, kinds):
            out.append(Snippet("function", node.name, _lines(lines, _begin(node), last), _begin(node), last, ast.get_docstring(node)))
        elif isinstance(node, ast.ClassDef):
            for m in node.body:
                if isinstance(m, kinds):
                    out.append(Snippet("function", m.name, _lines(lines, _begin(m), m.end_lineno), _begin(m), m.end_lineno, ast.get_docstring(m)))
            out.append(_python_class(node, lines))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            name = "" if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
            out.append(Snippet("import", name, _lines(lines, node.lineno, last), node.lineno, last))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            out.append(Snippet("module_constant", ast.get_source_segment(source, target) or "", _lines(lines, node.lineno, last), node.lineno, last))
    return out


def python_all_functions(source: str) -> list[Snippet]:
    """The older rules: every plain ``def`` at any depth without decorators, compact classes, every import, module-level constants."""
    lines, tree, out = source.split("\n"), ast.parse(source), []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            out.append(Snippet("function", node.name, _lines(lines, node.lineno, node.end_lineno), node.lineno, node.end_lineno, ast.get_docstring(node)))
        elif isinstance(node, ast.ClassDef):
            out.append(_python_class(node, lines))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            name = ", ".join(a.name for a in node.names) if isinstance(node, ast.Import) else node.module or ""
            out.append(Snippet("import", name, _lines(lines, node.lineno, node.end_lineno), node.lineno, node.end_lineno))
    for node in tree.body:
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            out.append(Snippet("module_constant", node.targets[0].id, _lines(lines, node.lineno, node.end_lineno), node.lineno, node.end_lineno))
    return out


def _close(masked: str, at: int) -> int:
    """Where the bracket at ``at`` is closed, or the end."""
    depth = 0
    for i in range(at, len(masked)):
        depth += (masked[i] in "{([") - (masked[i] in "})]")
        if depth == 0:
            return i
    return len(masked) - 1


_CONTINUES = re.compile(r"\s*[.?:+*/&|,=]")


def _statement_end(masked: str, at: int) -> int:
    """End of a statement: a semicolon, or a line end outside brackets that no operator continues."""
    i = at
    while i < len(masked):
        c = masked[i]
        if c in "{([":
            i = _close(masked, i)
        elif c == ";":
            return i
        elif c == "\n":
            last = i
            while last > at and masked[last - 1].isspace():
                last -= 1
            goes_on = masked[max(at, last - 2) : last].endswith(("=", ",", "=>", "+", "&&", "||", "?", ":", "("))
            if not goes_on and not _CONTINUES.match(masked, i):
                return i - 1
        i += 1
    return len(masked) - 1


_JS_TOP = re.compile(
    r"(?P<export>export\s+(?:default\s+)?)?(?:(?P<async>async\s+)?function\b\s*\*?\s*(?P<fn>[\w$]*)|(?:abstract\s+)?(?P<kls>class)\b(?:\s+(?!extends\b|implements\b)(?P<cls>[\w$]+))?|(?P<imp>import)\b(?!\s*\()|(?P<var>const|let|var)\s)"
)
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^>{(]*>)?\s*\(")
_JS_NOT = {"if", "for", "while", "switch", "catch", "return", "function"}


def script_snippets(source: str) -> list[Snippet]:
    """Top-level functions, classes with their methods, imports (no name) and declarations; arrow functions are functions."""
    masked, out = mask_script(source), []
    lines = source.split("\n")
    breaks = [i for i, c in enumerate(source) if c == "\n"]
    line_of = lambda at: bisect_left(breaks, at) + 1
    whole = lambda a, b: source[a : b + 1]
    at = 0
    while at < len(masked):
        m = _JS_TOP.match(masked, at)
        if not m:
            at = _close(masked, at) + 1 if masked[at] in "{([" else at + 1
            while at < len(masked) and (masked[at - 1].isalnum() or masked[at - 1] in "_$.") and (masked[at].isalnum() or masked[at] in "_$"):
                at += 1
            continue
        begin = m.start()
        if m["imp"]:
            # The module's string is blanked in the mask; the statement ends at its line's end or semicolon.
            end = _statement_end(masked, m.end())
            out.append(Snippet("import", "", whole(begin, end), line_of(begin), line_of(end)))
        elif m["kls"]:
            open_ = masked.find("{", m.end())
            end = _close(masked, open_) if open_ >= 0 else len(masked) - 1
            own = begin + len(m["export"] or "")
            signatures = []
            i = open_ + 1
            while 0 < i < end:
                mm = _JS_METHOD.match(masked, i)
                if mm and mm["name"] not in _JS_NOT:
                    body = masked.find("{", _close(masked, mm.end() - 1))
                    if 0 <= body < end and re.fullmatch(r"\s*(?::[^{;=]*)?", masked[_close(masked, mm.end() - 1) + 1 : body]):
                        stop = _close(masked, body)
                        first = mm.start() + len(mm[0]) - len(mm[0].lstrip())  # the name, if the match begins with the blanks before it
                        out.append(Snippet("function", mm["name"], whole(first, stop), line_of(first), line_of(stop)))
                        signatures.append("  " + lines[line_of(first) - 1].strip())
                        i = stop + 1
                        continue
                if masked[i] in "{([":
                    i = _close(masked, i)
                i += 1
                while i < end and (masked[i - 1].isalnum() or masked[i - 1] in "_$") and (masked[i].isalnum() or masked[i] in "_$"):
                    i += 1
            head = _lines(lines, line_of(own), line_of(max(open_, own)))
            content = "\n\n".join([head, *(["\n".join(["  // Methods:", *signatures])] if signatures else [])])
            out.append(Snippet("class", m["cls"] or "default", content, line_of(own), line_of(end)))
        elif m["var"]:
            end = _statement_end(masked, m.end())
            body = masked[m.end() : end + 1]
            depth, pieces, last = 0, [], 0
            for i, c in enumerate(body):
                depth += (c in "{([") - (c in "})]")
                if c == "," and depth == 0:
                    pieces.append(body[last:i])
                    last = i + 1
            for piece in [*pieces, body[last:]]:
                name = re.match(r"\s*([\w$]+)", piece)
                if name:
                    arrow = re.match(r"[^=]*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", piece) or re.match(r"[^=]*=\s*(?:async\s*)?\(.*?\)\s*(?::[^=]+)?=>", piece, re.S)
                    out.append(Snippet("function" if arrow else "module_constant", name[1], whole(begin, end), line_of(begin), line_of(end)))
        else:
            open_ = masked.find("{", _close(masked, masked.find("(", m.end())))
            end = _close(masked, open_) if open_ >= 0 else len(masked) - 1
            out.append(Snippet("function", m["fn"] or "default", whole(begin, end), line_of(begin), line_of(end)))
        at = end + 1
    return out


_RUBY_LEAD = re.compile(r"\s*(?:(?:private|public|protected|module_function|private_class_method)\s+)?(class|module|def|if|unless|case|while|until|for|begin)\b(?!\s*:)")
_RUBY_ENDLESS = re.compile(r"\s*(?:\w+\s+)?def\s+[\w.?!]+(?:\s*\([^)]*\))?\s*=\s")
_RUBY_VALUE = re.compile(r"(?:=|\breturn|\()\s*(?:if|unless|case|begin|while|until)\b")
_RUBY_DO = re.compile(r"\bdo\b(?=\s*(?:\|[^|]*\|)|\s*$|\s*;)")
_RUBY_CLOSE = re.compile(r"(?<![.:@$\w])end\b(?![?!:\w])")


def _ruby_depth(code: str) -> tuple[int, int]:
    """Blocks that a line opens and closes."""
    lead = _RUBY_LEAD.match(code)
    opens = 0 if _RUBY_ENDLESS.match(code) else int(bool(lead))
    opens += len(_RUBY_VALUE.findall(code))
    if not (lead and lead[1] in ("while", "until", "for")):  # their do is theirs
        opens += len(_RUBY_DO.findall(code))
    return opens, len(_RUBY_CLOSE.findall(code))


def _ruby_end(lines: list[str], at: int, stop: int) -> int:
    """Line (0-based) of the ``end`` that closes the block opened at ``at``; the lines are code alone."""
    depth = 0
    for i in range(at, stop):
        opens, closes = _ruby_depth(lines[i])
        depth += opens - closes
        if depth <= 0:
            return i
    return stop - 1


def ruby_snippets(source: str) -> list[Snippet]:
    """Methods, classes and modules with their methods, classes directly in a module, requires, capitalised assignments."""
    lines, coded, out = source.split("\n"), [x.rstrip() for x in mask_ruby(source).split("\n")], []

    def body(first: int, last: int, nested: bool) -> list[str]:
        signatures, i = [], first
        while i < last:
            code = coded[i]
            m = re.match(r"\s*(?:(?:private|public|protected|module_function|private_class_method)\s+)?def\s+(?:self\.)?([\w?!=]+)", code)
            k = re.match(r"\s*class\s+([A-Z]\w*)", code)
            end = _ruby_end(coded, i, last)
            if m:
                out.append(Snippet("function", m[1], _lines(lines, i + 1, end + 1), i + 1, end + 1))
                signatures.append("  " + lines[i].strip())
            elif k and nested:
                group(i, end, k[1], False)
            elif re.match(r"\s*class\s*<<", code):  # methods of the class itself
                signatures += body(i + 1, end, False)
            i = max(end, i) + 1 if _ruby_depth(code)[0] else i + 1
        return signatures

    def group(first: int, last: int, name: str, nested: bool) -> None:
        signatures = body(first + 1, last, nested)
        parts = [lines[first], *(["\n".join(["  # Methods:", *signatures])] if signatures else [])]
        out.append(Snippet("class", name, "\n\n".join(parts), first + 1, last + 1))

    i = 0
    while i < len(lines):
        code = coded[i]
        end = i
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)", code):
            end = _ruby_end(coded, i, len(lines))
            group(i, end, m[2], m[1] == "module")
        elif m := re.match(r"def\s+(?:self\.)?([\w?!=]+)", code):
            end = _ruby_end(coded, i, len(lines))
            out.append(Snippet("function", m[1], _lines(lines, i + 1, end + 1), i + 1, end + 1))
        elif m := re.match(r"(require|require_relative|include)\b", code):
            out.append(Snippet("import", m[1], lines[i], i + 1, i + 1))
        elif m := re.match(r"([A-Z]\w*)\s*=[^=~]", code):
            out.append(Snippet("module_constant", m[1], lines[i], i + 1, i + 1))
        elif _ruby_depth(code)[0]:
            end = _ruby_end(coded, i, len(lines))
        i = end + 1
    return out


def whole_file(path: str, source: str) -> Snippet:
    """The fallback: one snippet named by the file's stem."""
    return Snippet("file", re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), source, 1, len(source.split("\n")))


def snippets_of(path: str, source: str, language: str | None = None, nested: bool = False) -> tuple[list[Snippet], str, str | None]:
    """(snippets, language, error) of one file; never empty for a file with content."""
    suffix = re.search(r"\.[^./]+$", path.lower())
    language = language or LANGUAGES.get(suffix[0] if suffix else "", "text")
    try:
        if language == "python":
            found = python_all_functions(source) if nested else python_snippets(source)
        elif language in ("javascript", "typescript", "jsx", "tsx"):
            found = script_snippets(source)
        elif language == "ruby":
            found = ruby_snippets(source)
        else:
            found = []
        return found or [whole_file(path, source)], language, None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [whole_file(path, source)], language, f"{type(e).__name__}: {e}"[:500]


def extract(files: DataFrame, path: str = "relative_path", content: str = "content", nested: bool = False) -> DataFrame:
    """Snippet rows (SCHEMA) of text files; snippets without content are left out, null contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for p, source in zip(batch[path], batch[content]):
                if source is None or not source.strip():
                    continue
                found, language, error = snippets_of(p, source, nested=nested)
                rows += [(p, s.snippet_type, s.name, s.content, s.start_line, s.end_line, language, s.docstring, error) for s in found if s.content.strip()]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(path, content).mapInPandas(run, SCHEMA)
