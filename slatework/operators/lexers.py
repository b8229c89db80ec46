"""What of a source is code: comments, strings and other literals blanked, every character and line in its place.

One pass over the source with an explicit stack, linear in its length. Where the language needs a parser to tell a literal
from an operator (a slash, a percent sign, two less-than signs) the token before decides, as it does for a reader.
"""

from __future__ import annotations

import re


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _hollow(text: str) -> str:
    """A literal whose ends are quotes and whose inside is blank; an end that is a part of something larger is blank too."""
    inside = _blank(text)
    first, last = text[0] in "\"'`/", text[-1] in "\"'`" or text[0] == "/"
    return ('"' if first else inside[:1]) + inside[1:-1] + ('"' if last else inside[-1:])


_JS_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|[A-Za-z_$][\w$]*+|\d[\w.]*+|\s++|.""", re.S)
_JS_BARE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|[A-Za-z_$][\w$]*+|\d[\w.]*+|\s++|.", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*+")
_JS_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*+(`|\$\{|\Z)", re.S)
#: Slashes and quotes of a line that turned out to begin no literal, after which others are not looked at.
_TRIES = 20
#: Tokens after which a slash begins a regular expression. A closing bracket or brace is none, nor a tag's less-than sign.
_JS_BEFORE = frozenset("( , = : [ ! & | ? { ; + - * % ~ ^ > return typeof case in of delete void throw new instanceof do else yield await".split()) | {""}


def mask_script(source: str) -> str:
    """JavaScript and TypeScript without comments, strings, regular expressions, and template literals with all that is nested in them; a quote stands at a literal's ends."""
    out: list[str] = []
    at, before, nested, tries = 0, "", [], 0  # nested: open braces in each template expression
    while at < len(source):
        m = (_JS_TOKEN if tries < _TRIES else _JS_BARE).match(source, at)
        token, r = m[0], None
        tries += token in ("'", '"')
        if token == "/" and before in _JS_BEFORE and tries < _TRIES:
            r = _JS_REGEX.match(source, at)
            tries += r is None
        if r:
            token, kind = r[0], "literal"
        elif token == "`" or token == "}" and nested and nested[-1] == 0:
            if token == "}":
                nested.pop()
            t = _JS_TEMPLATE.match(source, at + 1)
            token, kind = source[at : t.end()], "literal"
            if t[1] == "${":
                nested.append(0)
                kind = "open"
        elif token[0] in "\"'" and len(token) > 1:
            kind = "literal"
        elif token.startswith(("//", "/*")):
            kind = "comment"
        else:
            kind = "code"
            if nested and token in "{}":
                nested[-1] += 1 if token == "{" else -1
        literal = kind in ("literal", "open") and len(nested) == (kind == "open")
        out.append(token if kind == "code" and not nested else _hollow(token) if literal and len(token) > 1 else _blank(token))
        at += len(token)
        tries = 0 if "\n" in token else tries
        if kind == "literal":
            before = '""'
        elif kind == "open":
            before = "("
        elif kind == "code" and not token.isspace():
            before = token
    return "".join(out)


_RB_TOKEN = re.compile(r"#[^\n]*|[A-Za-z_]\w*+[?!]?|[@$]+\w+|\d[\w.]*+|\?\\?\S(?!\w)|[^\S\n]++|.", re.S)
_RB_HEREDOC = re.compile(r"""<<([~-]?)(["'`]?)([A-Za-z_]\w*)\2""")
_RB_PERCENT = re.compile(r"%([qQwWiIrsx]?)([^\w\s])")
_RB_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Words after which a value begins.
_RB_BEFORE = frozenset("if unless while until when case and or not return in then elsif else do puts yield".split())


def mask_ruby(source: str) -> str:
    """Ruby: comments, ``=begin`` parts, strings and regular expressions with what is nested in them, percent literals, heredocs, what follows ``__END__``."""
    out: list[str] = []
    at, before, spaced, tries = 0, "", True, 0
    waiting: list[tuple[str, bool]] = []  # heredocs whose text begins on the next line: (terminator, indented)
    size = len(source)
    whole, bare = {x.rstrip("\r") for x in source.split("\n")}, {x.strip() for x in source.split("\n")}

    def literal(begin: int, close: str, opener: str | None, interpolates: bool, limit: int) -> int:
        """Where a literal ends whose text begins at ``begin``, or ``limit``; braces and quotes of what is interpolated are its own."""
        i, depth, inside = begin, 0, []  # inside: open braces of each interpolation, with the mark that ends its string
        while i < limit:
            c = source[i]
            if c == "\\":
                i += 2
                continue
            if inside:
                braces, quote = inside[-1]
                if quote:
                    inside[-1] = (braces, "" if c == quote else quote)
                elif c in "\"'":
                    inside[-1] = (braces, c)
                elif c == "{":
                    inside[-1] = (braces + 1, "")
                elif c == "}":
                    if braces:
                        inside[-1] = (braces - 1, "")
                    else:
                        inside.pop()
            elif interpolates and c == "#" and source.startswith("#{", i):
                inside.append((0, ""))
                i += 1
            elif opener and c == opener:
                depth += 1
            elif c == close:
                if not depth:
                    return i + 1
                depth -= 1
            i += 1
        return limit

    while at < size:
        if at == 0 or source[at - 1] == "\n":
            tries = 0
            line_end = source.find("\n", at)
            line_end = size if line_end < 0 else line_end
            line = source[at:line_end]
            if waiting:
                name, indented = waiting[0]
                if (line.strip() if indented else line.rstrip("\r")) == name:
                    waiting.pop(0)
                out.append(_blank(source[at : line_end + 1]))
                at, before = line_end + 1, ""
                continue
            if line.startswith("=begin") and not line[6:7].isalnum():
                done = re.compile(r"^=end\b[^\n]*", re.M).search(source, line_end)
                stop = size if done is None else done.end()
                out.append(_blank(source[at:stop]))
                at = stop
                continue
            if line == "__END__":
                out.append(_blank(source[at:]))
                break
        c, stop = source[at], 0
        value = before in ("", "\n") or before in _RB_BEFORE or not (before[-1].isalnum() or before[-1] in "_?!)]}\"'@$")
        ahead = source[at + 1 : at + 2]
        begins = value or (spaced and before[:1].isalpha() and not ahead.isspace() and ahead != "=")
        if c == '"' or c == "`":
            stop = literal(at + 1, c, None, True, size)
        elif c == "'":
            stop = literal(at + 1, c, None, False, size)
        elif c == "/" and begins:
            end = source.find("\n", at)
            end = size if end < 0 else end
            closes = literal(at + 1, "/", None, True, min(end + 1, size)) if tries < _TRIES else size + 1
            stop = closes if closes <= end and source[closes - 1] == "/" else 0
            tries += not stop
        elif c == "%" and begins and (p := _RB_PERCENT.match(source, at)):
            stop = literal(p.end(), _RB_PAIRS.get(p[2], p[2]), p[2] if p[2] in _RB_PAIRS else None, p[1] in ("", "Q", "W", "I", "r", "x"), size)
        elif c == "<" and before != "class" and (h := _RB_HEREDOC.match(source, at)) and (h[1] or h[2] or h[3].isupper() and begins):
            if h[3] in (bare if h[1] else whole):
                waiting.append((h[3], bool(h[1])))
                stop = h.end()
        if stop:
            out.append(_blank(source[at:stop]))
            at, before, spaced = stop, '"', False
            continue
        m = _RB_TOKEN.match(source, at)
        token = m[0]
        out.append(_blank(token) if token[0] == "#" or token[0] == "?" and len(token) > 1 and value else token)
        if token[0] != "#":
            spaced = token.isspace()
            before = before if token.isspace() and token != "\n" else token
        at += len(token)
    return "".join(out)
