"""Text expressions: analysis, identifier splitting, previews, imports and calls. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a run of letters, digits and underscores, in any script.
TERM = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.]*"
_PARTS = r"[._]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

#: Names that look like calls but are not worth an edge.
CALL_STOPLIST = ("if", "for", "while", "return", "assert", "print", "len", "range", "int", "str", "list", "dict", "set")

#: File suffixes that are indexed, and their languages.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "jsx",
    ".tsx": "tsx",
    ".rb": "ruby",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".go": "go",
    ".rs": "rust",
}
SCRIPT_LANGUAGES = ("javascript", "typescript", "jsx", "tsx")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased terms of a text in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def sanitise(query: Column) -> Column:
    """Everything but terms becomes one space; blank queries become empty."""
    return F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_]+", " "))


def query_terms(query: Column) -> Column:
    """Distinct terms of a query in order of first use."""
    return F.array_distinct(terms(query))


def count_term(terms_: Column, term: Column | str) -> Column:
    """How often a term stands in an array of terms."""
    wanted = F.lit(term) if isinstance(term, str) else term
    return F.size(F.filter(terms_, lambda t: t == wanted))


def term_counts(text: Column) -> Column:
    """Distinct terms of a text with their counts, as an array of structs: sorted and cut into runs, within the row."""

    def runs(held: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(held)), lambda i: (i == 0) | (i == F.size(held)) | (F.get(held, i) != F.get(held, i - 1)))
        cut = lambda at: F.transform(at, lambda b, i: F.struct(F.get(held, b).alias("term"), (F.get(at, i + 1) - b).cast("long").alias("tf")))
        return F.filter(let(begins, cut), lambda r: r["term"].isNotNull())

    return let(F.array_sort(terms(text)), runs)


def identifier_parts(text: Column) -> Column:
    """Parts of the distinct compound identifiers of a text, lower-cased, in order.

    Identifiers under three characters and case-insensitive repeats are skipped. Repeats are found by
    sorting, so the cost stays near linear in the text.
    """
    names = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda x: F.length(x) >= 3)
    keyed = F.array_sort(F.transform(names, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("name"))))
    firsts = let(keyed, lambda held: F.filter(held, lambda s, i: (i == 0) | (F.get(held, i - 1)["low"] != s["low"])))
    ordered = F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["name"].alias("name"))))
    split = F.transform(ordered, lambda s: F.array_remove(F.transform(F.split(s["name"], _PARTS), F.lower), ""))
    return F.flatten(F.filter(split, lambda p: F.size(p) > 1))


def with_identifier_parts(text: Column) -> Column:
    """The text, and its identifier parts on a line below if there are any."""
    return let(identifier_parts(text), lambda parts: F.when(F.size(parts) > 0, F.concat(text, F.lit("\n"), F.array_join(parts, " "))).otherwise(text))


def preview(content: Column, width: int = 150) -> Column:
    """The first characters, line breaks indented, dots where the text goes on."""
    cut = F.regexp_replace(F.substring(content, 1, width), "\n", "\n    ")
    return F.when(F.length(content) > width, F.concat(cut, F.lit("..."))).otherwise(cut)


def truncate(content: Column, width: int = 4000) -> Column:
    """What is embedded of a long text."""
    return F.substring(content, 1, width)


def is_blank(content: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(content, F.lit("")).rlike(r"\S")


def language_of(path: Column) -> Column:
    """Language by suffix, null for others."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def stem_of(path: Column) -> Column:
    """File name without directories and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def short_commit(sha: Column) -> Column:
    """Eight characters, or never."""
    return F.coalesce(F.substring(sha, 1, 8), F.lit("never"))


def iso_time(at: Column) -> Column:
    """A time as ISO text, to the microsecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def first_line(text: Column, width: int) -> Column:
    """The first line, cut."""
    return F.substring(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1), 1, width)


def imports(content: Column, language: Column) -> Column:
    """Distinct modules that a snippet imports, sorted; one per line and form."""
    python = F.concat(
        F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*import[ \t]+([\w.]+)"), F.lit(1)),
        F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import"), F.lit(1)),
    )
    script = F.regexp_extract_all(content, F.lit(r"""import[ \t]+[^\n]*from[ \t]+['"]([^'"\n]+)['"]"""), F.lit(1))
    found = F.when(language == "python", python).when(language.isin(*SCRIPT_LANGUAGES), script)
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def imported_names(content: Column, language: Column) -> Column:
    """module.name of every name that Python's ``from module import`` asks for: such a name may be a module itself."""
    pattern = F.lit(r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+\(?([\w, \t]+)")
    modules, names = (F.regexp_extract_all(content, pattern, F.lit(i)) for i in (1, 2))
    full = lambda m, some: F.transform(F.split(some, ","), lambda n: F.concat(m, F.lit("."), F.regexp_extract(n, r"\w+", 0)))
    found = F.when(language == "python", F.flatten(F.zip_with(modules, names, full)))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def calls(content: Column, language: Column, own_name: Column | None = None, literal: bool = False) -> Column:
    """Distinct names that a snippet calls, sorted, comment lines and the stoplist left out.

    ``literal``: only names after a blank, a dot or the line's start count, and the definition line's own name does.
    Otherwise nested calls count too, and ``own_name`` on a definition line does not.
    """
    lines = F.filter(F.split(content, "\n"), lambda x: ~F.trim(x).rlike(r"^(#|//)"))
    if not literal:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, r"\b(def|function|class)[ \t]+[A-Za-z_$][A-Za-z0-9_$]*[ \t]*\(", "("))
        if own_name is not None:  # a method's definition has no keyword: its name before the first bracket of the first line
            method = F.concat(F.lit(r"^[^(]*\Q"), F.coalesce(own_name, F.lit("")), F.lit(r"\E[ \t]*\("))
            lines = F.transform(lines, lambda x, i: F.when(i == 0, F.regexp_replace(x, method, F.lit("("))).otherwise(x))
        pattern = r"(?<![A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*\("
    else:
        pattern = r"(?:^|\s|\.)\s*([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))
    found = F.when(language.isin("python", *SCRIPT_LANGUAGES), found).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in CALL_STOPLIST]))))


def dollars(amount: Column) -> Column:
    """$1,234 from a thousand on, else $12.34."""
    return F.when(amount >= 1000, F.format_string("$%,.0f", amount.cast("double"))).otherwise(F.format_string("$%,.2f", amount.cast("double")))


def human_count(n: Column) -> Column:
    """12.3K, 4.5M, or the number."""
    million, thousand = F.format_string("%.1fM", F.round(n / 1e6, 1)), F.format_string("%.1fK", F.round(n / 1e3, 1))
    return F.when(n >= 1_000_000, million).when(n >= 1_000, thousand).otherwise(n.cast("long").cast("string"))
