"""Languages: the registry and detection by extension, name, first line and contents; exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

#: Id, name, extensions, interpreter named in a first line, line comment, block comment.
LANGUAGES = [
    ("typescript", "TypeScript", (".ts", ".tsx", ".mts", ".cts"), None, "//", "/* */"),
    ("javascript", "JavaScript", (".js", ".jsx", ".mjs", ".cjs"), "node", "//", "/* */"),
    ("python", "Python", (".py", ".pyi", ".pyx"), "python", "#", None),
    ("java", "Java", (".java",), None, "//", "/* */"),
    ("go", "Go", (".go",), None, "//", "/* */"),
    ("rust", "Rust", (".rs",), None, "//", "/* */"),
    ("cpp", "C++", (".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh", ".h"), None, "//", "/* */"),
    ("csharp", "C#", (".cs",), None, "//", "/* */"),
    ("php", "PHP", (".php", ".phtml"), None, "//", "/* */"),
    ("ruby", "Ruby", (".rb", ".rake", ".gemspec"), "ruby", "#", None),
    ("swift", "Swift", (".swift",), None, "//", "/* */"),
    ("kotlin", "Kotlin", (".kt", ".kts"), None, "//", "/* */"),
]
#: Whole file names.
FILE_NAMES = {
    "Makefile": "cpp", "CMakeLists.txt": "cpp", "Dockerfile": "javascript", "Cargo.toml": "rust", "go.mod": "go", "package.json": "javascript",
    "composer.json": "php", "Gemfile": "ruby", "Rakefile": "ruby", "Podfile": "swift", "build.gradle": "kotlin", "pom.xml": "java",
    "requirements.txt": "python", "pyproject.toml": "python",
}
#: Language, what a line of it looks like, weight of such a line.
CONTENT_RULES = [
    ("python", r"^\s*import\s+(\w+)", 0.3), ("python", r"^\s*def\s+\w+\s*\(", 0.3), ("python", r"^\s*class\s+\w+\s*:", 0.3),
    ("java", r"^\s*public\s+class\s+\w+", 0.4), ("java", r"^\s*package\s+[\w.]+;", 0.5),
    ("go", r"^\s*package\s+\w+", 0.5), ("go", r"^\s*func\s+\w+\s*\(", 0.3),
    ("rust", r"^\s*fn\s+\w+\s*\(", 0.4), ("rust", r"^\s*use\s+[\w:]+;", 0.3), ("rust", r"^\s*struct\s+\w+", 0.3),
    ("cpp", r"^\s*#include\s+[<\"]", 0.4), ("cpp", r"^\s*using\s+namespace\s+\w+;", 0.3),
    ("csharp", r"^\s*using\s+[\w.]+;", 0.4), ("csharp", r"^\s*namespace\s+\w+", 0.3),
    ("php", r"^<\?php", 0.9),
    ("ruby", r"^\s*require\s+['\"]", 0.3), ("ruby", r"^\s*def\s+\w+", 0.3),
    ("swift", r"^\s*import\s+\w+", 0.3),
    ("kotlin", r"^\s*package\s+[\w.]+", 0.4), ("kotlin", r"^\s*fun\s+\w+\s*\(", 0.3),
    ("typescript", r"^\s*interface\s+\w+", 0.4), ("typescript", r":\s*(string|number|boolean)\b", 0.2),
]
CONTENT_LINES, CONTENT_LEAST = 50, 0.5
_registered = list(LANGUAGES)


def register_language(language: tuple) -> None:
    """(id, name, extensions, interpreter, line comment, block comment); a known id is replaced."""
    _registered[:] = [x for x in _registered if x[0] != language[0]] + [language]


def supported() -> list[str]:
    return [x[0] for x in _registered]


def registry(spark: SparkSession) -> DataFrame:
    """One row a language."""
    rows = [(i, n, list(e), s, lc, bc, f"{i}.scm") for i, n, e, s, lc, bc in _registered]
    return spark.createDataFrame(rows, "id string, name string, extensions array<string>, interpreter string, line_comment string, block_comment string, query string")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def by_extension(path: Column) -> Column:
    return _lookup(F.coalesce(paths.extension(path), F.lit("")), {e[1:]: x[0] for x in _registered for e in x[2]})


def by_name(path: Column) -> Column:
    """I8."""
    return _lookup(paths.base_name(path), FILE_NAMES)


def by_first_line(content: Column) -> Column:
    line = F.regexp_extract(F.coalesce(content, F.lit("")), r"^#!([^\n]*)", 1)
    out = F.lit(None).cast("string")
    for language in reversed(_registered):
        if language[3]:
            out = F.when(line.contains(language[3]), language[0]).otherwise(out)
    return out


def by_content(content: Column) -> Column:
    """The language of the rule that most lines times its weight speak for, the first of equals, if that is 0.5 or more.
    Rules count by themselves, not summed by language."""
    lines = F.slice(F.split(content, "\n"), 1, CONTENT_LINES)
    scored = []
    for place, (language, pattern, weight) in enumerate(CONTENT_RULES):
        hits = F.size(F.filter(lines, _liker(pattern)))
        scored.append(F.struct(F.round(hits * weight, 6).alias("score"), F.lit(-place).alias("place"), F.lit(language).alias("language")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] >= CONTENT_LEAST, best["language"])


def _liker(pattern: str):
    return lambda line: line.rlike(pattern)


def detect(path: Column, content: Column | None = None, fallback: str | None = None) -> Column:
    """(language, confidence, detected_by): by extension 0.95, by name 0.85, by first line 0.9, by contents 0.7; a
    fallback has 0.3 and counts as the extension's. Null if nothing tells."""
    tries = [(by_extension(path), 0.95, "extension"), (by_name(path), 0.85, "filename")]
    if content is not None:
        tries += [(by_first_line(content), 0.9, "shebang"), (by_content(content), 0.7, "content")]
    if fallback:
        tries.append((F.lit(fallback), 0.3, "extension"))
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("language"), F.lit(s).alias("confidence"), F.lit(h).alias("detected_by"))) for c, s, h in tries])


def is_exported(line: Column, name: Column, language: Column) -> Column:
    """I18, from a declaration's line: an export for scripts; no leading underscore for Python; for Go a first character
    that is its own upper case; public or pub where the language says so; public by default for the rest."""
    word = lambda w: line.rlike(rf"\b(?:{w})\b")
    first = F.substring(name, 1, 1)
    return (
        F.when(language.isin("javascript", "typescript"), line.rlike(r"^\s*export\b"))
        .when(language == "python", ~name.startswith("_"))
        .when(language == "go", (F.length(name) > 0) & (first == F.upper(first)))
        .when(language.isin("java", "csharp"), word("public"))
        .when(language == "rust", line.rlike(r"^\s*pub\b"))
        .when(language == "swift", word("public|open"))
        .when(language == "kotlin", ~word("private|internal|protected"))
        .when(language.isin("cpp", "php", "ruby"), F.lit(True))
        .otherwise(F.lit(False))
    )


def export_reason(exported: Column, language: Column) -> Column:
    yes = F.when(language == "go", "uppercase first letter").when(language == "python", "no underscore prefix").when(language.isin("java", "csharp"), "public modifier").when(language == "rust", "pub keyword").otherwise("exported")
    no = F.when(language == "go", "lowercase first letter").when(language == "python", "underscore prefix").when(language.isin("java", "csharp"), "no public modifier").when(language == "rust", "no pub keyword").otherwise("not exported")
    return F.when(exported, yes).otherwise(no)
