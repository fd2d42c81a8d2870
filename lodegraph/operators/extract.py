"""Symbols, imports and call sites from source text, with patterns by language.

There is no grammar here. Comments and strings are blanked, brackets are paired in one pass over the text, and what looks
like a definition is read to the end of its brackets, over as many lines as they take. In languages with braces it reaches to
the brace that closes it, else to the line before the next definition that is indented no deeper. Files go through Arrow
in batches and each is scanned once; everything after that is joins.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import edge_id, symbol_id
from ..sources.language import is_exported
from .calls import call_form, enclosing, receiver
from .iterate import first_by, reach

_MODS = r"(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|open\s+|override\s+|sealed\s+|partial\s+|pub(?:\([^)]*\))?\s+|unsafe\s+|suspend\s+|data\s+|inline\s+)*"
#: A list in round brackets, with two levels of them inside.
_PARAMS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_SCRIPT = [
    ("Function", rf"^\s*{_MODS}function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("Class", rf"^\s*{_MODS}class\s+([A-Za-z_$][\w$]*)"),
    ("Interface", rf"^\s*{_MODS}interface\s+([A-Za-z_$][\w$]*)"),
    ("Enum", rf"^\s*{_MODS}(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("TypeAlias", rf"^\s*{_MODS}type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
    ("Function", rf"^\s*{_MODS}(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:{_PARAMS}|[\w$]+)\s*(?::[^=]+)?=>"),
    ("Constructor", r"^\s+(constructor)\s*\("),
    ("Method", rf"^\s+{_MODS}(?:get\s+|set\s+|readonly\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)([A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\s*{_PARAMS}\s*(?::[^{{]+)?\{{"),
    ("Variable", rf"^{_MODS}(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
]
_BRACES = [
    ("Class", rf"^\s*{_MODS}(?:class|struct|object|record)\s+([A-Za-z_]\w*)"),
    ("Interface", rf"^\s*{_MODS}(?:interface|trait|protocol)\s+([A-Za-z_]\w*)"),
    ("Enum", rf"^\s*{_MODS}enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
    ("Namespace", r"^\s*namespace\s+([A-Za-z_][\w.:]*)"),
    ("Method", rf"^\s+{_MODS}(?:fn|func|fun|function|def)\s+([A-Za-z_]\w*)"),
    ("Function", rf"^{_MODS}(?:fn|func|fun|function|def)\s+([A-Za-z_]\w*)"),
    ("Method", rf"^\s+{_MODS}(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w<>\[\],.*&]*\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w.,\s]+)?\{{"),
    ("Function", r"^(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w<>\[\],.*&:]*\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{"),
]
#: Kind and pattern of a definition line, the name in its group; the first that matches counts.
DEFINITIONS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "python": [("Class", r"^\s*class\s+([A-Za-z_]\w*)"), ("Method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("Function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "go": [("Method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)"), ("Function", r"^func\s+([A-Za-z_]\w*)"), ("Class", r"^type\s+([A-Za-z_]\w*)\s+struct"), ("Interface", r"^type\s+([A-Za-z_]\w*)\s+interface"), ("TypeAlias", r"^type\s+([A-Za-z_]\w*)\s")],
    "ruby": [("Class", r"^\s*class\s+([A-Z]\w*)"), ("Module", r"^\s*module\s+([A-Z]\w*)"), ("Method", r"^\s+def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"), ("Function", r"^def\s+([A-Za-z_]\w*[?!]?)")],
} | {language: _BRACES for language in ("java", "rust", "cpp", "csharp", "php", "swift", "kotlin")}
#: What names a module, over the whole text: the module in one of the groups.
SCRIPT_IMPORTS = (
    r"""^[ \t]*+import\s++(?:type\s++)?(?:[\w$]++\s*+(?:,\s*+)?)?(?:\*\s*+as\s++[\w$]++\s*+|\{[^{};'"]*+\}\s*+)?from\s*+['"]([^'"\n]+)['"]"""
    r"""|^[ \t]*+export\s++(?:type\s++)?(?:\*\s*+(?:as\s++[\w$]++\s*+)?|\{[^{};'"]*+\}\s*+)from\s*+['"]([^'"\n]+)['"]"""
    r"""|^[ \t]*+import\s*+['"]([^'"\n]+)['"]|\b(?:require|import)\(\s*+['"]([^'"\n]+)['"]\s*+\)"""
)
#: What names a module on a line.
IMPORTS = {
    "python": [r"^\s*from\s+([.\w]+)\s+import\b", r"^\s*import\s+([\w.]+)"],
    "go": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$'],
    "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"],
    "kotlin": [r"^\s*import\s+([\w.]+)"],
    "swift": [r"^\s*import\s+(\w+)"],
    "csharp": [r"^\s*using\s+([\w.]+)\s*;"],
    "cpp": [r'^\s*#include\s+[<"]([^>"]+)[>"]'],
    "php": [r"^\s*use\s+([\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""],
    "ruby": [r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""],
}
CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*+)\s*+(?:\?\.)?\(")
#: Words before a bracket that call nothing.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "func", "fn", "fun", "class", "elif", "and", "or", "not", "in", "match", "sizeof", "typeof", "await", "throw", "else", "super")
#: The same, where they begin a line, and by language wherever they stand.
NO_CALLS_FIRST = ("except", "with", "assert", "foreach", "using", "lock", "unless", "until", "case", "when", "del", "raise", "yield", "import")
NO_CALLS_IN = {"python": ("lambda", "yield", "is", "import"), "kotlin": ("when", "is", "as"), "ruby": ("yield",), "csharp": ("is", "as")}

LINE_END = re.compile("\r\n|\n|\r")
_QUOTED = r"""\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"""
_NOTES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_BACKTICKS = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_TRIPLE = r"""\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)"""
#: Comments, and then strings, by language.
COVERED = {
    "javascript": (_NOTES, f"{_QUOTED}|{_BACKTICKS}"), "typescript": (_NOTES, f"{_QUOTED}|{_BACKTICKS}"),
    "python": (r"\#[^\n]*", f"{_TRIPLE}|{_QUOTED}"), "ruby": (r"\#[^\n]*|^=begin.*?(?:^=end|\Z)", _QUOTED),
    "go": (_NOTES, rf"{_QUOTED}|`[^`]*(?:`|\Z)"), "php": (rf"{_NOTES}|\#(?!\[)[^\n]*", _QUOTED),
    "rust": (_NOTES, r"""\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n']*|[^'\\\n])'"""),
}
#: Languages whose definitions end by indentation or a word.
BY_INDENT = ("python", "ruby")
#: What the header of a definition may go on with on the next line.
GOES_ON = re.compile(r"\s*(?:extends|implements|throws|where|with|[:,{])")
#: Characters of a definition's header, and of a call, that are kept and matched.
HEADER, SHOWN = 4_000, 1_000


@lru_cache(64)
def rules(language: str) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(pattern)) for kind, pattern in DEFINITIONS.get(language, [])]


@lru_cache(64)
def import_rules(language: str) -> list[re.Pattern]:
    return [re.compile(pattern) for pattern in IMPORTS.get(language, [])]


@lru_cache(64)
def covered(language: str) -> re.Pattern:
    notes, strings = COVERED.get(language, (_NOTES, _QUOTED))
    return re.compile(f"(?P<note>{notes})|(?P<string>{strings})", re.DOTALL | re.MULTILINE)


def bare(text: str, language: str, strings: bool = False) -> str:
    """The text with its comments blanked, and unless ``strings`` the insides of its strings, too; every other character and
    every line stays in its place."""

    def blank(found: re.Match) -> str:
        held = found.group()
        if found.lastgroup == "note":
            return re.sub(r"[^\n]", " ", held)
        return held if strings else held[0] + re.sub(r"[^\n]", "_", held[1:-1]) + held[-1:] * (len(held) > 1)

    return covered(language).sub(blank, text)


def brackets(code: str) -> dict[int, tuple[int, int]]:
    """For each opening bracket's place, where it is closed (the end of the text if it is not) and how many things
    separated by commas stand in it. One pass, whatever is inside what."""
    out, open_now = {}, []
    pairs = {")": "(", "]": "[", "}": "{"}
    for found in re.finditer(r"[()\[\]{},]|[^()\[\]{},\s]", code):
        mark = found.group()
        if mark in "([{":
            if open_now:
                open_now[-1][3] = True
            open_now.append([mark, found.start(), 0, False])
        elif mark in pairs:
            if open_now and open_now[-1][0] == pairs[mark]:
                _, start, commas, more = open_now.pop()
                out[start] = (found.start(), commas + more)
        elif open_now:
            if mark == ",":
                open_now[-1][2] += open_now[-1][3]
                open_now[-1][3] = False
            else:
                open_now[-1][3] = True
    for _, start, commas, more in open_now:
        out[start] = (len(code), commas + more)
    return out


def line_starts(code: str) -> list[int]:
    return [0, *(found.end() for found in re.finditer("\n", code))]


def defined(line: str, language: str) -> tuple[str, str, int] | None:
    """The kind and name that a line defines, and where the name ends."""
    for kind, pattern in rules(language):
        if found := pattern.search(line):
            return kind, found.group(1), found.end(1)
    return None


def header(code: str, start: int, stop: int, pairs: dict[int, tuple[int, int]], braces: bool) -> int:
    """Where the statement ends that begins with the line from ``start`` to ``stop``: its round brackets are closed, and lines
    that only go on with a header are taken in. It is followed for HEADER characters."""
    limit = min(len(code), start + HEADER)
    at = start
    while (at := code.find("(", at, stop)) >= 0:
        at = pairs.get(at, (at, 0))[0] + 1
        if at > stop:
            end = code.find("\n", at)
            stop = min(len(code) if end < 0 else end, limit)
    while braces and stop < limit and "{" not in code[start:stop] and ";" not in code[start:stop] and GOES_ON.match(code, stop + 1):
        end = code.find("\n", stop + 1)
        end = len(code) if end < 0 else end
        if not code[stop + 1 : end].strip():
            break
        stop = min(end, limit)
    return stop


def find_definitions(code: str, language: str, pairs: dict[int, tuple[int, int]]) -> Iterator[tuple]:
    """(kind, name, line, start, where the name ends, where the header ends)."""
    starts = line_starts(code)
    braces = language not in BY_INDENT
    for number, start in enumerate(starts, 1):
        stop = starts[number] - 1 if number < len(starts) else len(code)
        line = code[start:stop]
        if not line or line.isspace():
            continue
        found = defined(line, language)
        end = stop
        if found or "(" in line:
            end = header(code, start, stop, pairs, braces)
            if end > stop and (wide := defined(code[start:end].replace("\n", " "), language)) and wide[2] <= len(line):
                found = wide
        if found:
            yield found[0], found[1], number, start, start + found[2], end


def scan_symbols(text: str, language: str) -> list[tuple]:
    """(kind, name, line, end line, indent, place of the definition around it or -1, declaration, parameters)."""
    code = bare(LINE_END.sub("\n", text), language)
    pairs, starts = brackets(code), line_starts(code)
    braces = language not in BY_INDENT
    line_of = lambda place: bisect.bisect_right(starts, place)
    out: list[list] = []
    ends: list[int] = []  # where each definition's braces are closed
    open_now: list[int] = []  # places of definitions that may go on, each inside of the one before
    for kind, name, number, start, after, end in find_definitions(code, language, pairs):
        head = code[start:end]
        indent = len(head) - len(head.lstrip(" \t"))
        while open_now and (ends[open_now[-1]] < start if braces else out[open_now[-1]][4] >= indent):
            closed = open_now.pop()
            if not braces:
                out[closed][3] = number - 1
        first = code.find("(", after, end)
        count = pairs[first][1] if first >= 0 and first in pairs else None
        last = end
        if braces:
            begin = pairs[first][0] if first >= 0 and kind not in ("Class", "Interface", "Enum", "Namespace") else after
            body = re.compile(r"[{;]").search(code, begin, end)
            while body and body.group() == "{":
                last = pairs[body.start()][0]
                body = re.compile(r"\{").search(code, last + 1, end)  # then the braces before were a type
        out.append([kind, name, number, line_of(min(last, len(code))) if braces else len(starts), indent, open_now[-1] if open_now else -1, " ".join(head.split()), count])
        ends.append(last)
        open_now.append(len(out) - 1)
    return [tuple(row) for row in out]


def scan_imports(text: str, language: str) -> list[tuple]:
    """(import path, line)."""
    code = bare(LINE_END.sub("\n", text), language, strings=True)
    if language in ("javascript", "typescript"):
        found = re.finditer(SCRIPT_IMPORTS, code, re.MULTILINE)
        starts = line_starts(code)
        return [(next(filter(None, f.groups())), bisect.bisect_right(starts, f.start())) for f in found]
    out = []
    for number, line in enumerate(code.split("\n"), 1):
        for pattern in import_rules(language):
            if found := pattern.search(line):
                out.append((found.group(1), number))
                break
        if language == "python" and (several := re.match(r"\s*import\s+[\w.]+(?:\s+as\s+\w+)?\s*,(.*)", line)):
            out += [(name.split()[0], number) for name in several.group(1).split(",") if name.strip()]
    return out


def chain_start(code: str, start: int, chains: dict[int, int]) -> int:
    """Where the names, calls and links begin that stand before a called name; ``chains`` has the calls found, by the places
    where they are closed."""
    at = start
    while True:
        link = at
        while link and code[link - 1].isspace():
            link -= 1
        size = 1 if code.startswith(".", link - 1) else 2 if code.startswith(("->", "::"), link - 2) else 0
        if not link or not size:
            return at
        end = link - size - code.startswith("?.", link - 2)
        while end > 0 and code[end - 1].isspace():
            end -= 1
        if end > 0 and code[end - 1] == ")":
            return chains.get(end - 1, link - size)
        word = end
        while word > 0 and (code[word - 1].isalnum() or code[word - 1] in "_$"):
            word -= 1
        if word == end:
            return link - size
        at = word


def scan_calls(text: str, language: str) -> list[tuple]:
    """(line, column, call text, called name, argument count): every call, those inside of others and over several lines too.
    Names that are defined call nothing. A chain's call begins where the chain does; its text is kept for SHOWN characters."""
    whole = LINE_END.sub("\n", text)
    code = bare(whole, language)
    pairs, starts = brackets(code), line_starts(code)
    names = {after for _, _, _, _, after, _ in find_definitions(code, language, pairs)}
    never = (*NO_CALLS, *NO_CALLS_IN.get(language, ()))
    out, chains = [], {}
    for found in CALL.finditer(code):
        name, opened = found.group(1), found.end() - 1
        start = chain_start(code, found.start(), chains)
        if found.end(1) in names or (start == found.start() and name in never):
            continue
        if name in NO_CALLS_FIRST and start == found.start() and not code[max(code.rfind("\n", max(0, start - SHOWN), start) + 1, start - SHOWN) : start].strip("} \t"):
            continue
        closed, n = pairs[opened]
        chains[closed] = start
        made = re.search(r"\bnew\s+$", code[max(0, start - 16) : start])
        first = start - len(made.group()) if made else start
        line = bisect.bisect_right(starts, first)
        out.append((line, first - starts[line - 1] + 1, whole[first : min(closed + 1, first + SHOWN)], name, n))
    return out


def scanned(files: DataFrame, scan: Callable[[str, str], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """``file_path``, ``language``, ``at`` and what ``scan`` finds in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(path, language, at, *found) for path, language, text in zip(frame["path"], frame["language"], frame["content"]) if text and language for at, found in enumerate(scan(text, language))]
            made = pd.DataFrame(rows, columns=["file_path", "language", "at", *columns])
            yield made.astype({name: "Int32" for name, kind in columns.items() if kind == "int"})

    schema = "file_path string, language string, at int, " + ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return files.select("path", "language", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``content``, ``language``) as symbol nodes: ``id``, ``kind``, ``name``, ``file_path``,
    ``start_line``, ``end_line``, ``language``, ``is_exported``, ``parent_id``, ``indent``, ``declaration``,
    ``parameter_count``, ``ord``. Of equal ids in a file the first stays. Files without text give nothing.
    """
    columns = {"kind": "string", "name": "string", "start_line": "int", "end_line": "int", "indent": "int", "around": "int", "declaration": "string", "parameter_count": "int"}
    found = scanned(files, scan_symbols, columns).withColumn("id", symbol_id(F.col("kind"), F.col("file_path"), F.col("name")))
    outer = found.select("file_path", F.col("at").alias("around"), F.col("id").alias("parent_id"))
    rows = found.join(outer, ["file_path", "around"], "left")
    order = F.xxhash64("file_path").bitwiseAND(F.lit(0x7FFFFFFF)) * 1_000_000 + F.col("at")
    rows = rows.select(
        "id", "kind", "name", "file_path", "start_line", "end_line", "language", is_exported(F.col("declaration"), F.col("name"), F.col("language")).alias("is_exported"),
        "parent_id", "indent", "declaration", "parameter_count", order.alias("ord"),
    )
    return first_by(rows, ["id"], F.col("ord"))


def defines(found: DataFrame) -> DataFrame:
    """DEFINES edges from files to their symbols."""
    file = F.concat(F.lit("File:"), F.col("file_path"))
    return found.select(edge_id(file, F.col("id"), F.lit("DEFINES")).alias("id"), file.alias("source_id"), F.col("id").alias("target_id"), F.lit("DEFINES").alias("kind"), F.lit(1.0).alias("confidence"), "ord")


def imports(files: DataFrame) -> DataFrame:
    """``import_path``, ``file_path``, ``language``, ``line``, without quotes and angle brackets."""
    return scanned(files, scan_imports, {"import_path": "string", "line": "int"}).select("import_path", "file_path", "language", "line")


def call_sites(files: DataFrame, found: DataFrame) -> DataFrame:
    """Every call in the text: ``site``, ``file_path``, ``line``, ``column``, ``call_text``, ``called_name``,
    ``argument_count``, ``call_form``, ``receiver`` and ``source_id``, the innermost definition around it (else the file).
    """
    columns = {"line": "int", "column": "int", "call_text": "string", "called_name": "string", "argument_count": "int"}
    each = scanned(files, scan_calls, columns)
    spans = found.where(F.col("kind").isin("Function", "Method", "Constructor"))
    inside = enclosing(each.select("file_path", "line").distinct(), spans)
    site = F.concat_ws(":", "file_path", F.col("line").cast("string"), F.col("at").cast("string"))
    return each.join(inside, ["file_path", "line"], "left").select(
        site.alias("site"), F.coalesce("enclosing_id", F.concat(F.lit("File:"), "file_path")).alias("source_id"), "file_path", *columns,
        call_form(F.col("call_text")).alias("call_form"), receiver(F.col("call_text")).alias("receiver"),
    )


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder and File nodes for every prefix of every path, and CONTAINS edges between them."""
    each = files.select("path").distinct().select("path", F.posexplode(paths.prefixes(F.col("path"))).alias("at", "prefix"), F.size(paths.parts(F.col("path"))).alias("n"))
    each = each.where(F.col("prefix") != "").select("prefix", (F.col("at") == F.col("n") - 1).alias("is_file"), "at").groupBy("prefix").agg(F.max("is_file").alias("is_file"), F.min("at").alias("at"))
    kind = F.when(F.col("is_file"), "File").otherwise("Folder")
    nodes = each.select(F.concat(kind, F.lit(":"), "prefix").alias("id"), kind.alias("kind"), paths.base_name(F.col("prefix")).alias("name"), F.col("prefix").alias("file_path"), F.col("at").cast("long").alias("ord"))
    inner = each.where("at > 0")
    above = F.concat(F.lit("Folder:"), F.regexp_extract("prefix", r"^(.*)/[^/]*$", 1))
    below = F.concat(kind, F.lit(":"), F.col("prefix"))
    edges = inner.select(edge_id(above, below, F.lit("CONTAINS")).alias("id"), above.alias("source_id"), below.alias("target_id"), F.lit("CONTAINS").alias("kind"), F.lit(1.0).alias("confidence"))
    return nodes, edges


# --- trees: rows of file_path, node_id, parent_id, type, start_row, start_col, end_row, end_col; ids differ between files ---

#: Rows of text under which a node is known.
ROWS = 64


def tree_paths(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``ancestor``, ``node``, ``distance``, the node itself at 0."""
    down = tree.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))
    return reach(down, tree.select(F.col("node_id").alias("root")), max_depth).select(F.col("root").alias("ancestor"), "node", F.col("depth").alias("distance"))


def tree_depths(tree: DataFrame) -> DataFrame:
    """Every node's distance from its root, level by level from the roots."""
    down = tree.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))
    found = reach(down, tree.where("parent_id is null").select(F.col("node_id").alias("root")))
    return found.select(F.col("node").alias("node_id"), "depth")


def nodes_of_type(tree: DataFrame, *types: str) -> DataFrame:
    """The nodes of the types, in the order of the text."""
    return tree.where(F.col("type").isin(*types)).orderBy("start_row", "start_col", F.desc("end_row"), F.desc("end_col"))


def descends(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``node``, ``ancestor``) with ``is_descendant``; a node does not descend from itself."""
    up = tree.where("parent_id is not null").select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    above = reach(up, pairs.select(F.col("node").alias("root")).distinct()).where("depth > 0").select(F.col("root").alias("node"), F.col("node").alias("ancestor"), F.lit(True).alias("is_descendant"))
    return pairs.join(above, ["node", "ancestor"], "left").select("node", "ancestor", F.coalesce("is_descendant", F.lit(False)).alias("is_descendant"))


def children_by_field(tree: DataFrame, field: str) -> DataFrame:
    """``parent_id`` and ``node_id`` of the children that stand in a field of their parents (column ``field``), the first
    of each."""
    order = F.struct("start_row", "start_col", "node_id")
    return tree.where((F.col("field") == field) & F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.min_by("node_id", order).alias("node_id"))


def node_range(start_row: Column, start_col: Column, end_row: Column, end_col: Column) -> Column:
    """Lines from 1 and columns from 0, as ranges are shown."""
    return F.struct((start_row + 1).alias("start_line"), start_col.alias("start_column"), (end_row + 1).alias("end_line"), end_col.alias("end_column"))


def serialise(tree: DataFrame) -> DataFrame:
    """A row a node in reading order: ``node_id``, ``depth`` and ``line``, indented by two spaces a level: its type, with its text
    where it has no children (column ``text``, if there is one)."""
    leaves = tree.join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", F.lit(True).alias("leaf"))
    rows = tree.join(tree_depths(tree), "node_id").join(leaves, "node_id", "left")
    text = F.when(F.col("leaf") & F.col("text").isNotNull(), F.concat(F.lit(' "'), F.col("text"), F.lit('"'))) if "text" in tree.columns else F.lit(None).cast("string")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("type"), F.coalesce(text, F.lit("")))
    return rows.select("node_id", "depth", line.alias("line"), "start_row", "start_col", "end_row", "end_col").orderBy("start_row", "start_col", "depth").select("node_id", "depth", "line")


def nodes_at(tree: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost node that holds each point (``file_path``, ``row``, ``col``): the one that spans least. Points meet
    the nodes of their own file, by its rows: a node is known under each block of ROWS rows that it reaches into, so one
    that spans a whole file costs a row a block and no point meets nodes that are elsewhere."""
    block = lambda row: F.floor(row / ROWS)
    spans = tree.select("*", F.explode(F.sequence(block(F.col("start_row")), block(F.col("end_row")))).alias("block"))
    before = F.struct(F.col("start_row"), F.col("start_col")) <= F.struct(F.col("row").alias("start_row"), F.col("col").alias("start_col"))
    after = F.struct(F.col("row").alias("end_row"), F.col("col").alias("end_col")) <= F.struct(F.col("end_row"), F.col("end_col"))
    held = points.withColumn("block", block(F.col("row"))).join(spans, ["file_path", "block"]).where(before & after)
    order = F.struct(F.col("end_row") - F.col("start_row"), F.col("end_col") - F.col("start_col"), "node_id")
    return held.groupBy("file_path", "row", "col").agg(F.min_by("node_id", order).alias("node_id"))


def context_lines(content: Column, line: Column, around: int = 2) -> Column:
    """The text from ``around`` lines before to ``around`` lines after a line counted from 1."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(content, "\n"), first, line + around - first + 1), "\n")
