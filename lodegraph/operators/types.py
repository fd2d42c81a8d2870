"""Types of variables: what the text declares or constructs, and what follows from it across files.

A binding says where a variable's type comes from; members say what types fields and calls have. Bindings whose base is
known are looked up round by round, for all files at once, until a round finds nothing.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import LINE_END, bare, scan_symbols, scanned
from .iterate import cut

#: Languages that write a type after a name and a colon, and before a name.
AFTER_COLON = ("typescript", "python", "kotlin", "swift", "rust")
BEFORE_NAME = ("java", "csharp", "cpp", "php")
#: Languages that construct by calling the class.
BY_CALL = ("python", "kotlin", "swift")
_TYPE = r"([A-Z]\w*)(?:<[^<>]*>)?"
_ANNOTATED = re.compile(rf"(?<![\w$.])([A-Za-z_$][\w$]*+)\??[ \t]*+:[ \t]*+(?:&[ \t]*+(?:mut[ \t]++)?)?{_TYPE}")
_TYPED = re.compile(rf"(?<![\w$.]){_TYPE}(?:[ \t]*[*&][ \t]*|[ \t]++)\$?([A-Za-z_]\w*+)[ \t]*+(?=[=;,)])")
_GO_VAR = re.compile(r"\bvar[ \t]++([A-Za-z_]\w*+)[ \t]++\*?([A-Z]\w*)")
_MADE = re.compile(
    r"(?<![\w$.>])\$?([A-Za-z_$][\w$]*+)[ \t]*+(?::[ \t]*+[^=\n(){};]{1,80})?(?::=|=)(?![=>])[ \t]*+(?:await[ \t]++)?(?P<new>new[ \t]++|&)?"
    r"(?:\$?([A-Za-z_$][\w$]*+)[ \t]*+(\?\.|\.|->|::)[ \t]*+)?([A-Za-z_$][\w$]*+)[ \t]*+(?P<next>[({]|[;,)\n]|\Z)"
)
_RETURNS = {
    "typescript": rf"\)\s*:\s*(?:Promise<\s*)?{_TYPE}", "python": rf"\)\s*->\s*{_TYPE}", "kotlin": rf"\)\s*:\s*{_TYPE}", "swift": rf"\)\s*(?:async\s*)?(?:throws\s*)?->\s*{_TYPE}",
    "rust": rf"\)\s*->\s*(?:&\s*)?(?:Option<|Result<)?{_TYPE}", "go": rf"\)\s*\(?\*?{_TYPE}", "php": rf"\)\s*:\s*\??{_TYPE}",
}
_FIELD = re.compile(rf"\s*(?:(?:public|private|protected|readonly|static|final|internal|var|val|let|pub|override|abstract)\s+)*([A-Za-z_$][\w$]*)[?!]?\s*:\s*{_TYPE}")
_TYPED_FIELD = re.compile(rf"\s*(?:(?:public|private|protected|readonly|static|final|internal)\s+)*\??{_TYPE}\s+\$?([A-Za-z_]\w*)\s*[=;]")
_GO_FIELD = re.compile(r"\s*([A-Za-z_]\w*)\s+\*?([A-Z]\w*)\s*(?:`|$)")
_SELF = re.compile(r"\b(?:self|this)\.([A-Za-z_]\w*+)\s*+(?::\s*+([A-Z]\w*)|=\s*+(?:new\s++)?([A-Z]\w*)\()")


def scan_bindings(text: str, language: str) -> list[tuple]:
    """(variable, how, base, member, type, place): ``how`` is ``declared`` and ``constructed`` (with a type), ``called`` (a
    function), ``member`` (a method or field of ``base``) or ``alias`` (of ``base``)."""
    code = bare(LINE_END.sub("\n", text), language)
    out = []
    if language in AFTER_COLON:
        out += [(f.group(1), "declared", None, None, f.group(2), f.start()) for f in _ANNOTATED.finditer(code)]
    if language in BEFORE_NAME:
        out += [(f.group(2), "declared", None, None, f.group(1), f.start()) for f in _TYPED.finditer(code)]
    if language == "go":
        out += [(f.group(1), "declared", None, None, f.group(2), f.start()) for f in _GO_VAR.finditer(code)]
    for f in _MADE.finditer(code):
        var, base, link, name, follows = f.group(1), f.group(3), f.group(4), f.group(5), f.group("next")
        called = follows == "("
        if f.group("new") and not base or (not base and name[0].isupper() and (called and language in BY_CALL or follows == "{" and language in ("go", "rust"))):
            out.append((var, "constructed", None, None, name, f.start()))
        elif base and base[0].isupper() and called and name == "new":
            out.append((var, "constructed", None, None, base, f.start()))
        elif base and follows != "{":
            out.append((var, "member", base, name, None, f.start()))
        elif called:
            out.append((var, "called", None, name, None, f.start()))
        elif not base and follows != "{" and name not in ("null", "None", "nil", "true", "false", "True", "False", "undefined"):
            out.append((var, "alias", name, None, None, f.start()))
    return out


def scan_members(text: str, language: str) -> list[tuple]:
    """(owner, member, type): what the methods and fields of classes give, and with an empty owner what functions return."""
    text = LINE_END.sub("\n", text)
    found = scan_symbols(text, language)
    out = []
    for kind, name, _, _, _, around, declaration, _ in found:
        if kind not in ("Function", "Method"):
            continue
        if language in ("java", "csharp", "cpp"):
            told = re.search(rf"{_TYPE}\s+[*&]?{re.escape(name)}\s*\(", declaration)
        else:
            pattern = _RETURNS.get(language)
            told = re.search(rf"\b{re.escape(name)}\b.*?" + pattern, declaration) if pattern else None
        owner = re.match(r"func\s+\(\s*\w*\s*\*?([A-Za-z_]\w*)", declaration) if language == "go" else None
        holder = owner.group(1) if owner else found[around][1] if around >= 0 and found[around][0] in ("Class", "Interface") else ""
        if told:
            out.append((holder, name, told.group(1)))
    classes = sorted((row[2], row[3], row[1]) for row in found if row[0] in ("Class", "Interface"))
    code = bare(text, language)
    lines, first = code.split("\n"), [c[0] for c in classes]
    defined_on = {row[2] for row in found}
    inside = sorted((row[2], row[3]) for row in found if row[0] in ("Method", "Constructor", "Function"))
    begun = [span[0] for span in inside]
    for number, line in enumerate(lines, 1):
        at = bisect.bisect_right(first, number) - 1
        if at < 0 or number > classes[at][1] or number in defined_on:
            continue
        for own in _SELF.finditer(line):
            out.append((classes[at][2], own.group(1), own.group(2) or own.group(3)))
        method = bisect.bisect_right(begun, number) - 1
        if method >= 0 and inside[method][1] >= number:
            continue
        pattern, type_first = (_GO_FIELD, False) if language == "go" else (_TYPED_FIELD, True) if language in BEFORE_NAME else (_FIELD, False)
        if field := pattern.match(line):
            out.append((classes[at][2], field.group(2 if type_first else 1), field.group(1 if type_first else 2)))
    return out


def bindings(files: DataFrame) -> DataFrame:
    """``file_path``, ``ord`` and the columns of :func:`scan_bindings`."""
    columns = {"var": "string", "how": "string", "base": "string", "member": "string", "type": "string", "place": "int"}
    return scanned(files, scan_bindings, columns).select("file_path", F.col("place").cast("long").alias("ord"), "var", "how", "base", "member", "type")


def members(files: DataFrame) -> DataFrame:
    """``owner``, ``member``, ``type`` over all files; of several types of a member the least."""
    found = scanned(files, scan_members, {"owner": "string", "member": "string", "type": "string"})
    return found.groupBy("owner", "member").agg(F.min("type").alias("type"))


def propagate(bound: DataFrame, known: DataFrame) -> DataFrame:
    """``file_path``, ``var`` and ``type``, for the types that bindings have or that follow from them.

    ``bound`` has ``file_path``, ``ord``, ``var``, ``how``, ``base``, ``member`` and ``type``; ``known`` has ``owner``,
    ``member`` and ``type``. A variable takes its type in the round that first knows one, of several from the binding with the
    least ``ord``, and keeps it: circles of bindings end, however long a chain is. Parents' members are to be among
    ``known``. A round costs two joins; only whether it found something comes to the driver.
    """
    order = F.struct("ord", "type")
    least = lambda rows: rows.groupBy("file_path", "var").agg(F.min(order)["type"].alias("type"))
    functions = known.where("owner = ''").select("member", F.col("type").alias("type"))
    called = bound.where("how = 'called'").select("file_path", "ord", "var", "member").join(functions, "member").select("file_path", "ord", "var", "type")
    told = bound.where("type is not null").select("file_path", "ord", "var", "type").unionByName(called)
    fresh = cut(least(told))
    waiting = cut(bound.where("type is null and how in ('member', 'alias')").select("file_path", "ord", "var", "how", "base", "member").join(fresh.select("file_path", "var"), ["file_path", "var"], "left_anti"))
    out = fresh
    owned = known.where("owner <> ''").select(F.col("owner").alias("base_type"), "member", "type")
    while not fresh.isEmpty():
        base = fresh.select("file_path", F.col("var").alias("base"), F.col("type").alias("base_type"))
        asked = waiting.join(base, ["file_path", "base"])
        alias = asked.where("how = 'alias'").select("file_path", "ord", "var", F.col("base_type").alias("type"))
        member = asked.where("how = 'member'").join(owned, ["base_type", "member"]).select("file_path", "ord", "var", "type")
        fresh = cut(least(alias.unionByName(member)))
        waiting = cut(waiting.join(fresh.select("file_path", "var"), ["file_path", "var"], "left_anti"))
        out = out.unionByName(fresh)
    return out


def inherited(known: DataFrame, parents: DataFrame) -> DataFrame:
    """``known`` with what classes have from those above: ``parents`` has ``name`` and ``above``, and ``distance``; the
    nearest counts, a class's own members first."""
    own = known.select("owner", "member", "type", F.lit(0).alias("distance"))
    more = known.join(parents.select(F.col("above").alias("owner"), "name", "distance"), "owner").select(F.col("name").alias("owner"), "member", "type", "distance")
    return own.unionByName(more).groupBy("owner", "member").agg(F.min(F.struct("distance", "type"))["type"].alias("type"))


def type_env(files: DataFrame) -> DataFrame:
    """The types of the variables in ``files`` (``path``, ``content``, ``language``), as J11 takes them."""
    return propagate(cut(bindings(files)), cut(members(files)))
