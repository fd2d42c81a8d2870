"""Ignore patterns and binary files as column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is always ignored.
DEFAULT_PATTERNS = (
    # version control
    ".git", ".svn", ".hg", ".bzr",
    # dependencies
    "node_modules", "bower_components", "vendor", "venv", ".venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".cargo",
    # build outputs
    "dist", "build", "out", "target", "bin", "obj", ".next", ".nuxt", ".output", ".vercel", ".netlify",
    # editors
    ".idea", ".vscode", ".vs", ".DS_Store", "Thumbs.db",
    # logs and temporary files
    "logs", "log", "tmp", "temp", ".cache", ".turbo",
    # generated
    ".generated", "generated", "coverage", ".nyc_output", ".coverage",
    # lock files
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum", "composer.lock",
    # binary extensions
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.webp", "*.mp4", "*.mp3", "*.wav", "*.mov", "*.pdf", "*.doc", "*.docx", "*.xls", "*.xlsx",
    "*.zip", "*.tar", "*.gz", "*.rar", "*.7z", "*.exe", "*.dll", "*.so", "*.dylib", "*.class", "*.jar", "*.war", "*.pyc", "*.pyo", "*.wasm",
    "*.bin", "*.dat",
)
#: First bytes of binary files, as hexadecimal digits.
SIGNATURES = ("FFD8FF", "89504E47", "25504446", "504B0304", "7F454C46")
SAMPLE, MOST_ODD = 8192, 0.1


def pattern_lines(text: str) -> list[str]:
    """The patterns of an ignore file: no blank lines, no comments."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def to_regex(pattern: str) -> tuple[str, bool]:
    """A pattern as an anchored regular expression over relative paths, and whether it takes back what others ignore."""
    keeps = pattern.startswith("!")
    body = pattern[1:] if keeps else pattern
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]).replace("\\-", "-"), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), keeps


class IgnorePatterns:
    """The default patterns and more; a later pattern overrules an earlier one."""

    def __init__(self, patterns: list[str] | None = None, defaults: bool = True):
        self.patterns = [*(DEFAULT_PATTERNS if defaults else ()), *(patterns or [])]

    def add(self, pattern: str) -> IgnorePatterns:
        self.patterns.append(pattern)
        return self

    def add_file(self, text: str) -> IgnorePatterns:
        self.patterns += pattern_lines(text)
        return self

    def groups(self) -> list[tuple[str, bool]]:
        """Neighbouring patterns of one kind as one alternation."""
        out: list[tuple[str, bool]] = []
        for regex, keeps in map(to_regex, self.patterns):
            if out and out[-1][1] == keeps:
                out[-1] = (out[-1][0] + "|" + regex, keeps)
            else:
                out.append((regex, keeps))
        return out

    def ignores(self, path: Column) -> Column:
        verdict = F.lit(False)
        for regex, keeps in self.groups():
            verdict = F.when(path.rlike(regex), not keeps).otherwise(verdict)
        return verdict

    def ignores_path(self, path: str) -> bool:
        verdict = False
        for regex, keeps in self.groups():
            if re.search(regex, path):
                verdict = not keeps
        return verdict


def is_binary(content: Column, sample: int = SAMPLE) -> Column:
    """S9, over bytes: a zero byte, a known first few bytes, or over a tenth of the first bytes not printable."""
    digits = F.hex(F.substring(content, 1, sample))
    n = F.length(digits) / 2
    printable = F.length(F.regexp_replace(F.regexp_replace(digits, "(..)", "$1 "), "(?:09|0[A-D]|[2-6][0-9A-F]|7[0-9A-E]) ", ""))
    odd = printable / 3
    zero = F.regexp_replace(digits, "(..)", "$1 ").contains("00 ")
    signed = digits.rlike("^(?:" + "|".join(SIGNATURES) + ")")
    return F.coalesce(zero | signed | ((n > 0) & (odd / F.greatest(n, F.lit(1)) > MOST_ODD)), F.lit(False))


def is_binary_text(text: Column, sample: int = SAMPLE) -> Column:
    """S10, over characters."""
    head = F.substring(text, 1, sample)
    odd = F.length(F.regexp_replace(head, "[\\t-\\r -~]", ""))
    return F.coalesce(head.contains("\0") | ((F.length(head) > 0) & (odd / F.greatest(F.length(head), F.lit(1)) > MOST_ODD)), F.lit(False))
