"""Symbols of source files by patterns: a table function from (path, source) to symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.text import PARSED

MAX_SOURCE_BYTES = 2 * 1024 * 1024
SCHEMA = "file_path string, language string, kind string, name string, span_start int, span_end int, line_start int, line_end int, blob_sha string, source_text string"

_BRACED = {
    "rust": [("class", r"\b(?:struct|enum|trait)\s+(\w+)"), ("function", r"\bfn\s+(\w+)"), ("const", r"\b(?:const|static)\s+(\w+)\s*:")],
    "java": [("class", r"\b(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^[ \t]+(?:[\w<>\[\],.@]+\s+)+(\w+)\s*\([^;{}]*\)[^;{}]*\{")],
    "kotlin": [("class", r"\b(?:class|interface|object)\s+(\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(")],
    "javascript": [("class", r"\bclass\s+(\w+)"), ("function", r"\bfunction\s*\*?\s+(\w+)"), ("function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>"), ("method", r"^[ \t]+(?:async\s+|static\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^;{}]*\)\s*\{")],
}
_BRACED["typescript"] = [*_BRACED["javascript"], ("class", r"\binterface\s+(\w+)")]
_PATTERNS = {lang: [(kind, re.compile(p, re.M)) for kind, p in own] for lang, own in _BRACED.items()}
_PYTHON = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", re.M)


#: How comments and strings begin, by language, in the order they are looked for.
_STARTS = {
    "rust": r"//|/\*|b?r#*\"|b?\"|b?'(?=\\|[^'\n]')",
    "java": r"//|/\*|\"\"\"|\"|'",
    "kotlin": r"//|/\*|\"\"\"|\"|'",
    "javascript": r"//|/\*|\"|'|`|(?:(?<=[=(,:;!&|?{}\[\n])|(?<=\breturn))[ \t]*/(?![*/])",
    "python": r"#|[rbfuRBFU]{0,2}(?:\"\"\"|\'\'\'|\"|')",
}
_STARTS["typescript"] = _STARTS["javascript"]
_STARTS = {language: re.compile(p) for language, p in _STARTS.items()}
_NESTED = frozenset(("rust", "kotlin"))
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_TEMPLATE_EDGE = re.compile(r"\\.|`|\$\{", re.S)
_HOLE_EDGE = re.compile(r"[{}`'\"]|//|/\*")
_REGEX_END = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*(?:/|(?=\n)|\Z)")


def _token_end(source: str, at: int, start: str, language: str) -> int:
    """Where a comment or string ends that begins with start, which ends at a place; without an end, at that of its line or of the source."""
    opened = start.lstrip(" \t")
    if opened in ("//", "#"):
        end = source.find("\n", at)
        return len(source) if end < 0 else end
    if opened == "/*":
        depth = 1
        for edge in _COMMENT_EDGE.finditer(source, at):
            if edge[0] == "*/":
                depth -= 1
                if depth == 0:
                    return edge.end()
            elif language in _NESTED:
                depth += 1
        return len(source)
    if opened == "/":
        return _REGEX_END.match(source, at).end()
    if opened == "`":
        return _template_end(source, at)
    prefix = opened.rstrip("\"'#")
    quotes = opened[len(prefix) :]
    raw = "r" in prefix.lower() and language == "rust"
    if raw or quotes == '"""' and language == "kotlin":
        close = '"' + "#" * quotes.count("#") if raw else quotes
        end = source.find(close, at)
        return len(source) if end < 0 else end + len(close)
    many = len(quotes) == 3 or language == "rust" and quotes == '"'
    end = re.compile(r"\\.|" + re.escape(quotes) + ("" if many else r"|(?=\n)"), re.S)
    for edge in end.finditer(source, at):
        if not edge[0].startswith("\\"):
            return edge.end()
    return len(source)


def _template_end(source: str, at: int) -> int:
    """The end of a template string, whose holes are code that may hold braces, strings and templates."""
    holes: list[int] = []  # open braces in each hole around
    while True:
        edge = (_HOLE_EDGE if holes else _TEMPLATE_EDGE).search(source, at)
        if edge is None:
            return len(source)
        at = edge.end()
        if not holes:
            if edge[0] == "`":
                return at
            if edge[0] == "${":
                holes.append(1)
        elif edge[0] in "{}":
            holes[-1] += 1 if edge[0] == "{" else -1
            if holes[-1] == 0:
                holes.pop()
        else:
            at = _token_end(source, at, edge[0], "javascript")


def code_alone(source: str, language: str) -> str:
    """A source with spaces for all of its comments and strings but their first character; places and lines stay."""
    starts = _STARTS[language]
    out, at = [], 0
    while True:
        m = starts.search(source, at)
        if m is None:
            return "".join([*out, source[at:]])
        first = m.end() - len(m[0].lstrip(" \t")) + 1
        end = _token_end(source, m.end(), m[0], language)
        out += [source[at:first], re.sub(r"[^\n]", " ", source[first:end])]
        at = max(end, first)


def _braced_end(source: str, at: int) -> int:
    """The end of the block that opens after a place, or of its line if none does."""
    opened = re.compile(r"[{;\n]").search(source, at)
    while opened and opened[0] == "\n" and source[opened.end() :].lstrip()[:1] in ("{", "w", ":"):
        opened = re.compile(r"[{;\n]").search(source, opened.end())
    if opened is None:
        return len(source)
    if opened[0] != "{":
        return opened.start() + (opened[0] == ";")
    depth = 0
    for brace in re.compile(r"[{}]").finditer(source, opened.start()):
        depth += 1 if brace[0] == "{" else -1
        if depth == 0:
            return brace.end()
    return len(source)


def extract(path: str, source: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) in characters; where two patterns name a span, methods and classes stay."""
    language = PARSED.get(path.rsplit(".", 1)[-1]) if path and source and "." in path else None
    found: dict[tuple[int, int, str], str] = {}
    code = code_alone(source, language) if language else ""
    if language == "python":
        for m in _PYTHON.finditer(code):
            deeper = re.compile(rf"^(?![ \t]{{{len(m[1]) + 1},}}|\s*$)", re.M)
            end = deeper.search(code, code.find("\n", m.end()) + 1) if "\n" in code[m.end() :] else None
            kind = "class" if m[2] == "class" else "method" if m[1] else "function"
            stop = len(source[: end.start()].rstrip()) if end else len(source.rstrip())
            found[(m.start(2), max(stop, m.end()), m[3])] = kind
    elif language:
        for kind, pattern in _PATTERNS[language]:
            for m in pattern.finditer(code):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                key = (start, _braced_end(code, m.end()) if not m[0].endswith("{") else _braced_end(code, m.end() - 1), m[1])
                if found.get(key) not in ("method", "class"):
                    found[key] = kind
    return [(kind, name, start, end) for (start, end, name), kind in sorted(found.items())]


def head_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (file_path, source); sources beyond 2 MiB have none, files that fail are passed over."""
    small = files.where(F.octet_length("source") <= MAX_SOURCE_BYTES).select("file_path", "source", F.sha2("source", 256).alias("blob_sha"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    found = extract(r.file_path, r.source)
                except (TypeError, ValueError, RecursionError):
                    continue
                for kind, name, start, end in found:
                    first = r.source.count("\n", 0, start) + 1
                    span = len(r.source[:start].encode()), len(r.source[:end].encode())
                    rows.append((r.file_path, PARSED[r.file_path.rsplit(".", 1)[-1]], kind, name, *span, first, first + r.source.count("\n", start, max(end - 1, start)), r.blob_sha, r.source[start:end]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return small.mapInPandas(run, SCHEMA)
