"""Scalar functions over diffs, paths and text, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_LINES = 80


#: Where Latin letters with marks are, and the marks that may follow a letter.
LATIN, MARKS = (range(0xC0, 0x250), range(0x1E00, 0x1F00)), "".join(map(chr, range(0x300, 0x332)))


def _accents() -> tuple[str, str]:
    """Latin letters with one mark and the letters they fold to, by Unicode decomposition; a capital sigma."""
    pairs = [("\u03a3", "\u03c3")]  # or its lower case would depend on what follows
    for code in (c for part in LATIN for c in part):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) == 2 and plain[0].isascii():
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
_FOLDS = str.maketrans(ACCENTED, PLAIN, MARKS)
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case, Latin letters without diacritics, no combining marks; what has no plain letter in place is deleted."""
    plain = F.octet_length(text) == F.length(text)  # only ASCII, which has nothing to translate
    return F.lower(F.when(plain, text).otherwise(F.translate(text, ACCENTED + MARKS, PLAIN)))


def fold_word(word: str) -> tuple[str, ...]:
    """The tokens of a word of a query, as tokens() has them."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in word.translate(_FOLDS).lower())
    return tuple(kept.split())


def tokens(text: Column) -> Column:
    """Full-text tokens: maximal runs of letters, numbers and private-use characters, folded."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), "")  # compiled, which a lambda is not


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing newline starts no line."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def count_lines(text: Column) -> Column:
    return F.size(lines(text))


def truncate_diff(text: Column, most: int = EXCERPT_LINES) -> tuple[Column, Column]:
    """The first lines of a diff with a note on how many are left out, and whether any are."""
    text = F.coalesce(text, F.lit(""))
    n = count_lines(text)
    cut = F.concat(F.array_join(F.slice(lines(text), 1, most), "\n"), F.lit("\n... ("), (n - most).cast("string"), F.lit(" more lines)\n"))
    return F.when(n > most, cut).otherwise(text), n > most


def added_lines(diff: Column) -> Column:
    """What a diff adds: its + lines without the sign, file headers left out."""
    kept = F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 2147483647)), "\n")


def added_line_count(diff: Column) -> Column:
    return F.size(F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++")))


def semantic_text(message: Column, diff: Column, first_symbol: Column | None = None) -> Column:
    """What is embedded for a hunk: its first symbol, if any, the message and the diff."""
    body = F.concat(message, F.lit("\n\n"), diff)
    return body if first_symbol is None else F.when(first_symbol.isNotNull(), F.concat(first_symbol, F.lit("\n"), body)).otherwise(body)


def sectioned_text(message: Column, path: Column, language: Column, symbols: Column, change: Column, diff: Column) -> Column:
    """The sectioned form of a hunk; sections without content are left out.  symbols: array of names."""

    def section(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(name), value))

    first = F.element_at(F.split(F.coalesce(message, F.lit("")), "\n"), 1)
    return F.concat_ws(
        "\n",
        section("commit: ", first),
        F.concat(F.lit("file: "), path),
        F.when(language.isNotNull(), F.concat(F.lit("language: "), language)),
        section("symbols: ", F.array_join(symbols, ", ")),
        F.concat(F.lit("change: "), change),
        section("added_lines:\n", added_lines(diff)),
    )


def post_image_ranges(diff: Column) -> Column:
    """(start, count) of the new side of each @@ header; a count left out is 1, zeros are passed over."""
    headers = F.filter(lines(diff), lambda x: x.rlike(r"^@@\s*\S+\s+\+"))
    found = F.transform(
        headers,
        lambda x: F.struct(
            F.coalesce(F.regexp_extract(x, r"^@@\s*\S+\s+\+(\d+)", 1).try_cast("int"), F.lit(0)).alias("start"),
            F.when(x.rlike(r"^@@\s*\S+\s+\+\d+,"), F.coalesce(F.regexp_extract(x, r"^@@\s*\S+\s+\+\d+,(\d+)", 1).try_cast("int"), F.lit(0))).otherwise(F.lit(1)).alias("count"),
        ),
    )
    return F.filter(found, lambda r: (r["start"] > 0) & (r["count"] > 0))


def header_suffixes(diff: Column) -> Column:
    """The context behind each @@ header."""
    headers = F.filter(lines(diff), lambda x: x.rlike(r"^@@.*?@@"))
    return F.filter(F.transform(headers, lambda x: F.trim(F.regexp_extract(x, r"^@@.*?@@(.*)$", 1))), lambda x: x != "")


#: The words that introduce a definition, in the order they are tried, and the kind they define.
DEFINERS = (
    ("fn", "function"),
    ("def", "function"),
    ("function", "function"),
    ("class", "class"),
    ("struct", "class"),
    ("enum", "class"),
    ("interface", "class"),
    ("trait", "class"),
    ("object", "class"),
    ("const", "const"),
)


def header_symbol(suffix: Column) -> Column:
    """(name, kind) that a header's context defines; null if none."""
    found = []
    for word, kind in DEFINERS:
        name = F.regexp_extract(suffix, rf"(?:^|[^A-Za-z0-9_]){word} ([A-Za-z0-9_]*)", 1)
        found.append(F.when(name != "", F.struct(name.alias("name"), F.lit(kind).alias("kind"))))
    return F.coalesce(*found)


#: Languages by file extension, for hunks; parsers know the second group too.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}
PARSED = {"rs": "rust", "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}


def _by_extension(path: Column, table: dict[str, str]) -> Column:
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for language in sorted(set(table.values())):
        out = F.when(extension.isin([e for e, x in table.items() if x == language]), F.lit(language)).otherwise(out)
    return out


def detect_language(path: Column) -> Column:
    return _by_extension(path, LANGUAGES)


def parser_language(path: Column) -> Column:
    return _by_extension(path, PARSED)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def repo_id(first_sha: Column, path: Column) -> Column:
    """16 bytes of the SHA-256 of the first commit, a zero byte and the path, in hex."""
    return F.substring(F.sha2(F.concat(first_sha.cast("binary"), F.lit(b"\x00"), path.cast("binary")), 256), 1, 32)


#: Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ts: Column, sha: Column) -> Column:
    """The 26 characters of a ULID whose time is ts (seconds) and whose randomness is the first 10 bytes of the SHA."""
    head = F.when(F.lower(sha).rlike("^[0-9a-f]{20}"), F.lower(F.substring(sha, 1, 20))).otherwise(F.lit("0" * 20))
    # 48 bits of time behind two zero bits are 10 characters, 80 bits are 16
    millis = F.greatest(ts.cast("long"), F.lit(0)) * 1000
    time = [F.substring(F.lit(CROCKFORD), (F.shiftright(millis, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(9, -1, -1)]
    halves = [F.conv(F.substring(head, 1 + 10 * h, 10), 16, 10).cast("long") for h in (0, 1)]
    rest = [F.substring(F.lit(CROCKFORD), (F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for h in halves for i in range(7, -1, -1)]
    return F.concat(*time, *rest)


def path_prefixes(path: Column) -> Column:
    """a/b/c gives a/, a/b/ and a/b/c."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < n, F.lit("/")).otherwise(F.lit(""))))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent, without decimals; less than one is shown as such."""
    value = part / whole * 100.0
    return F.when(value < 1, F.lit("<1%")).otherwise(F.concat(F.bround(value).cast("long").cast("string"), F.lit("%")))


def line_span(source: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last line, from 1, of a byte span of a source."""
    raw = source.cast("binary")
    size = F.octet_length(source)

    def at(pos: Column) -> Column:
        head = F.substring(raw, F.lit(1), pos.cast("int"))
        return F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\n]", "")) + 1

    start, end = F.least(start, size), F.least(end, size)
    first = at(start)
    return first, F.greatest(F.when(end == 0, first).otherwise(at(end - 1)), first)


def rfc3339(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ssxxx")
