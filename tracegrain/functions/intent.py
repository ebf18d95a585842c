"""What a query's words say about the search: intent, filters, and the profile that follows."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime

DAY = 86400

#: Phrases that bound the time, with their days, in the order they are looked for.
SINCE_PHRASES = (
    ("last week", 7),
    ("last 7 days", 7),
    ("last 30 days", 30),
    ("last month", 30),
    ("last quarter", 90),
    ("last 90 days", 90),
    ("last 6 months", 180),
    ("last year", 365),
)
#: Languages that a query may name.
HINTED = ("rust", "python", "java", "kotlin")

#: An intent holds if all words of any of its groups are in the query; the first that holds counts.
#: A group's word may be a tuple, of which one must be in the query.
RULES = (
    ("configuration", "high", "intent:configuration:phrase", (("where do we configure",), ("where did we configure",), ("how is", ("loaded", "configured")), ("load configuration",))),
    ("configuration", "medium", "intent:configuration:keyword", (("config",), (" env ",), ("environment variable",))),
    ("bug_fix_precedent", "high", "intent:bug_fix:phrase", (("how did we fix",), ("how do we fix",), ("regression for",))),
    ("bug_fix_precedent", "medium", "intent:bug_fix:keyword", (((" bug", " crash", " error"), (" fix", "fixed")),)),
    ("api_usage", "high", "intent:api_usage:phrase", (("how is", ("called", "used", "invoked")), ("usages of",), ("callers of",), ("call sites",))),
    (
        "implementation_pattern",
        "high",
        "intent:implementation_pattern:phrase",
        (("how did we",), ("how do we",), ("pattern for",), ("like the existing",), ("like our existing",), ("how was", ("done before", "implemented")), ("add ", " like ", "before")),
    ),
)


@dataclass(frozen=True)
class ParsedQuery:
    intent: str
    confidence: str
    language: str | None
    path_terms: tuple[str, ...]
    symbol_terms: tuple[str, ...]
    since_unix: int | None
    matched_rules: tuple[str, ...]


def parse_query(query: str, now: int) -> ParsedQuery:
    low = query.lower()
    rules = []
    language = next((x for x in HINTED if _names(low, x)), None)
    if language:
        rules.append(f"language_hint:{language}")
    paths = tuple(w for w in (re.sub(r"^[^A-Za-z0-9/._]+|[^A-Za-z0-9/._]+$", "", w) for w in re.split(r"[\s,;]", query)) if "/" in w and "." in w)
    rules += ["path_terms"] * bool(paths)
    symbols = _quoted(query)
    rules += ["quoted_symbols"] * bool(symbols)
    since = next(((p, d) for p, d in SINCE_PHRASES if p in low), None)
    if since:
        rules.append(f"since:{since[0]}")
    intent, confidence, rule = classify(low)
    return ParsedQuery(intent, confidence, language, paths, symbols, now - since[1] * DAY if since else None, (*rules, rule))


def _names(low: str, language: str) -> bool:
    return f"in {language}" in low or language in (low, *_edges(low)) or f" {language} " in low


def _edges(low: str) -> tuple[str, str]:
    """The first and the last word, where a space sets them off."""
    return (low.split(" ", 1)[0] if " " in low else "", low.rsplit(" ", 1)[1] if " " in low else "")


def _quoted(query: str) -> tuple[str, ...]:
    """What stands between two equal quotation marks, if it is one word."""
    found = []
    for match in re.finditer(r"([`'\"])(.*?)\1|[`'\"].*\Z", query, re.S):
        if match[1] and match[2] and not re.search(r"\s", match[2]):
            found.append(match[2])
    return tuple(found)


def classify(low: str) -> tuple[str, str, str]:
    """Intent, confidence and the rule that decided, of a lower-cased query."""

    def has(word: str | tuple[str, ...]) -> bool:
        return word in low if isinstance(word, str) else any(w in low for w in word)

    for intent, confidence, rule, groups in RULES:
        if any(all(has(w) for w in group) for group in groups):
            return intent, confidence, rule
    return "unknown", "low", "intent:unknown:fallthrough"


def intent_column(query):
    """classify() for a column of queries."""
    from pyspark.sql import functions as F

    low = F.lower(query)

    def has(word):
        tests = [F.contains(low, F.lit(w)) for w in ((word,) if isinstance(word, str) else word)]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    out = F.lit("unknown")
    for intent, _, _, groups in reversed(RULES):
        holds = F.lit(False)
        for group in groups:
            one = F.lit(True)
            for word in group:
                one = one & has(word)
            holds = holds | one
        out = F.when(holds, F.lit(intent)).otherwise(out)
    return out


@dataclass(frozen=True)
class Weights:
    """How lanes are gathered, fused and weighed by age."""

    lane_top_k: int = 100
    rrf_k: int = 60
    rerank_top_k: int = 20
    recency_weight: float = 0.05
    recency_half_life_days: float = 90.0


@dataclass(frozen=True)
class Profile:
    """What an intent changes of the search."""

    name: str = "unknown"
    explanation: str = "No specific intent detected; the default blend of lanes is used."
    recency_multiplier: float = 1.0
    lanes: tuple[str, ...] = ("vec", "text", "semantic", "historical_symbol", "head_symbol")
    rerank_top_k: int | None = None
    recency_weight: float | None = None
    recency_half_life_days: float | None = None
    lane_top_k: int | None = None

    def weights(self, base: Weights = Weights()) -> Weights:
        own = {k: v for k in ("rerank_top_k", "recency_weight", "recency_half_life_days", "lane_top_k") if (v := getattr(self, k)) is not None}
        made = replace(base, **own)
        return replace(made, recency_weight=made.recency_weight * self.recency_multiplier)


PROFILES = {
    "unknown": Profile(),
    "implementation_pattern": Profile("implementation_pattern", "A pattern is asked for; the default blend of lanes is used."),
    "bug_fix_precedent": Profile("bug_fix_precedent", "A fix is asked for; newer changes count more.", recency_multiplier=1.5),
    "api_usage": Profile("api_usage", "Uses are asked for; more candidates are reranked.", rerank_top_k=40),
    "configuration": Profile("configuration", "Configuration is asked for; symbols are not searched.", lanes=("vec", "text", "semantic")),
}


def parse_since(since: str | None, now: int) -> int | None:
    """Unix seconds of "30d", an RFC 3339 time or a date at midnight UTC; ValueError for anything else."""
    text = (since or "").strip()
    if not text:
        return None
    if re.fullmatch(r"\d+d", text):
        return now - int(text[:-1]) * DAY
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())
        when = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not a time: {since!r}") from None
    if when.tzinfo is None:
        raise ValueError(f"a time without a zone: {since!r}")
    return int(when.timestamp())


def parse_lines(spec: str | None, n_lines: int) -> tuple[int, int]:
    """"A:B", ":B" or "A:" as first and last line; None is the whole file."""
    if spec is None:
        return 1, max(n_lines, 1)
    first, colon, last = spec.partition(":")
    if not colon:
        raise ValueError(f"lines must be START:END, not {spec!r}")
    start = int(first) if first else 1
    return start, int(last) if last else max(n_lines, start)
