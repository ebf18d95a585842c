"""Whether an index was built with what a query expects of it."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Components whose change makes vectors wrong, and those that can be refreshed, in the order they are looked at.
VECTOR_COMPONENTS = ("embedding_model", "embedding_dimension", "embed_input_mode")
DERIVED_COMPONENTS = ("schema", "chunker_version", "semantic_text_version", "reranker_model")

#: Fixed value: how a mismatch is told.
MISMATCH = '{key} mismatch (index has "{stored}", binary expects "{wanted}")'


@dataclass(frozen=True)
class Verdict:
    status: str
    reason: str = ""
    missing: tuple[str, ...] = ()


@dataclass(frozen=True)
class Expected:
    components: dict[str, str] = field(default_factory=dict)
    parsers: dict[str, str] = field(default_factory=dict)

    def all(self) -> dict[str, str]:
        return self.components | {f"parser_{k}": v for k, v in self.parsers.items()}


def assess(expected: Expected, stored: dict[str, str]) -> Verdict:
    """compatible, query_compatible_needs_refresh, needs_rebuild or unknown; a wrong vector component comes before all else."""
    wanted = expected.all()
    missing: list[str] = []
    for group, status in ((VECTOR_COMPONENTS, "needs_rebuild"), ((*DERIVED_COMPONENTS, *sorted(k for k in wanted if k.startswith("parser_"))), "query_compatible_needs_refresh")):
        for key in (k for k in group if k in wanted):
            if key not in stored:
                missing.append(key)
            elif stored[key] != wanted[key]:
                return Verdict(status, MISMATCH.format(key=key, stored=stored[key], wanted=wanted[key]))
    return Verdict("unknown", missing=tuple(missing)) if missing else Verdict("compatible")


def hint(last_indexed: str | None, behind: int, verdict: Verdict, most_behind: int = 50) -> str | None:
    """What to do about a stale or unfit index; None if nothing."""
    said = []
    if last_indexed is None:
        said.append("Nothing has been indexed here yet: ingest the history first.")
    elif behind > most_behind:
        said.append(f"{behind} commits since the last ingest are missing from the answers: ingest them.")
    told = {
        "query_compatible_needs_refresh": f"Answers are usable, but parts of the index are out of date ({verdict.reason}): ingest everything again when there is time.",
        "needs_rebuild": f"The index does not fit this version ({verdict.reason}): nothing can be searched before it is built again.",
        "unknown": f"It is not known which versions made this index ({', '.join(verdict.missing)} unrecorded): ingest everything again to record them.",
    }
    if verdict.status in told:
        said.append(told[verdict.status])
    return " ".join(said) or None
