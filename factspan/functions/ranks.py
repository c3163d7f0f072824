"""Rank expressions for enumerated strings, reason lists and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The closed vocabularies, best or most severe first.
SEVERITY = ["error", "warning", "info"]
CONFIDENCE = ["high", "medium", "low"]
LIFETIME = ["singleton", "scoped", "transient"]
RISK = ["low", "medium", "high"]
USAGE_KINDS = [
    "read", "write", "invoke", "construct", "inherit",
    "implement", "override", "attribute", "nameof", "typeof",
]
GROUP_KINDS = ["file", "project", "containing-symbol", "usage-kind", "test-vs-production"]
FILE_REASONS = [
    "declares-selected-symbol",
    "references-selected-symbol",
    "caller-of-selected-member",
    "implements-selected-symbol",
    "hierarchy-related-symbol",
    "callee-of-selected-member",
]
TEST_REASONS = [
    "direct-reference-to-symbol",
    "test-method-attribute",
    "test-class-name-convention",
    "test-file-name-convention",
]
PROJECT_REASONS = [
    "test-sdk-package",
    "xunit-package",
    "nunit-package",
    "mstest-package",
    "benchmarkdotnet-package",
    "pack-as-tool",
    "output-type-exe",
    "output-type-library",
    "project-name-test",
    "project-path-test",
    "assembly-name-test",
    "sdk-web",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_of(value, ordered: list[str], default: int | None = None) -> Column:
    """Position of a value in an ordered list; ``default`` (list length) when absent or null."""
    value = _col(value)
    fallback = len(ordered) if default is None else default
    expr = F.when(value == ordered[0], 0)
    for position, item in enumerate(ordered[1:], start=1):
        expr = expr.when(value == item, position)
    return expr.otherwise(fallback)


def value_at(rank, ordered: list[str], default: str | None = None) -> Column:
    """Inverse of :func:`rank_of`."""
    rank = _col(rank)
    expr = F.when(rank == 0, ordered[0])
    for position, item in enumerate(ordered[1:], start=1):
        expr = expr.when(rank == position, item)
    return expr.otherwise(F.lit(default))


def reasons(*conditions: tuple[Column, object]) -> Column:
    """Array of the reason codes whose condition holds, in the given order."""
    items = [F.when(cond, F.lit(code) if isinstance(code, str) else code) for cond, code in conditions]
    return F.array_compact(F.array(*items))


def ordered_reasons(codes, priority: list[str] | None = None) -> Column:
    """Distinct codes by priority, then by text."""
    codes = F.array_distinct(_col(codes))
    if not priority:
        return F.array_sort(codes)
    ranked = F.transform(codes, lambda c: F.struct(rank_of(c, priority, 100).alias("r"), c.alias("c")))
    return F.transform(F.array_sort(ranked), lambda s: s["c"])


def identity(doc_id=None, fqn=None, display=None, name=None, container=None, default=None) -> Column:
    """Documentation id, else qualified name, else display name, else (container.)name."""
    parts = [_col(c) for c in (doc_id, fqn, display) if c is not None]
    if name is not None:
        name = _col(name)
        if container is not None:
            name = F.concat(F.coalesce(_col(container), F.lit("")), F.lit("."), name)
        parts.append(name)
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)
