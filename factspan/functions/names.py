"""Functions of symbol names, ids and attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ranks import _col

CANDIDATE_PREFIX = "sym:v1:"
CANDIDATE_HEX = 32

# Attribute short names and the verbs they declare.
HTTP_VERBS = {
    "HttpGet": "GET",
    "HttpPost": "POST",
    "HttpPut": "PUT",
    "HttpDelete": "DELETE",
    "HttpPatch": "PATCH",
    "HttpHead": "HEAD",
    "HttpOptions": "OPTIONS",
}


def normalize_name(name) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(_col(name), r"[^\p{L}\p{Nd}]", ""))


def is_type_like(query) -> Column:
    """Starts upper case and has no blank."""
    return F.coalesce(_col(query).rlike(r"^\p{Lu}[^ ]*$"), F.lit(False))


def candidate_id(doc_id, fqn, kind, project, framework, path, line, column, end_line, end_column) -> Column:
    """Stable id of a declaration: a prefix and the leading hex of a digest over its fields."""
    fields = [doc_id, fqn, kind, project, framework, path, line, column, end_line, end_column]
    texts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in fields]
    digest = F.sha2(F.concat_ws("\n", F.lit("v1"), *texts), 256)
    return F.concat(F.lit(CANDIDATE_PREFIX), F.substring(digest, 1, CANDIDATE_HEX))


def is_candidate_id(value) -> Column:
    return F.coalesce(_col(value).rlike(f"^{CANDIDATE_PREFIX}[0-9a-f]{{{CANDIDATE_HEX}}}$"), F.lit(False))


def stable_id(kind, path, line, column, end_line, end_column, suffix=None) -> Column:
    parts = [F.lit(kind) if isinstance(kind, str) else kind]
    parts += [F.coalesce(_col(c).cast("string"), F.lit("")) for c in (path, line, column, end_line, end_column)]
    parts.append(F.coalesce(_col(suffix), F.lit("")) if suffix is not None else F.lit(""))
    return F.concat_ws(":", *parts)


def project_id(path, name, framework) -> Column:
    return F.concat_ws(":", F.lit("project"), F.coalesce(_col(path), _col(name)), F.coalesce(_col(framework), F.lit("")))


def short_attribute(name) -> Column:
    """Last dotted part of an attribute name without its suffix."""
    bare = F.regexp_replace(_col(name), "Attribute$", "")
    return F.element_at(F.split(bare, r"\."), -1)


def http_methods(attributes) -> Column:
    """Sorted distinct verbs declared by attribute names."""
    table = F.create_map(*[F.lit(x) for pair in HTTP_VERBS.items() for x in pair])
    verbs = F.transform(_col(attributes), lambda a: F.try_element_at(table, short_attribute(a)))
    return F.array_sort(F.array_distinct(F.array_compact(verbs)))


def auth_state(attributes) -> Column:
    """Struct(kind, policies, roles, schemes) of attribute structs(name, first_arg, policy, roles, schemes).

    An anonymous marker beats a required one, which beats unknown.
    """
    attributes = _col(attributes)
    marks = F.filter(attributes, lambda a: short_attribute(a["name"]) == "Authorize")
    anonymous = F.exists(attributes, lambda a: short_attribute(a["name"]) == "AllowAnonymous")
    required = ~anonymous & (F.size(marks) > 0)
    empty = F.array().cast("array<string>")

    def values(pick) -> Column:
        found = F.filter(F.transform(marks, pick), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
        return F.when(required, found).otherwise(empty)

    kind = F.when(anonymous, "anonymous").when(required, "required").otherwise("unknown")
    return F.struct(
        kind.alias("kind"),
        values(lambda a: F.coalesce(a["policy"], a["first_arg"])).alias("policies"),
        values(lambda a: a["roles"]).alias("roles"),
        values(lambda a: a["schemes"]).alias("schemes"),
    )


def lifetime_of(method) -> Column:
    """Registration lifetime named by a call."""
    method = _col(method)
    return (
        F.when(method.contains("Singleton"), "singleton")
        .when(method.contains("Scoped"), "scoped")
        .when(method.contains("Transient"), "transient")
        .otherwise("unknown")
    )


def collapse_whitespace(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def doc_id(kind, container, name, param_types) -> Column:
    """Documentation id: kind letter, qualified name, parameter types in brackets when there are any."""
    kind, container = _col(kind), _col(container)
    letter = (
        F.when(kind == "NamedType", "T")
        .when(kind == "Property", "P")
        .when(kind == "Field", "F")
        .when(kind == "Event", "E")
        .otherwise("M")
    )
    qualified = F.when(F.trim(container) != "", F.concat(container, F.lit("."), _col(name))).otherwise(_col(name))
    types = F.coalesce(_col(param_types), F.array().cast("array<string>"))
    suffix = F.when(F.size(types) > 0, F.concat(F.lit("("), F.array_join(types, ","), F.lit(")"))).otherwise("")
    return F.concat(letter, F.lit(":"), qualified, suffix)


def default_values(params) -> Column:
    """'name=value' of the parameters that have a default."""
    with_default = F.filter(_col(params), lambda p: p["default_value"].isNotNull())
    return F.transform(with_default, lambda p: F.concat(p["name"], F.lit("="), p["default_value"]))


def nullable_annotations(signature) -> Column:
    """One mark when the signature has a nullable annotation anywhere, else an empty list."""
    marked = F.array(F.lit("annotated"))
    return F.when(_col(signature).contains("?"), marked).otherwise(F.array().cast("array<string>"))


def target_framework(project_name, symbols) -> Column:
    """From a '(net...)' suffix of the project name, else the smallest framework named by a build symbol."""
    named = F.regexp_extract(_col(project_name), r"\((net[^)]+)\)$", 1)

    def of_symbol(s: Column) -> Column:
        expr = F.lit(None).cast("string")
        legacy = F.regexp_extract(s, r"^NET(4\d+)$", 1)
        spaced = F.regexp_replace(F.substring(legacy, F.lit(2), F.length(legacy)), r"(\d)", r".$1")
        expr = F.when(legacy != "", F.concat(F.lit("net"), F.substring(legacy, 1, 1), spaced)).otherwise(expr)
        for token, label in (("NETCOREAPP", "netcoreapp"), ("NETSTANDARD", "netstandard"), ("NET", "net")):
            pattern = rf"^{token}(\d+)_(\d+)$"
            version = F.concat(F.regexp_extract(s, pattern, 1), F.lit("."), F.regexp_extract(s, pattern, 2))
            expr = F.when(s.rlike(pattern), F.concat(F.lit(label), version)).otherwise(expr)
        return expr

    return F.coalesce(F.when(named != "", named), F.array_min(F.transform(_col(symbols), of_symbol)))
