"""Functions of paths, routes and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ranks import _col

# File-name forms and folder names of generated code.
GENERATED_SUFFIXES = ["g", "generated", "designer", "AssemblyInfo", "AssemblyAttributes"]
GENERATED_PREFIX = "TemporaryGeneratedFile_"
SOURCE_EXTENSIONS = ["cs", "vb"]
BUILD_FOLDERS = ["obj", "bin"]


# The escapes of quoted paths, as hexadecimal bytes.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def _unescaped(text: Column) -> Column:
    """Text with backslash escapes and octal bytes (of UTF-8) decoded."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+|\\"), F.lit(0))
    named = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def as_hex(piece: Column) -> Column:
        rest = F.substring(piece, 2, 3)
        octal = F.lpad(F.conv(rest, 8, 16), 2, "0")
        escaped = F.coalesce(F.try_element_at(named, rest), F.hex(rest))
        return F.when(piece.rlike(r"^\\[0-7]{3}$"), octal).when(piece.startswith("\\") & (F.length(piece) > 1), escaped).otherwise(F.hex(piece))

    return F.decode(F.unhex(F.array_join(F.transform(pieces, as_hex), "")), "UTF-8")


def normalize_path(path) -> Column:
    """Unquote, drop a leading a/ or b/, forward slashes, no leading ./."""
    text = F.trim(_col(path))
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    text = F.when(quoted, _unescaped(F.regexp_replace(text, r'(?s)^"(.*)"$', "$1"))).otherwise(text)
    text = F.regexp_replace(text, "^[ab]/", "")
    return forward_slashes(text)


def forward_slashes(path) -> Column:
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^\./", "")


def file_name(path) -> Column:
    return F.element_at(F.split(F.translate(_col(path), "\\", "/"), "/"), -1)


def directory(path) -> Column:
    """Directory of a path, '' at the root."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"[^/]*$", ""), "/$", "")


def ancestor_dirs(path) -> Column:
    """All directories above a path, from '' (root) down to its own."""
    parts = F.split(directory(path), "/")
    return F.array_distinct(
        F.concat(
            F.array(F.lit("")),
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
        )
    )


def relative_path(path, root) -> Column:
    """Path below the root; null outside it."""
    path, root = _col(path), F.concat(F.rtrim(_col(root), F.lit("/")), F.lit("/"))
    return F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path)))


def is_generated_path(path) -> Column:
    """Generated-file name or a build-output folder, any case; false for null or blank."""
    path = F.trim(_col(path))
    stems = "|".join(GENERATED_SUFFIXES)
    kinds = "|".join(SOURCE_EXTENSIONS)
    folders = "|".join(BUILD_FOLDERS)
    pattern = (
        rf"(?i)(^|[/\\]){GENERATED_PREFIX}[^/\\]*$"
        rf"|\.({stems})\.({kinds})$"
        rf"|(^|[/\\])\s*({folders})\s*([/\\]|$)"
    )
    return F.coalesce(path.rlike(pattern), F.lit(False))


def is_source_path(path) -> Column:
    return F.coalesce(_col(path).rlike(rf"(?i)\.({'|'.join(SOURCE_EXTENSIONS)})$"), F.lit(False))


def in_build_output(path) -> Column:
    """A .git, bin or obj segment anywhere in a relative path."""
    return F.coalesce(_col(path).rlike(r"(^|[/\\])(\.git|bin|obj)([/\\]|$)"), F.lit(False))


def project_kind(name, path) -> Column:
    """'test' when the name or the path mentions it, else 'production'."""
    mentions = F.coalesce(F.lower(_col(name)).contains("test"), F.lit(False)) | F.coalesce(
        F.lower(_col(path)).contains("test"), F.lit(False)
    )
    return F.when(mentions, "test").otherwise("production")


def normalize_route(pattern) -> Column:
    """One leading slash, no doubled slashes; null for blank."""
    text = F.trim(_col(pattern))
    return F.when(text != "", F.regexp_replace(F.concat(F.lit("/"), text), "/+", "/"))


def combine_routes(type_route, method_route) -> Column:
    """Type part and method part joined by one slash; the other part alone where one is blank."""
    left, right = _col(type_route), _col(method_route)
    joined = F.concat(F.rtrim(left, F.lit("/")), F.lit("/"), F.ltrim(right, F.lit("/")))
    return (
        F.when(F.coalesce(F.trim(left), F.lit("")) == "", right)
        .when(F.coalesce(F.trim(right), F.lit("")) == "", left)
        .otherwise(joined)
    )


def lines_of(text) -> Column:
    """Lines of a text; a final line break does not add an empty line."""
    body = F.regexp_replace(_col(text), r"\r\n|\r", "\n")
    parts = F.split(body, "\n", -1)
    return F.when(body.endswith("\n") | (body == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def estimate_tokens(chars) -> Column:
    return F.ceil(_col(chars) / 4).cast("long")


def material_chars(lines, path, kind, codes) -> Column:
    """Characters a context item costs: its lines, path, kind and reason codes."""

    def total(items) -> Column:
        items = F.coalesce(_col(items), F.array().cast("array<string>"))
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(F.length(s), F.lit(0)))

    return total(lines) + F.coalesce(F.length(_col(path)), F.lit(0)) + F.length(_col(kind)) + total(codes)
