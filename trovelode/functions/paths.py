"""Column functions on paths and on names of languages and syntax captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovelode import config


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; null where the file name has none. A leading dot is no extension."""
    found = F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)
    return F.nullif(found, F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """The language under which a file's parser is known: its extension, or what the extension is another spelling of."""
    own = extension(path)
    known = own
    for alias, name in config.ALIASES.items():
        known = F.when(own == alias, name).otherwise(known)
    return F.when(own.isin(config.STRUCTURED_EXTENSIONS) | own.isin(list(config.ALIASES)), known)


def is_scanned(path: Column) -> Column:
    """Whether a file belongs to an index: its extension or name is known and no directory or name of it is ignored."""
    directories = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    name = file_name(path)
    ignored = F.arrays_overlap(directories, F.array(*map(F.lit, [*config.IGNORED_DIRECTORIES, config.INDEX_DIRECTORY]))) | name.isin(config.IGNORED_FILES)
    known = F.coalesce(extension(path).isin(config.EXTENSIONS), F.lit(False)) | name.isin(config.FILE_NAMES)
    return F.coalesce(known & ~F.coalesce(ignored, F.lit(False)), F.lit(False))


def under(path: Column, wanted: str) -> Column:
    """Filter of listings: a wanted path that ends with a slash is a prefix, any other is the path itself."""
    return path.startswith(wanted) if wanted.endswith("/") else path == wanted


#: What a capture's name has in it, and the kind that makes of it; the first that fits counts.
KIND_PARTS = (
    ("function", "function"), ("method", "method"), ("class", "class"), ("interface", "interface"), ("type", "type"), ("enum", "enum"),
    ("module", "module"), ("namespace", "namespace"), ("struct", "class"), ("trait", "interface"), ("protocol", "interface"),
    ("object", "class"), ("record", "class"), ("package", "module"), ("decorator", "decorator"),
)


def kind_of_capture(capture: Column) -> Column:
    """Kind of a syntax capture; ``fallback`` where none fits, also for null."""
    kind = F.lit("fallback")
    for part, name in reversed(KIND_PARTS):
        kind = F.when(F.contains(capture, F.lit(part)), name).otherwise(kind)
    return kind


def branch_file_name(branch: Column) -> Column:
    """A branch as part of a file name: other characters become underscores, 64 characters at most."""
    return F.substring(F.regexp_replace(branch, "[^a-zA-Z0-9._-]", "_"), 1, 64)
