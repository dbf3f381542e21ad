"""Node names and paths as columns: normalisation, grammar, segments, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a file system reserves for devices.
DEVICES = [
    "CON", "PRN", "AUX", "NUL", "CLOCK$", "COM0", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT0", "LPT1",
    "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"
]
#: Letters, digits, blank, dot, underscore and hyphen; no blank at either end, no final dot.
_SEGMENT = r"^[\p{L}\p{Nd} ._-]+$"


def normalized(name: Column) -> Column:
    """Back-slashes become slashes; slashes at both ends go."""
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def segments(gid: Column) -> Column:
    return F.split(gid, "/")


def joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def depth(gid: Column) -> Column:
    return F.size(segments(gid))


def local_id(gid: Column) -> Column:
    return F.element_at(segments(gid), -1)


def parent(gid: Column) -> Column:
    """The parent's gid; null for a top-level node."""
    return F.when(F.contains(gid, F.lit("/")), F.regexp_extract(gid, r"^(.*)/[^/]*$", 1))


def ancestors(gid: Column) -> Column:
    """All proper prefixes of a path, nearest last."""
    parts = segments(gid)
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def is_descendant(gid: Column, ancestor: Column) -> Column:
    return F.startswith(gid, F.concat(ancestor, F.lit("/")))


def is_direct_child(gid: Column, owner: Column) -> Column:
    return parent(gid) == owner


def moved(gid: Column, old: Column, new: Column) -> Column:
    """gid with the prefix ``old`` (itself or an ancestor) replaced by ``new``."""
    return F.when(gid == old, new).when(is_descendant(gid, old), F.concat(new, F.substr(gid, F.length(old) + 1))).otherwise(gid)


def valid_segment(name: Column) -> Column:
    stem = F.upper(F.substring_index(name, ".", 1))
    return F.coalesce(
        (F.trim(name) != "") & (F.trim(name) == name) & ~F.endswith(name, F.lit(".")) & ~name.isin(".", "..") & name.rlike(_SEGMENT) & ~F.trim(stem).isin(DEVICES),
        F.lit(False),
    )


def valid_path(gid: Column) -> Column:
    return F.coalesce(F.forall(segments(gid), valid_segment), F.lit(False))


def kebab(name: Column) -> Column:
    """A hyphen before each capital but the first character, then lower case."""
    return F.lower(F.regexp_replace(name, r"(?<=.)(\p{Lu})", "-$1"))


def stripped_type_name(name: Column) -> Column:
    """A type's display name, without one of the suffixes NodeType, Edge, Node."""
    return F.regexp_replace(name, r"(?<=.)(NodeType|Edge|Node)$", "")


def relation_name(type_name: Column, node_name: Column) -> Column:
    return F.concat(F.lit("instance-of-"), kebab(stripped_type_name(type_name)), F.lit("-for-"), kebab(node_name))


def next_free(prefix: str, taken: Column) -> Column:
    """``prefix-N`` with the least N from 1 that the array ``taken`` does not hold."""
    tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.concat(F.lit(prefix + "-"), n.cast("string")))
    return F.element_at(F.filter(tries, lambda x: ~F.array_contains(taken, x)), 1)


def record_file(identifier: Column) -> Column:
    return F.concat(F.sha2(identifier, 256), F.lit(".json"))


def member_id(type_gid: Column, member: Column) -> Column:
    return F.concat(F.lit("member-"), F.substr(F.sha2(F.concat(type_gid, F.char(F.lit(0)), member), 256), F.lit(1), F.lit(16)))


def fingerprint(names: Column) -> Column:
    """One digest of a set of type names, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(names), "\n"), 256)
