"""Directories: paths as arrays of names, each with a prefix, a layer and metadata.

A directory table is (path array<string>, prefix binary, layer string); a row with an empty path is the root.
A path without a row of its own exists as long as a row below it does, when it is moved or removed. Subtrees are found by comparing
path arrays, never by packed bytes. Changes return a new table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class DirectoryError(ValueError):
    pass


#: Fixed value: the layout's version.
LAYOUT_VERSION = (1, 0, 0)
#: Fixed value: the prefix of the directories' own metadata, which is the root's.
ROOT = b"\xfe"
SCHEMA = "path array<string>, prefix binary, layer string"


def validate(path) -> tuple[str, ...]:
    """A path as a tuple of names; an error for a name that no directory may have."""
    names = (path,) if isinstance(path, str) else tuple(path)
    for n in names:
        if not isinstance(n, str) or n in ("", ".", "..") or "\x00" in n:
            raise DirectoryError("invalid_path")
        try:
            raw = n.encode()
        except UnicodeEncodeError as e:
            raise DirectoryError("invalid_path") from e
        if raw[0] in (0xFE, 0xFF):
            raise DirectoryError("invalid_path")
    return names


def check_version(stored: tuple[int, int, int], writing: bool) -> None:
    """A newer major version blocks all use, a newer minor one blocks writes."""
    if stored[0] > LAYOUT_VERSION[0]:
        raise DirectoryError("incompatible_directory_version")
    if writing and stored[0] == LAYOUT_VERSION[0] and stored[1] > LAYOUT_VERSION[1]:
        raise DirectoryError("directory_version_write_restricted")


def under(path: Column, parent: tuple[str, ...]) -> Column:
    """Whether path is parent or below it."""
    if not parent:
        return F.lit(True)
    return F.slice(path, 1, len(parent)) == F.array(*[F.lit(p) for p in parent])


def _is(path: Column, names: tuple[str, ...]) -> Column:
    return path == (F.array(*[F.lit(p) for p in names]) if names else F.array().cast("array<string>"))


def exists(table: DataFrame, path) -> bool:
    return bool(table.where(_is(F.col("path"), validate(path))).limit(1).count())


def children(table: DataFrame, parent) -> DataFrame:
    """name of each immediate child of parent."""
    names = validate(parent)
    path = F.col("path")
    return table.where(under(path, names) & (F.size(path) > len(names))).select(F.element_at(path, len(names) + 1).alias("name")).distinct()


def prefix_free(table: DataFrame, prefix: bytes) -> bool:
    """Whether no directory's prefix starts with prefix, nor prefix with a directory's."""
    p = F.lit(bytearray(prefix))
    return not table.where(F.size("path") > 0).where(F.startswith(F.col("prefix"), p) | F.startswith(p, F.col("prefix"))).limit(1).count()


def root(spark, version: tuple[int, int, int] = LAYOUT_VERSION) -> DataFrame:
    """A directory table that holds its root alone: an empty path, the metadata's own prefix, the layout's version as layer."""
    return spark.createDataFrame([([], bytearray(ROOT), ".".join(map(str, version)))], SCHEMA)


def layout_version(table: DataFrame) -> tuple[int, int, int]:
    """The version that the table's root names; this layout's where there is no root."""
    row = table.where(F.size("path") == 0).first()
    return LAYOUT_VERSION if row is None else tuple(int(x) for x in row["layer"].split("."))  # type: ignore[return-value]


def _writable(table: DataFrame) -> None:
    check_version(layout_version(table), True)


def _row(table: DataFrame, path):
    row = table.where(_is(F.col("path"), validate(path))).first()
    if row is None:
        raise DirectoryError("directory_does_not_exist")
    return row


def path_of(row) -> list[str]:
    return list(row["path"])


def layer_of(row) -> str | None:
    return row["layer"] if row["path"] else None


def create(table: DataFrame, path, prefix: bytes, layer: str | None = None) -> DataFrame:
    names = validate(path)
    _writable(table)
    if not names:
        raise DirectoryError("cannot_create_root")
    if exists(table, names):
        raise DirectoryError("directory_already_exists")
    if len(names) > 1 and not exists(table, names[:-1]):
        raise DirectoryError("parent_directory_does_not_exist")
    if not prefix_free(table, prefix):
        raise DirectoryError("prefix_collision")
    return table.unionByName(table.sparkSession.createDataFrame([(list(names), bytearray(prefix), layer)], "path array<string>, prefix binary, layer string"))


def open_(table: DataFrame, path) -> DataFrame:
    """The directory's row, with partition: whether its layer says so."""
    check_version(layout_version(table), False)
    _row(table, path)
    return table.where(_is(F.col("path"), validate(path))).withColumn("partition", F.coalesce(F.col("layer") == "partition", F.lit(False)))


def create_or_open(table: DataFrame, path, prefix: bytes, layer: str | None = None) -> DataFrame:
    return table if exists(table, path) else create(table, path, prefix, layer)


def moved(table: DataFrame, old, new) -> DataFrame:
    """The table with the subtree at old renamed to new; prefixes stay. A partition does not move, nor onto a path that exists or has no parent."""
    old, new = validate(old), validate(new)
    if not old or not new:
        raise DirectoryError("cannot_move_root")
    if new[: len(old)] == old:
        raise DirectoryError("cannot_move_to_subdirectory")
    _writable(table)
    if not table.where(under(F.col("path"), old)).limit(1).count():
        raise DirectoryError("directory_does_not_exist")
    if table.where(_is(F.col("path"), old) & (F.col("layer") == "partition")).limit(1).count():
        raise DirectoryError("cannot_move_partition")
    if table.where(under(F.col("path"), new)).limit(1).count():
        raise DirectoryError("directory_already_exists")
    if len(new) > 1 and not table.where(under(F.col("path"), new[:-1])).limit(1).count():
        raise DirectoryError("parent_directory_does_not_exist")
    path = F.col("path")
    tail = F.slice(path, F.lit(len(old) + 1), F.greatest(F.size(path) - len(old), F.lit(0)))
    return table.withColumn("path", F.when(under(path, old), F.concat(F.array(*[F.lit(p) for p in new]), tail)).otherwise(path))


def removed(table: DataFrame, path, missing_ok: bool = False) -> DataFrame:
    """The table without the subtree at path; contents under its prefixes are not touched."""
    names = validate(path)
    if not names:
        raise DirectoryError("cannot_remove_root")
    _writable(table)
    if not missing_ok and not table.where(under(F.col("path"), names)).limit(1).count():
        raise DirectoryError("directory_does_not_exist")
    return table.where(~under(F.col("path"), names))


def removed_if_exists(table: DataFrame, path) -> DataFrame:
    return removed(table, path, missing_ok=True)
