"""Slash-separated paths as column expressions."""

from pyspark.sql import Column, functions as F

ROOT = "."


def parts(path) -> Column:
    return F.split(path, "/")


def order_key(path) -> Column:
    """A string that sorts as the path does component by component.

    The separator becomes the lowest character, which no file name may hold, so a folder
    sorts before names it is a prefix of; strings sort much faster than arrays.
    """
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def name(path) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path) -> Column:
    """Direct parent folder, ``.`` at the top."""
    return F.when(
        F.contains(path, F.lit("/")),
        F.substring(path, F.lit(1), F.length(path) - F.length(name(path)) - 1),
    ).otherwise(F.lit(ROOT))


def ancestors(path) -> Column:
    """Strict ancestor folders, nearest last; ``.`` is an ancestor of all but itself."""
    pieces = parts(path)
    depth = F.size(pieces)
    inner = F.when(
        depth > 1,
        F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.array_join(F.slice(pieces, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(path == ROOT, F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit(ROOT)), inner)
    )


def self_and_ancestors(path) -> Column:
    return F.array_append(ancestors(path), path)


def _resolved(path) -> Column:
    """Absolute path as components, with empty and dot components worked out."""
    pieces = F.filter(parts(path), lambda p: (p != "") & (p != "."))
    return F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.array_append(done, p)
        ),
    )


def relative(path, root) -> Column:
    """Path of an absolute path seen from ``root``; climbs with ``..`` when outside it."""
    target, base = _resolved(path), _resolved(root)
    shorter = F.least(F.size(target), F.size(base))
    shared = F.when(
        shorter > 0,
        F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.slice(target, 1, i) == F.slice(base, 1, i))),
    ).otherwise(F.lit(0))
    climb = F.array_repeat(F.lit(".."), F.size(base) - shared)
    rest = F.slice(target, shared + 1, F.size(target))
    joined = F.array_join(F.concat(climb, rest), "/")
    return F.when(joined == "", F.lit(ROOT)).otherwise(joined)
