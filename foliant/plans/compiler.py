"""Compile a query tree to row predicates over ``file_path``, ``file_tags`` and ``content``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.paths import path_matches
from foliant.functions.text import has_term
from foliant.plans.querylang import And, Node, Not, Or, Path, Tag, Term


def exact(node: Node | None) -> Column:
    """The whole tree as one predicate."""
    match node:
        case None:
            return F.lit(True)
        case Tag(name):
            return F.coalesce(F.array_contains("file_tags", name), F.lit(False))
        case Path(pattern):
            return path_matches(F.col("file_path"), pattern)
        case Term(text):
            return has_term(F.col("content"), text)
        case Not(child):
            return ~exact(child)
        case And(children):
            return reduce(lambda a, b: a & b, map(exact, children))
        case Or(children):
            return reduce(lambda a, b: a | b, map(exact, children))


def file_level(node: Node | None) -> Column | None:
    """The older reading, first half: terms say nothing about files (None), and fall out of AND, OR and NOT."""
    match node:
        case None | Term():
            return None
        case Tag():
            return exact(node)
        case Path(pattern):
            return path_matches(F.col("file_path"), pattern, compat=True)
        case Not(child):
            inner = file_level(child)
            return None if inner is None else ~inner
        case And(children) | Or(children):
            parts = [p for c in children if (p := file_level(c)) is not None]
            return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts) if parts else None


def _about_files(node: Node) -> bool:
    match node:
        case Tag() | Path():
            return True
        case Not(child):
            return _about_files(child)
        case And(children) | Or(children):
            return any(map(_about_files, children))
        case _:
            return False


def content_level(node: Node | None) -> Column:
    """The older reading, second half: file conditions are true, and so is the NOT of anything that holds one."""
    match node:
        case None | Tag() | Path():
            return F.lit(True)
        case Term():
            return exact(node)
        case Not(child):
            return F.lit(True) if _about_files(child) else ~content_level(child)
        case And(children):
            return reduce(lambda a, b: a & b, map(content_level, children))
        case Or(children):
            return reduce(lambda a, b: a | b, map(content_level, children))


def predicate(node: Node | None, compat: bool = False) -> Column:
    if not compat:
        return exact(node)
    files = file_level(node)
    return content_level(node) if files is None else files & content_level(node)


def any_value(**filters) -> Column:
    """Equality with each value, or membership where a list is given."""
    return reduce(lambda a, b: a & b, [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in filters.items()], F.lit(True))
