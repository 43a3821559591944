"""Globs and path parts as driver helpers and Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKDOWN = (".md", ".markdown", ".mdown", ".mkd", ".mdx", ".mdwn")
SUPPORTED = (*MARKDOWN, ".html", ".htm", ".txt", ".pdf", ".docx")


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a shell glob: ``*`` crosses ``/``, ``?`` is one character, ``[...]`` and ``[!...]`` are sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + pattern.startswith("!", i))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(basename(name), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def under(path: Column, root: Column) -> Column:
    """path is root or lies below it (whole path segments)."""
    return (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def path_matches(path: Column, pattern: str, compat: bool = False) -> Column:
    """Glob on the whole path or the base name, else a case-insensitive substring; a glob with a folder part also matches
    at the end of a path, unless ``compat``. An empty pattern matches nothing."""
    if not pattern:
        return F.lit(False)
    hit = path.rlike(glob_regex(pattern)) | basename(path).rlike(glob_regex(pattern)) | F.contains(F.lower(path), F.lit(pattern.lower()))
    if "/" in pattern and not compat:
        hit = hit | path.rlike(glob_regex("*/" + pattern.lstrip("/")))
    return hit


def _segment_matches(path: Column, regex: str) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.rlike(regex))


def excluded(path: Column, root: str, rules: list[str]) -> Column:
    """Any rule matches the path relative to root, its base name, or one of its segments, in any case; blank rules don't count."""
    prefix = root.rstrip("/") + "/"
    rel = F.lower(F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path))
    out = F.lit(False)
    for rule in filter(None, (r.strip().lower().replace("\\", "/") for r in rules)):
        out = out | rel.rlike(glob_regex(rule)) | _segment_matches(rel, glob_regex(rule))
    return out


def normal_path(path: Column) -> Column:
    """The path without empty and ``.`` segments, each ``..`` taken together with the segment before it."""
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(absolute, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
