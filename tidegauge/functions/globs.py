"""Glob patterns over metric names."""

from __future__ import annotations

import re

from pyspark.sql import Column

WILD = frozenset("*?[{")


class GlobError(ValueError):
    pass


def has_wildcard(glob: str) -> bool:
    return any(c in WILD for c in re.sub(r"\\.", "", glob))


def to_regex(glob: str) -> str:
    """``*`` any run, ``?`` one character, ``{a,b}`` alternatives, ``[a-z]`` and ``[!a]`` classes, backslash escapes."""
    out, depth, inside, i = [], 0, False, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\":
            if i == len(glob):
                raise GlobError("the pattern ends in an escape")
            out.append(re.escape(glob[i]))
            i += 1
        elif inside:
            if c == "]":
                inside = False
            out.append("^" if c == "!" and out[-1] == "[" else c)
        elif c == "[":
            inside = True
            out.append("[")
        elif c == "{":
            depth += 1
            out.append("(")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        else:
            out.append("\\" + c if c in ".^$+()|" else c)
    if depth or inside:
        raise GlobError("a bracket is not closed")
    return "".join(out)


def level_regex(glob: str) -> str:
    """For one level of a dotted name: no wildcard crosses a dot."""
    if glob == "*":
        return "[^.]+"
    return to_regex(glob).replace(".*", "[^.]*")


def path_regex(glob: str) -> str:
    return r"\.".join(level_regex(t) for t in glob.split("."))


def matches(column: Column, glob: str) -> Column:
    """Whole-string match; plain equality where the pattern has no wildcard, so that it is pushed to the scan."""
    return column.rlike(f"^(?:{to_regex(glob)})$") if has_wildcard(glob) else column == re.sub(r"\\(.)", r"\1", glob)
