"""Path patterns as regular expressions: * ? [..] {a,b} and **."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """An anchored regular expression for a glob.

    With `crosses`, * and ? match a slash too (policies, gates, waivers); without, only ** does (ownership files). A class
    may begin with ! or ^; an unclosed [ or { stands for itself.
    """
    one, any_ = (".", ".*") if crosses else ("[^/]", "[^/]*")
    token = re.compile(r"(?:^|(?<=/))\*\*/|\*+|\?|\[[!^]?\]?[^\]]*\]|\{[^{}]*\}|.", re.S)

    def part(found: re.Match) -> str:
        t = found.group()
        if t == "**/":
            return "(?:.*/)?"
        if t[0] == "*":
            return ".*" if len(t) > 1 else any_
        if t == "?":
            return one
        if t[0] == "[" and len(t) > 2:
            negated = t[1] in "!^"
            return "[" + "^" * negated + t[1 + negated : -1].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&") + "]"
        if t[0] == "{" and len(t) > 1:
            return "(?:" + "|".join(token.sub(part, x) for x in t[1:-1].split(",")) + ")"
        return re.escape(t)

    return "^(?s:" + token.sub(part, pattern) + ")$"


def glob(path: Column, pattern: str, crosses: bool = True) -> Column:
    """Whether a path matches; null for a null path."""
    return path.rlike(glob_regex(pattern, crosses))


def first_match(path: Column, choices: list[tuple[str, object]], crosses: bool = True) -> Column:
    """The value of the first pattern that matches, else null: a few written rules are picked in the row, without a join."""
    out = [F.when(glob(path, p, crosses), F.lit(v)) for p, v in choices]
    return F.coalesce(*out) if out else F.lit(None)
