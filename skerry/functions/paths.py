"""Column functions over paths: types, classes, normalisation, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and path classes.
FILE_TYPES = (
    ("code", r"\.(rs|go|py|js|jsx|ts|tsx|java|c|cpp|h|hpp|cs|dart)$"),
    ("markdown", r"\.md$"),
    ("text", r"\.txt$"),
    ("json", r"\.json$"),
    ("yaml", r"\.(yaml|yml)$"),
    ("toml", r"\.toml$"),
    ("pdf", r"\.pdf$"),
    ("binary", r"\.(png|jpg|jpeg|gif|mp4)$"),
)
PATH_CLASSES = {
    "docs": r"/docs/|\.md$|\.rst$|\.adoc$|readme$",
    "test": r"/tests?/|_test\.rs$|_test\.py$|\.spec\.ts$|\.test\.ts$",
    "code": r"\.(rs|py|ts|tsx|js|jsx|go|java|c|cpp|h|hpp|cs)$",
    "script": r"^scripts/|/scripts/|\.ps1$|\.sh$|\.bat$",
    "workflow": r"(^\.?github/workflows/|/workflows/)(.*)\.ya?ml$",
    "unit": r"^systemd/|/systemd/|\.(service|socket|timer|mount|target)$",
    "config": r"^config/|/config/|\.(toml|yaml|yml|json|ini|conf)$",
    "generated": r"/(\.next|\.nuxt|\.svelte-kit|\.turbo|\.dart_tool|__generated__|dist|build|out|coverage|target)/|\.min\.js$",
    "asset": r"/(assets|static|media)/|\.(dat|bin|png|jpg|jpeg|gif|svg|ico|mp3|wav|ogg|pdf|zip|onnx|pt|ckpt|pb|tflite)$",
}


def file_type(path: Column) -> Column:
    """The type by extension, whatever its case; unknown ones are text."""
    out = None
    for name, pattern in FILE_TYPES:
        hit = F.lower(path).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("text")


def in_class(path: Column, name: str) -> Column:
    return F.lower(path).rlike(PATH_CLASSES[name])


def normalise(path: Column) -> Column:
    """Backslashes to slashes, no slash at either end."""
    return F.btrim(F.translate(path, "\\", "/"), F.lit("/"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Directories above a path: ".", then each prefix of its segments."""
    parts = F.split(path, "/")
    deep = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(deep, F.array().cast("array<string>")))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\s*\.")


def climbs(path: Column) -> Column:
    """A ".." segment, with either slash."""
    return F.array_contains(F.split(F.translate(path, "\\", "/"), "/"), "..")


def glob_regex(pattern: str, star_crosses: bool = True) -> str:
    """Pattern as an anchored regular expression; a single * crosses "/" unless told otherwise."""
    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif pattern.startswith("**", k):
            out.append(".*")
            k += 2
        elif pattern[k] == "*":
            out.append(".*" if star_crosses else "[^/]*")
            k += 1
        elif pattern[k] == "?":
            out.append(".")
            k += 1
        elif pattern[k] == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out.append("(?:" + "|".join(re.escape(x) for x in pattern[k + 1 : end].split(",")) + ")")
            k = end + 1
        else:
            out.append(re.escape(pattern[k]))
            k += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)
