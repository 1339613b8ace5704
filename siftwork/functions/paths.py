"""Path expressions: hygiene, containment, globs, exclusions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from siftwork.functions.text import strip

# Directory names that are never scanned.
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "dist", "build", "out", "coverage",
    ".coverage", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".next", ".nuxt",
    ".turbo", ".cache", "target", "bin", "obj",
)

# Characters and prefixes a path may not carry.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BIDI_OVERRIDES = r"[\u202a-\u202e\u2066-\u2069]"
# A percent sign and two hex digits that appear only after one decoding round. Each of the three
# may itself be encoded, and at least one must be; encoded digits are %30-%39, %41-%46, %61-%66.
_HEX = "[0-9A-Fa-f]"
_HEX_ENCODED = "%(?:3[0-9]|[46][1-6])"
_HEX_ANY = f"(?:{_HEX}|{_HEX_ENCODED})"
DOUBLE_ENCODED = f"%25{_HEX_ANY}{_HEX_ANY}|%{_HEX_ENCODED}{_HEX_ANY}|%{_HEX}{_HEX_ENCODED}"
UNC_PREFIX = r"^(?:\\\\|//)"
TILDE_PREFIX = r"^/*\\*~"
SHELL_PREFIX = r"^/*\\*[$%=]"
DRIVE_ROOT = r"^\p{L}:/*\\*\z"


def hygiene_reason(raw: Column) -> Column:
    """First failing path check, or null for a clean path."""
    return (
        F.when(raw.isNull() | (strip(raw) == ""), "empty")
        .when(raw.contains("\x00"), "null_byte")
        .when(raw.rlike(CONTROL_CHARS), "control_character")
        .when(raw.rlike(BIDI_OVERRIDES), "bidi_override")
        .when(raw.rlike(DOUBLE_ENCODED), "double_encoded_percent")
        .when(raw.rlike(UNC_PREFIX), "unc_path")
        .when(raw.rlike(TILDE_PREFIX), "tilde_prefix")
        .when(raw.rlike(SHELL_PREFIX), "shell_expansion")
        .when(raw.rlike(DRIVE_ROOT), "windows_drive_root")
    )


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def clean_file(path: Column) -> Column:
    return slashed(strip(F.coalesce(path, F.lit(""))))


def posix_path(path: Column) -> Column:
    """Repeated slashes, ``.`` parts and a trailing slash removed; empty becomes ``.``."""
    p = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"(?:/\.)+(?=/|\z)", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"(?<=.)/\z", "")
    return F.coalesce(F.nullif(p, F.lit("")), F.lit("."))


def resolve_parts(path: Column) -> Column:
    """Parts of an absolute path with ``.`` and ``..`` folded (lexical, no link resolution)."""
    parts = F.filter(F.split(slashed(path), "/"), lambda x: (x != "") & (x != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, x)),
    )


def inside_base(path: Column, base: Column) -> Column:
    """Path, taken relative to ``base`` unless absolute, stays at or under ``base``."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))
    home = resolve_parts(base)
    return F.slice(resolve_parts(full), F.lit(1), F.size(home)) == home


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_excluded_dir(path: Column, excluded: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in excluded]))


def _glob_set(body: str) -> str:
    """Regex of a bracket's body; a range whose ends are reversed holds nothing."""
    head = "^" if body.startswith("!") else ""
    body, out, at = body[len(head) :], "", 0
    while at < len(body):
        if body[at + 1 : at + 2] == "-" and at + 2 < len(body):
            if body[at] <= body[at + 2]:
                out += f"{re.escape(body[at])}-{re.escape(body[at + 2])}"
            at += 3
        else:
            out += re.sub(r"([\[\]^&~|\\-])", r"\\\1", body[at])
            at += 1
    if not out:
        return "." if head else "(?!)"
    return f"[{head}{out}]"


def glob_regex(glob: str) -> str:
    """Regex of a file glob: ``*`` crosses slashes, ``[!..]`` negates, an open ``[`` is literal."""
    def one(m: re.Match[str]) -> str:
        tok = m.group(0)
        if tok == "*":
            return ".*"
        if tok == "?":
            return "."
        return _glob_set(tok[1:-1]) if len(tok) > 1 else re.escape(tok)

    return "(?s)^" + re.sub(r"\[!?\]?[^\]]*\]|[\s\S]", one, glob) + r"\z"


def glob_match(path: Column, glob: str) -> Column:
    """Glob on the whole path or on the base name."""
    g = glob_regex(glob)
    return path.rlike(g) | base_name(path).rlike(g)
