"""Checks and preparation of user-supplied rule patterns (the small control side of a scan)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from siftwork.functions.paths import glob_regex

# Fixed value: longest pattern that is accepted.
MAX_PATTERN_CHARS = 500

_QUANTIFIER = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_LINT_TOKEN = re.compile(
    r"\\.|\[(?:\\.|[^\]\\])*\]?|(?P<open>\((?:\?:|\?P<[^>]*>)?)|(?P<close>\))|(?P<mark>\||[*+?]|\{\d+(?:,\d*)?\})",
    re.S,
)


def _risky_group(pattern: str) -> bool:
    """A quantified group whose body holds a group, a quantifier or an alternation."""
    busy: list[bool] = []  # one flag per open group: has its body any such token yet
    for tok in _LINT_TOKEN.finditer(pattern):
        if tok["open"] or tok["mark"]:
            if busy:
                busy[-1] = True
            if tok["open"]:
                busy.append(False)
        elif tok["close"] and busy and busy.pop() and _QUANTIFIER.match(pattern, tok.end()):
            return True
    return False


def unsafe_reason(pattern: str) -> str | None:
    if len(pattern) > MAX_PATTERN_CHARS:
        return f"pattern length {len(pattern)} exceeds {MAX_PATTERN_CHARS} characters"
    if re.search(r"\\[1-9]|\(\?P=", pattern):
        return "backreferences are not allowed in policy forbid patterns"
    if _risky_group(pattern):
        return (
            "quantified groups containing nested groups, quantifiers, or "
            "alternation are not allowed in policy forbid patterns"
        )
    return None


_SYNTAX = re.compile(
    r"(?P<esc>\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|0[0-7]{0,2}|.))"
    r"|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])"
    r"|(?P<named>\(\?P<)"
    r"|(?P<times>\{(?:\d+(?:,\d*)?|,\d*)\})"
    r"|(?P<brace>\{)",
    re.S,
)
_NOT_IN_JAVA = re.compile(r"(?<!\\)(?:\(\?\(|\(\?[aLu]|\(\?[imsx-]*[aLu][a-zA-Z-]*[:)])|\\N\{")


def _java_escape(tok: str, in_set: bool) -> str:
    if tok[1] == "Z":
        return r"\z"
    if tok[1] == "v":
        return r"\x0b"
    if tok[1] == "b" and in_set:
        return r"\x08"
    if tok[1] == "0":
        return f"\\x{int(tok[1:], 8):02x}"
    if tok[1] == "U":
        return f"\\x{{{tok[2:]}}}"
    return tok


def _java_set(tok: str) -> str:
    head = "[^" if tok.startswith("[^") else "["
    body = re.sub(
        r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|0[0-7]{0,2}|.)|[\[\]&^]",
        lambda m: _java_escape(m[0], True) if m[0][0] == "\\" else "\\" + m[0],
        tok[len(head) : -1],
        flags=re.S,
    )
    return f"{head}{body}]"


def java_regex(pattern: str) -> str:
    """The same pattern in Java syntax, with Unicode classes where the pattern uses classes."""
    def one(m: re.Match[str]) -> str:
        if m["esc"]:
            return _java_escape(m["esc"], False)
        if m["set"]:
            return _java_set(m["set"])
        if m["named"]:
            return "(?<"
        # A brace that opens no repetition is itself; a repetition without a lower end begins at none.
        return r"\{" if m["brace"] else m["times"].replace("{,", "{0,")

    out = _SYNTAX.sub(one, pattern)
    return ("(?U)" if re.search(r"\\[wWdDsSbB]|\(\?[a-z]*i", pattern) else "") + out


_LITERAL_TOKEN = re.compile(
    r"(?P<char>\\[^0-9A-Za-z]|[^\\\[\](){}|*+?.^$])|(?P<quant>[*+?]|\{[^}]*\})|(?P<or>\|)|(?P<open>\()|(?P<close>\))"
    r"|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[\s\S]",
    re.S,
)


def required_literal(pattern: str) -> str | None:
    """Longest text that every match must contain, where one is plain to see."""
    if "(?" in pattern.replace("(?:", ""):
        return None
    best, run, depth = "", "", 0
    for tok in _LITERAL_TOKEN.finditer(pattern):
        if tok["or"] and depth == 0:
            return None
        if tok["char"] and depth == 0:
            run += tok["char"][-1]
            continue
        ended = run
        if tok["quant"] and depth == 0 and re.match(r"[*?]|\{0|\{,", tok["quant"]):
            ended = run[:-1]  # the last character may be absent
        best = max(best, ended, key=len)
        run = ""
        depth += bool(tok["open"]) - bool(tok["close"])
    return max(best, run, key=len) or None


# A rule is found by so many characters of its required text. What is shorter than the least is in most texts, so a rule
# that requires no more is tried on all of them.
KEY_CHARS, LEAST_KEY_CHARS = 8, 3


def index_key(literal: str | None) -> str | None:
    """The stretch of a required text by which a text is looked up: the one with most characters that are no small letters."""
    if literal is None or len(literal) < LEAST_KEY_CHARS:
        return None
    starts = range(max(1, len(literal) - KEY_CHARS + 1))
    return max((literal[k : k + KEY_CHARS] for k in starts), key=lambda s: sum(not c.islower() and c != " " for c in s))


def _quoted(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def any_key_regex(keys: Sequence[str]) -> str:
    """A Java regex whose group 1 is, at every place where a key begins, the longest such key.

    The keys are a tree of characters, so a place costs a few steps however many keys there are, and a place whose
    character begins no key costs one. Keys that begin a longer key are found with it.
    """
    tree: dict = {}
    for key in keys:
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [_quoted(c) + written(after) for c, after in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{body})?" if "" in node else body

    first = "".join(_quoted(c) for c in sorted(tree))
    return f"(?=[{first}])(?=({written(tree)}))"


def text_gate_is_exact(pattern: str) -> bool:
    """A match in a line is also a match in the whole text.

    False where the pattern looks at line ends or ahead, or gives nothing back.
    """
    return not re.search(r"[\^$]|\\[AZ]|\(\?(?!:|P<)|[*+?}]\+", re.sub(r"\\[\^$]|\[\^", "", pattern))


def loose_regex(pattern: str) -> str | None:
    """The pattern in Java syntax without its word-boundary tests, if it has any.

    It matches whatever the pattern matches and more, and its search need not classify characters
    at every position.
    """
    bare = _SYNTAX.sub(lambda m: "" if m["esc"] == r"\b" else m[0], pattern)
    if bare == pattern or re.search(r"\\b[*+?{]|\(\?", pattern):
        return None
    return java_regex(bare)


class Prepared(NamedTuple):
    reject_kind: str | None = None
    reject_reason: str | None = None
    regex: str | None = None
    glob: str | None = None
    literal: str | None = None
    loose: str | None = None
    gate: bool = False


def prepare(pattern: str, in_glob: str | None) -> Prepared:
    """Check one rule and translate it; a rejected rule has a kind and a reason instead."""
    reason = unsafe_reason(pattern)
    if reason:
        return Prepared("unsafe-regex", reason)
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as exc:
        return Prepared("invalid-regex", str(exc))
    if _NOT_IN_JAVA.search(pattern):
        return Prepared("invalid-regex", "construct is not supported by the scan")
    return Prepared(
        None,
        None,
        java_regex(pattern),
        glob_regex(in_glob) if in_glob else None,
        required_literal(pattern),
        loose_regex(pattern),
        text_gate_is_exact(pattern),
    )
