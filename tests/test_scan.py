import fnmatch
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftwork.functions import patterns
from siftwork.functions.paths import glob_match
from siftwork.operators import scan
from siftwork.operators.scan import Rule
from tests.conftest import rows

BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
RULES = [
    Rule(r"\bTODO\b", "p1", "todo"),
    Rule(r"^key\s*=\s*\w+$", "P9", ""),
    Rule(r"eval\(", "P0", "eval", "*.ts", "ask"),
    Rule(r"(?i)secret", "P3", "s", "src/*", "allow"),
    Rule(r"[[]x&&y|été", "P2", "set"),
    Rule(r"\d{3}-\d{4}\b", "P2", "phone"),
    Rule(r"a.c", "P2", "dot"),
]
PARTS = ["TODO", "xTODO", "TODOé", "key = v", " key=1", "eval(1)", "SECRET", "[x&&y", "été", "555-1234", "555-12345", "abc", "a\tc", "", "  "]


def brute(files, rules):
    out = []
    for run, file, text in files:
        for no, r in enumerate(rules, 1):
            if r.in_glob:
                g = re.compile(patterns.glob_regex(r.in_glob).replace(r"\z", r"\Z"))
                if not (g.match(file) or g.match(file.rsplit("/", 1)[-1])):
                    continue
            for n, line in enumerate(text.splitlines(), 1):
                if re.search(r.pattern, line):
                    sev = r.severity.upper() if r.severity.upper() in ("P0", "P1", "P2", "P3") else "P2"
                    out.append((run, file, n, no, sev, line.strip()[:240], r.behavior))
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    files = []
    for i in range(60):
        text = "".join(" ".join(rnd.choices(PARTS, k=3)) + rnd.choice(BREAKS) for _ in range(rnd.randrange(12)))
        files.append((f"r{i % 3}", rnd.choice(["src/", "lib/", ""]) + f"f{i}" + rnd.choice([".ts", ".py"]), text))
    return files


COLS = ("run_id", "file", "line", "seq", "severity", "evidence", "decision")


def test_scan_equals_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    want = brute(corpus, RULES)
    assert want
    assert rows(scan.scan_rules(df, RULES), *COLS) == want
    assert rows(scan.scan_rules(df.repartition(7), RULES), *COLS) == want


def test_run_rules_equal_the_literal_scan(spark, corpus):
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    table = [(f"r{i}", no, *r) for i in range(3) for no, r in enumerate(RULES, 1)]
    rules = spark.createDataFrame(
        table, "run_id string, rule_no int, pattern string, severity string, message string, in_glob string, behavior string"
    )
    assert rows(scan.scan_run_rules(df, rules), *COLS) == brute(corpus, RULES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(scan.scan_run_rules(df, rules), *COLS) == brute(corpus, RULES)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("glob, path, hit", [
    ("*.ts", "a/b/c.ts", True), ("*.ts", "a.tsx", False), ("src/*", "src/a/b", True), ("b?.py", "x/b1.py", True),
    ("[!a]*.py", "x/a.py", True), ("[!a]*.py", "a.py", False), ("a[b", "a[b", True), ("f.o", "fxo", False), ("[]]x", "]x", True),
])
def test_glob(spark, glob, path, hit):
    df = spark.range(1).select(glob_match(F.lit(path), glob).alias("m"))
    assert df.first().m is hit


UNSAFE = ["(a+)+$", "(a|aa)+$", "((a+))+$", "(a?)+$", "(?:a{2})*", "(?P<n>a|b){2,}", r"(\w+)\s\1", "(?P<q>a)(?P=q)", "x" * 501]
SAFE = ["(abc)+", r"(\+\*)+", "([a+*|])+", "(a)|b", "a+b*", "(?:ab)+c", r"\(a+\)+", "(a+)b", "a{2,3}", "(ab){", "(a{,2})+"]


def test_lint():
    assert all(patterns.prepare(p, None).reject_kind == "unsafe-regex" for p in UNSAFE)
    assert [p for p in SAFE if patterns.prepare(p, None).reject_kind] == []
    assert all(patterns.prepare(p, None).reject_kind == "invalid-regex" for p in ["(", "[a", "*a", "(?(1)a|b)", "(?a)x"])
    start = time.time()
    patterns.prepare("(" * 250 + "a+" + ")" * 200 + "+", None)
    assert time.time() - start < 1.0


def test_rejected_rules_become_findings(spark, corpus):
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    got = rows(scan.scan_rules(df, [Rule("(a+)+$"), Rule("(")], "conf/policy.yaml"), "run_id", "rule_id", "severity", "file", "decision")
    assert got == sorted(
        (f"r{i}", f"policy:forbid-pattern:{n}", "P1", "conf/policy.yaml", "deny") for i in range(3) for n in ("1:unsafe-regex", "2:invalid-regex")
    )


def test_required_literal():
    cases = {"foo(bar)?baz": {"foo", "baz"}, "a|b": {None}, "ab?c": {"a", "c"}, r"x\.y+": {"x.y"}, "(abc)": {None}, "[abc]": {None},
             r"\bab{0,2}": {"a"}, "(?i)abc": {None}, "a(b|c)d{2}ef": {"ef"}}
    for pattern, ok in cases.items():
        assert patterns.required_literal(pattern) in ok, pattern


def test_scannable(spark):
    df = spark.createDataFrame(
        [("a.py", 10), ("x/node_modules/a.js", 10), (".git/c", 1), ("builds/a", 1_000_000), ("big", 1_000_001), (".github/w.yml", 5)],
        "file string, size long",
    )
    assert rows(scan.scannable(df), "file") == [(".github/w.yml",), ("a.py",), ("builds/a",)]


BRACES = ["foo{bar}", r"\${[A-Z]+}", "a{,}b", "{x", "x}{", "a{1}{", r"[{]a{2}", "({)b", "{}", "a{1,x}", r"\{2}", "}{,2}"]


def test_braces_mean_the_same(spark):
    text = "foo{bar} ${HOME} aab {x x}{ a{ {aa {b {} a{1,x} {{ }} }"
    lines = [text, *text.split(" "), "b", "fo{bar}", "", "a"]
    df = spark.createDataFrame([("r", "f", "\n".join(lines))], "run_id string, file string, text string")
    got = rows(scan.scan_rules(df, [Rule(p) for p in BRACES]), "line", "seq")
    assert got == sorted(((n, i) for i, p in enumerate(BRACES, 1) for n, t in enumerate(lines, 1) if re.search(p, t)), key=lambda t: tuple((x is not None, str(x)) for x in t))


GLOBS = ["[z-a]*", "[!z-a]b", "[a-c-e]x", "[a-]x", "[-a]x", "[]-a]x", "[!]-a]x", "[a-c0-9]x", "[[]x", "[^a]x", "[&&a]x", "[\\\\]x", "[a~b|]x", "[c-b]x"]


@pytest.mark.parametrize("glob", GLOBS)
def test_bracket_globs(spark, glob):
    names = [c + "x" for c in "abcde0-]^[&~|\\!z"] + ["b", "bb", "x", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "n string").filter(glob_match(F.col("n"), glob))
    assert {r.n for r in df.collect()} == {n for n in names if fnmatch.fnmatchcase(n, glob)}


def test_bad_rules_of_one_run_leave_the_others(spark, corpus):
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    bad = ["(?P<a_b>x)", "(", "(a+)+$", "x{2,1}"]
    table = [(f"r{i}", no, *r) for i in range(3) for no, r in enumerate(RULES, 1)]
    table += [("r0", 90 + k, p, "P0", "", None, "deny") for k, p in enumerate(bad)] + [("r9", 1, "(", "P0", "", "[z-a]", "deny")]
    rules = spark.createDataFrame(
        table, "run_id string, rule_no int, pattern string, severity string, message string, in_glob string, behavior string"
    )
    found = scan.scan_run_rules(df, rules)
    assert rows(found.filter("line > 0"), *COLS) == brute(corpus, RULES)
    refused = rows(found.filter("line = 0"), "run_id", "seq")
    assert refused == [("r0", 90), ("r0", 91), ("r0", 92), ("r0", 93), ("r9", 1)]
    got = rows(scan.scan_rules(df, RULES + [Rule(p) for p in bad]), *COLS)
    assert [r for r in got if r[2]] == brute(corpus, RULES) and len([r for r in got if not r[2]]) == 3 * len(bad)


def test_a_thousand_rules(spark, corpus):
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    many = [Rule(rf"\bnothing{k}\b") for k in range(1000)]
    start = time.time()
    got = rows(scan.scan_rules(df, RULES + many), *COLS)
    assert got == brute(corpus, RULES) and time.time() - start < 60


def test_the_index_finds_every_key():
    rnd = random.Random(6)
    letters = "ab(.é\n\\-"
    for _ in range(300):
        keys = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 12))}
        text = "".join(rnd.choice(letters) for _ in range(40))
        # The same syntax in Python, but for the braces of its escapes.
        regex = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", patterns.any_key_regex(sorted(keys)))
        found = {m[1] for m in re.finditer(regex, text)}
        assert found <= keys
        assert {k for k in keys if any(f.startswith(k) for f in found)} == {k for k in keys if k in text}
    assert patterns.index_key("abc") == "abc" and patterns.index_key("ab") is None and patterns.index_key(None) is None
    assert patterns.index_key("never17here") in "never17here" and "17" in patterns.index_key("never17here")


MANY = [Rule(p) for p in ["to+ken", "ken", "k", "(?i)TOKEN", "a|b", "x{2}y", "é.+z", r"\(\)", "end$", "tokens", "oken", "to", "[0-9]+ab", "b-", "-b-c", "c++", "ab", "abc", "bca", "cab"]]


def test_indexed_rules_equal_brute_force(spark):
    rnd = random.Random(9)
    bits = ["token", "tooken", "xxy", "é", "z", "()", "end", "\n", " ", "12ab", "b-b-c", "cc", "ab", "bc", "ca"]
    corpus = [(f"r{i % 3}", f"f{i}", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(150)] + [("r0", "none", None)]
    df = spark.createDataFrame(corpus, "run_id string, file string, text string")
    many = [r for r in MANY if r.pattern != "c++"] + [Rule(f"idle{k}x") for k in range(30)]
    want = brute([c for c in corpus if c[2] is not None], many)
    assert want and rows(scan.scan_rules(df, many), *COLS) == want
    table = [(f"r{i}", no, *r) for i in range(3) for no, r in enumerate(many if i else many[:6], 1)]
    rules = spark.createDataFrame(table, "run_id string, rule_no int, pattern string, severity string, message string, in_glob string, behavior string")
    few = brute([c for c in corpus if c[2] is not None and c[0] == "r0"], many[:6])
    assert rows(scan.scan_run_rules(df, rules), *COLS) == sorted([w for w in want if w[0] != "r0"] + few, key=lambda t: tuple((x is not None, str(x)) for x in t))
