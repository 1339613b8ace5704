import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import secrets as S

NAMES = ["config", "server", "client", "handler", "request", "response", "timeout", "session", "credential", "connect"]


def brute_base(text):
    """The contract's words, kind by kind."""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def secret(rng, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


def prose(rng, n):
    return " ".join(rng.choice(NAMES) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with planted strings, and where a novel one must be found."""
    rng = random.Random(5)
    rows, novel = [], {}
    for i in range(120):
        text = prose(rng, 60)
        if i % 4 == 1:
            own = secret(rng, 28)
            text = f"{prose(rng, 30)} the credential of the client is {own} {text}"
            novel[i] = (text.index(own), text.index(own) + 28)
        elif i % 4 == 2:
            text += f"\npassword = '{secret(rng, 12)}' Token:{secret(rng, 6)} API_KEY=\"{secret(rng, 20)}\" AKIA{secret(rng, 16, string.ascii_uppercase)} {secret(rng, 40, '0123456789abcdef')} AKIA12 {secret(rng, 31, '0123456789abcdef')}"
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "é😀 secret: token: abcdefghij é password=😀 passwd=" + "a" * 300_000), (203, "İ token='12345678' ſecret=abcdefgh1 toKen=abcdefgh2"), (None, "token=12345678"), (204, "token=12345678"), (204, "token=12345678")]
    rows += [(300 + k, "the credential is connectionTimeoutHandler") for k in range(3)]
    return rows, novel


def test_base_and_novel_spans(spark, corpus):
    rows, novel = corpus
    docs = docs_of(spark, rows).withColumns({n: F.lit("clash") for n in ("spans", "n_hex", "word", "context")})
    got = S.scanned(docs).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, brute_base(r[1] or "")) for r in rows)
    digest = lambda spans: hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == [
        (i, *(sum(s.startswith(k) for s in spans) for k in ("assign:", "access:", "hex:")), digest(spans)) for i, spans in want
    ]
    found = {}
    for r in got:
        every = [s for s in r.spans.split(",") if s]
        places = [(int(s.split(":")[1]), S.KINDS.index(s.split(":")[0])) for s in every]
        assert places == sorted(places)
        assert digest([s for s in every if not s.startswith("novel")]) == r.base_sha256
        found.update({r.doc_id: tuple(map(int, s.split(":")[1:])) for s in every if s.startswith("novel")})
        assert r.n_novel == sum(s.startswith("novel") for s in every)
    assert found == novel


def test_identifiers_come_from_different_documents(spark, corpus):
    own = "Zq7Kp2Lm9Xw4Rt8Yb3Nv"
    copies = [(1000 + k, f"our credential {own} kopierterText") for k in range(50)]
    rows = corpus[0] + copies
    words = S.identifiers(docs_of(spark, rows))
    assert {"config", "server", "client"} <= set(words) and "kopierterText" not in words
    assert len(" ".join(words)) <= S.DICTIONARY_BYTES and len(" ".join(S.identifiers(docs_of(spark, rows), size=40))) <= 40
    got = S.scanned(docs_of(spark, rows)).filter("doc_id >= 1000").collect()
    assert {r.spans for r in got} == {"novel:15:35"} and len(got) == 50


def test_added_bytes_are_marginal():
    """Against a plain measurement: the frame with the string less the frame without it."""
    import zstandard

    novelty = S.Novelty(["connection", "timeout", "handler"])
    made = zstandard.ZstdCompressionDict("handler timeout connection".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressor(level=6, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
    text = "a credential Xy12Zz98Qq34Ww and Xy12Zz98Qq34Ww again"
    around = " and   again a credential "
    assert novelty.added(text, 13, 27) == len(plain.compress((around + "Xy12Zz98Qq34Ww").encode())) - len(plain.compress(around.encode()))
    assert novelty.novel(text, 13, 27)
    text = "a credential connection_timeout_handler"
    assert not novelty.novel(text, 13, len(text))


def test_quick_search_equals_the_patterns():
    rng = random.Random(2)
    bits = ["token", "TOKEN", "secret", "api", "key", "_", " ", "=", ":", "'", "passwd", "password", "AKIA", "0a" * 9, "abc12345", "\n", "private", "bearer", "İ", "ſ", "auth", "s"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [f"{k}:{a}:{b}" for a, b, k in S.base_spans(text)] == brute_base(text)
        assert [m.span() for m in S.CONTEXT.finditer(text)] == [m.span() for m in S._matches(S.CONTEXT, S._CONTEXT_STEMS, text)]
        import pyarrow as pa

        if brute_base(text) or list(S.contexts(text)):
            column = pa.array([text])
            assert S._some(column, S._ANY_CONTEXT)[0] or S._some(column, S._ANY_BASE)[0]


def test_empty_table(spark):
    assert S.scanned(docs_of(spark, [])).collect() == []
