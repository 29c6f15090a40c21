from __future__ import annotations

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from plumbline.llm import automaton, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text, rules=secrets.RULES):
    found = []
    for k, rule in enumerate(rules):
        if rule.kind == "assign":
            found += [(m.start(), k, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        elif rule.kind == "hex":
            found += [(m.start(), k, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        else:
            found += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
    return sorted(found)


FRAGMENTS = [
    "password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", "'", '"', "AKIA", "AKIAAKIA", "deadbeef", "0123456789abcdef", "abcdefghijkl", "Z9", "é", "☃", ",", "\n", "==", "ghp_",
    "abcDEF123456abcDEF123456abcDEF123456xyz", "eyJ", "eyJhbGci.", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "1234-5678-9012", "_.-/+", "K", "ſ",
]


def test_random_texts_equal_python_regexes():
    rnd = random.Random(8)
    texts = ["".join(rnd.choices(FRAGMENTS, k=rnd.randint(0, 40))) for _ in range(1500)]
    assert secrets.find(pa.array(texts)) == [brute(t) for t in texts]


def test_long_texts_are_scanned_whole_and_across_segments():
    texts = ["x" * 70_000 + " token=abcdefghijklmnop " + "f" * 30_000, "a," * 5000 + "AKIA" + "B" * 20, "z" * 10_000]
    assert secrets.find(pa.array(texts)) == [brute(t) for t in texts]


def test_a_failing_match_consumes_what_it_covers():
    assert secrets.find(pa.array(["secret: token: abcdefghijklmnop", "secret=token=abcdefghijklmnop"])) == [[], [(0, 0, 29)]]


def test_automaton_is_minimal_and_refuses_what_it_does_not_cover():
    dfa = automaton.compile_rules([("ab|cb", False)], anchored=True)
    assert dfa.states == 4
    with pytest.raises(ValueError):
        automaton.compile_rules([("a(?=b)", False)])


SCHEMA = "doc_id long, text string, spans int, n_hex string, n_chars long"


def test_digest_columns_and_nulls(spark):
    rows = [(1, "é token = abcdefghijkl", 0, "", 22), (2, None, 0, "", 0), (None, "", 0, "", 0), (2, "0123456789abcdef", 0, "", 16), (2, "0123456789abcdef", 0, "", 16)]
    out = sorted([tuple(r) for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()], key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    want = [
        (1, 1, 0, 0, hashlib.sha256(b"assign:2:22").hexdigest(), "assign:2:22"), (2, 0, 0, 0, empty, ""), (None, 0, 0, 0, empty, ""),
        *[(2, 0, 0, 1, hashlib.sha256(b"hex:0:16").hexdigest(), "hex:0:16")] * 2,
    ]
    assert out == sorted(want, key=repr)


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "key é token = abcdefghijkl end", 7, "q", 30), (2, None, 7, "q", 0), (3, "clean text", 7, "q", 10)]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[1].text, out[1].n_chars, out[1].spans) == ("key é [assign] end", 18, 7)
    assert out[2].text is None and out[3].text == "clean text" and out[3].n_chars == 10


def test_overlapping_spans_are_replaced_once():
    text = "token=" + "0" * 20
    assert secrets.redact_text(text, brute(text)) == "[assign]"


def test_empty_table(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    assert secrets.redact(spark.createDataFrame([], SCHEMA)).count() == 0


KEY = "MIIEpAIBAAKCAQEAx2" + "Ab9+/Zq0" * 5


@pytest.mark.parametrize("kind", ["", "RSA "])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", " "])
def test_private_keys_go_with_their_bodies(kind, end):
    begin, close = f"-----BEGIN {kind}PRIVATE KEY-----", f"-----END {kind}PRIVATE KEY-----"
    fields = f"{end}Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF{end}" if end != "\\n" else ""
    whole = f"{begin}{fields}{end}{KEY}{end}{KEY}{end}a0=={end}{close}"
    text = f"key: {whole} and, {whole}{end}more words."
    assert secrets.redact_text(text, brute(text)) == f"key: [pem] and, [pem]{end}more words."
    cut = f"{begin}{end}{KEY}{end}{KEY}"
    assert secrets.redact_text(cut + ", x", brute(cut)) == "[pem], x"
    assert secrets.redact_text(f"{begin} is a line, x", brute(begin)) == "[pem] is a line, x"


@pytest.mark.parametrize(
    "text", ["token = x " * 20_000, "token = abcdefghijkl " * 10_000, "eyJ" * 64_000, "0123456789abcdef" * 60_000, "AKIA" * 50_000, "eyJabc.eyJdef.ghi" * 12_000, "x" + "token=" * 30_000 + "abcdefghijkl"],
    ids=["short", "assign", "starts", "hex", "nested", "jwt", "chain"],
)
def test_long_texts_without_breaks_are_fast(text):
    """No loop over bytes of a document: 200 kB without a byte that ends every rule take a fraction of a second."""
    secrets._automata(secrets.RULES)
    began = time.perf_counter()
    found = secrets.find(pa.array([text]))
    assert time.perf_counter() - began < 3
    assert found == [brute(text)]


def test_random_long_lanes_equal_python_regexes(monkeypatch):
    """Pieces that are cut anywhere are read again from the right state."""
    rnd = random.Random(9)
    loose = [f for f in FRAGMENTS if not set(f) & set(",\n☃é")]
    texts = ["".join(rnd.choices(loose, k=rnd.randint(200, 2500))) for _ in range(60)]
    combined, each = secrets._automata(secrets.RULES)
    for segment in (7, 64, 2048):
        small = lambda dfa, cls, bounds, _, s=segment, f=automaton._lanes: f(dfa, cls, bounds, s)
        with monkeypatch.context() as m:
            m.setattr(automaton, "_lanes", small)
            assert secrets.find(pa.array(texts), automata=(combined, each)) == [brute(t) for t in texts]


def test_rules_are_read_as_python_reads_them():
    rnd = random.Random(10)
    for pattern in ["a(b|cd)*e", "[^a-c]x{2,3}y?", r"\x61[\]-]+", "(a|ab)(c|bcd)", "a{2}b*c+", "[a-]b|-c"]:
        texts = ["".join(rnd.choices("abcdexy-]", k=rnd.randint(0, 12))) for _ in range(300)]
        dfa = automaton.compile_rules([(pattern, False)], anchored=True)
        for t in texts:
            state, longest = 0, None
            for i, c in enumerate(t.encode()):
                state = int(dfa.table[state + dfa.byte_class[c]])
                longest = i + 1 if state >= dfa.first_accept * dfa.classes else longest
            want = max((k for k in range(1, len(t) + 1) if re.fullmatch(pattern, t[:k])), default=None)
            assert longest == want
