"""Secret scans: all rules in one pass of a combined minimal byte automaton.

The automata are compiled once on the driver; their size follows the rules, not
the data, so they are broadcast.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.arrow import frugal, parts, utf8
from plumbline.llm.automaton import compile_rules, scan, spans


@dataclass(frozen=True)
class Rule:
    """``least``: bytes that a match needs; ``value``: bytes that what follows the first ``:`` or ``=`` needs."""

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    value: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", fold=True, value=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the scan finds beside the base rules.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE
_MOST = 8 << 20


@lru_cache(maxsize=4)
def _automata(rules: tuple[Rule, ...]):
    whole = [(r.pattern, r.fold) for r in rules]
    return compile_rules(whole), [(compile_rules([w], anchored=True), compile_rules([w], anchored=False, backward=True)) for w in whole]


def _passes(rule: Rule, match: bytes) -> bool:
    if len(match) < rule.least:
        return False
    if rule.value:
        at = next(i for i, c in enumerate(match) if c in b":=") + 1
        rest = match[at:].lstrip(b" ")
        return len(rest) - (rest[:1] in (b"'", b'"')) >= rule.value
    return True


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES, automata=None) -> list[list[tuple[int, int, int]]]:
    """For each text its spans ``(start, rule, end)`` in code points, by start and then rule."""
    combined, each = automata or _automata(rules)
    body, offsets = utf8(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for a, b in parts(np.diff(offsets).tolist(), _MOST):
        ends, masks = scan(combined, body, offsets[a : b + 1])
        doc = np.searchsorted(offsets, ends - 1, side="right") - 1
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for r, rule in enumerate(rules):
            own = np.flatnonzero(masks >> r & 1)
            if len(own):
                docs = np.unique(doc[own])
                where = spans(*each[r], body, np.column_stack([offsets[docs], offsets[docs + 1]]), ends[own])
                of = np.searchsorted(offsets, [s for s, _ in where], side="right") - 1
                for i, (s, e) in zip(of.tolist(), where):
                    if _passes(rule, body[s:e].tobytes()):
                        hits.setdefault(i, []).append((s, r, e))
        for i, own in hits.items():
            base = int(offsets[i])
            points = np.r_[0, np.cumsum((body[base : offsets[i + 1]] & 0xC0) != 0x80)]
            found[i] = sorted((int(points[s - base]), r, int(points[e - base])) for s, r, e in own)
    return found


def _listed(hits, rules) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in hits)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Return doc_id, ``n_<kind>`` for the base kinds, base_sha256 and spans for every row of ``docs``.

    Matches are leftmost-longest and do not overlap within a rule; those that
    are too short are dropped after matching.  Spans are ``kind:start:end`` in
    code points, end exclusive, by start and then rule order.  A null text is
    empty and has no spans; rows with null or repeated ids are all returned;
    an empty table gives an empty result; other columns are not read.
    """
    n_base = len(BASE)
    compiled = docs.sparkSession.sparkContext.broadcast(_automata(rules))

    def run(batches):
        for batch in batches:
            found = find(batch.column(1), rules, compiled.value)
            base = [[h for h in hits if h[1] < n_base] for hits in found]
            digests = [hashlib.sha256(_listed(h, rules).encode()).hexdigest() for h in base]
            counts = [pa.array([sum(r == k for _, r, _ in h) for h in base], pa.int64()) for k in range(n_base)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_listed(h, rules) for h in found], pa.string())],
                ["doc_id", *[f"n_{r.kind}" for r in BASE], "base_sha256", "spans"],
            )

    if rules[:n_base] != BASE:
        raise ValueError("the base rules come first")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, {', '.join(f'n_{r.kind} long' for r in BASE)}, base_sha256 string, spans string")


_GAP, _SIGN = r"[\x20\t\r\n\\]", r"[A-Za-z0-9+/=]"
#: What follows a private key's BEGIN line: header fields, then all up to the END line, or without that the lines of a body.
_KEY_REST = re.compile(rf"(?:{_GAP}*+[A-Za-z]++-[A-Za-z]++: [A-Za-z0-9,-]++)*+(?:(?:{_GAP}|{_SIGN})*+-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:{_GAP}*+{_SIGN}{{16,}}+)*+)")


def redact_text(text: str, hits, rules: tuple[Rule, ...] = RULES) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first one; a private key goes with its body and END line."""
    out, cursor = [], 0
    for s, r, e in hits:
        if rules[r].kind == "pem":
            e = _KEY_REST.match(text, e).end()
        if s >= cursor:
            out += [text[cursor:s], f"[{rules[r].kind}]"]
        cursor = max(cursor, e)
    return "".join([*out, text[cursor:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``[kind]``; all rows and columns stay, ``n_chars`` follows the new text if it is there.

    A null text stays null and an empty one empty; overlapping spans become
    one mark; rows with null or repeated ids are each judged by their text; an
    empty table gives an empty result; other columns, of any name, pass
    through as they are.
    """
    places = {name: i for i, name in enumerate(docs.columns)}
    compiled = docs.sparkSession.sparkContext.broadcast(_automata(rules))

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(places["text"])
            found = find(texts, rules, compiled.value)
            if any(found):
                new = [redact_text(t, h, rules) if h else t for t, h in zip(texts.to_pylist(), found)]
                columns[places["text"]] = pa.array(new, texts.type)
                if "n_chars" in places:
                    old = batch.column(places["n_chars"])
                    lengths = [len(t) if h else n for t, h, n in zip(new, found, old.to_pylist())]
                    columns[places["n_chars"]] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(frugal(run), docs.schema)


__all__ = ["BASE", "MORE", "RULES", "Rule", "find", "redact", "redact_text", "scan_secrets"]
