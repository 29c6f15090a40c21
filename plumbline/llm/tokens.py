"""Ids of the public byte-level BPE, by the fastest of two libraries that give the same ids."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: White space from which a run is taken out of the text first: the fast library's pattern goes back over a run one character at a time on a bounded stack.
LONG_BLANK = 4096
#: The characters of Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = re.compile(f"[{_WHITE}]{{{LONG_BLANK},}}")


def vocabulary_paths(name: str = VOCABULARY) -> tuple[str, str]:
    """Paths of the ``tokenizers`` file and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=2)
def _rust_bpe(ranks_path: str, whole: bool = False):
    """An encoder of texts, or one that takes what it is given as one pre-token."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+" if whole else public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(bpe, text: str) -> np.ndarray:
    return bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


@lru_cache(maxsize=2)
def added_tokens(json_path: str) -> dict[str, int]:
    """Texts that are one token wherever they stand, and their ids."""
    with open(json_path, encoding="utf-8") as f:
        listed = json.load(f).get("added_tokens", ())
    if any(t.get(k) for t in listed for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes in what is around it")
    return {t["content"]: t["id"] for t in listed}


@lru_cache(maxsize=2)
def added_pattern(json_path: str) -> re.Pattern | None:
    """Finds added tokens, leftmost first; None if the vocabulary has none."""
    names = sorted(added_tokens(json_path), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def _plain(text: str, ranks_path: str) -> np.ndarray:
    """Ids of a text without added tokens.

    A run of n blanks that more text follows is one pre-token of n - 1 (all n
    at the end), whatever is before it, so a long one is merged on its own.
    """
    texts = _rust_bpe(ranks_path)
    sample = text[:: LONG_BLANK // 2] if len(text) >= LONG_BLANK else ""
    if not any(a.isspace() and b.isspace() for a, b in zip(sample, sample[1:])):
        return _ids(texts, text)
    parts, at = [], 0
    for run in _BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [_ids(texts, text[at : run.start()]), _ids(_rust_bpe(ranks_path, True), text[run.start() : end])]
        at = end
    return np.concatenate([*parts, _ids(texts, text[at:])])


def count_pretoken(token: str, paths: tuple[str, str]) -> int:
    """Tokens of one pre-token or added token."""
    return 1 if token in added_tokens(paths[0]) else len(_ids(_rust_bpe(paths[1], True), token))


def encode(text: str, paths: tuple[str, str]) -> np.ndarray:
    """Ids (unsigned 32-bit) as ``tokenizers`` gives them without special tokens added.

    The rank file holds the same merges and is several times faster.  The text
    is first split at added tokens, as that library does.
    """
    added = added_tokens(paths[0])
    if not any(a in text for a in added):
        return _plain(text, paths[1])
    parts, at = [], 0
    for m in added_pattern(paths[0]).finditer(text):
        parts += [_plain(text[at : m.start()], paths[1]), np.array([added[m[0]]], np.uint32)]
        at = m.end()
    return np.concatenate([*parts, _plain(text[at:], paths[1])])
