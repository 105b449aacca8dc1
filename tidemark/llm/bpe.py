"""Byte-level BPE ids of whole texts, the same as the `tokenizers` library gives with add_special_tokens=False.

A tokenizer file whose merges are numbered in order after the 256 bytes, and whose splitting is the common pattern, can be
run by `tiktoken`, which gives the same ids several times faster. Any other file is run by `tokenizers` itself. Both are
kept for the life of a Python worker.

The matcher in `tiktoken` gives up on very long runs of white space. No piece of the splitting pattern holds white space after anything
else, so a text may be cut before any white space that follows something else without a change of ids. Where a
word or a run of white space is long, that part is cut out so and run by `tokenizers`.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Fixed values of the byte-level pre-tokenizer: its splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words and white space of so many characters go to `tokenizers`.
LONG = 1000
#: The characters with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHORT_RUNS = re.compile(rf"[{_SPACE}]{{0,{LONG - 1}}}+(?:[^{_SPACE}]{{1,{LONG - 1}}}+[{_SPACE}]{{1,{LONG - 1}}}+)*+[^{_SPACE}]{{0,{LONG - 1}}}+")
_UNIT = re.compile(rf"[{_SPACE}]*+[^{_SPACE}]{{{LONG},}}+|[{_SPACE}]{{{LONG},}}+[^{_SPACE}]*+")


def public_vocabulary() -> str:
    """The path of the 50k byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one free from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return found | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to a list of id sequences."""
    spec = json.load(open(path, encoding="utf-8"))
    fast = _ranked(spec)
    if fast is None:
        return lambda texts: [e.ids for e in reference(path).encode_batch(texts, add_special_tokens=False)]
    special = set(fast.special_tokens_set)

    def encode(text: str) -> list[int]:
        if len(text) < LONG or _SHORT_RUNS.fullmatch(text):
            return fast.encode(text, allowed_special=special)
        ids, at = [], 0
        for unit in _UNIT.finditer(text):
            ids += fast.encode(text[at : unit.start()], allowed_special=special)
            ids += reference(path).encode(unit.group(), add_special_tokens=False).ids
            at = unit.end()
        return ids + fast.encode(text[at:], allowed_special=special)

    return lambda texts: [encode(t) for t in texts]


@lru_cache(maxsize=4)
def reference(path: str):
    """The file as the `tokenizers` library reads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ranked(spec: dict):
    """The same vocabulary as ranks, or None where ranks can't stand for it."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"[{_SPACE}]", t["content"]) for t in spec.get("added_tokens", []))
    )
    if not plain:
        return None
    byte = _byte_of_symbol()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ordered = [model["vocab"].get("".join(m)) for m in merges] == list(range(256, 256 + len(merges)))
    if not ordered or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def token_bytes(path: str):
    """The length in bytes of every id of a byte-level vocabulary, as an array."""
    import numpy as np

    spec = json.load(open(path, encoding="utf-8"))
    special = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
    sizes = {i: len(token) for token, i in spec["model"]["vocab"].items()} | special
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out
