"""Token ids of whole texts for tokenizers that provably never join two words, each distinct word encoded once.

Whether white space separates is read from the tokenizer file, not tried on examples: the normalizers must
work character by character within words, the pre-tokenizer must drop white space, nothing may be
added around a text, and no added token may touch white space. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from confab.llm.textkernel import _LOWER as LOWER
from confab.llm.textkernel import _SPACE as BLANK
from confab.llm.textkernel import flat, words

#: Normalizers that change nothing across a white space between two words: fixed values.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
#: Pre-tokenizers that split at all white space and drop it: fixed values.
_DROPPING = {"WhitespaceSplit", "Whitespace", "BertPreTokenizer"}
_BLANK = " \t\n\x0b\x0c\r"
MAX_WORDS = 200_000
#: 1 for ASCII letters, 2 for ASCII signs and digits.
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = 2
_KIND[65:91] = _KIND[97:123] = 1
#: Words of more bytes are not kept beyond their batch.
LONG = 256


def _steps(part: dict | None, key: str) -> list[dict]:
    if part is None:
        return []
    return [y for x in part[key] for y in _steps(x, key)] if part["type"] == "Sequence" else [part]


def _local(step: dict) -> bool:
    blank = step["type"] == "Replace" and step["pattern"].get("Regex") in (r"\s+", r"\s") and step["content"] == " "
    return step["type"] in _LOCAL or blank


#: A part of a pattern: a class without white space and letters or of letters, or one character.
_PART = r"(?P<other>\[\^\\s\\p\{L\}(?:\\p\{\w+\}|\\d)*\])\+?|(?P<letter>\[\\p\{L\}\]\+?|[A-Za-z])|(?P<digit>\[\\p\{N\}\]\+?)|(?P<sign>['-])"


def _parts(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern the kinds of its parts; None if it has any other part."""
    import regex

    if not regex.fullmatch(rf"(?:{regex.sub(r'[?]P<[a-z]+>', '?:', _PART)}|[|])+", pattern):
        return None
    parts = [[m.lastgroup for m in regex.finditer(_PART, own)] for own in pattern.split("|")]
    return parts if all(parts) else None


def _drops_blanks(step: dict) -> bool:
    """Whether no piece that a pre-tokenizer makes has white space, and white space is dropped."""
    if step["type"] in _DROPPING:
        return True
    if step["type"] != "Split" or step["behavior"] != "Removed":
        return False
    pattern = step["pattern"].get("Regex") or ""
    return _parts(pattern) is not None if step["invert"] else pattern in (r"\s+", r"\s")


def _ends_with_letters(step: dict) -> bool:
    """Whether every piece that has a letter before something else than a letter is split between them."""
    parts = _parts(step["pattern"].get("Regex") or "") if step["type"] == "Split" and step["invert"] else None
    return parts is not None and all(b == "letter" for own in parts for a, b in zip(own, own[1:], strict=False) if a == "letter")


def separates_words(config: dict) -> bool:
    """Whether ids of a text are the ids of its words (runs without ASCII white space), one after the other."""
    added = all(not (set(t["content"]) & set(_BLANK)) and not t["single_word"] for t in config.get("added_tokens") or [])
    pre = _steps(config.get("pre_tokenizer"), "pretokenizers")
    prefix = any(s.get("add_prefix_space") for s in pre if s["type"] == "ByteLevel")
    return added and config.get("post_processor") is None and all(map(_local, _steps(config.get("normalizer"), "normalizers"))) and bool(pre) and _drops_blanks(pre[0]) and not prefix


def folds_letters(config: dict) -> bool:
    """Whether, besides, letter case makes no difference and a word may be cut between an ASCII letter and an ASCII sign or digit."""
    lower = any(s["type"] == "Lowercase" for s in _steps(config.get("normalizer"), "normalizers"))
    return separates_words(config) and lower and _ends_with_letters(_steps(config["pre_tokenizer"], "pretokenizers")[0])


def split_pattern(config: dict) -> str:
    """The pattern that the first pre-tokenizer keeps the matches of; empty if it has none."""
    first = (_steps(config.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    return (first["pattern"].get("Regex") or "") if first.get("type") == "Split" and first["invert"] else ""


class WordIds:
    """Encodes columns of texts. Ids of words live in the Python worker across its tasks, about twice ``most`` at a time."""

    def __init__(self, path: str, most: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word, self.by_part = separates_words(config), folds_letters(config)
        self.added = [t["content"].lower().encode() for t in config.get("added_tokens") or []]
        self.most, self.new, self.old = most, {}, {}

    def ids(self, texts: list[str]) -> list[array]:
        return [array("i", e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, own: list[bytes]) -> list[bytes]:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = [new.get(w) or old.get(w) for w in own]
        lacking = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(lacking, self.ids([own[i].decode() for i in lacking]), strict=True):
            out[i] = x.tobytes()
        new.update((w, x) for w, x in zip(own, out, strict=True) if len(w) <= LONG)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, int32; where each text's ids end). A null text has none."""
        if not self.by_word:
            each = self.ids(["" if t is None else t for t in column.to_pylist()])
            return np.concatenate([*(np.frombuffer(x, np.int32) for x in each), np.zeros(0, np.int32)]), np.cumsum([len(x) for x in each], dtype=np.int64)
        data, offsets = flat(column)
        starts, ends, first = words(data, offsets)
        if self.by_part:
            lower = LOWER[data]
            if not any(lower.tobytes().find(t) >= 0 for t in self.added):  # added tokens are found as they are written
                data, kind = lower, _KIND[lower]
                inside = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
                starts, ends = (np.sort(np.concatenate([x, np.setdiff1d(inside, x, assume_unique=True)]), kind="stable") for x in (starts, ends))
                first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        letters = data[~BLANK[data]]
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        held = self._of_words(own.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(held), np.int32)
        size = np.array([len(x) // 4 for x in held], np.int64)
        at, which = np.cumsum(size) - size, own.indices.to_numpy()
        n = size[which]
        done = np.cumsum(n)
        ids = pool[np.arange(done[-1]) + np.repeat(at[which] - done + n, n)]
        return ids, np.concatenate([[0], done])[first[1:]]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]
