"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks at the same places wherever the same passage
stands. A task encodes each chunk once, whole, and reuses its ids across documents. Where two chunks
join, what was encoded apart is repaired: a window from the last white space of the one to the first of
the other, and a whole word further on both sides, is encoded anew. Its ids replace those of the cut
word if at both ends they agree with what the chunks have for the further words; where they don't, the
window widens to the text. Chunks without white space are part of the window. Windows always go to the
tokenizer as they stand; inside a chunk, words that were seen before keep their ids (white space is
dropped, no token crosses it). The new chunks of a batch are taken apart together, as arrays of bytes; only
their distinct parts are looked up. Stores are bounded and live in the Python worker, across its tasks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import table
from confab.llm.textkernel import _LOWER, tidy, words
from confab.llm.wordids import _steps, folds_letters, separates_words, split_pattern

CHUNK_MASK = 0x3FF
WINDOW = 16
MAX_WORDS = 100_000
MAX_PIECES = 200_000
MAX_WINDOWS = 15_000
MAX_CHUNKS = 5_000
#: Chunks, words and windows of more bytes are not kept beyond their batch.
LONG = 8192
BATCH_BYTES = 1 << 20
#: No chunk has more bytes: a passage that the hash never cuts, as one word again and again, is cut here.
MOST = 1 << 18
#: So many new pieces are one text for the tokenizer.
JOINED = 64
_GEAR = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64)
#: Where a tokenizer file splits by this pattern, after lower-casing and composing: fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_COMPOSING = {"NFC", "NFKC", "Lowercase", "Replace"}
#: words of printable ASCII and letters of Latin-1 only are split here as it splits them; others, and all of other tokenizers, go to the tokenizer whole.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
#: What the pattern matches as one, in UTF-8; contractions are not among them.
_PIECE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|(?:[!-/:-@\[-`{-~]|\xc3[\x97\xb7])+")


class Store:
    """A dict of at most about twice ``most`` entries; those not used for a while go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """Those of ``keys`` that aren't held; the others stay."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out

    def get(self, keys: list) -> tuple[list, list[int]]:
        """(what is held of each of ``keys``, or None; the places of None)."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        absent = [i for i, x in enumerate(out) if x is None]
        for i in absent:
            if (x := old.get(keys[i])) is not None:
                out[i] = new[keys[i]] = x
        return out, [i for i in absent if out[i] is None]


def cuts(data: np.ndarray, mask: int = CHUNK_MASK) -> np.ndarray:
    """Places at which the hash of the last ``WINDOW`` bytes, or its length, ends a chunk, never inside a character."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    gear = _GEAR[data]
    rolled = gear.copy()
    done = 1
    while done < WINDOW:  # sums of gear[i - j] << j over the window, doubled step by step
        rolled[done:] += rolled[:-done] << np.uint64(done)
        done *= 2
    hit = ((rolled >> np.uint64(WINDOW)) & np.uint64(mask)) == 0
    hit[:WINDOW] = False
    at = np.flatnonzero(hit) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    if len(data) <= MOST:
        return at
    edges = [0, *at.tolist(), len(data)]
    more = np.concatenate([np.arange(a + MOST, b, MOST) for a, b in zip(edges, edges[1:], strict=False)])
    for _ in range(3):  # back to the start of a character
        more -= (data[more] & 0xC0) == 0x80
    return np.union1d(at, more)


class Chunk(NamedTuple):
    """A chunk's first and last word (empty at white space), the words next to them inside with their ids, and the ids between."""

    head: bytes
    second: bytes
    second_ids: bytes
    body: bytes
    last: bytes
    last_ids: bytes
    tail: bytes


class ChunkEncoder:
    """Encodes and decodes whole texts; ids are kept as bytes of int32."""

    def __init__(self, path: str, mask: int = CHUNK_MASK, max_words: int = MAX_WORDS, max_pieces: int = MAX_PIECES, max_windows: int = MAX_WINDOWS, max_chunks: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if self.tok.decoder is not None or not separates_words(config):
            raise ValueError("only tokenizers that provably drop white space and have no decoder")
        composing = all(s["type"] in _COMPOSING for s in _steps(config.get("normalizer"), "normalizers"))
        self.by_piece = folds_letters(config) and composing and split_pattern(config) == _SPLIT
        after = _steps(config["pre_tokenizer"], "pretokenizers")[1:]
        self.joins = self.by_piece and all(s["type"] == "ByteLevel" and not s.get("use_regex", True) for s in after)
        self.added = [unicodedata.normalize("NFC", t["content"]).lower().encode() for t in config.get("added_tokens") or [] if t["content"]]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        tokens = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.large_string())
        self.mask = mask
        self.words, self.windows, self.chunks = Store(max_pieces if self.by_piece else max_words), Store(max_windows), Store(max_chunks)
        self.encoded = 0

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _all(self, texts: list[bytes]) -> list[bytes]:
        self.encoded += sum(map(len, texts))
        return self._each([x.decode() for x in texts])

    def _learn(self, new: list[bytes]) -> None:
        """Encodes words and pieces of words. Pieces that the tokenizer can't split share texts, cut by its own numbers of the pieces."""
        held, alone, single = self.words.new, [], []
        for x in new:
            (single if self.joins and _PIECE.fullmatch(x) else alone).append(x)
        groups = [single[i : i + JOINED] for i in range(0, len(single), JOINED)]
        for own, e in zip(groups, self.tok.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            of = e.word_ids
            n = np.bincount(of, minlength=len(own)) if of and None not in of else []
            if len(n) == len(own) and n.all():
                ids, ends = array("i", e.ids).tobytes(), (4 * n.cumsum()).tolist()
                held.update(zip(own, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                alone += own
        held.update(zip(alone, self._each([x.decode() for x in alone]), strict=True))

    def _ids_of(self, own: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct words or pieces ``own``; those that aren't held are encoded once."""
        out, lacking = self.words.get(own)
        new = [own[i] for i in lacking]
        self._learn(new)
        held = self.words.new
        for i, x in zip(lacking, new, strict=True):
            out[i] = held.pop(x) if len(x) > LONG else held[x]
        return out

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the words at ``starts``, lower-cased where they are split; where in them each piece begins).

        Pieces are runs of letters, with an apostrophe before them that no other sign stands before, single
        digits and runs of signs: the pattern has no match across their ends. Words with other characters
        or an added token are one piece as they stand.
        """
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts], inside[ends] = 1, -1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        if not self.by_piece:
            return data[inside], np.cumsum(ends - starts) - (ends - starts)
        low = _LOWER[data]
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)) + 1  # second bytes of letters of Latin-1
        second = low[at]
        low[at] = second + np.where((second <= 0x9E) & (second != 0x97), 0x20, 0).astype(np.uint8)
        kind = _KIND[low]
        kind[at] = kind[at - 1] = np.where(second | 0x20 == 0xB7, _SIGN, _LETTER)
        text = low.tobytes()
        for token in self.added:
            if token in text:
                for m in re.finditer(re.escape(token), text):
                    kind[m.start() : m.end()] = _ODD
        kind *= inside
        if len(odd := np.flatnonzero(kind == _ODD)):
            which = np.unique(np.searchsorted(starts, odd, side="right") - 1)
            whole = np.zeros(len(data) + 1, np.int8)
            whole[starts[which]], whole[ends[which]] = 1, -1
            whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
            low[whole], kind[whole] = data[whole], _ODD
        begin = kind != 0
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        sign = np.flatnonzero((low == 39) & (kind == _SIGN))  # white space stands around every word
        sign = sign[(kind[sign - 1] != _SIGN) & (kind[sign + 1] == _LETTER)]
        begin[sign + 1] = False
        return low[inside], np.flatnonzero(begin[inside])

    def _records(self, own: list[bytes]) -> list[Chunk | None]:
        """A record of each of ``own``; None for one without white space."""
        data = np.frombuffer(b"".join(own), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        starts, ends, first = words(data, offsets)
        some = first[1:] > first[:-1]
        lead, trail = some.copy(), some.copy()
        lead[some] = starts[first[:-1][some]] == offsets[:-1][some]
        trail[some] = ends[first[1:][some] - 1] == offsets[1:][some]
        inner = np.ones(len(starts), bool)
        inner[first[:-1][lead]] = False
        inner[first[1:][trail] - 1] = False
        rank = np.concatenate([[0], np.cumsum(inner)])[first]
        a, b = starts[inner], ends[inner]
        letters, places = self._pieces(data, a, b)
        cut = np.append(places, len(letters)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(cut), pa.py_buffer(letters)]).dictionary_encode()
        held = self._ids_of(parts.dictionary.to_pylist())
        pool, size = np.frombuffer(b"".join(held), np.int32), np.array([len(x) // 4 for x in held], np.int64)
        which = parts.indices.to_numpy()
        n = size[which]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(done[-1]) + np.repeat((np.cumsum(size) - size)[which] - done[:-1], n)].tobytes()
        at = np.concatenate([[0], np.cumsum(b - a)])  # where words begin in letters
        lo, hi = rank[:-1], rank[1:]
        full = (hi > lo).astype(np.int64)
        four = [4 * done[np.searchsorted(places, at[x])] for x in (lo, lo + full, hi - full, hi)]  # where the ids of the second word begin and end, and of the last
        a, b = np.append(a, 0), np.append(b, 0)
        in_chunk = [x - offsets[:-1] for x in (a[lo], b[lo], a[hi - full], b[hi - full])]
        head, tail = np.zeros(len(own), np.int64), offsets[1:] - offsets[:-1]
        head[lead] = ends[first[:-1][lead]] - offsets[:-1][lead]
        tail[trail] = starts[first[1:][trail] - 1] - offsets[:-1][trail]
        out = []
        for x, h, t, p, q, r, s, i, j, k, m in zip(own, *(y.tolist() for y in (head, tail, *in_chunk, *four)), strict=True):
            if h == len(x):
                out.append(None)  # one word, open on both sides
            elif i == m:
                out.append(Chunk(x[:h], b"", b"", b"", b"", b"", x[t:]))
            else:
                out.append(Chunk(x[:h], x[p:q], ids[i:j], ids[i:m], x[r:s], ids[k:m], x[t:]))
        return out

    def _learn_chunks(self, pieces_: set[bytes]) -> dict[bytes, Chunk | None]:
        """A record of each piece that isn't held, encoded once."""
        new = self.chunks.missing(x for x in pieces_ if len(x) <= LONG) + [x for x in pieces_ if len(x) > LONG]
        records, own, size = {}, [], 0
        for i, x in enumerate(new, 1):
            own.append(x)
            size += len(x)
            if size >= BATCH_BYTES or i == len(new):
                records.update(zip(own, self._records(own), strict=True))
                self.encoded += size
                own, size = [], 0
        self.chunks.new.update((x, r) for x, r in records.items() if len(x) <= LONG)
        return records

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text."""
        cut = []
        for text in texts:
            at = [0, *cuts(np.frombuffer(text, np.uint8), self.mask).tolist(), len(text)]
            cut.append([text[a:b] for a, b in zip(at, at[1:], strict=False) if b > a])
        fresh = self._learn_chunks({x for own in cut for x in own})
        held = self.chunks.new
        plans, asked = [], {}
        for own in cut:
            plan, open_, last, front = [], [], b"", b""
            for piece in own:
                r = fresh[piece] if piece in fresh else held[piece]
                if r is None:
                    open_.append(piece)
                    continue
                open_.append(r.head)
                if middle := b"".join(open_):
                    plan.append(window := (last, middle, r.second))
                    asked[window] = front, r.second_ids
                plan.append(r.body)
                open_, last, front = [r.tail], r.last, r.last_ids
            if middle := b"".join(open_):
                plan.append(window := (last, middle, b""))
                asked[window] = front, b""
            plans.append(plan)
        new = self.windows.missing(x for x in asked if len(x[1]) <= LONG) + [x for x in asked if len(x[1]) > LONG]
        local = {}
        for window, ids in zip(new, self._all([b" ".join(x for x in w if x) for w in new]), strict=True):
            front, back = asked[window]
            agrees = ids.startswith(front) and ids.endswith(back) and len(ids) >= len(front) + len(back)
            local[window] = ids[len(front) : len(ids) - len(back)] if agrees else None
        self.windows.new.update((w, x) for w, x in local.items() if len(w[1]) <= LONG)
        out = []
        for text, plan in zip(texts, plans, strict=True):
            parts = [x if isinstance(x, bytes) else local[x] if x in local else self.windows.new[x] for x in plan]
            out.append(self._all([text])[0] if None in parts else b"".join(parts))
        return out

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list, joined by a space."""
        tokens = self.tokens.take(ids.values)
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), pa.scalar(" ", pa.large_string())).cast(pa.string())

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(as_lists([ids]))[0].as_py().encode()


def as_lists(own: list[bytes]) -> pa.ListArray:
    """Ids of texts, kept as bytes of int32, as lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(own))]))


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, **kw) -> ChunkEncoder:
    key = (path, *sorted(kw.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, **kw)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, ids array<int>, decoded string), a row per input row.

    The whole text is encoded without special tokens added; a null or empty text has no ids, a null id is
    kept. Repeated rows give equal rows; other columns are ignored; an empty table gives no rows. The
    text decoded from the ids joins the tokens by a space, as a tokenizer without decoder does.
    ``tokenizer_path`` must be readable on the executors.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, **kw)
        for batch in batches:
            texts, first = batch.column(1), 0
            ends = np.cumsum(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset)[1:] - np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset)[:-1])
            while first < len(texts):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
                ids = as_lists(enc.encode_all(texts.slice(first, last - first).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), ids, enc.decode_all(ids)], ["doc_id", "ids", "decoded"])
                first = last
        tidy()

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_digests`` of all of ``documents``."""
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row per input row; cases as in ``encode_documents``."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    own = encode_documents(docs, tokenizer_path)
    return own.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
