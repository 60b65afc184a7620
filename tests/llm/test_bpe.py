import json
import sys

import numpy as np
import pytest

from confab.llm import bpe
from tests.llm.support import awkward, prose, sha, table

public = pytest.importorskip("public_tokenizers")
ODD = ["<|endoftext|> a<|endoftext|>b", "it's o'the '' 3.14", "İstanbul ΣΑΣ é ́x", "a\u0085b c", "x" * 5000 + "y z", "ß ÿ × ÷ ª", prose(7, 3000), prose(7, 2990) + " other"]


@pytest.mark.parametrize("mask", [0x0, 0x7, 0xFF])
def test_chunked_ids_equal_whole_text_ids(mask):
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"), mask=mask, max_words=500, max_pieces=200, max_windows=200, max_chunks=50)
    texts = [*ODD, *(r[1] or "" for r in awkward())]
    for batch in (texts, texts[:3], texts[::-1], *([x] for x in texts)):
        for text, ids in zip(batch, enc.encode_all([x.encode() for x in batch]), strict=True):
            want = enc.ids(text)
            assert memoryview(ids).cast("i").tolist() == want
            assert enc.decode(ids).decode() == enc.tok.decode(want, skip_special_tokens=False)


def test_other_tokenizers_are_encoded_right_or_refused(tmp_path):
    """One that splits at white space only and keeps case, one with another pattern; those that may join words are refused."""
    config = json.load(open(public.path("word_bpe_49k.json")))
    split = config["pre_tokenizer"]["pretokenizers"][0] | {"pattern": {"Regex": r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"}}
    spaced = config | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "normalizer": None}
    other = config | {"pre_tokenizer": config["pre_tokenizer"] | {"pretokenizers": [split, *config["pre_tokenizer"]["pretokenizers"][1:]]}}
    texts = ["a one HELLO two b", "it's 2024, o'the IT'S", prose(3, 400) + " HELLO World's 12 34", *ODD[:3]]
    for name, own in (("spaced", spaced), ("other", other), ("own", config)):
        (tmp_path / name).write_text(json.dumps(own))
        enc = bpe.ChunkEncoder(str(tmp_path / name), mask=0x7)
        assert enc.by_piece == (name == "own")
        assert [memoryview(x).cast("i").tolist() for x in enc.encode_all([t.encode() for t in texts])] == [enc.ids(t) for t in texts]
    for name, own in (("joined", config | {"pre_tokenizer": None}), ("prefixed", config | {"normalizer": {"type": "Prepend", "prepend": "x"}})):
        (tmp_path / name).write_text(json.dumps(own))
        with pytest.raises(ValueError, match="provably"):
            bpe.ChunkEncoder(str(tmp_path / name))


def test_added_tokens_and_marks_split_off_are_not_cut(tmp_path):
    """An added token may stand inside a word; a mark that the normalizer splits off a letter joins the signs after it."""
    config = json.load(open(public.path("word_bpe_49k.json")))
    added = config | {"added_tokens": [*config["added_tokens"], config["added_tokens"][0] | {"id": 49408, "content": "Ab'c"}]}
    split_off = config | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}}
    texts = ["x1 xAb'cy ab'c 'Ab'c! it's z", "a caf\u00e9! \u00e9'S \u00c9\u00c9.. b", "so as it is 'there ''s a!'s 3's 'S' \u00d7'\u00c9\u00d7\u00d7 o'th\u00e9 end"]
    for name, own in (("added", added), ("split_off", split_off), ("own", config)):
        (tmp_path / name).write_text(json.dumps(own))
        enc = bpe.ChunkEncoder(str(tmp_path / name), mask=0x7)
        for cut in (texts, [" ".join(texts) + prose(4, 100)]):
            assert [memoryview(x).cast("i").tolist() for x in enc.encode_all([t.encode() for t in cut])] == [enc.ids(t) for t in cut]


def test_words_of_known_pieces_cost_no_python_calls_of_their_own():
    """15,000 distinct words of 300 runs of letters and 25 of signs."""
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"))
    runs = ["".join(chr(97 + int(d)) for d in str(7919 * i)) for i in range(1, 301)]
    signs = [a + b for a in ".,;:!" for b in "?*%$#"]
    text, calls = " ".join(case(r) + s for s in signs for r in runs for case in (str.title, str.upper)), [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    try:
        got = enc.encode_all([text.encode()])
    finally:
        sys.setprofile(None)
    assert memoryview(got[0]).cast("i").tolist() == enc.ids(text)
    assert calls[0] < 15_000


def test_passages_that_the_hash_never_cuts_are_cut_by_length(monkeypatch):
    monkeypatch.setattr(bpe, "MOST", 1 << 10, raising=False)
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"), mask=2**31 - 1)
    for text in ("\u4e2d\u00e9 it's " * 1_000, "\u4e2d" * 3_000 + " end", "ab " * 2_000):
        data = text.encode()
        at = [0, *bpe.cuts(np.frombuffer(data, np.uint8), 2**31 - 1).tolist(), len(data)]
        assert max(b - a for a, b in zip(at, at[1:], strict=False)) <= (1 << 10) + 3
        assert "".join(data[a:b].decode() for a, b in zip(at, at[1:], strict=False)) == text
        assert memoryview(enc.encode_all([data])[0]).cast("i").tolist() == enc.ids(text)


def test_shared_chunks_are_encoded_once():
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"))
    text = prose(9, 40_000).encode()
    enc.encode_all([text])
    first = enc.encoded
    enc.encode_all([b"before it " + text, text + b" and after"])
    assert enc.encoded - first < first / 10


def test_windows_that_do_not_agree_widen_to_the_text(monkeypatch):
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"), mask=0x7)
    text, all_ = prose(10, 50), enc._all
    monkeypatch.setattr(enc, "_all", lambda texts: [b"\0\0\0\0" + x if b" " in t and t != text.encode() else x for t, x in zip(texts, all_(texts), strict=True)])
    assert memoryview(enc.encode_all([text.encode()])[0]).cast("i").tolist() == enc.ids(text)


def test_query_digests(spark):
    rows = [*awkward(), (None, "no id", None), *((100 + i, t, "o") for i, t in enumerate(ODD))]
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(table(spark, rows)).collect()))
    enc = bpe.ChunkEncoder(public.path("word_bpe_49k.json"))
    want = []
    for d, t, _ in rows:
        ids = enc.ids(t or "")
        want.append((d or 0, len(ids), sha(" ".join(map(str, ids))), sha(enc.tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.token_digests(table(spark, [])).collect() == []
