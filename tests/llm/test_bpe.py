import base64

import numpy as np
import public_tokenizers
import tiktoken
from tests.llm.texts import TEXTS, docs

from pulsegrid.llm.bpe import Encoder, PerfectHash, Vocabulary, tokenize

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_finds_each_key_and_no_other():
    keys = [f"key{i}".encode() for i in range(3000)] + [b""]
    table = PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(len(keys)))
    assert all(table.find(f"other{i}".encode()) == -1 for i in range(3000))
    assert PerfectHash([]).find(b"x") == -1


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    enc = reference()
    got = tokenize(docs(spark), PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(got) == len(TEXTS)
    want = sorted(((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in TEXTS), key=str)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in TEXTS)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_odd_white_space_and_pieces():
    enc, own = reference(), Encoder(Vocabulary(PATH, public_tokenizers.PATTERN))
    for text in ("  a", "a  ", "a \n b", "\n\n a", "a  b", " ", "  \n  x  \t", "'s 're it's I'LL", "¹²³ ٣ ab12", "\u0000\u0001", "a" * 5000 + " " * 5000, "퟿", "🏳️‍🌈 é"):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == enc.encode_ordinary(text), text
        assert own.decode(own.encode(text)).decode() == text


def test_empty_table(spark):
    assert tokenize(docs(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
