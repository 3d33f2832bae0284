import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from groundspark.llm.bpe import Codec, encode_documents
from groundspark.llm.token_files import WordEncoder, decode_segment, encode_segment, token_file_digests

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = ["a", "B", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'LL", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "#", "😀", "é", "中", "the", " of", "\r\n", "…", "²"]


def texts(seed, n=600):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_equals_library():
    library, codec = Tokenizer.from_file(BYTE), Codec(open(BYTE, encoding="utf-8").read())
    for t in [*texts(1), "a" * 3000, "ab" * 2000]:
        ids = library.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)
    assert codec.encode(None) == b"" and codec.decode(b"") == ""


def test_word_encoder_equals_library():
    library, encoder = Tokenizer.from_file(WORD), WordEncoder(open(WORD, encoding="utf-8").read())
    some = texts(2)
    for t, packed in zip(some, encoder.encode(some)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_segments_round_trip(n):
    rng = random.Random(n)
    for _ in range(30):
        ids = np.array([rng.choice([5, 6, rng.randrange(50000), rng.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        data = encode_segment(ids)
        assert decode_segment(data).tolist() == ids.tolist()
        i, j = rng.randint(0, n), rng.randint(0, n + 2)
        assert decode_segment(data, i, j).tolist() == ids[i:j].tolist()


def test_encode_documents(spark, docs, empty):
    library = Tokenizer.from_file(BYTE)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in encode_documents(spark, docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_documents(spark, empty, BYTE).count() == 0


def test_token_files(spark, docs, empty):
    library = Tokenizer.from_file(WORD)
    got = {}
    for r in token_file_digests(spark, docs, WORD).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at, want = 0, {}
    for i, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert token_file_digests(spark, empty, WORD).count() == 0
