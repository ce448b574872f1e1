import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pitchframe.llm.bpe import Codec, Vocabulary, bpe_digests
from pitchframe.llm.token_shards import END_ID, WaveletMatrix, _Encoder, open_shard, pack_shard, read_shards, token_shards, write_shards
from tests.llm.helpers import ODD, odd_docs

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_the_library(library):
    rng = random.Random(1)
    alphabet = "ab c \n\t'sdé日😀0٣½<|>endoftext.!  \x1f\x85"
    texts = ["", " ", "  ", "a  b", "a   b\n", "a \n \nb", "x\n \ny", "a  b", "<|endoftext|>", "a <|endoftext|> b",
             "it's don't WE'LL 's", "a" * 3000, "　 　x", " " * 300 + "x", "ab" * 2000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    codec = Codec(Vocabulary(PATH, P.PATTERN))
    for found, text, e in zip(codec.encode(texts), texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [int(i) for x in found for i in x[1].split(",") if i] == e.ids, repr(text)
        assert b"".join(x[2] for x in found).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_pairs_found_compatible_are_exact():
    v = Vocabulary(PATH, P.PATTERN)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    exact = v.merge([v.bytes[a] + v.bytes[b] for a, b in zip(x, y)])
    assert v.compatible(x, y).tolist() == [e == [a, b] for e, a, b in zip(exact, x.tolist(), y.tolist())]


def test_long_words_are_merged_exactly_and_fast(library):
    import time

    rng = random.Random(2)
    v = Vocabulary(PATH, P.PATTERN)
    words = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)) for n in (300, 20_000)]
    words += ["".join(rng.choices("abcdeé", k=4000)), "a" * 3000, "".join(rng.choices("ab", k=3000)), "日本" * 400]
    began = time.process_time()
    got = [v.merge_long(w.encode()) for w in words]
    assert time.process_time() - began < 3
    assert got == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    short = ["".join(rng.choices("abcdeést ", k=rng.randint(1, 30))).replace(" ", "").encode() or b"a" for _ in range(500)]
    assert [v.merge_long(w) for w in short] == v.merge(short)


def test_bpe_digests_of_odd_rows(spark, library):
    got = bpe_digests(odd_docs(spark), PATH, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(ODD)
    want = set()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got} == want
    assert bpe_digests(odd_docs(spark).limit(0), PATH, P.PATTERN).count() == 0


def test_wavelet_matrix_answers_from_the_file():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 6, n), rng.integers(0, 50257, n)).astype(np.uint16)
        wm, lengths = open_shard(pack_shard(ids, [n], 16))
        assert isinstance(wm, WaveletMatrix) and lengths.tolist() == [n]
        assert wm.ids(np.uint16).tolist() == ids.tolist()
        assert all(wm.access(i) == ids[i] for i in range(0, n, 37))
        for t in (0, 3, 50256):
            assert wm.occurrences(t) == np.flatnonzero(ids == t).tolist()
            assert wm.rank(t, n // 2) == int((ids[:n // 2] == t).sum())
        assert wm.select(3, 10**6) == -1 and wm.rank(1 << 20) == 0


def test_shards_hold_all_documents_in_id_order(spark, library, tmp_path):
    df = odd_docs(spark)
    path = str(tmp_path / "shards")
    write_shards(df, path, PATH, shard_tokens=5)
    assert spark.read.parquet(path).count() > 3
    got = sorted(read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    start = 0
    texts = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (_, t) in zip(got, texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_shards(df.limit(0), PATH).count() == 0


def test_shard_encoder_equals_the_library(library):
    rng = random.Random(7)
    alphabet = "ab c \n\t'sdé日😀0٣½<|>endoftext.,!:  \x1f\x85\r\v"
    texts = ["", " ", "a", "a\nb", "a\n", "\na", "a \nb", "a\n\nb", "word.", "word. next", "word.\nNext", "it's. don't, 's. x",
             "a.b. c,d", "ab.. c", "a. b. c. d", "\ra", "a\vb", "a b", "日本. 語\nx", "x<|endoftext|>. y", "½. 0. a.",
             " ".join(["long"] * 5000), "w" * 3000 + ". x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("abé.,'\n") for _ in range(rng.randint(1, 6))) for _ in range(9)) for _ in range(2000)]
    encoder = _Encoder(PATH)
    for batch in (texts[:23], texts, texts[::-1], []):
        ids, lengths = encoder.encode(pa.array(batch, pa.string()))
        want = [e.ids + [END_ID] for e in library.encode_batch(batch, add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_shards_do_not_depend_on_cuts(spark, tmp_path, library):
    """Small shards and small pieces of a batch give the same rows; texts of one id and null ids are split."""
    rows = [(i // 3 if i % 7 else None, f"text {i % 11}. and\nmore {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write_shards(docs, str(tmp_path / "s"), PATH, shard_tokens=100)
    got = read_shards(spark, str(tmp_path / "s")).collect()
    want = sorted((i, zlib.crc32(np.array(library.encode(t).ids + [END_ID], "<u4").tobytes())) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.ids_crc32) for r in got if r.doc_id is not None) == want and len(got) == 400
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None] == [i for i, _ in want]
