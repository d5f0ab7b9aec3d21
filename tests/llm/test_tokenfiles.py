import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelight.llm import queries, tokenfiles
from tidelight.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b", "a   b", " a", "a ", "a\n b", "x \n y", "  ", "a \ny", "a\n\n  b", "<|endoftext|> a", "é ñ  ", "don't 's", "a\t b   d"]


def expected(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_round_trip(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op8_token_files(spark, small).collect()]
    assert sorted(got) == expected(rows)


@pytest.mark.parametrize("size", [0, 1, 2, 255, 256, 257, 3000])
def test_elias_fano(size):
    rng = np.random.default_rng(size)
    for top in (1, size + 1, 10**6, 2**63):
        v = np.sort(rng.integers(0, top, size, dtype=np.uint64))
        seq = tokenfiles.EliasFano.from_bytes(tokenfiles.EliasFano.of(v).to_bytes())
        assert (seq.all() == v).all() and len(seq.all()) == size
        assert all(seq.select(i) == int(v[i]) for i in range(0, size, 7))


def test_odd_texts():
    tok, enc = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH)
    for t in ODD:
        assert enc.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_cases(spark, make_docs):
    rows = [(7, None), (None, "null id"), (-3, "b c"), (-3, "b c"), (-3, "a"), (2**62, "long " * 50_000), *enumerate(ODD)]
    df = tokenfiles.encode_documents(make_docs(rows, ["start", "k", "n_tokens"]), PATH, shard_bytes=1000)
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == expected(rows)
    assert tokenfiles.encode_documents(make_docs([]), PATH).collect() == []


def test_random_access(spark, make_docs, tmp_path):
    texts = [f"word{i} and more {i * i}" for i in range(600)]
    manifest = tokenfiles.write_files(make_docs(list(enumerate(texts))), PATH, f"file://{tmp_path}/out")
    shard = tokenfiles.Shard(manifest.first().path)
    tok = Tokenizer.from_file(PATH)
    for i in (0, 255, 256, 599):
        assert shard.document(i).tolist() == tok.encode(texts[i]).ids + [0]


def test_word_table_is_trimmed(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE_WORDS", 40)
    tok, enc = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH)
    for k in range(30):
        texts = [f"the word{k}x{i}, and the.\nEnd of{i} it" for i in range(k % 5 + 1)]
        assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t).ids for t in texts]
    assert len(enc.words) < 80
