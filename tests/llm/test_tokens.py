import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer
from tokenizers import Tokenizer

from quernstone.llm import bpe_codec, token_counts

random.seed(7)
HARD = ["", " ", "  a", "a  b   ", "\n\n a\t b▁c", "<s> hi </s><0x0A>", "日本語 😀 zz" * 5, "é́" * 40, "a" * 3000, "ΑΣΣ Σ İstanbul ǅ", "<|endoftext|>a <|startoftext|>B<|endoftext|", "!" * 900, "x\x1cy\x85z​q", "I'LL don't '' 's ½ ² 12345", "".join(random.choice("thinge") for _ in range(9000))]


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    counter = token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"))
    assert [counter.count(x) for x in HARD] == [len(x) for x in sp.encode(HARD)]


def test_memo_stays_bounded():
    counter = token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"))
    counter.words.most = 50
    n = [counter.count(f"w{i} v{i * 7}") for i in range(200)]
    assert len(counter.words) <= 51 and n == [counter.count(f"w{i} v{i * 7}") for i in range(200)]


@pytest.mark.parametrize("leaf", [4, 64, 256])
def test_codec_equals_the_library(monkeypatch, leaf):
    monkeypatch.setattr(bpe_codec, "LEAF", leaf)
    want, codec = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), bpe_codec.Codec(tokenizer("word_bpe_49k.json"))
    for x in HARD:
        ids = want.encode(x, add_special_tokens=False).ids
        got = codec.encode(x)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert codec.decode(got) == want.decode(ids, skip_special_tokens=False)


def test_counts_of_odd_rows(odd, nothing):
    got = {r.doc_id: r for r in token_counts.count_tokens(odd, tokenizer("piece_bpe_32k.model"), limit=100).collect()}
    assert len(got) == 11 and got[2].n_tokens == got[3].n_tokens == 0 and got[3].n_bytes == 0 and got[1].n_tokens == got[5].n_tokens and got[1].over_limit and not got[8].over_limit
    assert token_counts.count_tokens(nothing, tokenizer("piece_bpe_32k.model")).count() == 0


def test_codec_of_odd_rows_and_spread_runs(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(bpe_codec, "SPREAD", 1000)
    want = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(12, "ab " + "thing" * 900 + " <|endoftext|> " + "q!" * 20 + "z" * 1500)]
    got = {r.doc_id: r for r in bpe_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("word_bpe_49k.json")).collect()}
    assert len(got) == 12
    for i, text in rows:
        ids = want.encode(text or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert got[i].decoded == want.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode_decode(nothing, tokenizer("word_bpe_49k.json")).count() == 0
