import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from querymill.llm import token_counts as T
from tests.llm.helpers import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def random_texts(seed, n):
    rng = random.Random(seed)
    signs = "ab CD1²é \u0085\x1c\n\t 'sß漢<|endoftext|>#İΣς́e\xa0" + "".join(map(chr, range(256)))
    ends = ["", "<|endoftext|>x", "<|startoftext|> ", " ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "'re"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) + rng.choice(ends) for _ in range(n)]


def test_counts_are_those_of_the_library(spark):
    own = Tokenizer.from_file(PATH)
    texts = [*ODD, *random_texts(1, 3000), *[r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]]
    df = spark.createDataFrame([(t, "own") for t in texts + texts[:3]], "text string, n_tokens string")
    got = T.token_counts(df, PATH).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        n = len(own.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len((r["text"] or "").encode()), n, n > 2048), r["text"]
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_remembered_counts_stay_right_when_the_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 5)
    texts = random_texts(2, 200)
    own, counter = Tokenizer.from_file(PATH), T.Counter(PATH)
    for i in range(0, 200, 10):
        assert counter.count(texts[i:i + 10]) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts[i:i + 10]]
        assert len(counter.known) < 200


def test_merges_out_of_order_are_refused():
    symbols = T.byte_symbols()
    vocab = {s: i for i, s in enumerate([*symbols, *[c + "</w>" for c in symbols], "abc", "ab"])}
    with pytest.raises(ValueError):
        T.merges_of({"vocab": vocab, "end_of_word_suffix": "</w>", "merges": [["ab", "c"], ["a", "b"]]})
