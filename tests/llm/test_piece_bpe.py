import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from querymill.llm import piece_bpe as P
from querymill.llm.queries import QUERIES
from tests.llm.helpers import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def random_texts(seed, n):
    rng = random.Random(seed)
    signs = "ab CD  1²é\u0085\x1c\n\t 'sß漢字▁<s></s><0x41>#İΣςé\xa0　\x00😀𓀀▁▁▁    " + "".join(map(chr, range(256)))
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_and_texts_are_those_of_the_library(spark, library):
    texts = [*ODD, " " * 1000, "  a", "a ", "▁a", *random_texts(1, 2000)]
    df = spark.createDataFrame([(t, [7], "own") for t in texts + texts[:3]], "text string, ids array<int>, `own.column` string")
    got = P.decode(P.encode(df, PATH), PATH).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        want = library.encode(r["text"] or "")
        assert r["ids"] == want and r["agrees"] and r["decoded"] == library.decode(want) and r["own.column"] == "own", r["text"]
    assert P.decode(P.encode(df.limit(0), PATH), PATH).count() == 0


def test_any_ids_decode_as_in_the_library(library):
    own, rng = P.Pieces(PATH), random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(300) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_null_ids_count_as_none(spark, library):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, library.piece_to_id("▁"), None])], "n int, ids array<int>")
    assert {r["n"]: r["decoded"] for r in P.decode(df, PATH).collect()} == {1: "", 2: "", 3: ""}


@pytest.mark.parametrize("short", [0, P.SHORT])
def test_the_best_pair_comes_first_and_of_equals_the_leftmost(monkeypatch, short):
    monkeypatch.setattr(P, "SHORT", short)
    own = P.Pieces(PATH)
    own.score = {"aa": 0.0, "ab": 1.0, "aab": 0.0}
    assert own.merge("aaaab") == ["aa", "aab"] and own.merge("aaa") == ["aa", "a"] and own.merge("") == []


def test_the_check_tells_texts_apart():
    own = P.Pieces(PATH)
    right = own.ids_of("▁wrong")
    own.ids_of = lambda word, plain=own.ids_of: plain("▁other" if word == "▁wrong" else word)
    ids, agrees = own.encode(["so wrong", "so right", "", "wrong\n\n again"])
    assert agrees == [False, True, True, False] and right not in ids
    assert own.encode(["right", "wrong"])[1] == [True, False]


def test_what_is_remembered_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    monkeypatch.setattr(P, "LONGEST", 3)
    monkeypatch.setattr(P, "SHORT", 5)
    own = P.Pieces(PATH)
    for text in random_texts(3, 300):
        assert own.decode(library.encode(text)) == library.decode(library.encode(text))
        assert own.encode([text]) == ([b"".join(i.to_bytes(4, "little") for i in library.encode(text))], [True])
        assert len(own.known) < 60 and len(own.older) < 60


def test_registered_query_over_whole_tables(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_piece_bpe"](spark, SF)
    assert not got.where("NOT agrees").count()
    assert {r["doc_id"] for r in got.select(F.col("doc_id")).collect()} == docs.keys()
    for r in got.collect():
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
