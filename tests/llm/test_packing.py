import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tokenizers

from querymill.llm import packing as P
from querymill.llm.queries import byte_bpe
from querymill.session import Scratch
from tests.llm.helpers import ODD


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 1000) for _ in range(rng.randrange(1, 60))}
    made = P.plan(counts, 64)
    placed = defaultdict(int)
    for k, inside in made:
        assert k > 0 and sum(inside) <= 64 and sum(n * 3 > 64 for n in inside) <= 2
        for n in inside:
            placed[n] += k
    assert placed == counts
    bins, least = sum(k for k, _ in made), -(-sum(n * k for n, k in counts.items()) // 64)
    large = sum(k for n, k in counts.items() if n * 2 > 64)
    assert bins <= max(least, large) * 1.25 + 1 and len(made) <= 64 * 8


def test_ids_are_those_of_the_tokenizer():
    own, encode = tokenizers.Tokenizer.from_file(byte_bpe().path), P._encoder(byte_bpe())
    rng = random.Random(2)
    signs = "ab CD1²é \u0085\n\t 'sß漢<|endoftext|>#" + "".join(map(chr, range(256)))
    for text in [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(500)]:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def test_documents_are_whole_and_sequences_full(spark):
    rows = [(i, t, "own") for i, t in enumerate(ODD)] + [(None, "no id", None), (3, "a", "own"), (3, "a", "own")]
    rows += [(100 + r["doc_id"], r["text"], "own") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, number string").repartition(5)
    with Scratch(spark) as scratch:
        packed = P.pack_documents(scratch, df.select("doc_id", "text"), byte_bpe())
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        got = packed.collect()
        assert P.pack_documents(scratch, df.limit(0), byte_bpe()).count() == 0
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for inside in bins.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= 1024
    encode = P._encoder(byte_bpe())
    for doc_id, text, _ in rows:
        if doc_id == 3:
            assert len(docs[3]) == 3
            continue
        ids, at = [*encode(text or ""), 2], 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(docs[doc_id]) == 1) == (len(ids) <= 1024)
        assert [r["piece"] for r in sorted(docs[doc_id], key=lambda r: r["start"])] == list(range(len(docs[doc_id])))
    tokens = sum(r["length"] for r in got)
    assert len(bins) <= -(-tokens // 1024) * 1.05 + 1
