"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not met before lie side by side in one array of symbols. In every round each
sequence finds its own lowest-ranked pair, all sequences merge at once, and those without a pair left are finished; what
is counted are the symbols that survive. A pair can only come from a merge of lower rank (checked when the vocabulary is read), so merging
all places of a sequence's lowest pair in one round gives what merging them one after another gives.
"""

import functools
import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from querymill.llm.arrow import with_columns

LIMIT = 2048
CACHED = 400_000  # pre-tokens whose counts a task remembers at a time
TEXTS = 512  # texts whose new pre-tokens are merged together

# Printable ASCII and Latin-1: no Unicode version, normal form or library changes these.
PLAIN = re.compile("[\t\n\r -~\xa1-\xff]*")
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
# The vocabulary's own pattern for such texts; a fixed value.
PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges(NamedTuple):
    first: np.ndarray  # symbol of a byte inside a pre-token
    final: np.ndarray  # and at its end
    pairs: np.ndarray  # left * size + right, sorted
    ranks: np.ndarray
    made: np.ndarray  # symbol that the merge of each rank makes
    size: int


def merges_of(model: dict) -> Merges:
    """The merges of a byte-pair model with word ends."""
    vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    size = max(vocab.values()) + 1
    listed = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([vocab[m[i]] for m in listed], np.int64) for i in (0, 1))
    made = np.array([vocab[a + b] for a, b in listed], np.int64)
    born = np.full(size, -1)
    born[made[::-1]] = np.arange(len(made))[::-1]
    if len(np.unique(made)) < len(made) or np.any(born[left] >= np.arange(len(made))) or np.any(born[right] >= np.arange(len(made))):
        raise ValueError("merges are not in the order in which their parts arise")
    keys = left * size + right
    order = np.argsort(keys)
    return Merges(
        np.array([vocab[c] for c in byte_symbols()]), np.array([vocab[c + suffix] for c in byte_symbols()]),
        keys[order], order, made, size,
    )


def survivors(words: list[str], merges: Merges) -> np.ndarray:
    """Symbols left of each word; every word has at least one byte."""
    encoded = [w.encode() for w in words]
    lengths = np.array([len(w) for w in encoded])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    symbols = merges.first[data]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = merges.final[data[ends - 1]]
    counts = lengths.copy()
    open_ = np.arange(len(words))  # words not finished; lengths and symbols are theirs
    none = len(merges.made)
    while len(open_):
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(open_)), lengths)
        keys = symbols[:-1] * merges.size + symbols[1:]
        at = np.searchsorted(merges.pairs, keys)
        at[at == len(merges.pairs)] = 0
        ranks = np.full(len(symbols), none)
        ranks[:-1] = np.where((merges.pairs[at] == keys) & (owner[:-1] == owner[1:]), merges.ranks[at], none)
        lowest = np.minimum.reduceat(ranks, starts)
        chosen = (ranks == lowest[owner]) & (ranks < none)
        # Of places that overlap, as in a run of one symbol, every other is merged, from the left.
        places = np.flatnonzero(chosen)
        fresh = np.ones(len(places), bool)
        fresh[1:] = np.diff(places) > 1
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        places = places[(np.arange(len(places)) - run) % 2 == 0]
        symbols[places] = merges.made[ranks[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        going = lowest < none
        keep &= going[owner]
        counts[open_[~going]] = lengths[~going]
        lengths = lengths - np.bincount(owner[places], minlength=len(open_))
        symbols, lengths, open_ = symbols[keep], lengths[going], open_[going]
    return counts


class Counter:
    """Counts tokens of texts as the tokenizer file's own library gives them, without special tokens added.

    Special strings inside a text are one token each. Texts of plain characters are split here, others by the
    library's normalizer and splitter; the merging is done here for all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as file:
            model = json.load(file)
        self.own = Tokenizer.from_file(path)
        if SPLIT not in json.dumps(model["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError(f"{path} splits texts in another way")
        self.merges = merges_of(model["model"])
        self.special = [t["content"] for t in model["added_tokens"]]
        self.parts = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_SPLIT.findall(text.lower())
        words = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in w).decode() for w, _ in words]

    def count(self, texts: list[str]) -> list[int]:
        found, fixed = [], []
        for text in texts:
            if any(s in text for s in self.special):
                fixed.append(len(self.parts.findall(text)))
                found.append([w for part in self.parts.split(text) for w in self.split(part)])
            else:
                fixed.append(0)
                found.append(self.split(text))
        new = list(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(set().union(*found))
        if new:
            self.known.update(zip(new, survivors(new, self.merges).tolist()))
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(fixed, found)]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, without=()) -> DataFrame:
    """``docs`` (text and any others) with n_bytes (UTF-8), n_tokens and over_limit of each whole text; a null text is empty.

    Own columns of these names are replaced.
    """

    def make(batches):
        counter = _counter(path)
        for (texts,) in batches:
            texts = pc.fill_null(texts, "")
            counts = [n for i in range(0, len(texts), TEXTS) for n in counter.count(texts[i:i + TEXTS].to_pylist())]
            yield [pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())]

    made = with_columns(docs.drop("over_limit"), ["text"], [("n_bytes", "long"), ("n_tokens", "long")], make, without=without)
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
