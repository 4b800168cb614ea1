"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent pairs.

Every pair of neighbouring symbols that together are a piece waits on the agenda, the best score first and of equal scores the leftmost. The
best pair is merged, its new neighbours go on the agenda, and entries whose symbols have changed meanwhile are skipped. What is left when the agenda is
empty are the pieces; a character without a piece becomes its bytes. A long word of n characters takes n log n steps.

Merges never cross certain places: before a space mark that follows something else, and beside characters that no longer piece holds. Both are read from
the vocabulary. Texts are cut there, and a task remembers the ids of the words it has met.
"""

import functools
import heapq
import re
from array import array
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from querymill.llm.arrow import with_columns

SPACE = "▁"  # how pieces write a space
UNKNOWN = " ⁇ "  # how the library shows an unknown piece
REMEMBERED = 250_000  # words whose ids a task keeps; as many more, those that were met before, are given up when these are full
SHORT = 32  # characters of a word whose agenda is a list
NONE = float("-inf")
LONGEST = 200  # longer words are worked out each time
TEXTS = 512  # texts whose ids are held at once


class Pieces:
    """A vocabulary with byte pieces, whose normalizer only puts a space in front and writes spaces as marks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = own = SentencePieceProcessor(model_file=path)
        if own.normalize(" ﬁ\t①  a ") != SPACE + " ﬁ\t①  a ".replace(" ", SPACE):
            raise ValueError(f"{path} normalizes texts in another way")
        self.id, self.score, self.bytes, self.shown = {}, {}, {}, []
        for i in range(len(own)):
            piece = own.id_to_piece(i)
            if own.is_unused(i):
                raise ValueError(f"{path} holds unused pieces")
            if own.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.shown.append(bytes([int(piece[1:-1], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.shown.append(UNKNOWN.encode() if own.is_unknown(i) else b"")
            else:
                self.id[piece], self.score[piece] = i, own.get_score(i)
                self.shown.append(piece.replace(SPACE, " ").encode())
        if len(self.bytes) < 256:
            raise ValueError(f"{path} has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError(f"{path} has pieces that go on beyond a space")
        self.first_is_space = {i for p, i in self.id.items() if p.startswith(SPACE)}
        self.silent = {i for i in range(len(own)) if own.is_control(i)}
        joined = {c for p in self.id if len(p) > 1 for c in p} - {SPACE}
        letters = "".join(map(re.escape, sorted(joined)))
        self.words = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]" if joined else f"{SPACE}+|[^{SPACE}]")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        if "\n" in joined:
            raise ValueError(f"{path} has longer pieces with a line feed")

    def merge(self, word: str) -> list[str]:
        """The pieces of a word, and characters that are none."""
        return self._merge_short(list(word)) if len(word) <= SHORT else self._merge_long(list(word))

    def _merge_short(self, text: list[str]) -> list[str]:
        """The agenda is a list of the pairs' scores in their places, in which the best is looked for."""
        find = self.score.get
        agenda = [find(a + b, NONE) for a, b in zip(text, text[1:])]
        while agenda:
            best = max(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            text[i] += text.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = find(text[i - 1] + text[i], NONE)
            if i < len(agenda):
                agenda[i] = find(text[i] + text[i + 1], NONE)
        return text

    def _merge_long(self, text: list[str]) -> list[str]:
        """The agenda is a heap, in which entries stay whose symbols have changed."""
        n, score, push, agenda = len(text), self.score, heapq.heappush, []
        for i in range(n - 1):
            both = text[i] + text[i + 1]
            if both in score:
                agenda.append((-score[both], i, i + 1, both))
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if not text[left] or not text[right] or text[left] + text[right] != both:
                continue
            text[left], text[right] = both, ""
            first, next_ = before[left], after[right]
            after[left] = next_
            if next_ < n:
                before[next_] = left
                wider = both + text[next_]
                if wider in score:
                    push(agenda, (-score[wider], left, next_, wider))
            if first >= 0:
                wider = text[first] + both
                if wider in score:
                    push(agenda, (-score[wider], first, left, wider))
        return [t for t in text if t]

    def ids_of(self, word: str) -> bytes:
        found = []
        for piece in self.merge(word):
            at = self.id.get(piece)
            if at is None:
                found += [self.bytes[b] for b in piece.encode()]
            else:
                found.append(at)
        return array("i", found).tobytes()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """For each text, its ids as 32-bit integers, and whether the library gives every word of it the same ids."""
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, odd = self.known, self.older, {}
        new = [w for w in set().union(*cut) if w not in known]
        for word in new:
            (known if len(word) <= LONGEST else odd)[word] = older.get(word) or self.ids_of(word)
        self.check([w for w in new if w not in older], odd)
        look = (lambda w: odd.get(w) or known[w]) if odd else known.__getitem__
        ids = [b"".join(map(look, words)) for words in cut]
        return ids, [self.wrong.isdisjoint(words) for words in cut] if self.wrong else [True] * len(cut)

    def check(self, words: list[str], odd: dict[str, bytes]) -> None:
        """Let the library encode the words in one text, each after a line feed, which no longer piece holds."""
        if not words:
            return
        end = self.ids_of("\n")
        own = [odd.get(w) or self.known[w] for w in words]
        theirs = array("i", self.library.encode("\n" + "\n".join(words), num_threads=1)).tobytes()
        if theirs != self.ids_of(SPACE) + end + end.join(own):
            front = len(self.ids_of(SPACE) + end)
            for word, ids in zip(words, own):
                found = array("i", self.library.encode("\n" + word, num_threads=1)).tobytes()
                if found[front:] != ids:
                    self.wrong.add(word)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that make no character are shown as U+FFFD, one by one."""
        first = next((i for i in ids if self.shown[i]), None)
        # Bytes on both sides of a control piece, which shows nothing, are not one run.
        runs = [ids] if self.silent.isdisjoint(ids) else [list(run) for _, run in groupby(ids, self.silent.__contains__)]
        parts = []
        for data in (b"".join(map(self.shown.__getitem__, run)) for run in runs):
            try:
                parts.append(data.decode())
            except UnicodeDecodeError:
                parts.append(self._repaired(data))
        return "".join(parts)[first in self.first_is_space:]

    @staticmethod
    def _repaired(data: bytes) -> str:
        """Pieces are whole characters, so none of a broken run of bytes can be completed by what stands beside it."""
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at:at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, without=()) -> DataFrame:
    """``docs`` (text and any others) with ids (array<int>) of each whole text, and agrees: whether the sentencepiece library gives the same for each of its words.

    A null or empty text has no ids. Ids come from the agenda; the library only checks them, all words that are new to the task in one call for a few hundred
    texts of an Arrow batch.
    Own columns named ids or agrees are replaced; rows stay as they are, repeated ones too. ``path`` must be readable on every executor.
    """

    def make(batches):
        pieces = _pieces(path)
        for (texts,) in batches:
            values, agrees = [], []
            for low in range(0, len(texts), TEXTS):
                ids, same = pieces.encode([t or "" for t in texts[low:low + TEXTS].to_pylist()])
                values += ids
                agrees += same
            offsets = pa.array([0, *accumulate(len(ids) // 4 for ids in values)], pa.int32())
            flat = pa.array(np.frombuffer(b"".join(values), np.int32))
            yield [pa.ListArray.from_arrays(offsets, flat), pa.array(agrees, pa.bool_())]

    return with_columns(docs, ["text"], [("ids", "array<int>"), ("agrees", "boolean")], make, without=without)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (ids: array<int>, and any others) with decoded, the text that the library's decode(ids) gives; null ids and null arrays count as none.

    An own column named decoded is replaced. An id outside the vocabulary is an error.
    """

    def make(batches):
        pieces = _pieces(path)
        for (ids,) in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
            flat = ids.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            flat = pc.fill_null(flat, 0).to_numpy()
            # Row by row: the ids of a batch as Python numbers would take many times its size.
            rows = ((flat[low:high], there[low:high]) for low, high in zip([0, *ends], ends))
            yield [pa.array([pieces.decode(row[sound].tolist()) for row, sound in rows], pa.string())]

    return with_columns(tokens, ["ids"], [("decoded", "string")], make)
