"""Hooks for models: plain callables on pandas batches, wrapped as Arrow UDFs.

A hook gets one Series per argument and returns one value per row. If a batch call raises, or
returns another number of replies, its halves are tried, so a bad row costs its own answer and never the task. Hooks count as
nondeterministic: Spark then never evaluates one twice for the same row of a plan.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

EMBEDDING_DIM = 64
_NGRAM = 3
# Odd 64-bit multipliers, one per place in a 3-gram; the top six bits of the product pick the bucket.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

TextHook = Callable[..., pd.Series]


def text_hook(hook: TextHook) -> Callable[..., Column]:
    """Wrap a text-returning hook; the column is ``struct<reply, error>``.

    Rows with a null in the first argument are not sent to the hook.
    """

    @F.pandas_udf("reply string, error string")
    def call(first: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"reply": None, "error": None}, index=first.index, dtype=object)
        asked = first.notna()
        if asked.any():
            args = [s[asked].reset_index(drop=True) for s in (first, *rest)]
            replies, errors = _call_rows(hook, args)
            out.loc[asked, "reply"] = replies
            out.loc[asked, "error"] = errors
        return out

    return call.asNondeterministic()


def _call_rows(hook, args):
    """Replies and errors by row. What fails as a whole is tried again in halves, so good rows are asked few times more."""
    n = len(args[0])
    try:
        replies = list(hook(*args))
        if len(replies) != n:
            raise ValueError(f"{len(replies)} replies for {n} rows")
        return replies, [None] * n
    except Exception as failure:  # noqa: BLE001 - any failure is an answer, not a lost task
        if n <= 1:
            return [None] * n, [str(failure)] * n
    halves = [_call_rows(hook, [a.iloc[s].reset_index(drop=True) for a in args]) for s in (slice(0, n // 2), slice(n // 2, n))]
    return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]


def embed_hook(hook: Callable[[pd.Series], list] | None = None) -> Callable[[Column], Column]:
    """Wrap an embedding hook; a failed row gets an empty vector, which matches nothing."""
    hook = hook or hashed_ngrams

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        vectors, _ = _call_rows(hook, [texts.fillna("").reset_index(drop=True)])
        return pd.Series([[] if v is None else np.asarray(v, dtype=np.float32) for v in vectors], index=texts.index)

    return call.asNondeterministic()


def hashed_ngrams(texts: pd.Series) -> list[np.ndarray]:
    """Default embedding: signed hashing of character 3-grams, unit length; the whole text counts."""
    return [_hashed(t) for t in texts]


def _hashed(text: str) -> np.ndarray:
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    mixed = sum(
        (chars[i : len(chars) - _NGRAM + 1 + i] * np.uint64(factor) for i, factor in enumerate(_FACTORS)), np.uint64(0)
    )
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_FACTORS[0])
    bucket, sign = mixed >> np.uint64(58), 1.0 - 2.0 * ((mixed >> np.uint64(57)) & np.uint64(1))
    vector = np.bincount(bucket.astype(np.int64), weights=sign, minlength=EMBEDDING_DIM)
    length = np.linalg.norm(vector)
    return (vector / length if length else vector).astype(np.float32)
