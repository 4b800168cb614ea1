"""The trie of conversation prefixes, from adaptive radix trees over the ids of turns.

A turn's id is 16 bytes, a hash of role and text; a conversation's key is the ids of its turns, one after another. Keys are sorted and cut into ranges, equal ones by
conversation, so that a beginning or a whole conversation shared by any part of the table is split among tasks. Each task builds trees over short stretches of its
range (radix.py), which settle every prefix that lies wholly inside a stretch: most of them. What is left are the prefixes of the first and last key of each
stretch. Those are merged in one stream along the order of keys, of as many rows as there are stretches, times their depth.

A prefix's conversations that end there are hashed in their order. SHA-256 is sequential, so where such a list spans stretches, it is handed on in
pieces of text and read through by one task, which holds one piece at a time.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querymill.llm.radix import ROW, Tree
from querymill.session import Scratch

STRETCH = 1 << 18  # prefixes that the keys of one tree have at most, before those they share are folded; a longer key is a tree of its own
PIECE = 1 << 13  # conversations named by one piece of text
WORDS = "[^\\x20\\x09-\\x0D]+"
COUNTS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
SUMS = {"n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long"}
NODE = {c: "string" if c == "ends_sha256" else "long" for c in ROW}
SPINE = {"slot": "long", "name": "binary", "above": "binary", "conv_id": "long", "depth": "long", "words": "long", **SUMS}
ENDS = {"name": "binary", "number": "long", "text": "string"}
MERGED = {"name": "binary", "above": "binary", "conv_id": "long", "depth": "long", **SUMS}
HASHED = {"name": "binary", "ends_sha256": "string"}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in fields.items())


def _arrow(fields: dict[str, str]) -> list[tuple[str, pa.DataType]]:
    return [(name, KINDS[kind]) for name, kind in fields.items()]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of id and words) of ``turns`` (conv_id, turn, role, text), by turn, null first, then role and id; null role or text is empty.

    A row per conversation, so a task holds 16 bytes and a count for every turn of its longest one, but no text. Rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    told = F.struct(F.col("turn"), role.alias("role"), name.alias("id"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    listed = F.transform(F.sort_array(F.collect_list(told)), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(listed.alias("turns"))


def with_starts_of(scratch: Scratch, convs: DataFrame, other: Column, many: Column, most: int) -> DataFrame:
    """``convs`` (conv_id, turns) with the first ``many`` (``most`` at most) turns replaced by those of conversation ``other``, as many as that has."""
    convs = scratch.cut(convs)
    starts = scratch.cut(convs.select(F.col("conv_id").alias("other"), F.slice("turns", 1, most).alias("start")))
    joined = convs.withColumns({"other": other, "many": many}).join(starts, "other", "left")
    own = F.when(F.col("many") >= F.size("turns"), F.slice("turns", 1, 0)).otherwise(F.expr("slice(turns, cast(many + 1 AS int), size(turns))"))
    start = F.when(F.col("start").isNull(), F.slice("turns", 1, 0)).otherwise(F.expr("slice(start, 1, cast(many AS int))"))
    return joined.select("conv_id", F.concat(start, own).alias("turns"))


def trie(scratch: Scratch, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of ``convs`` (conv_id, unique; turns: array of id and words).

    conv_id is the smallest member, depth the number of turns, parent_conv_id the smallest member of the sequence one turn shorter (root: null), n_convs the members, n_children
    the sequences one turn longer, n_leaves those of its subtree without any, saved_tokens the sum over its subtree of (n_convs - 1) times the words of the last turn, and
    ends_sha256 the hash of the comma-joined conv_ids, ascending, of members that end there. Conversations without turns belong to the root. No conversations, no rows.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keyed = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ranges = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    parts = scratch.cut(ranges.mapInArrow(_trees, f"segment: long, node: struct<{_ddl(NODE)}>, spine: struct<{_ddl(SPINE)}>, ends: struct<{_ddl(ENDS)}>"))

    spine = parts.where("spine IS NOT NULL").select("segment", "spine.*")
    ends = parts.where("ends IS NOT NULL").select("segment", "ends.*")
    merged = scratch.cut(spine.repartition(1).sortWithinPartitions("segment", "slot").mapInArrow(_merged, _ddl(MERGED)))
    hashed = scratch.cut(ends.repartition("name").sortWithinPartitions("name", "segment", "number").mapInArrow(_hashed, _ddl(HASHED)))
    least = merged.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = merged.join(least, "above", "left").join(hashed, "name", "left")
    whole = whole.select(*COUNTS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    # Rows below a prefix of the spine find it by their own stretch, so no key has more of them than a stretch.
    parents = scratch.cut(spine.select("segment", "slot", F.col("name").alias("above")).join(least, "above").select("segment", "slot", F.col("parent_conv_id").alias("found")))
    nodes = parts.where("node IS NOT NULL").select("segment", "node.*").join(parents, ["segment", "slot"], "left")
    inner = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    return whole.unionByName(inner.select(*COUNTS, "ends_sha256"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a task's stretches of sorted keys."""
    tree, part, number = Tree(), None, 0
    for batch in batches:
        part = batch.column("part")[0].as_py() if part is None and len(batch) else part
        for key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words"))):
            tree.insert(key, conv, words)
            if tree.ids >= STRETCH:
                yield from _parts(tree, (part << 32) + number)
                tree, number = Tree(), number + 1
    if tree.ids:
        yield from _parts(tree, (part << 32) + number)


def _parts(tree: Tree, segment: int) -> Iterator[pa.RecordBatch]:
    rows, spine = tree.report()
    nodes = [{"node": dict(zip(ROW, row))} for row in rows]
    names = {"least": "conv_id", "members": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    spines = [{"spine": {names.get(k, k): v for k, v in s._asdict().items() if k != "ends"}} for s in spine]
    ends = [
        {"ends": {"name": s.name, "number": low, "text": ",".join(map(str, s.ends[low:low + PIECE]))}}
        for s in spine for low in range(0, len(s.ends), PIECE)
    ]
    schema = pa.schema([("segment", pa.int64()), *[(n, pa.struct(_arrow(f))) for n, f in (("node", NODE), ("spine", SPINE), ("ends", ENDS))]])
    every = nodes + spines + ends
    for low in range(0, len(every), PIECE):
        yield pa.RecordBatch.from_pylist([{"segment": segment, **row} for row in every[low:low + PIECE]], schema=schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of first and last keys, summed up over all trees that hold them.

    They come in the order of keys, so those that may still go on are the prefixes of the latest key: a stack.
    """
    stack, done = [], []

    def close(depth: int) -> None:
        while len(stack) > depth:
            top = stack.pop()
            top["n_leaves"] = top["n_leaves"] if top["n_children"] else 1
            top["saved_tokens"] += (top["n_convs"] - 1) * top["words"]
            if stack:
                stack[-1]["n_children"] += 1
                stack[-1]["n_leaves"] += top["n_leaves"]
                stack[-1]["saved_tokens"] += top["saved_tokens"]
            done.append(top)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if depth < len(stack) and stack[depth]["name"] == row["name"]:
                here = stack[depth]
                here["conv_id"] = min(here["conv_id"], row["conv_id"])
                for name in SUMS:
                    here[name] += row[name]
            else:
                close(depth)
                stack.append(row)
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(_arrow(MERGED)))
        done.clear()
    close(0)
    yield pa.RecordBatch.from_pylist(done, schema=pa.schema(_arrow(MERGED)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each prefix's pieces of text, joined by commas."""
    name, state = None, None
    for batch in batches:
        found = []
        for at, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            if state is None or at != name:
                if state is not None:
                    found.append({"name": name, "ends_sha256": state.hexdigest()})
                name, state = at, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema(_arrow(HASHED)))
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": state.hexdigest()}], schema=pa.schema(_arrow(HASHED)))
