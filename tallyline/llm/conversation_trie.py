"""A prefix trie of conversations, merged family first.

A family is a base conversation and those rebuilt from its first turns. Its conversations meet by base id (the texts stay
behind: a turn is a digest and a number of words), are rebuilt and make a small trie. Only the nodes of these tries are
shuffled, a row for each family and node, and equal prefixes merge to the nodes of the whole. What is summed over subtrees
takes no level by level: a node of the whole is given to the family of its smallest member, each family sums the subtrees
of its own trie, and the sums of families are added, for all ancestors of a node are in the trie that it was given to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.mixing import word_count
from tallyline.llm.tables import written

#: The digest of the root, and where the chain of digests begins.
ROOT = hashlib.sha256(b"").digest()
NODES = pa.schema([("base", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.string())])
NODES_DDL = "base long, node binary, parent binary, depth long, conv_id long, n_convs long, words long, ends string"


def base_of(conv_id: Column, size: int) -> Column:
    return conv_id - conv_id % size


def turns(conversations: DataFrame, size: int) -> DataFrame:
    """base, conv_id, turn, digest of (role, text), words of the text; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    key = F.col("conv_id").cast("long")
    return conversations.select(key.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), word_count(text).alias("words")).where("conv_id IS NOT NULL").select(base_of(F.col("conv_id"), size).alias("base"), "*")


def _by_conversation(rows: pa.Table) -> dict[int, list]:
    out: dict[int, list] = {}
    for conv, turn, digest, words in zip(*(rows[c].to_pylist() for c in ("conv_id", "turn", "digest", "words")), strict=True):
        out.setdefault(conv, []).append((turn is not None, turn or 0, digest, words))
    return {conv: sorted(x) for conv, x in out.items()}


def _family(most: int) -> Callable:
    def family(base: pa.Table, others: pa.Table) -> pa.Table:
        """The trie of a family: base has the rows of its base conversation, others those of all others."""
        first = _by_conversation(base)
        own = first | _by_conversation(others)
        start = next(iter(first.values()), [])
        nodes: dict[bytes, list] = {}
        for conv in sorted(own):
            h = crc32(str(conv).encode()) % most
            node, parent, depth, words = ROOT, None, 0, 0
            path = start[:h] + own[conv][h:]
            for depth_of in range(len(path) + 1):
                if depth_of:
                    parent, depth, words = node, depth_of, path[depth_of - 1][3]
                    node = hashlib.sha256(node + path[depth_of - 1][2]).digest()
                entry = nodes.setdefault(node, [parent, depth, conv, 0, words, []])
                entry[3] += 1
            entry[5].append(str(conv))
        which = (base if base.num_rows else others)["base"][0].as_py()
        columns = list(zip(*nodes.values(), strict=True))
        return pa.table([[which] * len(nodes), list(nodes), *columns[:5], [",".join(x) for x in columns[5]]], schema=NODES)

    return family


def _subtrees(own: pa.Table, given: pa.Table) -> pa.Table:
    """Sums over the subtrees of a family's trie of what its nodes were given."""
    at = {n: i for i, n in enumerate(own["node"].to_pylist())}
    parents, depths = own["parent"].to_pylist(), own["depth"].to_pylist()
    leaves, saved = [0] * len(at), [0] * len(at)
    for node, leaf, tokens in zip(*(given[c].to_pylist() for c in ("node", "leaf", "tokens")), strict=True):
        leaves[at[node]], saved[at[node]] = leaf, tokens
    for i in sorted(range(len(at)), key=lambda i: -depths[i]):
        if parents[i] is not None:
            up = at[parents[i]]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    some = [i for i in range(len(at)) if leaves[i] or saved[i]]
    return pa.table({"node": own["node"].take(pa.array(some, pa.int64())), "n_leaves": pa.array([leaves[i] for i in some], pa.int64()), "saved_tokens": pa.array([saved[i] for i in some], pa.int64())})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends in the order of families -> SHA-256 of each node's ends, comma-joined; one digest is held at a time."""
    node, digest = None, None
    for batch in batches:
        nodes, digests = [], []
        for n, ends in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if n != node:
                if digest:
                    nodes.append(node)
                    digests.append(digest.hexdigest())
                node, digest = n, hashlib.sha256(ends.encode())
            else:
                digest.update(f",{ends}".encode())
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


def conversation_trie(conversations: DataFrame, size: int = 20, most: int = 4) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns go by turn (null first); those with equal turns by the digest of role
    and text, so that any order of rows gives the same trie. Null roles and texts are empty. Conversation c is rebuilt
    from the first crc32(c) % most turns of conversation c - c % size and its own turns after as many. A node is a
    sequence of first turns; its members are the rebuilt conversations that begin with it, and conv_id is the smallest.
    saved_tokens counts the words that members share: for each node of the subtree, its words times members but one.

    Rows without a conv_id belong to no conversation. Rows that repeat all columns are turns of their own. An empty table
    has no conversation and no root. Other columns are not read. Equal prefixes are told by chained SHA-256 digests.
    """
    rows = turns(conversations, size)
    bases, rest = rows.where("conv_id = base"), rows.where("conv_id <> base")
    families = written(bases.groupBy("base").cogroup(rest.groupBy("base")).applyInArrow(_family(most), NODES_DDL))

    merged = families.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("parent").alias("parent"))
    merged = written(merged)
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), drop=(merged,))

    given = nodes.select(base_of(F.col("conv_id"), size).alias("base"), "node", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    sums = families.select("base", "node", "parent", "depth").groupBy("base").cogroup(given.groupBy("base")).applyInArrow(_subtrees, "node binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # Families are ranges of ids, so their lists follow each other in the order of the bases.
    ends = families.where("ends <> ''").select("node", "base", "ends").repartition("node").sortWithinPartitions("node", "base")
    ends = ends.select("node", "ends").mapInArrow(_joined, "node binary, ends_sha256 string")

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
