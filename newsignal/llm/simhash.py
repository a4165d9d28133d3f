"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, exact Hamming check.

Fingerprints are cut into ``blocks`` runs of bits. Two that differ in at most ``distance`` bits agree in at
least ``blocks - distance`` whole runs, so they share at least one key made of ``blocks - distance`` runs;
all such combinations are keys. Equal fingerprints are one node throughout, so copies cost nothing, and a
bucket hands on a spanning forest of its links and never its pairs. A bucket above ``cell`` nodes is split
into chunks and each pair of chunks becomes a cell of its own: every pair is still compared, by one task
that holds two chunks at most.

Defined results: null, empty or blank texts have the fingerprint zero and are linked like any other. Rows
with a null id are given the component of their group, but never name one. Repeated rows fall in the same
component. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import components, map_texts, materialise, stars

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_SEED = 42


def shingle_hashes(text: str | None, size: int = 4) -> np.ndarray:
    """XXH64 of the runs of ``size`` words, repeats included; a shorter text is one run, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], _SEED) for a, b in zip(starts[:count].tolist(), ends[-count:].tolist())), np.uint64, count)


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of the shingles of ``size`` words: a bit is set if it is set in over half of their XXH64."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at: at + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(ones * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every row."""
    def work(texts: pa.Array) -> dict[str, pa.Array]:
        found = np.fromiter((fingerprint(text.as_py(), size) for text in texts), np.uint64, len(texts))
        return {"bits": pa.array(found.view(np.int64))}

    return map_texts(docs, "bits long", work, ["doc_id"])


def _trees(bits: np.ndarray, distance: int, step: int = 1 << 21) -> np.ndarray:
    """For each fingerprint the first position of the component in which links of ``distance`` put it."""
    root = np.arange(len(bits))
    rows = max(1, step // max(1, len(bits)))
    for first in range(0, len(bits), rows):
        block = bits[first: first + rows]
        near = np.triu(np.bitwise_count(block[:, None] ^ bits[None, first:]) <= distance, 1)
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            trees = np.unique(root[np.flatnonzero(near[i]) + first])
            trees = trees[trees != root[i + first]]
            if len(trees):  # those within one tree add nothing
                trees = np.append(trees, root[i + first])
                root[np.isin(root, trees)] = trees.min()
    return root


def _links_of_runs(run: np.ndarray, bits: np.ndarray, node: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links within the runs of equal bucket numbers. Small runs are compared all at once, shift by shift."""
    small = 16
    edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    length = np.diff(np.append(edge, len(run)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = np.flatnonzero(np.repeat(length <= small, length))
    for shift in range(1, small):
        if len(low) <= shift:
            break
        x, y = low[:-shift], low[shift:]
        hit = (run[x] == run[y]) & (np.bitwise_count(bits[x] ^ bits[y]) <= distance)
        a.append(node[x[hit]])
        b.append(node[y[hit]])
    for first, size in zip(edge[length > small].tolist(), length[length > small].tolist()):
        ends = stars(node[first: first + size], _trees(bits[first: first + size], distance))
        a.append(ends[0])
        b.append(ends[1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def links(nodes: DataFrame, distance: int = 4, blocks: int = 7, cell: int = 512) -> DataFrame:
    """(a, b): links that connect the nodes (bits, node) whose fingerprints are near."""
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    keys = [sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    signed = [key - (1 << 64) if key >> 63 else key for key in keys]
    keyed = nodes.select("bits", "node", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(k)) for k in signed]))
                         .alias("table", "key"))
    # a bucket of one node links nothing; the sizes are narrow partial sums. Spark rates what was exploded as large as the
    # nodes, a key's worth of each, and would broadcast the sizes of all keys
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = keyed.join(sizes.hint("merge"), ["table", "key"])
    chunks = F.ceil(F.col("members") / cell).cast("int")
    chunk = F.pmod(F.xxhash64("bits"), chunks).cast("int")
    split = shared.select("table", "key", "bits", "node", chunk.alias("chunk"),
                          F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    place = ["table", "key", "low", "high"]
    split = (split.select("table", "key", F.least("chunk", "other").alias("low"),
                          F.greatest("chunk", "other").alias("high"), "bits", "node")
             .repartition(*place).sortWithinPartitions(*place, "bits"))

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            number = _numbered(rest, place)
            whole = int(np.searchsorted(number, number[-1])) if len(number) else 0
            if whole:  # the last bucket may go on in the next batch
                yield links_of(rest.slice(0, whole), number[:whole])
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield links_of(rest, _numbered(rest, place))

    def links_of(table: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        bits = table["bits"].to_numpy().view(np.uint64)
        return _links_of_runs(number, bits, table["node"].to_numpy(), distance)

    return split.mapInArrow(run, "a long, b long")


def _numbered(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Running number of the group of equal ``columns`` that a row of the sorted table belongs to."""
    changed = np.zeros(table.num_rows, dtype=bool)
    for name in columns:
        value = table[name].to_numpy()
        changed[1:] |= value[1:] != value[:-1]
    return np.cumsum(changed)


def classes(prints: DataFrame, distance: int = 4, blocks: int = 7, cell: int = 512) -> DataFrame:
    """bits, component_id (smallest doc_id reachable over links) of the fingerprints of ``prints`` (doc_id, bits)."""
    groups = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("node")))
    found = components(links(groups.filter("node is not null"), distance, blocks, cell))
    return groups.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4, blocks: int = 7, cell: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row."""
    prints = materialise(fingerprints(docs, size))
    named = classes(prints, distance, blocks, cell)
    return prints.join(named.hint("merge"), "bits").select(  # both are as long as the documents
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` (all columns) whose id names its group; of repeated rows of that id one stays.

    A row with a null id is kept: nothing says which group it may stand for.
    """
    named = near_duplicates(docs, **how)
    first = named.filter("doc_id = component_id").select("doc_id").distinct()
    stay = docs.join(first, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id is null"))
