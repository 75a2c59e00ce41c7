"""Self-join of documents on the Jaccard similarity of their five-word shingles, exact, and its components.

Sets with one content are one node. In a global order of tokens, rare before frequent, two similar sets share a token of
their prefixes (n - ceil(t n) + 1 tokens), and k tokens of the prefixes that are k - 1 longer. Rare tokens are indexed
alone. A frequent token whose bucket still joins many different components after the first links is indexed in
combinations with a second token of the longer prefix. All candidates that could matter are verified on the whole sets.

1. count tokens, in 24-bit buckets by hash range; those above a threshold are the frequent class
2. index the prefixes by token; in each bucket, propose the pairs with the bucket's first node (linear in the bucket)
3. verify each node's best proposal, and find components
4. in buckets that still hold several components, compare the nodes outside the largest with all, in NumPy blocks of
   bounded size: by size, by place (the first token that two sets share leaves only the tokens after it) and by a bit
   sketch of the sets, all of which are upper bounds of the overlap; what they don't refute is verified
5. buckets with too many such pairs: the same over combinations of two tokens; first only with each node's most
   promising pair, then, when these have joined most components, with all that are left

Pairs inside one component aren't looked at again, so a group of copies costs its size, not its square; no pair of
different components that share a bucket is left out. Blocks of packed arrays travel between tasks instead of rows, and
only pairs that pass all bounds become rows. A token or node with many rows is dealt over tasks by a salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, salted_join, small_batches, text_or_empty, written
from corvane.llm.components import merged, trees
from corvane.llm.hashing import mix, texts_shingles

PERCENT = 80
#: Tokens above this count may be frequent; the class holds the most frequent at most MAX_FREQUENT (which are broadcast).
FREQUENT_FROM, MAX_FREQUENT = 16, 1 << 20
#: A part holds about so many tokens; a task packs so many before it sends them.
PART_TOKENS, FLUSH = 1 << 21, 1 << 19
#: Sets that a task remembers, so as not to send them again; then it starts anew.
SEEN = 1 << 16
#: A bucket with more pairs across components than this for each member goes on to combinations.
DIRECT = 48
#: Bits of the filter of nodes whose sets are wanted; when too many nodes set too many bits, more sets are moved, no fewer.
BLOOM_BITS = 1 << 25
#: Scores are similarities in this unit.
SCORE = 1 << 20
#: Bits of a set's sketch. A bucket is compared in blocks of so many entries a side; a chunk holds so many pairs at once.
SKETCH_BITS, BLOCK, CHUNK = 2048, 2048, 1 << 16

_ENTRIES = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("tokens", "nodes", "sizes", "places"))])


def _needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap with any partner."""
    return -(-PERCENT * n // 100)


def _node(shingles: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64).item()


def _sets(batches: Iterator[pa.RecordBatch], once: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Each non-empty set's node and tokens; with ``once`` a task skips sets that it has seen lately."""
    seen: set[int] = set()
    for batch in batches:
        for _, tokens in texts_shingles(batch.column("text")):
            if len(tokens):
                node = _node(tokens)
                if not once or node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    yield node, tokens


def _sketch(tokens: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH_BITS, dtype=bool)
    bits[(tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _map_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sketch: list[bytes | None] = [None] * batch.num_rows
        for i, tokens in texts_shingles(batch.column("text")):
            size[i] = len(tokens)
            if len(tokens):
                node[i], sketch[i] = _node(tokens), _sketch(tokens)
        made = [batch.column("doc_id"), batch.column("key"), pa.array(size), pa.array(node), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays(made, ["doc_id", "key", "n_shingles", "node", "sketch"])


# --- token counts ---------------------------------------------------------------------------------------------------


def _steps(values: np.ndarray) -> bytes:
    """Ascending values as 16-bit steps; 65535 goes on without a value."""
    step = np.diff(values, prepend=0)
    length = step // 65535 + 1
    out = np.full(int(length.sum()), 65535, dtype="<u2")
    out[np.cumsum(length) - 1] = step % 65535
    return out.tobytes()


def _from_steps(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, dtype="<u2")
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _ids(tokens: np.ndarray, bits: int, low: int) -> np.ndarray:
    """A token's part and place in it as one number."""
    return (tokens >> np.uint64(64 - bits - low)).astype(np.int64)


def _map_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ids, count = np.unique(_ids(np.concatenate(held), bits, 24), return_counts=True)
            bound = np.searchsorted(ids, np.arange((1 << bits) + 1, dtype=np.int64) << 24)
            rows = []
            for part in range(1 << bits):
                own, c = ids[bound[part] : bound[part + 1]] & 0xFFFFFF, count[bound[part] : bound[part + 1]]
                if len(own):
                    more = np.flatnonzero(c > 1).astype("<u4")
                    rows.append((part, _steps(own), more.tobytes(), (c[more] - 1).astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "steps", "more", "extra"])

        for _, tokens in _sets(batches):
            held.append(tokens)
            n += len(tokens)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _reduce_counts(blocks: pa.Table) -> pa.Table:
    """By level (the power of two of the count): the tokens of one part that may be frequent, and their counts."""
    total = np.zeros(1 << 24, dtype=np.uint32)
    for steps, more, extra in zip(*(blocks.column(c).to_pylist() for c in ("steps", "more", "extra")), strict=True):
        own = _from_steps(steps)
        total[own] += 1
        total[own[np.frombuffer(more, "<u4")]] += np.frombuffer(extra, "<u4")
    part = blocks.column("part")[0].as_py()
    ids = np.flatnonzero(total >= FREQUENT_FROM)
    level = np.floor(np.log2(total[ids])).astype(int)
    rows = [(int(x), int((level == x).sum()), ((part << 24) | ids[level == x]).astype("<i8").tobytes(), total[ids[level == x]].astype("<u4").tobytes()) for x in np.unique(level)]
    names = (("level", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()))
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(names)})


def _frequent(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the frequent class. At most MAX_FREQUENT come to the driver: the level they start from rises as needed."""
    blocks = docs.mapInArrow(_map_counts(bits), "part int, steps binary, more binary, extra binary")
    levels = written(blocks.groupBy("part").applyInArrow(_reduce_counts, "level int, n bigint, ids binary, counts binary"), "frequent", "level", "n")
    held, least = 0, 64
    for level, n in sorted(((r[0], r[1]) for r in levels.groupBy("level").agg(F.sum("n")).collect()), reverse=True):
        if held + n > MAX_FREQUENT:
            break
        held, least = held + n, level
    rows = levels.where(F.col("level") >= least).select("ids", "counts").collect()
    ids = np.concatenate([np.frombuffer(r[0], "<i8") for r in rows] or [np.empty(0, np.int64)])
    counts = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows] or [np.empty(0, np.uint32)])
    order = np.argsort(ids)
    return ids[order], counts[order]


# --- prefixes -------------------------------------------------------------------------------------------------------


def _prefix(tokens: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int, more: int = 0) -> np.ndarray:
    """The first n - ceil(t n) + 1 + ``more`` tokens, rare ones by hash first, then frequent ones by count and hash."""
    n = len(tokens)
    p = min(n, n - _needed(n) + 1 + more)
    if not len(ids):
        return tokens[:p]
    own = _ids(tokens, bits, 24)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    often = ids[at] == own
    rare = tokens[~often]
    if len(rare) >= p:
        return rare[:p]
    rest = tokens[often]
    return np.concatenate([rare, rest[np.lexsort((rest, counts[at[often]]))][: p - len(rare)]])


def _pack(held: list[tuple[np.ndarray, np.ndarray, int, int]], bits: int) -> pa.RecordBatch:
    """Entries (token, node, size, place) in blocks by part, sorted by token; a token's id in its part has 32 bits."""
    lengths = [len(t) for t, *_ in held]
    ids = _ids(np.concatenate([t for t, *_ in held]), bits, 32)
    places = np.concatenate([p for _, p, _, _ in held]).astype("<u4")
    nodes = np.repeat(np.array([n for *_, n, _ in held], dtype="<i8"), lengths)
    sizes = np.repeat(np.array([s for *_, s in held], dtype="<u4"), lengths)
    order = np.argsort(ids, kind="stable")
    ids, nodes, sizes, places = ids[order], nodes[order], sizes[order], places[order]
    bound = np.searchsorted(ids, np.arange((1 << bits) + 1, dtype=np.int64) << 32)
    rows = [(p, ids[a:b].astype("<u4").tobytes(), nodes[a:b].tobytes(), sizes[a:b].tobytes(), places[a:b].tobytes()) for p, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ENTRIES.types, strict=True)], schema=_ENTRIES)


def _map_entries(bits: int, frequent, hot=None):
    """Without ``hot``: each token of the prefix. With it: each combination of a hot token of the prefix and another of
    the prefix that is one longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = frequent.value
        held, n = [], 0
        for node, tokens in _sets(batches):
            if hot is None:
                sig = _prefix(tokens, ids, counts, bits)
                places = np.arange(len(sig))
            else:
                sig, places = _combinations(tokens, ids, counts, bits, hot.value)
            if len(sig):
                held.append((sig, places, node, len(tokens)))
                n += len(sig)
            if n >= FLUSH:
                yield _pack(held, bits)
                held, n = [], 0
        if held:
            yield _pack(held, bits)

    return run


def _combinations(tokens: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The combinations, and the later one of each one's two places in the prefix."""
    prefix = _prefix(tokens, ids, counts, bits, more=1)
    short = len(tokens) - _needed(len(tokens)) + 1
    is_hot = np.isin(_ids(prefix[:short], bits, 32), hot)
    if not is_hot.any() or len(prefix) < 2:
        return tokens[:0], np.empty(0, np.int64)
    own = np.flatnonzero(is_hot)
    one, two = np.repeat(own, len(prefix)), np.tile(np.arange(len(prefix)), len(own))
    one, two = one[one != two], two[one != two]
    less, more = np.minimum(prefix[one], prefix[two]), np.maximum(prefix[one], prefix[two])
    made, at = np.unique(mix(mix(less) + more), return_index=True)
    return made, np.maximum(one, two)[at]


def _reduce_entries(blocks: pa.Table) -> pa.Table:
    """Of one part: the entries of tokens with two nodes or more, and a proposal for each with its bucket's first node
    (of the nodes of about its size), as (kind, part, a, b, c) of packed arrays."""
    columns = (("tokens", "<u4"), ("nodes", "<i8"), ("sizes", "<u4"), ("places", "<u4"))
    ids, nodes, sizes, places = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in blocks.column(c)]) for c, t in columns)
    part = blocks.column("part")[0].as_py()
    order = np.lexsort((nodes, ids))
    ids, nodes, sizes, places = ids[order], nodes[order], sizes[order], places[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (nodes[1:] != nodes[:-1])
    ids, nodes, sizes, places = ids[new], nodes[new], sizes[new], places[new]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[1:] != ids[:-1]
    run = np.cumsum(first) - 1
    many = np.bincount(run)[run] > 1
    ids, nodes, sizes, places = ids[many].astype(np.int64) | (part << 32), nodes[many], sizes[many], places[many]
    rows = [("entries", ids.tobytes(), nodes.tobytes(), sizes.tobytes(), places.tobytes(), None)] if len(ids) else []
    a, b, na, nb = _proposals(ids, nodes, sizes)
    if len(a):
        order = np.lexsort((a, b))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        rows.append(("pairs", a[at].tobytes(), b[at].tobytes(), np.diff(np.append(at, len(a))).astype("<u4").tobytes(), na[at].tobytes(), nb[at].tobytes()))
    names = (("kind", pa.string()), *((c, pa.binary()) for c in ("a", "b", "c", "na", "nb")))
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(names)})


def _proposals(ids: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((nodes, sizes, ids))
    ids, nodes, sizes = ids[order], nodes[order], sizes[order]
    centre = np.empty(len(ids), dtype=np.int64)  # places
    begin = 0
    bounds = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)) if len(ids) else []
    for end in bounds:
        while begin < end:  # sizes that could be similar to the smallest left
            stop = begin + int(np.searchsorted(sizes[begin:end], sizes[begin] * 100 // PERCENT, side="right"))
            centre[begin:stop] = begin + int(nodes[begin:stop].argmin())
            begin = stop
    real = np.flatnonzero(centre != np.arange(len(ids)))
    return nodes[centre[real]], nodes[real], sizes[centre[real]], sizes[real]


_INDEX = "kind string, a binary, b binary, c binary, na binary, nb binary"


def _unpack(df: DataFrame, kind: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of bigint columns from packed arrays; ``columns``: name by packed column, with its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x[c], t).astype(np.int64)) for c, (_, t) in columns.items()], [n for n, _ in columns.values()])

    return df.where(F.col("kind") == kind).select(*columns).mapInArrow(run, ", ".join(f"{n} bigint" for n, _ in columns.values()))


def _entries(index: DataFrame) -> DataFrame:
    return _unpack(index, "entries", {"a": ("token", "<i8"), "b": ("node", "<i8"), "c": ("n", "<u4"), "na": ("place", "<u4")})


def _best(index: DataFrame) -> DataFrame:
    """(a, b, na, nb, c): each node's proposal that shares most buckets."""
    pairs = _unpack(index, "pairs", {"a": ("a", "<i8"), "b": ("b", "<i8"), "c": ("c", "<u4"), "na": ("na", "<u4"), "nb": ("nb", "<u4")})
    best = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).groupBy("b").agg(F.max_by(F.struct("a", "na", "nb", "c"), F.struct("c", "a")).alias("x"))
    return best.select("x.a", "b", "x.na", "x.nb", "x.c")


# --- verification ---------------------------------------------------------------------------------------------------


def _bloom_places(nodes: np.ndarray, bits: int) -> np.ndarray:
    h = mix(nodes.view(np.uint64))
    return np.stack([(h >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 13, 27)]).astype(np.int64)


def _bloom(nodes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A filter of bounded size: each task sets bits of its own, the chunks of which are then joined by OR."""
    chunk = 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = _bloom_places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = own.reshape(-1, min(chunk, bits // 8))
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["chunk", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((bits // 8 // min(chunk, bits // 8), min(chunk, bits // 8)), dtype=np.uint8)
    for r in nodes.mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInArrow(join, "chunk int, bits binary").collect():
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.ravel()


def _wanted_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A table (node, tokens) with the sets of at least the documents with ``ids`` (doc_id)."""
    wanted = docs.sparkSession.sparkContext.broadcast(_bloom(ids.select(F.coalesce("doc_id", F.lit(-1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            own = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = _bloom_places(own, len(bits) * 8)
            part = batch.filter(pa.array((bits[at >> 3] & (128 >> (at & 7)).astype(np.uint8) > 0).all(axis=0)))
            for at in range(0, part.num_rows, 500):
                held = list(_sets([part.slice(at, 500)]))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([t.view(np.int64) for _, t in held], pa.list_(pa.int64()))], ["node", "tokens"])

    return written(docs.mapInArrow(run, "node bigint, tokens array<bigint>"), "sets", "node")


def _verified(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a < b) whose sets are similar, as a table. Only sets that a pair needs leave their tasks: of each node
    that of its document with the smallest id."""
    pairs = written(pairs.select("a", "b"), "pairs")
    if not pairs.head(1):
        return pairs
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _wanted_sets(docs, owners.join(needed, "node").select("doc_id"))
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both >= PERCENT * (F.size("x") + F.size("y") - both)
    return written(pairs.join(two, "b").join(one, "a").where(similar).select("a", "b").distinct(), "links", "a", "b")


def _across(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their components; and of each bucket that holds several the size, the largest component, the number
    of entries outside it, and the number of pairs across components."""
    labelled = entries.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = labelled.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    buckets = by_root.groupBy("token").agg(
        F.sum("m").alias("size"), F.max_by("root", F.struct("m", "root")).alias("largest"), (F.sum("m") - F.max("m")).alias("minor"),
        ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("across"), F.count(F.lit(1)).alias("roots"),
    )
    return labelled, buckets.where("roots > 1")


def _compare(shared: int, best: bool = False):
    """Of groups of blocks: the pairs across components whose overlap could reach the threshold, each once a group. With
    ``best``, for each node outside its bucket's largest component one of them, as (a, b, score): the most promising."""

    def fewest(pairs: np.ndarray) -> np.ndarray:
        if not best:
            return np.unique(pairs, axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], -pairs[2], pairs[0]))]
        return pairs[:, np.diff(pairs[0], prepend=pairs[0, 0] - 1 if pairs.size else 0) != 0]

    def run(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_numpy()
        token, node, root, i, j = (column(c) for c in ("token", "node", "root", "i", "j"))
        n, place = column("n").astype(np.int64), column("place").astype(np.int64)
        minor, major = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("minor", "major"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        order = np.lexsort((n, j, i, token))
        new = np.ones(len(order), dtype=bool)
        t, p, q = token[order], i[order], j[order]
        new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        run_of = np.empty(len(order), dtype=np.int64)
        run_of[order] = np.cumsum(new) - 1
        left, right = order[minor[order]], order[~minor[order]]
        by = (run_of[right] << 32) + n[right]  # ascending
        begin = np.searchsorted(by, (run_of[left] << 32) + _needed(n[left]))
        count = np.searchsorted(by, (run_of[left] << 32) + n[left] * 100 // PERCENT, side="right") - begin
        ends = np.cumsum(count)
        found, held, at = [], 0, 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            c = count[at:stop]
            first = np.repeat(begin[at:stop] - (np.cumsum(c) - c), c)
            x, y = np.repeat(left[at:stop], c), right[first + np.arange(len(first))]
            at = stop
            keep = root[x] != root[y]
            if not best:
                keep &= major[y] | (node[x] < node[y])
            x, y = x[keep], y[keep]
            need = -(-PERCENT * (n[x] + n[y]) // (100 + PERCENT))
            keep = shared + np.minimum(n[x] - place[x], n[y] - place[y]) - 1 >= need
            x, y, need = x[keep], y[keep], need[keep]
            one, two = sketch[x], sketch[y]
            most = np.minimum(n[x] - np.bitwise_count(one & ~two).sum(axis=1, dtype=np.int64), n[y] - np.bitwise_count(two & ~one).sum(axis=1, dtype=np.int64))
            keep = most >= need
            x, y, most = x[keep], y[keep], most[keep]
            score = most * SCORE // (n[x] + n[y] - most)  # the similarity that the bound allows
            x, y = node[x], node[y]
            found.append(np.stack([x, y, score] if best else [np.minimum(x, y), np.maximum(x, y)]))
            held += len(x)
            if held > 2 * CHUNK:
                found = [fewest(np.concatenate(found, axis=1))]
                held = 0
        pairs = fewest(np.concatenate(found, axis=1)) if found else np.empty((2 + best, 0), np.int64)
        return pa.table(dict(zip(("a", "b", "score"), pairs, strict=False)))

    return run


def _cross_pairs(labelled: DataFrame, buckets: DataFrame, owners: DataFrame, shared: int, best: bool = False) -> DataFrame:
    """(a, b): pairs across components that could be similar if the bucket's ``shared`` tokens are the first that they
    share. One side is the nodes outside the bucket's largest component, so a large component isn't paired with itself.

    Both sides go in blocks of about BLOCK entries, each pair of blocks into one group. With ``best`` each node outside
    gives only its most promising pair, so there are no more pairs than nodes.
    """
    total = buckets.agg(F.sum("size")).head()[0] or 0
    inside = salted_join(labelled, buckets.select("token", "largest", "size", "minor"), "token", "size", total, "node").join(owners.select("node", "sketch"), "node")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    others = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    major = F.col("root") == F.col("largest")
    as_whole = F.transform(others("minor"), lambda b: F.struct(F.lit(False).alias("minor"), b.alias("i"), own("size").alias("j")))
    as_minor = F.transform(others("size"), lambda b: F.struct(F.lit(True).alias("minor"), own("minor").alias("i"), b.alias("j")))
    sides = F.when(major, as_whole).otherwise(F.concat(as_whole, as_minor))
    rows = inside.select("token", "node", "n", "place", "root", "sketch", major.alias("major"), F.explode(sides).alias("side")).select("*", "side.*").drop("side")
    groups = max(16, int(total) >> 16)
    grouped = rows.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(groups)).alias("_group"))
    if not best:
        return grouped.applyInArrow(_compare(shared), "a bigint, b bigint").distinct()
    found = grouped.applyInArrow(_compare(shared, best), "a bigint, b bigint, score bigint")
    top = found.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _could_reach(c) -> object:
    """Whether ``c`` shared tokens of the prefixes leave an overlap of the threshold possible: of the set whose prefix
    ends first, all shared tokens up to there are counted, and needed(n) - 1 tokens come after."""
    need = lambda n: F.ceil(n * PERCENT / 100.0 - 1e-9)
    least = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100.0 + PERCENT) - 1e-9)
    return c + F.greatest(need(F.col("na")), need(F.col("nb"))) - 1 >= least


def similar_nodes(docs: DataFrame, owners: DataFrame, bits: int) -> DataFrame:
    """(node, root) for nodes that are linked to a smaller one. ``owners``: of each node a doc_id and the sketch."""
    spark = docs.sparkSession
    texts = docs.select("text")
    frequent = spark.sparkContext.broadcast(_frequent(texts, bits))
    layout = "part int, tokens binary, nodes binary, sizes binary, places binary"
    index = written(texts.mapInArrow(_map_entries(bits, frequent), layout).groupBy("part").applyInArrow(_reduce_entries, _INDEX), "index")
    entries = _entries(index)
    # What a first proposal misses by counting too few buckets, the next step finds.
    labels = trees(_verified(docs, owners, _best(index).where(_could_reach(F.col("c")))))

    labelled, buckets = _across(entries, labels)
    buckets = written(buckets, "buckets")
    is_hot = F.col("across") > DIRECT * F.col("size")
    labels = merged(labels, _verified(docs, owners, _cross_pairs(labelled, buckets.where(~is_hot), owners, 1)))

    hot = _across(entries.join(buckets.where(is_hot).select("token"), "token", "left_semi"), labels)[1].select("token")
    tokens = np.array([r[0] for r in hot.limit(MAX_FREQUENT + 1).collect()], dtype=np.int64)
    if len(tokens) > MAX_FREQUENT:
        raise ValueError(f"more than {MAX_FREQUENT} hot tokens: raise DIRECT or MAX_FREQUENT")
    if len(tokens):
        combined = _map_entries(bits, frequent, spark.sparkContext.broadcast(np.sort(tokens)))
        index = written(texts.mapInArrow(combined, layout).groupBy("part").applyInArrow(_reduce_entries, _INDEX), "index")
        labels = merged(labels, _verified(docs, owners, _best(index)))
        for best in (True, False):  # the best pairs join most components, so few pairs across components are left
            labelled, buckets = _across(_entries(index), labels)
            labels = merged(labels, _verified(docs, owners, _cross_pairs(labelled, written(buckets, "buckets"), owners, 2, best)))
    return labels


def _placed(documents: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, root (one for each component) and component_id of each row; root is null
    where there are no shingles."""
    docs = documents.select("doc_id", "text")
    with small_batches(docs.sparkSession):
        keyed = docs.withColumn("key", F.xxhash64(text_or_empty()))
        nodes = written(keyed.mapInArrow(_map_nodes, "doc_id bigint, key bigint, n_shingles bigint, node bigint, sketch binary"), "nodes")
        narrow = nodes.select("doc_id", "key", "n_shingles", "node")
        total, rows = (x or 0 for x in nodes.where("n_shingles > 0").agg(F.sum("n_shingles"), F.count(F.lit(1))).head())
        alone = narrow.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
        if not total:
            return alone
        bits = max(4, int(np.ceil(np.log2(total / PART_TOKENS))) if total > PART_TOKENS else 0)
        owned = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
        owners = written(owned, "owners")
        labels = similar_nodes(docs, owners, bits)
        rooted = owners.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
        component = written(salted_join(rooted.select("node", "copies", "root"), least, "root", "members", rows, "node"), "components")
    joined = salted_join(narrow.where("n_shingles > 0"), component.select("node", "copies", "root", "component_id"), "node", "copies", rows, "doc_id", "key")
    return joined.select("doc_id", "key", "n_shingles", "root", "component_id").unionByName(alone)


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each row.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows have one set and so one component.
    A null doc_id counts as larger than all others. Without rows there are none. Sets are told apart by 64-bit
    fingerprints and counted by 64-bit shingle hashes.
    """
    return _placed(documents).select("doc_id", "n_shingles", "component_id")


def first_of_each(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each component, with its own columns: a row of the smallest doc_id.

    Of rows that share that id, repeated rows and different texts alike, one stays in each component. Rows without
    shingles are linked with nothing and all stay. Of a component whose ids are all null one row stays.
    """
    own = documents.select(F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_key"), text_or_empty().rlike(WORD).alias("_worded"), F.struct(*[documents[c] for c in documents.columns]).alias("_row"))
    texts = _placed(documents).where("root is not null and component_id <=> doc_id").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    first = written(texts.groupBy("root").agg(F.min_by(F.struct("doc_id", "key", "times"), "key").alias("x")).select("x.*"), "first")
    found = own.where("_worded").join(first, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    repeated = found.where("times > 1").dropDuplicates(["_id", "_key"])
    return found.where("times = 1").select("_row.*").union(repeated.select("_row.*")).union(own.where("not _worded").select("_row.*"))
