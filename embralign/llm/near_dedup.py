"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Documents with equal sets form a class; one
representative of each class goes on. Independent trees branch the representatives: a node picks a
few coordinates of the documents' minwise sketch (by a hash of the node's path) and sends each
document to one child per coordinate, named by the document's minwise token there. Two sets of
Jaccard similarity J stay together in each branch with probability J, so with `branches` branches a
node loses a pair at the threshold rarely, and independent `trees` multiply what is left of that
chance. Small nodes are compared exhaustively on sketches, with a wide margin; a large node branches
again, unless nearly all of its parent came along: then its documents can't be told apart by minwise
tokens and stay together as one candidate group.

Candidate groups (connected candidates) are then resolved on the full sets, exactly. A small group
meets in one task. A large one never does: its rows, dealt to tasks by a salt, meet one hub, a row whose
minwise tokens are the most common of the group; what stays unconnected chooses another hub, and in the end
meets all rows in blocks. Only links that connect something new leave a task, so the output is linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, gathered, partitions, read_table
from ._graph import connected_components
from ._text import BASE, U, as_bytes, hash_words, mix, shingle_hashes, shingle_sets, small_batches, SPACED

SKETCH = 64
_COEFFICIENTS = mix(np.arange(101, 101 + SKETCH, dtype=U) * U(BASE)) | U(1)


def sketch(values: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens (32 bits each) of one non-empty set of hashes."""
    best = np.full(SKETCH, ~U(0), U)
    for a in range(0, len(values), 4096):
        np.minimum(best, (values[a : a + 4096, None] * _COEFFICIENTS).min(axis=0), out=best)
    return (best >> U(32)).astype(np.uint32)


_SIGNATURE = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sketch binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        words, counts, _ = hash_words(*as_bytes(batch.column("text")), SPACED)
        values, per = shingle_hashes(words, counts, 5)
        n, a, b, sketches, at = [], [], [], [], 0
        for c in per.tolist():
            s = np.unique(values[at : at + c])
            at += c
            n.append(len(s))
            a.append(int(s.sum(dtype=U).astype(np.int64)) if c else 0)
            b.append(int(mix(s + U(77)).sum(dtype=U).astype(np.int64)) if c else 0)
            sketches.append(sketch(s).tobytes() if c else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sketch"],
        )


def _sketches_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches with a byte a token: equal tokens have equal bytes, so none that agrees is lost, and others agree once in 256."""
    for batch in batches:
        m = np.ascontiguousarray(_sketches_of(batch).astype(np.uint8))
        short = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * SKETCH).astype(np.int32)), pa.py_buffer(m)])
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n_shingles"), short], names=["rep", "n_shingles", "sketch"])


def _child_keys(path: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(path + coordinate.astype(U) * U(BASE)) ^ (token.astype(U) + U(1)))


def _roots(trees: int, branches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, rep = _sketches_of(batch), batch.column("rep").to_numpy(zero_copy_only=False)
            for t in range(trees):
                for j in range(branches):
                    c = (t * branches + j) % SKETCH
                    path = np.full(len(rep), t + 1, U)
                    keys = _child_keys(mix(path), np.full(len(rep), c), m[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rep)], names=["node", "rep"])

    return run


def _branch(branches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, rep, size = _sketches_of(batch), batch.column("rep").to_numpy(), batch.column("size").to_numpy()
            node = batch.column("node").to_numpy().view(U)
            for j in range(branches):
                c = (mix(node + U(1 + j)) % U(SKETCH)).astype(np.int64)
                keys = _child_keys(node, c, m[np.arange(len(rep)), c])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rep), pa.array(size)], names=["node", "rep", "size"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, as one batch for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[a] != last:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _leaf_links(least_share: float, least_agree: float):
    """Links that span what is similar by sketch in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        need = least_agree * SKETCH
        for leaf in grouped(batches, "node"):
            rep, n = leaf.column("rep").to_numpy(), leaf.column("n_shingles").to_numpy()
            m = np.frombuffer(b"".join(leaf.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            left = np.arange(len(rep))
            while len(left) > 1:  # breadth-first, a row of comparisons at a time
                front, left = left[:1], left[1:]
                root = rep[front[0]]
                while len(front) and len(left):
                    near = np.zeros(len(left), bool)
                    for x in front.tolist():
                        rest = ~near
                        if not rest.any():
                            break
                        y = left[rest]
                        ok = ((m[y] == m[x]).sum(1) >= need) & (np.minimum(n[y], n[x]) >= least_share * np.maximum(n[y], n[x]))
                        near[np.flatnonzero(rest)[ok]] = True
                    front, left = left[near], left[~near]
                    a += [int(root)] * len(front)
                    b += rep[front].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked(inter: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def link_components(values: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest linked place of each of some sets (concatenated sorted values); exact."""
    k = len(n)
    owner = np.repeat(np.arange(k), n)
    begin = np.concatenate([[0], np.cumsum(n)])
    label = np.arange(k)
    for i in range(k):
        other = label != label[i]
        if not other.any():
            break
        mine = values[begin[i] : begin[i + 1]]
        at = np.searchsorted(mine, values)
        hit = mine[np.minimum(at, len(mine) - 1)] == values
        inter = np.bincount(owner[hit], minlength=k)
        joined = np.unique(np.append(label[other & linked(inter, n, int(n[i]), percent)], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _resolve(percent: int):
    """Components inside each small candidate group, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "group"):
            rep = group.column("rep").to_numpy()
            order = np.argsort(rep)
            values, n = shingle_sets(group.column("text").take(pa.array(order)))
            rep = rep[order]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep[link_components(values, n, percent)])], names=["rep", "component"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        values, n = shingle_sets(batch.column("text"))
        begin = np.concatenate([[0], np.cumsum(n)])
        sets = [values[begin[i] : begin[i + 1]].tobytes() for i in range(len(n))]
        yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("rep"), pa.array(sets, pa.binary())], names=["group", "rep", "set"])


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, U)


def _stars(percent: int):
    """In each task, the rows that link with the task's hub (its one row of kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = task = None
        for batch in batches:
            found = []
            sets = batch.column("set")
            for i, (t, kind) in enumerate(zip(batch.column("task").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                mine = np.frombuffer(sets[i].as_buffer(), U)
                if not kind:
                    hub, task = mine.copy(), t
                elif t == task and min(len(mine), len(hub)) * 100 >= percent * max(len(mine), len(hub)):
                    at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                    if linked(np.count_nonzero(hub[at] == mine), len(mine), len(hub), percent):
                        found.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(found, pa.int64()))], names=["rep"])

    return run


def _blocks(percent: int):
    """In each task, every row against every row of the block; a link for each new connection in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            rep, kind = group.column("rep").to_numpy(), group.column("kind").to_numpy()
            sets = [_set(x) for x in group.column("set").to_pylist()]
            k = int((kind == 0).sum())
            n = np.array([len(x) for x in sets[:k]], np.int64)
            vocabulary, code = np.unique(np.concatenate(sets[:k]), return_inverse=True)
            has = np.zeros((len(vocabulary) + 1, k), np.uint8)
            has[code, np.repeat(np.arange(k), n)] = 1
            place = {int(r): i for i, r in enumerate(rep[:k])}
            label = np.arange(k + len(rep))
            a, b = [], []
            for i in range(k, len(rep)):
                at = np.searchsorted(vocabulary, sets[i])
                at[vocabulary[np.minimum(at, len(vocabulary) - 1)] != sets[i]] = len(vocabulary)
                near = np.flatnonzero(linked(has[at].sum(0, dtype=np.int64), n, len(sets[i]), percent))
                me = place.get(int(rep[i]), i)
                for j in near.tolist():
                    if label[j] != label[me]:
                        a.append(int(rep[i]))
                        b.append(int(rep[j]))
                        label[label == label[j]] = label[me]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


_TOKENS = 8


def _main_star(hubs: int):
    """From masks (array of mask, n) of a group: the bits of the connected hubs that most rows are linked with."""

    def meets(x, reach):
        return x["mask"].bitwiseAND(reach) != 0

    def reached(reach):
        return F.aggregate("masks", reach, lambda r, x: F.when(meets(x, r), r.bitwiseOR(x["mask"])).otherwise(r))

    def star(h: int):
        reach = F.lit(1 << h)
        for _ in range(hubs - 1):
            reach = reached(reach)
        n = F.aggregate("masks", F.lit(0).cast("long"), lambda t, x: t + F.when(meets(x, reach), x["n"]).otherwise(0))
        return F.struct(n.alias("n"), reach.alias("reach"))

    return (F.greatest(*map(star, range(hubs))) if hubs > 1 else star(0))["reach"]


def _large_groups(rows: DataFrame, count: int, percent: int, scratch: Scratch, hubs: int = 3, block: int = 128, rows_per_task: int = 2000, broadcast_groups: int = 1 << 16, round_bytes: int = 1 << 28) -> DataFrame:
    """rows (group, rep, tokens, set), so many, of groups of any size -> links (a, b) whose components are the groups' true ones.

    A row's mask has a bit for each hub that it is linked with. Stars that share a row are connected; rows outside the
    group's largest connected stars choose the next hub, and in the end meet all rows of their group in blocks.
    """
    spark = scratch.spark
    small = lambda df, each=1 << 14: gathered(df, count, each)
    spans = scratch.table(small(rows.groupBy("group").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("salts"))), "spans")
    # one short row for each large group; beyond so many groups the planner joins (and splits what is skewed)
    beside = F.broadcast if spans.count() <= broadcast_groups else lambda x: x
    salt = F.pmod(F.xxhash64("rep", F.lit("salt")), F.col("salts")).cast("int")
    task = F.xxhash64("group", "salt").alias("task")
    dealt = rows.join(beside(spans), "group").withColumn("salt", salt).select(task, F.lit(1).alias("kind"), "rep", "set")
    links = spark.createDataFrame([], "a long, b long")
    state = rows.select("group", "rep", "tokens", F.lit(0).alias("mask"))
    outside = state
    for k in range(hubs):
        each = outside.select("group", F.posexplode("tokens").alias("c", "token"))
        each = small(each.groupBy("group", "c", "token").agg(F.count("*").alias("n")))
        top = small(each.groupBy("group", "c").agg(F.max_by("token", F.struct("n", "token")).alias("token")))
        top = small(top.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("c", "token"))).alias("top")))  # _TOKENS entries
        score = sum((F.col("tokens")[c] == F.element_at("top", F.lit(c))).cast("int") for c in range(_TOKENS))
        hub = outside.join(beside(top), "group").groupBy("group").agg(F.max_by("rep", F.struct(score, -F.col("rep"))).alias("rep"))
        hub = scratch.table(small(hub), f"hub{k}")
        sets = hub.join(rows.select("rep", "set"), "rep").join(spans, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = dealt.unionByName(sets.select(task, F.lit(0).alias("kind"), "rep", "set")).repartition(partitions(spark), "task")
        met = small(met, 1 << 11).sortWithinPartitions("task", "kind").mapInArrow(_stars(percent), "rep long").withColumn("bit", F.lit(1 << k))
        state = state.join(met, "rep", "left").select("group", "rep", "tokens", F.col("mask").bitwiseOR(F.coalesce("bit", F.lit(0))).alias("mask"))
        state = scratch.table(small(state), f"state{k}")
        links = links.unionByName(state.where(F.col("mask").bitwiseAND(1 << k) != 0).select("group", F.col("rep").alias("b")).join(beside(hub.withColumnRenamed("rep", "a")), "group").select("a", "b"))
        masks = small(state.groupBy("group", "mask").agg(F.count("*").alias("n"))).groupBy("group").agg(F.collect_list(F.struct("mask", "n")).alias("masks"))
        most = small(masks.select("group", _main_star(k + 1).alias("most")))
        outside = state.join(beside(most), "group").where(F.col("mask").bitwiseAND(F.col("most")) == 0).select("group", "rep", "tokens")
        outside = scratch.table(small(outside), f"outside{k}")
        if outside.isEmpty():
            return links
    # what stayed outside, against all rows of its group, in blocks; each task has one block and a bounded part of the rows
    parts = outside.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    spans = scratch.table(small(parts.join(spans, "group")), "parts")
    part, salt = F.pmod(F.xxhash64("rep"), F.col("parts")), F.pmod(F.xxhash64("rep", F.lit("salt")), F.col("salts"))
    first = outside.join(beside(spans), "group").select("group", "rep", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # a row goes to each block of its group, so the blocks take turns: a turn moves about what the rows hold, and its shuffles go
    held = small(rows.groupBy("group").agg(F.sum(F.length("set")).alias("bytes"))).join(beside(spans), "group")
    moved, once, tasks = held.agg(F.sum(F.col("bytes") * F.col("parts")), F.sum("bytes"), F.sum(F.col("parts") * F.col("salts"))).first()
    turns = -(-moved // max(once, round_bytes))
    for r in range(turns):
        every = F.explode(F.sequence(F.lit(r), F.col("parts") - 1, F.lit(turns)))
        second = rows.select("group", "rep").join(beside(spans.where(F.col("parts") > r)), "group").select("group", "rep", every.alias("part"), salt.alias("salt"))
        dealt = first.where(F.col("part") % turns == r).withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1))).join(rows.select("rep", "set"), "rep")
        dealt = dealt.select(F.xxhash64("group", "part", "salt").alias("task"), "kind", "rep", "set").repartition(partitions(spark), "task")
        dealt = gathered(dealt, -(-tasks // turns), 1).sortWithinPartitions("task", "kind", "rep")
        links = links.unionByName(scratch.table(dealt.mapInArrow(_blocks(percent), "a long, b long"), f"blocks{r}"))
    return links


def near_duplicates(
    docs: DataFrame, *, percent: int = 85, trees: int = 3, branches: int = 4, leaf: int = 1024, least_agree: float = 0.6, group_rows: int = 256, group_shingles: int = 1 << 20, broadcast_rows: int = 1 << 19
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, text_key, first; one row per row of docs.

    Links documents with 100 * |A & B| >= percent * |A | B| and follows links to components, named
    by their smallest doc_id. A pair at the threshold is lost with a chance below 1e-6 (three trees
    of four branches each; higher similarity: less), and its sketches of 64 tokens agree on less
    than `least_agree` of them with a chance of about 6e-7 at similarity 0.85 and 0.6, of about 4e-6
    at 0.80 and 0.55.
    Null, empty and blank texts have no shingles, link with nothing and are kept. A null doc_id links as
    any other and names no component that has another; kept is doc_id <=> component_id. Rows that repeat a
    doc_id with different texts are documents of their own; text_key (xxhash64 of the text) tells them apart,
    and first marks the smallest (doc_id, text_key) of a component. Extra columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = scratch.table(docs.mapInArrow(_signatures, _SIGNATURE), "signatures")
    key = F.struct("doc_id", "text_key")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("low"), F.min(key).alias("lead"), F.any_value("sketch").alias("sketch"))
    reps = scratch.table(gathered(classes, signed.count(), 1 << 13).withColumn("rep", F.monotonically_increasing_id()), "classes")
    sketches, count = reps.select("rep", "n_shingles", "sketch"), reps.count()

    paths = scratch.table(sketches.mapInArrow(_roots(trees, branches), "node long, rep long").withColumn("size", F.lit(None).cast("long")), "paths0")
    leaves, merged, depth, rows, edges = [], [], 0, count * trees * branches, 0
    while True:
        sizes = paths.groupBy("node").agg(F.count("*").alias("n"), F.any_value("size").alias("parent"), F.min("rep").alias("first")).where("n > 1")
        sizes = scratch.table(gathered(sizes, rows, 1 << 17), f"sizes{depth}")
        told = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= leaf, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > leaf, F.col("n"))), F.lit(0))).first()
        leaves.append(gathered(paths.join(sizes.where(F.col("n") <= leaf).select("node"), "node").select("node", "rep"), told[0]))
        edges += told[0] + told[1]
        if not told[1]:
            break
        large = sizes.where(F.col("n") > leaf)
        dense = large.where("2 * n >= parent")
        merged.append(gathered(paths.join(dense.select("node", "first"), "node").select(F.col("first").alias("a"), F.col("rep").alias("b")), told[1]))
        again = gathered(paths.drop("size").join(large.where("parent is null or 2 * n < parent").select("node", F.col("n").alias("size")), "node"), told[1])
        again = gathered(again.join(sketches, "rep"), told[1], 1 << 13)
        depth, rows = depth + 1, told[1] * branches
        paths = scratch.table(again.select("node", "rep", "size", "sketch").mapInArrow(_branch(branches), "node long, rep long, size long"), f"paths{depth}")

    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    n = partitions(spark)
    short = sketches.mapInArrow(_short, "rep long, n_shingles long, sketch binary")  # a row of them travels with each place in a leaf
    met = gathered(every.join(short, "rep"), edges, 1 << 14).repartition(n, "node")
    near = gathered(met, edges, 1 << 14).sortWithinPartitions("node").mapInArrow(_leaf_links(percent / 100, least_agree), "a long, b long")
    for more in merged:
        near = near.unionByName(more.where("a <> b"))
    groups = connected_components(near, scratch, "near", edges).select(F.col("id").alias("rep"), F.col("component").alias("group"))
    groups = scratch.table(gathered(groups.join(reps.select("rep", "n_shingles", "lead.*"), "rep"), count), "groups")
    scratch.drop("near_e0", *[f"{name}{k}" for k in range(depth + 1) for name in ("paths", "sizes")])
    size = gathered(groups.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total")), count)
    small = (F.col("rows") <= group_rows) & (F.col("total") <= group_shingles)
    members = scratch.table(gathered(groups.join(size, "group").select("group", "rep", "doc_id", "text_key", small.alias("small")), count), "members")

    told = {r.small: r["count"] for r in members.groupBy("small").count().collect()}  # two rows at most
    large = told.get(False, 0)
    turns = max(1, -(-sum(told.values()) // broadcast_rows))  # of members beside the texts, so texts of others never move; a turn's shuffles go
    turn = F.pmod(F.xxhash64(F.when(F.col("small"), F.col("group")).otherwise(F.col("rep"))), F.lit(turns))
    tokens = F.array(*[F.conv(F.hex(F.substring("sketch", 4 * c * (SKETCH // _TOKENS) + 1, 4)), 16, 10).cast("long") for c in range(_TOKENS)])
    each = lambda rows: -(-rows // turns)
    done = sets = None
    for r in range(turns):
        side = F.broadcast(members.where(turn == r).withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"}))
        texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
        few = texts.where("small").select("group", "rep", "text").dropDuplicates(["rep"])
        found = gathered(gathered(few, each(told.get(True, 0)), 1 << 9).repartition(n, "group"), each(told.get(True, 0)), 1 << 9).sortWithinPartitions("group").mapInArrow(_resolve(percent), "rep long, component long")
        found = scratch.table(gathered(found.groupBy("rep").agg(F.min("component").alias("component")), each(told.get(True, 0))), f"resolved{r}")
        done = found if done is None else done.unionByName(found)
        if large:
            found = texts.where("not small").select("group", "rep", "text").mapInArrow(_sets, "group long, rep long, set binary")
            found = gathered(found.dropDuplicates(["rep"]), each(large), 1 << 11).join(sketches.select("rep", "sketch"), "rep")
            found = scratch.table(gathered(found, each(large), 1 << 11).select("group", "rep", tokens.alias("tokens"), "set"), f"sets{r}")
            sets = found if sets is None else sets.unionByName(found)
    if large:
        links = _large_groups(sets, large, percent, scratch)
        parts = connected_components(links, scratch, "parts", large).select(F.col("id").alias("rep"), "component")
        done = done.unionByName(parts)
    done = done.join(reps.select("rep", "low", "lead"), "rep")
    named = gathered(done.groupBy("component").agg(F.min("low").alias("component_id"), F.min("lead").alias("first")), count)
    done = gathered(done.select("rep", "component").join(named, "component"), count).drop("component")
    top = reps.select("n_shingles", "set_a", "set_b", "rep", "low", "lead").join(done, "rep", "left")
    top = top.select("n_shingles", "set_a", "set_b", F.when(F.col("first").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", "lead").alias("first"))
    out = signed.drop("sketch").join(gathered(top, count), ["n_shingles", "set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    first = F.when(F.col("n_shingles") == 0, F.lit(True)).otherwise(key.eqNullSafe(F.col("first")))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key", first.alias("first"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The same over DuckDB; doc_ids are unique there.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS c FROM t GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""
