"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed in segments, each a few MB of text of one task: for every term that occurs, the
ascending places of the term in the segment, and the documents' places. Segments are a Parquet table,
made once without a shuffle, and any block of test items is looked up in it, in each segment by itself.
A window of a test item begins at its rarest term in the segment: the term's list, moved by the term's
offset, gives candidate beginnings, and the lists of the other terms, rarest first and moved by their
offsets, are intersected with it until none or the exact phrase occurrences are left. With a slack,
places within so many of the phrase's count too: those are the proximity matches. All windows of a block
are looked up together, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, read_table
from ._text import ALNUM, U, as_bytes, hash_words, shingle_hashes, small_batches

#: A block of test items is broadcast as a whole; larger item tables are queried block by block.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
#: Candidate beginnings, and window words, that are held at once.
PAIRS = 1 << 19


class Items:
    """The distinct windows of a block of test items: where each begins in the items' words, how long it is and whose it is."""

    def __init__(self, ids: list, texts: list, window: int):
        hashes, counts, _ = hash_words(*as_bytes(pa.array(texts, pa.string())), ALNUM)
        self.ids = [str(x) for x in ids]
        self.terms, codes = np.unique(hashes, return_inverse=True)
        self.codes = codes.astype(np.int32)
        names, per = shingle_hashes(hashes, counts, window)
        item = np.repeat(np.arange(len(counts)), per)
        begin = np.repeat(np.cumsum(counts) - counts, per) + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        self.begin, self.length = begin[first], np.minimum(counts[item[first]], window)
        owned = np.unique(np.stack([which.reshape(-1), item], 1), axis=0) if len(item) else np.empty((0, 2), np.int64)
        self.owner = owned[:, 1]
        self.owners = np.searchsorted(owned[:, 0], np.arange(len(first) + 1))

    def of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of windows: (place in windows, item) pairs."""
        a, n = self.owners[windows], self.owners[windows + 1] - self.owners[windows]
        at = np.repeat(np.arange(len(windows)), n)
        return at, self.owner[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]


def item_blocks(items: DataFrame, window: int) -> Iterator[Items]:
    """Blocks of items (item_id, text) of bounded number and size, read one after the other."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Items(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, window)


_INDEX = "doc_ids array<long>, text_keys array<long>, n_words array<long>, terms binary, ends binary, places binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 22):
        hashes, counts, _ = hash_words(*as_bytes(batch.column("text")), ALNUM)
        order = np.argsort(hashes, kind="stable")
        terms, n = np.unique(hashes[order], return_counts=True)
        # one free place between documents: no phrase crosses it, and places stay ascending
        place = (np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts))[order].astype(np.int32)
        longs = [pa.array([x], pa.list_(pa.int64())) for x in (batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), counts.tolist())]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (terms, np.cumsum(n).astype(np.int32), place)]
        yield pa.RecordBatch.from_arrays([*longs, *blobs], names=["doc_ids", "text_keys", "n_words", "terms", "ends", "places"])


def store_index(docs: DataFrame, scratch: Scratch, name: str = "index") -> DataFrame:
    """docs (doc_id, text) -> the written index of all their words; a row for each segment, with its number."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_index, _INDEX)
    return scratch.table(rows.withColumn("segment", F.monotonically_increasing_id()), name, **{"parquet.block.size": 32 << 20})


def intersect(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which ranges from low to high (both included) hold a number of key (ascending)."""
    at = np.searchsorted(key, low)
    return (at < len(key)) & (key[np.minimum(at, len(key) - 1)] <= high)


def occurrences(query: Items, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, begins: np.ndarray, counts: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the windows in a segment's lists: window, place of its beginning, document, whether it is an exact phrase (else within the slack)."""
    if not len(terms) or not len(query.terms):
        return
    span = int(begins[-1] + counts[-1]) + 2
    sizes = np.diff(ends, prepend=0)
    key = np.repeat(np.arange(len(terms), dtype=np.int64) * span, sizes) + places
    slot = np.minimum(np.searchsorted(terms, query.terms), len(terms) - 1)
    size = np.where(terms[slot] == query.terms, sizes[slot], 0)
    start = ends[slot] - sizes[slot]
    for n in np.unique(query.length).tolist():
        every = np.flatnonzero(query.length == n)
        for a in range(0, len(every), max(1, PAIRS // n)):
            own = every[a : a + max(1, PAIRS // n)]
            words = query.codes[query.begin[own][:, None] + np.arange(n)]
            own, words = (x[size[words].all(1)] for x in (own, words))
            order = np.argsort(size[words], axis=1, kind="stable")
            rarest = words[np.arange(len(own)), order[:, 0]] if len(own) else np.empty(0, np.int64)
            many = np.cumsum(size[rarest])
            b = 0
            while b < len(own):  # as many windows as have PAIRS candidates together, or one
                c = max(b + 1, int(np.searchsorted(many, (many[b - 1] if b else 0) + PAIRS, side="right")))
                k = size[rarest[b:c]]
                w = np.repeat(np.arange(b, c), k)
                place = places[np.repeat(start[rarest[b:c]], k) + np.arange(len(w)) - np.repeat(np.cumsum(k) - k, k)].astype(np.int64)
                at = place - order[w, 0]
                doc = np.searchsorted(begins, place, side="right") - 1
                low, high = begins[doc], begins[doc] + counts[doc] - 1
                left = np.flatnonzero((at >= low) & (at + n - 1 <= high))
                exact = np.ones(len(left), bool)
                for j in range(1, n):
                    offset = order[w[left], j]
                    base = slot[words[w[left], offset]] * span
                    want = at[left] + offset
                    same = intersect(key, base + want, base + want)
                    near = same if not slack else same | intersect(key, base + np.maximum(want - slack, low[left]), base + np.minimum(want + slack, high[left]))
                    left, exact = left[near], (exact & same)[near]
                if len(left):
                    yield own[w[left]], at[left], doc[left], exact
                b = c


def _lists(n: int, doc: np.ndarray, item: np.ndarray, ids: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
        out[d].append(ids[i])
    return [sorted(set(x)) for x in out]


_FOUND = "segment long, place int, doc_id long, text_key long, n_words long, n_hit long, runs binary, found array<string>, near array<string>"


def search_index(index: DataFrame, items: Items, slack: int = 0, every: bool = True) -> DataFrame:
    """For each indexed document (if every, else for those with a match): n_words, n_hit, and as strings the item_ids with an occurring window (found) and with one within the slack (near).

    segment and place tell documents apart. runs holds the hit words as begin and end of each run of them, counted in the document.
    """
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, keys = row["doc_ids"].as_py(), row["text_keys"].as_py()
                terms, ends, places = (np.frombuffer(row[c].as_buffer(), kind) for c, kind in (("terms", U), ("ends", np.int32), ("places", np.int32)))
                counts = np.array(row["n_words"].as_py(), np.int64)
                begins = np.cumsum(counts + 1) - counts - 1
                hit = np.zeros(int(counts.sum() + len(counts)) + 1, np.int32)
                found, near = [], []
                for w, at, doc, exact in occurrences(query, terms, ends, places, begins, counts, slack):
                    np.add.at(hit, at[exact], 1)
                    np.add.at(hit, at[exact] + query.length[w[exact]], -1)
                    for out, some in ((found, exact), (near, np.ones(len(w), bool))):
                        pair, item = query.of(w[some])
                        out.append(np.stack([doc[some][pair], item], 1))
                inside = np.cumsum(hit[:-1]) > 0
                covered = np.concatenate([[0], np.cumsum(inside)])
                n_hit = covered[begins + counts] - covered[begins]
                edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)  # places between documents are never hit
                cut = np.searchsorted(edges[:, 0], np.append(begins, len(inside)))
                runs = [(edges[a:b] - at).astype(np.int32).tobytes() if b > a else None for at, a, b in zip(begins, cut[:-1], cut[1:], strict=True)]
                found, near = (_lists(len(counts), *np.concatenate([np.empty((0, 2), np.int64), *x]).T, query.ids) for x in (found, near))
                keep = np.arange(len(counts)) if every else np.flatnonzero([bool(x) for x in near])
                take = lambda x, keep=keep: [x[k] for k in keep.tolist()]
                columns = [
                    pa.array(np.full(len(keep), row["segment"].as_py())), pa.array(keep.astype(np.int32)), pa.array(take(ids), pa.int64()), pa.array(take(keys), pa.int64()), pa.array(counts[keep]),
                    pa.array(n_hit[keep].astype(np.int64)), pa.array(take(runs), pa.binary()), pa.array(take(found), pa.list_(pa.string())), pa.array(take(near), pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "place", "doc_id", "text_key", "n_words", "n_hit", "runs", "found", "near"])

    return index.mapInArrow(run, _FOUND)


def _union_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit from the runs of all blocks."""
    for batch in batches:
        total = []
        for blobs in batch.column("runs").to_pylist():
            runs = np.concatenate([np.empty((0, 2), np.int32), *(np.frombuffer(x, np.int32).reshape(-1, 2) for x in blobs)])
            runs = runs[np.argsort(runs[:, 0], kind="stable")].astype(np.int64)
            before = np.maximum.accumulate(np.concatenate([[0], runs[:, 1]]))[:-1]
            total.append(int(np.maximum(runs[:, 1] - np.maximum(runs[:, 0], before), 0).sum()))
        names = [c for c in batch.schema.names if c not in ("runs", "n_hit")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(total, pa.int64())], names=[*names, "n_hit"])


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, slack: int = 2) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items, text_key; a row per row of docs.

    Words are runs of letters and digits after lower-casing A-Z. An item's windows are its runs of
    `window` words, or all its words if there are fewer; n_hit counts the document words inside any
    exact occurrence, items are the item_ids with one (as strings, sorted). near_items are those with a window whose words
    all stand within `slack` places of where the phrase has them, counted from its rarest word; a near
    match alone doesn't contaminate. Null, empty and wordless texts and items have no windows and no hits; items with
    equal texts all count. Items beyond one block are searched block by block in the same index, and a row's
    hits are the union over the blocks. Rows that repeat a doc_id get a row each; extra columns are ignored;
    without items nothing is contaminated. text_key is the xxhash64 of the text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    index = store_index(docs, scratch)
    found, k = None, 0
    for k, block in enumerate(item_blocks(items, window)):
        part = search_index(index, block, slack, every=not k)
        found = part if found is None else scratch.table(found, f"found{k}").unionByName(part)
    if found is None:
        found = search_index(index, Items([], [], window), slack)
    if k:
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        one = [F.max(c).alias(c) for c in ("doc_id", "text_key", "n_words")]  # equal in all blocks
        found = found.groupBy("segment", "place").agg(*one, F.collect_list("runs").alias("runs"), union("found"), union("near"))
        found = found.mapInArrow(_union_of_runs, "segment long, place int, doc_id long, text_key long, n_words long, found array<string>, near array<string>, n_hit long")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.col("found").alias("items"), F.col("near").alias("near_items"), "text_key",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The same over DuckDB: every run of as many words as some window has is looked up among the windows.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
runs AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT runs.doc_id, runs.i, runs.k, win.item_id FROM runs JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
