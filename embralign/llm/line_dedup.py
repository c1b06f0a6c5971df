"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct five-word shingles; a shorter line's one token is all its words. Lines with equal sets form a class that enters
the join once. All tokens have one global order, rarest first: by the corpus count of their bucket in
a table of fixed size (counts over all lines), then by hash; any fixed order gives the same result, a
good one short lists. If two sets reach Jaccard similarity t, their prefixes (the first n - ceil(t n) + 1
tokens) share a token, so the lists of prefix tokens hold every pair; sets too small to reach t with any but an
equal one (under 4 tokens for t = 0.8) need none; length and positional filters
discard most pairs of a list, and the full sets decide the others. A line goes if an earlier line
(by doc_id, then place in the text) has similarity t or more; all later copies go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Scratch, gathered, partitions, read_table
from ._graph import connected_components
from ._text import SPACED, U, as_bytes, distinct_by_group, hash_words, mix, shingle_hashes, small_batches, sort_by_group
from .near_dedup import grouped

WORDS = 5
BUCKETS = 1 << 18
SLICES = 64


def lines_of(column: pa.Array, least: int = WORDS, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with at least so many words: its text's place in the column, its number, its distinct tokens (all, sorted by hash) and how many.

    chosen(place, number), if given, says which lines are wanted.
    """
    data, offsets = as_bytes(column)
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], feeds, side="right")])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    words, counts, _ = hash_words(data, np.append(starts, len(data)), SPACED)
    enough = counts >= max(least, 1)
    if chosen is not None:
        enough &= chosen(owner, number)
    tokens, n = distinct_by_group(*shingle_hashes(words[np.repeat(enough, counts)], counts[enough], WORDS))
    return owner[enough], number[enough], tokens, n


def line_key(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of each set's name."""
    if not len(n):
        return np.empty(0, np.int64)
    begin = np.cumsum(n) - n
    return mix(np.add.reduceat(mix(tokens + U(0x51)), begin) ^ (n.astype(U) << U(48)) ^ np.bitwise_xor.reduceat(tokens, begin)).view(np.int64)


def line_tail(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """32 more bits of the name: lines are equal if both parts are (at 1e12 lines the chance of any false pair is about 6e-6)."""
    if not len(n):
        return np.empty(0, np.int32)
    return (mix(np.add.reduceat(tokens, np.cumsum(n) - n)) >> U(32)).astype(np.uint32).view(np.int32)


def _names_and_counts(least: int):
    """A row for each line, then the task's tokens in each bucket: a row for each slice of buckets, numbered from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "text_key", "number", "line", "tail", "counts"]
        for batch in small_batches(batches, "text"):
            owner, number, tokens, n = lines_of(batch.column("text"), least)
            total += np.bincount((tokens >> U(46)).astype(np.int64), minlength=BUCKETS)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("text_key").take(owner), pa.array(number, pa.int32()), pa.array(line_key(tokens, n)), pa.array(line_tail(tokens, n)), pa.nulls(len(owner), pa.binary())], names=names)
        if total.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(-1 - np.arange(SLICES), pa.int32()), none, pa.nulls(SLICES, pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=names)

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("number").to_pylist(), batch.column("counts"), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["number", "counts"])


def bucket_counts(named: DataFrame) -> np.ndarray:
    """Tokens of all lines in each bucket: BUCKETS numbers, summed on executors."""
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in named.where("number < 0").select("number", "counts").repartition(SLICES, "number").mapInArrow(_sum_slices, "number int, counts binary").collect():  # SLICES rows
        out[-1 - r.number] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _postings(order, least: int, percent: int, parts: int, most: int = 1 << 20):
    """A posting for each prefix token of each class that this task hasn't met yet, packed by the part its token falls in.

    order ranks the buckets, rarest first; a token's bucket is replaced by its rank, so tokens sort as the global order has
    them. A posting is three 64-bit numbers: token, line, and size and rank together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.empty(0, np.int64)  # sorted
        held, size = [], 0
        for batch in small_batches(batches, "text"):
            _, _, tokens, n = lines_of(batch.column("text"), least)
            partner = 100 * n >= percent * (n + 1)
            tokens, n = tokens[np.repeat(partner, n)], n[partner]
            key = line_key(tokens, n)
            if len(met) > 1 << 20:
                met = met[:0]
            fresh = np.zeros(len(key), bool)
            fresh[np.unique(key, return_index=True)[1]] = True
            if len(met):
                fresh &= met[np.minimum(np.searchsorted(met, key), len(met) - 1)] != key
            met = np.sort(np.concatenate([met, key[fresh]]))
            tokens, n, key = tokens[np.repeat(fresh, n)], n[fresh], key[fresh]
            tokens = sort_by_group((order.value[(tokens >> U(46)).astype(np.int64)] << U(46)) | (tokens & U((1 << 46) - 1)), n)
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            inside = rank < np.repeat(prefix_length(n, percent), n)
            own = np.repeat(np.arange(len(n)), n)[inside]
            held.append(np.stack([tokens[inside].view(np.int64), key[own], n[own] << 32 | rank[inside]], 1))
            size += len(own)
            if size >= most:
                yield from pack(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from pack(np.concatenate(held))

    def pack(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 1 << 22):  # one very long text has more
            some = rows[a : a + (1 << 22)]
            part = (mix(some[:, 0].view(U)) % U(parts)).astype(np.int32)
            by_part = np.argsort(part, kind="stable")
            name, first = np.unique(part[by_part], return_index=True)
            offsets = (np.append(first, len(some)) * some.itemsize * 3).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(offsets), pa.py_buffer(some[by_part].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(name), packed], names=["part", "postings"])

    return run


def _shared_lists(percent: int):
    """Of packed postings sorted by part: the lists with two lines or more that some other line of theirs is near in length.

    member names a list's lines, head is the rank of the token in its first line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "part"):
            rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in group.column("postings")])
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            yield emit([rows[:, 0], rows[:, 1], rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF])

    def emit(part: list[np.ndarray]) -> pa.RecordBatch:
        token, line, n, rank = part
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        token, line, n, rank = (x[new] for x in part)
        by_length = np.lexsort((n, token))
        t, k = token[by_length], n[by_length].astype(np.int64)
        close = (t[1:] == t[:-1]) & (100 * k[:-1] >= percent * k[1:])
        near = np.zeros(len(t), bool)
        near[1:] |= close
        near[:-1] |= close
        some = np.zeros(len(t), bool)
        some[by_length] = near
        token, line, n, rank = (x[some] for x in (token, line, n, rank))
        _, first, inverse, size = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
        member = np.add.reduceat(mix(line.view(U)), first) if len(first) else np.empty(0, U)
        out = [token, line, n.astype(np.int32), rank.astype(np.int32), member.view(np.int64)[inverse], rank[first][inverse].astype(np.int32), size[inverse]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "line", "n", "rank", "member", "head", "size"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted lines of each text (those in lists, so none of fewer than five words)."""
    for batch in small_batches(batches, "text"):
        want = batch.column("wanted").to_pylist()
        pairs = np.array([(i << 32) | k for i, x in enumerate(want) for k in x], np.int64)
        owner, number, tokens, n = lines_of(batch.column("text"), chosen=lambda o, k, pairs=pairs: np.isin((o << 32) | k, pairs))
        begin = np.cumsum(n) - n
        sets = [tokens[a : a + k].tobytes() for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
        owner = pa.array(owner)
        columns = [pa.array(line_key(tokens, n)), pa.array(line_tail(tokens, n)), batch.column("doc_id").take(owner), batch.column("text_key").take(owner), pa.array(number, pa.int32()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["line", "tail", "doc_id", "text_key", "number", "set"])


def _later_matches(percent: int):
    """The lines of each list task that an earlier line of the task matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[tuple[int, int]] = set()
        for group in grouped(batches, "task"):
            line = list(zip(group.column("line").to_pylist(), group.column("tail").to_pylist(), strict=True))
            rank = group.column("rank").to_numpy().astype(np.int64)
            sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("set")]
            n = np.array([len(x) for x in sets], np.int64)
            found = []
            for i in range(1, len(line)):  # rows come in the order of first places
                if line[i] in gone:
                    continue
                need = -(-percent * (n[i] + n[:i]) // (100 + percent))
                y = np.flatnonzero((100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i])) & (np.minimum(n[i] - rank[i], n[:i] - rank[:i]) >= need))
                for a in range(0, len(y), 256):
                    part = y[a : a + 256]
                    values = np.concatenate([sets[j] for j in part])
                    at = np.searchsorted(sets[i], values)
                    hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == values
                    inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[part]) - n[part])
                    if (100 * inter >= percent * (n[i] + n[part] - inter)).any():
                        gone.add(line[i])
                        found.append(line[i])
                        break
            if len(gone) > 1 << 20:
                gone.clear()
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int32())], names=["line", "tail"])

    return run


def _without(removed: str, n_lines: str, n_removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != removed]
            texts, total, gone = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column(removed).to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                out = set(drop or ())
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in out) if out else text)
                total.append(len(parts))
                gone.append(len(out))
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, n_lines, n_removed])

    return run


def _free(name: str, taken: list[str]) -> str:
    """name with so many underscores that no column has it, in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _beside(side: DataFrame, numbers: str, most: int) -> DataFrame:
    """side (a row for each text, with an array of numbers) to be broadcast if its measured size allows, else to be joined as the planner likes."""
    told = side.agg(F.count("*"), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(side) if 96 * told[0] + 8 * told[1] <= most else side


def remove_repeated_lines(docs: DataFrame, *, least_words: int = WORDS, percent: int = 80, block: int = 2048, long_tokens: int = 512, long_block: int = 64, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns with the later lines gone from text, and n_lines, n_removed.

    Lines end at line feeds; ASCII case doesn't count. Lines with fewer than `least_words` words
    stay (with 1 only those without a word); of fewer than five words the whole sequence counts. Of equal
    lines in one text the first stays. Texts come in the order of doc_id (null first), those that share a doc_id
    in the order of the xxhash64 of the text; only rows equal in both are one record, which keeps
    or loses the same lines in each of them. Null texts stay null with 0 lines. Columns n_lines and n_removed
    of docs, if any, are replaced; other columns pass through, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_removed")
    text_key = F.xxhash64("text")
    texts = docs.select("doc_id", text_key.alias("text_key"), "text")
    named = scratch.table(texts.mapInArrow(_names_and_counts(least_words), "doc_id long, text_key long, number int, line long, tail int, counts binary"), "lines")
    lines, n_lines = named.where("number >= 0").drop("counts"), named.count()
    counts, n = bucket_counts(named), partitions(spark)
    order = np.empty(BUCKETS, U)
    order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=U)
    posts = int(counts.sum()) * (100 - percent) // 100
    parts = max(8 * n, posts >> 18)  # about 2^18 postings each, or fewer
    posted = texts.mapInArrow(_postings(spark.sparkContext.broadcast(order), least_words, percent, parts), "part int, postings binary")
    posted = gathered(posted.repartition(n, "part"), posts, 1 << 18).sortWithinPartitions("part")
    lists = posted.mapInArrow(_shared_lists(percent), "token long, line long, n int, rank int, member long, head int, size long")
    lists = scratch.table(lists, "lists0")
    listed = lists.count()
    few = lambda df, rows=listed, each=1 << 15: gathered(df, rows, each)
    # Of lists with the same lines, the first in the global order decides: it comes first in each of them.
    chosen = few(lists.groupBy("member").agg(F.min(F.struct("head", "token")).alias("c")).select("member", F.col("c.token").alias("token")))
    lists = few(lists.join(chosen, ["member", "token"]))
    blocks = F.ceil(F.col("size") / block).cast("int")
    lists = lists.withColumn("mine", F.pmod(F.xxhash64("line"), blocks).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lists = scratch.table(lists.select(F.xxhash64("token", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("task"), "line", "n", "rank"), "lists")
    scratch.drop("lists0")
    some = scratch.table(few(lists.select("line").distinct()), "listed")
    place = F.struct("doc_id", "text_key", "number")
    first = gathered(lines.groupBy("line", "tail").agg(F.min(place).alias("first"), F.count("*").alias("copies")), n_lines)
    marked = some.withColumn("listed", F.lit(True))
    first = scratch.table(gathered(first.join(marked, "line", "left").where("copies > 1 or listed"), n_lines).select("line", "tail", "first", "copies", F.coalesce("listed", F.lit(False)).alias("listed")), "first")
    wanted = first.where("listed").groupBy(F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key")).agg(F.collect_set("first.number").alias("wanted"))
    wanted = scratch.table(few(wanted), "wanted")
    sets = texts.join(_beside(wanted, "wanted", broadcast_bytes), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("doc_id", "text_key", "text", "wanted")
    sets = sets.mapInArrow(_full_sets, "line long, tail int, doc_id long, text_key long, number int, set binary").dropDuplicates(["line", "tail"])
    sets = scratch.table(few(sets, listed, 1 << 13), "sets")
    # A prefix grows with its set, so long sets don't travel with every prefix token: lines that share lists form groups, dealt in pairs of blocks.
    long = lists.where(F.col("n") > long_tokens * percent // 100).select("task", "line", "n")
    heads = few(long.groupBy("task").agg(F.min("line").alias("a")))
    groups = connected_components(few(long.join(heads, "task")).select("a", F.col("line").alias("b")), scratch, "long", listed).withColumnRenamed("id", "line")
    sizes = few(groups.groupBy("component").agg(F.ceil(F.count("*") / long_block).cast("int").alias("blocks")))
    dealt = few(few(groups.join(sizes, "component")).join(few(long.select("line", "n").distinct()), "line")).withColumn("mine", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("component", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("task"), "line", "n", F.lit(0).alias("rank"))
    lists = lists.where(F.col("n") <= long_tokens).unionByName(dealt)
    met = few(lists.join(sets, "line").repartition(n, "task"), listed, 1 << 14).sortWithinPartitions("task", "doc_id", "text_key", "number", "line", "tail")
    gone = met.select("task", "line", "tail", "rank", "set").mapInArrow(_later_matches(percent), "line long, tail int").distinct()
    gone = scratch.table(few(gone), "gone")
    marked = gathered(first.select("line", "tail", "first", "copies").join(gone.withColumn("matched", F.lit(True)), ["line", "tail"], "left").where("matched or copies > 1"), n_lines)
    later = gathered(lines.join(marked, ["line", "tail"]), n_lines, 1 << 18).where(F.col("matched") | ~place.eqNullSafe(F.col("first")))
    removed = scratch.table(gathered(later.groupBy("doc_id", "text_key").agg(F.collect_set("number").alias("removed")), n_lines), "removed")
    own_id, own_key, gone_at = (_free(c, docs.columns) for c in ("own_id", "own_key", "removed"))
    beside = _beside(removed, "removed", broadcast_bytes).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("removed").alias(gone_at))
    out = docs.join(beside, docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_key)), "left").drop(own_id, own_key)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return out.mapInArrow(_without(gone_at, "n_lines", "n_removed"), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs, least_words=1).select("doc_id", "text", "n_lines", "n_removed")


#: The same over DuckDB; doc_ids are unique there. Equal lines form a class first, as they have equal sets.
OP3_SQL = r"""
WITH l AS (SELECT doc_id, k, x[k] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, k, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (SELECT doc_id, k, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min((doc_id, k)) AS first, len(s) AS n, row_number() OVER () AS id FROM t GROUP BY s),
u AS (SELECT id, first, n, unnest(s) AS token FROM c),
m AS (SELECT y.id FROM u x JOIN u y ON x.token = y.token AND x.first < y.first GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
g AS (SELECT t.doc_id, t.k FROM t JOIN c ON t.s = c.s WHERE c.id IN (SELECT id FROM m) OR (t.doc_id, t.k) <> c.first),
o AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL) AS text, count(*) AS n_lines, count(g.k) AS n_removed FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN o USING (doc_id)
"""
