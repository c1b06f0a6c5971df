"""op4 moves texts of candidates alone, and blocks of a large group in turns, whatever the table's size."""

import numpy as np
import pytest

from embralign.llm import near_dedup
from embralign.llm._base import Scratch

RNG = np.random.default_rng(11)


@pytest.fixture
def written(monkeypatch):
    """(name, plan) of each scratch table."""
    held, plain = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, **o: held.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(self, df, name, **o))
    return held


def test_texts_meet_their_candidates_in_turns_without_a_shuffle(spark, written):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(RNG.permutation(words)) for _ in range(6)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t + " more") for i, t in enumerate(texts)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=4).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {i: i - i % 2 for i in range(12)}
    found = [plan for name, plan in written if name.startswith("resolved")]
    assert len(found) == 3 and not any("SortMergeJoin" in plan for plan in found)


def test_blocks_of_a_large_group_take_turns(spark, written):
    sets = [np.unique(RNG.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(14)]
    sets += [np.sort(np.append(s[:-1], np.uint64(1))) for s in sets[9:]]  # 14 to 18 are near 9 to 13
    rows = [(0, i, [i] * 8, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "turns")
    links = near_dedup._large_groups(spark.createDataFrame(rows, "group long, rep long, tokens array<long>, set binary"), len(rows), 85, scratch, block=4, round_bytes=1).collect()
    assert {frozenset(x) for x in links if x.a != x.b} >= {frozenset((i, i + 5)) for i in range(9, 14)}
    assert all(abs(x.a - x.b) in (0, 5) for x in links)
    assert sum(name.startswith("blocks") for name, _ in written) > 1
