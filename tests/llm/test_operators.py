"""Small tables with every awkward case, against brute force or exact round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embralign.llm import decontaminate, html_text, language, line_dedup, near_dedup, pack, quality, shard, token_files, vector_dedup
from embralign.llm._tokens import tokenizer_path

RNG = np.random.default_rng(3)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


LONG = prose(60_000)
BASE = [prose(n) for n in (80, 90, 120, 40)]
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1].upper(), BASE[2] + " extra", "intro " + BASE[2], None, "", " \n\t ", "one", "one two", "ONE  two", "é ß x\x00y 日本", LONG, LONG + " tail",
    BASE[0] + "\n" + BASE[3] + "\n\n" + BASE[0], "a\n" + BASE[3] + " more",
]
KINDS = "doc_id long, text string, lang string, n long, score double, removed string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 0.5, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, BASE[1], None, None, None, None), (None, None, None, None, None, None)], KINDS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, short=True):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w and short else [])


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "group_rows": 1}])
def test_near_duplicates(docs, empty, options):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, **options).collect() if r.doc_id is not None}
    sets = [shingles(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(TEXTS))] == [(len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label, strict=True))]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(7, BASE[0]), (3, BASE[1]), (3, BASE[0] + " x"), (3, "quite another text of some length here"), (None, BASE[0]), (None, BASE[2]), (None, BASE[2]), (9, None), (None, None), (5, BASE[1]), (5, BASE[1])]
    got = near_dedup.near_duplicates(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, first double").repartition(3)).collect()
    found = Counter((r.doc_id, r.component_id, r.kept) for r in got)
    assert found == Counter([(7, 3, False), (3, 3, True), (3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (None, None, True), (9, 9, True), (None, None, True), (5, 3, False), (5, 3, False)])
    assert sum(r.first for r in got) == 1 + 1 + 1 + 2 + 2  # a component each: base 0, base 1, the other text, base 2 twice, no text twice


def test_lines(docs, empty):
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs.where("doc_id is not null")).collect()}
    seen = []
    for i, t in enumerate(TEXTS):
        keep = []
        for line in (t or "").split("\n"):
            s = shingles(line, False)
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                keep.append(line)
            if s:
                seen.append(s)
        assert got[i].text == (None if t is None else "\n".join(keep))
    assert "score" in got[0] and line_dedup.remove_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"long_tokens": 4, "block": 2, "long_block": 2}])
def test_lines_of_repeated_and_null_ids(spark, options):
    a, b, c, d = (prose(n) for n in (30, 25, 12, 3))
    rows = [(1, a), (2, a + "\n" + d), (2, b), (2, b), (3, d + "\n" + b + " tail\n" + c), (None, c), (None, c + " more\n" + d), (None, None), (4, ""), (5, a.replace(" ", "  ", 3).upper() + "\n" + prose(9))]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, removed_doc string, own_id int").repartition(3)
    got = {r.own_id: r for r in line_dedup.remove_repeated_lines(docs, least_words=1, **options).collect()}
    key = {r.own_id: r.k for r in docs.select("own_id", F.xxhash64("text").alias("k")).collect()}
    order = sorted({(i is not None, i or 0, key[k], t or "") for k, (i, t) in enumerate(rows)})
    seen, keep = [], {}
    for _, i, k, t in order:
        lines = keep[i, k] = []
        for line in t.split("\n"):
            s = shingles(line)
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                lines.append(line)
            if s:
                seen.append(s)
    for k, (i, t) in enumerate(rows):
        assert got[k].text == (None if t is None else "\n".join(keep[i or 0, key[k]])) and got[k].removed_doc == "x"
    assert sum(r.n_removed for r in got.values()) == sum(len((t or "").split("\n")) - len(keep[i or 0, key[k]]) for k, (i, t) in enumerate(rows) if t is not None)


def test_short_lines(spark, tmp_path):
    import corpus_pipeline

    texts = ["All rights reserved.\n" + BASE[0] + "\n\nHome", "ALL  rights reserved.\nreserved. rights all\n\n" + BASE[3] + "\nhome\nAll rights", "All rights\n \nAll rights reserved. 2024\na b c d e\nA b c d e", None]
    want = [texts[0], "reserved. rights all\n\n" + BASE[3] + "\nAll rights", " \nAll rights reserved. 2024\na b c d e", None]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.op3_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.text, r.n_removed) for r in got] == [*zip(want, (0, 2, 2), strict=False), (None, 0)]
    assert [r.text for r in corpus_pipeline.line_stage(spark, rows, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_shards(docs, empty):
    got = shard.shards(docs, 7, rows_per_bucket=1).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in sorted(Counter(r.shard for r in got).items()) for k in range(n)]
    more = {r.doc_id: r.shard for r in shard.shards(docs, 8).collect()}
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else None
        assert r.doc_id is None or (r["size"], r.text_crc32) == (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
        assert r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 7)
    heavy = docs.sparkSession.range(4000).select(shard.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    count = {r.s: r["count"] for r in heavy}
    assert 2.6 < count[1] / count[0] < 3.4 and 2 not in count
    assert shard.shards(empty).count() == 0


def encoded(name, end):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [np.append(np.array(e.ids, "<u4"), np.uint32(end)).astype("<u4") for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_token_files(docs, empty, tmp_path):
    want = encoded("byte_bpe_50k.json", 2)
    folder = str(tmp_path / "files")
    token_files.write_token_files(docs.where("doc_id is not null"), folder, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=2, segment_bytes=500)
    got = token_files.read_token_files(docs.sparkSession, folder, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, x in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(x), zlib.crc32(x.tobytes()), x.tolist())
        start += len(x)
    dictionary = bytes(docs.sparkSession.read.parquet(folder + "/dictionary").first().dictionary)
    hits = [token_files.read_document(bytes(r.blob), dictionary, 16) for r in docs.sparkSession.read.parquet(folder + "/segments").collect()]
    assert [h.tolist() for h in hits if h is not None] == [want[16].tolist()]
    token_files.write_token_files(empty, str(tmp_path / "none"), tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=2)
    assert token_files.read_token_files(docs.sparkSession, str(tmp_path / "none")).count() == 0


def test_packing(docs, empty):
    want = encoded("word_bpe_49k.json", 1)
    got = pack.pack(docs.where("doc_id is not null"), tokenizer=tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    pieces, rooms = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        rooms.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    for i, x in enumerate(want):
        assert sum((r.ids for r in sorted(pieces[i], key=lambda r: r.start)), []) == x.tolist()
    for own in rooms.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(rooms) == list(range(len(rooms))) and len(rooms) <= sum(map(len, want)) / 2048 * 1.05 + 2
    assert pack.pack(empty, tokenizer=tokenizer_path("word_bpe_49k.json")).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(5, BASE[0]), (40, "Intro: " + " ".join(BASE[2].split()[:12])), (7, "one, TWO!"), (8, None), (9, "..."), (10, BASE[0])], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs.where("doc_id is not null"), items).collect()}
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for i, t in enumerate(TEXTS):
        w, hit, found = token(t), set(), set()
        at = {}
        for k in range(len(w)):
            at.setdefault(w[k], []).append(k)
        for r in items.collect():
            v = token(r.text)
            for a in range(max(1, len(v) - 9) if v else 0):
                win = v[a : a + 10]
                for b in at.get(win[0], []):
                    if w[b : b + len(win)] == win:
                        hit |= set(range(b, b + len(win)))
                        found.add(str(r.item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), digest, bool(hit))
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_decontamination_of_many_blocks(spark, docs, monkeypatch):
    w = BASE[1].split()
    passages = [w[:12], w[8:20], w[40:55], w[70:80], BASE[0].split()[3:20], w[:10]]
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)] + [(2, " ".join(w[:15])), (9, None)], "item_id long, text string")
    twice = docs.unionByName(docs.where("doc_id = 2").withColumn("text", F.lit(" ".join(w[38:60]))))  # a doc_id with two texts
    rows = lambda: sorted(map(str, decontaminate.contamination(twice, items).collect()))
    want = rows()
    assert [r.n_hit for r in decontaminate.contamination(docs, items).where("doc_id = 1").collect()] == [20 + 15 + 10] and len(want) == twice.count()
    for n in (1, 2, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", n)
        assert rows() == want


def test_proximity(spark):
    w = [f"t{i}" for i in range(12)]
    moved = " ".join([*w[:4], "odd", *w[4:]])
    swapped = " ".join([*w[:5], w[6], w[5], *w[7:]])
    far = " ".join([*w[:4], "odd odd odd", *w[4:]])
    rows = [(1, " ".join(w)), (2, moved), (3, swapped), (4, far), (5, "t0 t1 t2 t3"), (6, " ".join(w[6:])), (7, " ".join(w[:6])), (None, moved)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("q", " ".join(w))], "item_id string, text string")
    got = decontaminate.contamination(docs, items, slack=1).collect()
    assert [(r.doc_id, r["items"], r.near_items, r.n_hit) for r in got] == [(1, ["q"], ["q"], 12), (2, [], ["q"], 0), (3, [], ["q"], 0), *[(i, [], [], 0) for i in (4, 5, 6, 7)], (None, [], ["q"], 0)]
    assert [r.near_items for r in decontaminate.contamination(docs, items, slack=0).collect()] == [["q"], *[[]] * 7]


def test_vectors(spark):
    base = RNG.standard_normal((40, 8))
    rows = [*base, base[0], base[0], *(base[:20] + 0.12 * RNG.standard_normal((20, 8))), np.zeros(8)]
    bad = [None, [], [float("nan")] * 8, [1.0, None, *[0.0] * 6], [float("inf")] * 8]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(100 + i, v) for i, v in enumerate(bad)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=4, pivots=6, keep=6, shared=1).collect()}
    m = np.array(rows[:-1])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    assert [got[i].n_links for i in range(len(m))] == link.sum(1).tolist()
    for i in [len(m), *range(100, 105)]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    for i, j in zip(*np.nonzero(link), strict=True):
        assert got[int(i)].component_id == got[int(j)].component_id
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_with_repeated_and_null_ids(spark):
    a, b, c = np.eye(3)
    near = a + 0.1 * b
    rows = [(1, a), (1, near), (2, b), (2, b), (None, a), (None, c), (3, c * 5), (4, -a)]
    got = vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, rep int").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (2, 1, 2, True), (None, 2, 1, False), (None, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True)])


def test_vectors_of_a_dense_group(spark):
    rng = np.random.default_rng(11)
    near = rng.standard_normal(64)
    near = near / np.linalg.norm(near) + 0.029 * rng.standard_normal((4000, 64))  # pairwise cosine about 0.95
    m = np.vstack([near, rng.standard_normal((4000, 64))])
    data = [(i, v.tolist()) for i, v in enumerate(m)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert [got[i].n_links for i in range(len(m))] == ((m @ m.T >= 0.9).sum(1) - 1).tolist()
    assert sum(r.kept for r in got.values()) == 4001


def test_language_and_quality(spark, docs, empty):
    tongues = {"en": "the and of house river stone ", "de": "der und die haus fluss stein ", "fr": "le et la maison fleuve pierre "}
    rows = [(i, " ".join(RNG.permutation((t * 4).split())), k) for i in range(60) for k, t in tongues.items()]
    known = spark.createDataFrame([(i, t, k) for i, (_, t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language.identify(known.select("doc_id", "text"), known.where("doc_id % 4 <> 2")).join(known.select("doc_id", "lang"), "doc_id")
    assert got.where("lang <> lang_pred").count() == 0
    odd = {r.doc_id: r for r in language.identify(docs, known).collect()}
    assert odd[9].lang_pred == odd[10].lang_pred == odd[11].lang_pred == "und" and odd[0].score <= 1
    assert language.identify(empty, known).count() == 0 and language.identify(docs, known.limit(0)).where("lang_pred <> 'und'").count() == 0
    code = language.codewords(9)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 5
    junk = spark.createDataFrame([(1000 + i, " ".join(f"{w}$$$" for w in RNG.choice(VOCABULARY, 30)), 0) for i in range(60)] + [(i, prose(40), 1) for i in range(60)], "doc_id long, text string, quality int")
    score = quality.score_quality(junk.drop("quality"), junk.where("doc_id % 3 > 0")).join(junk.select("doc_id", "quality"), "doc_id")
    assert score.where("predicted <> quality").count() == 0
    assert {r.score for r in quality.score_quality(docs, junk).where("doc_id in (9, 10, 11)").collect()} == {0.0}
    assert quality.score_quality(docs, junk.limit(0)).where("score <> 0").count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site to be of use.</div>
<article><h1>A &amp; B</h1><p>The   house of the river is in the valley and it was for the people who came from the hills, as they have said to us.<p>Short one.</p>
<aside>Related things</aside><p>It is by the <a href=y>old road</a> that the&nbsp;<b>mill</b>stone was found, and it was not for us to say which of the two stands there.</p><form><input>Sign up</form></article>
<section id="comments"><article class="comment"><p>I think that the house of the river is not in the valley and that it was for the others.</p></article></section><footer>&copy; x</footer><script>var a = "</p>";</script></body></html>"""


@pytest.mark.parametrize("k", [1, 4, 15, 99])
def test_equal_neighbours_count_in_order(k):
    from embralign.llm.quality import Neighbours

    rng = np.random.default_rng(5)
    x = np.repeat(np.abs(rng.normal(size=(12, quality.DIMENSIONS))).astype(np.float32), 5, axis=0)  # each row five times
    labels = rng.integers(0, 2, len(x))
    model = Neighbours(x, labels)
    got = model.score(x[::5], k)
    z = model._unit((x[::5] * model.weight) @ model.project)
    for i, cosine in enumerate(z @ model.vectors.T):
        near = np.argsort(-cosine, kind="stable")[:k]
        w = np.maximum(cosine[near], 0) ** 4 + 1e-9
        assert got[i] == pytest.approx(float((w * labels[near]).sum() / w.sum()), abs=1e-5)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizers_of_another_kind(name, tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from embralign.llm._tokens import Encoder, tokenizer_path

    assert Encoder(tokenizer_path(name)).by_pieces
    settings = json.load(open(tokenizer_path(name), encoding="utf-8"))
    settings["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / name)
    json.dump(settings, open(path, "w", encoding="utf-8"))
    other, library = Encoder(path), Tokenizer.from_file(path)
    texts = ["", "a plain text, of words", None, "two\n\nlines  and\tmore", "word " * 50]
    ids, counts = other.many(pa.array(texts, pa.string()))
    want = [[] if t is None else library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not other.by_pieces and ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as Fake

    from embralign.llm._base import shared_folder

    unset = Fake(get=lambda key, default=None: default)
    cluster = Fake(conf=unset, sparkContext=Fake(getConf=lambda: unset, master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_html(spark):
    want = "A & B\nThe house of the river is in the valley and it was for the people who came from the hills, as they have said to us.\nShort one.\nIt is by the old road that the millstone was found, and it was not for us to say which of the two stands there."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", PAGE[: PAGE.index("<aside")]), (6, "u", "<!-- x"), (7, "u", "<div>" * 3000)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[i].text for i in (2, 3, 4, 6, 7)] == [""] * 5
    assert got[5].text == "\n".join(want.split("\n")[:3])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SAID = "The house of the river is in the valley and it was for the people who came from the hills, as they have said to us."
MORE = "It is by the old road that the millstone was found, and it was not for us to say which of the two stands there."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Item of the menu number {i} and a few more words of the kind</a></li>" for i in range(8)) + "</ul>"
SHAPES = [
    (f"<div class='page has-sidebar'><div><p>{SAID}</p><p>{MORE}</p></div></div>", [SAID, MORE]),
    (f"<div class=post><div class='entry-header'><h1>A title</h1></div><p>{SAID}</p><p>Short end.</p></div>", ["A title", SAID, "Short end."]),
    (f"{LINKS}<div><p>{SAID}</p><p>And so on.</p><p>{MORE}</p></div>{LINKS}", [SAID, "And so on.", MORE]),
    (f"<article><p>{SAID}</p>{LINKS}<p>{MORE}</p></article>", [SAID, MORE]),
    (f"<p>{SAID}</p><a href=/x><div>All of the other stories that we have of the day, and it is for you to read them in the evening.</div></a><p>{MORE}</p>", [SAID, MORE]),
    ("<div><p>Дом у реки стоит в долине, и он был построен для людей, которые пришли с холмов, как они сами рассказали нам вчера вечером у большого огня во дворе.</p></div>", ["Дом у реки стоит в долине, и он был построен для людей, которые пришли с холмов, как они сами рассказали нам вчера вечером у большого огня во дворе."]),
    ("<body><p>One short paragraph.</p></body>", ["One short paragraph."]),
    (f"<article><h2>Teaser</h2></article><div><p>{SAID}</p><p>{MORE}</p></div>", ["Teaser", SAID, MORE]),
    (f"<form id=aspnet><h1>A title</h1><p>{SAID}</p></form>", ["A title", SAID]),
    (f"<main><p>{SAID}</p><p class=alert>It is a note.</p><div class='cookie-notice'>{MORE}</div></main><div class=related-posts><p>{MORE}</p></div>", [SAID, "It is a note."]),
    (f"<nav><p>{SAID}</p></nav><p>{MORE}</p><div class='comments-area'><p>{SAID}</p><p>{SAID}</p></div>", [MORE]),
    (f"<table><tr><td class=sidebar>{LINKS}</td><td><h2>A title</h2><p>{SAID}</p><p>{MORE}</td></tr></table>", ["A title", SAID, MORE]),
    ("<p hidden>No</p><div style='display:none'><p>No</p></div><p>a&lt;b&#x20AC;&nbsp;\t c</p>", ["a<b€ c"]),
]


def test_page_shapes():
    for page, want in SHAPES:
        assert html_text.main_text(page) == "\n".join(want), page


def test_text_decides(spark):
    """Without tags or classes the stop words decide, and many short blocks take no longer than they must."""
    low = "lorem ipsum " * 20
    linked = f"<p>{low}<a href=/>link</a></p>"
    found, regions = html_text.blocks(f"<p>{SAID} {MORE}</p>{linked}")
    html_text.classify(found, regions)
    assert [b.label for b in found] == ["good", "bad"]
    html_text.classify(found, regions, stop_words=frozenset("lorem ipsum".split()))
    assert found[1].label == "good"
    assert len(html_text.main_text("<p>few words</p>" * 20_000)) == 20_000 * 10 - 1
    rows = spark.createDataFrame([(1, "u", f"<p>{SAID}</p>", 5)], "page_id int, url string, html string, text int")
    assert html_text.extract(rows).first().text == SAID


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    whole = [prose(60) + "\n" + prose(30) for _ in range(8)]
    leak = prose(15)
    near = whole[1].replace("\n", " ").split()
    texts = [(i, t) for i, t in enumerate(whole)] + [
        (20, whole[0]), (None, " ".join([*near[:40], "odd", *near[40:]])), (21, "123 456"), (22, None), (22, ""), (23, prose(20) + " " + leak), (23, prose(25)), (None, prose(9) + " " + leak.upper()),
        (24, prose(30) + "\n" + whole[2].split("\n")[0] + " tail\nshort line"), (25, "short line\n" + prose(14)), (25, "Short  line"),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, spark.range(1).select(F.xxhash64(F.lit(r.text))).first()[0], r.text)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r for r in docs.collect()), key=key)
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want, seen = [], []
        for r in before:
            if name == "language_id":
                want += [(r.doc_id, r.text)] * (r.text is not None and any(map(str.isalpha, r.text)))
            elif name == "line_dedup":
                lines = r.text.split("\n")
                keep = []
                for line in lines:
                    s = shingles(line)
                    keep += [line] * (not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen))
                    seen += [s] * bool(s)
                want += [(r.doc_id, "\n".join(keep))] * (len(keep) == len(lines) or "\n".join(keep).strip() != "")
            elif name == "near_dedup":  # no chains here
                s = shingles(r.text)
                want += [(r.doc_id, r.text)] * (not any(100 * len(s & o) >= 80 * len(s | o) for o in seen))
                seen.append(s)
            elif name == "decontamination":
                w, x = r.text.lower().split(), leak.split()
                want += [(r.doc_id, r.text)] * (not any(w[a : a + 10] == x[b : b + 10] for a in range(len(w) - 9) for b in range(6)))
        if k < 4:
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want) and len(want) < len(before)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            total = Counter()
            for r in docs.collect():
                total[r.doc_id] += r.length
            sizes = Counter()
            for r in before:
                sizes[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
            assert total == sizes
    whole_run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole_run.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "start", "length", "ids_crc32").collect()))
    bare = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, bare, str(tmp_path)).count() == 0
