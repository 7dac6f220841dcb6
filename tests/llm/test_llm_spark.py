"""The operators on Spark: awkward rows, empty tables, repeated rows, clashing columns; and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lexweave.llm")
import corpus_pipeline
from lexweave.llm import packing
from lexweave.llm.additive_ann import search
from lexweave.llm.chat import conversation_records, format_records, read_back
from lexweave.llm.hmm import score_documents
from lexweave.llm.line_dedup import dedup_lines, line_report
from lexweave.llm.minhash import _prefix_joined, dedup_documents, near_groups, shingle_sets
from lexweave.llm.mixing import mix, mixed_documents, word_count
from lexweave.llm.packing import pack
from lexweave.llm.shared import BATCH_BYTES, array_blocks, in_batches, summed, written
from lexweave.llm.pq_dedup import near_vectors
from lexweave.llm.quality import quality_scores
from lexweave.llm.queries import OP1, OP5, OP6
from lexweave.llm.token_output import token_round_trip
from lexweave.llm.tokens import public_path

LINE = "this line is long enough to be a key of forty"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, length int, hash string, n int, component string, k1 int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 0.5, 1, "x", 2, "c", 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{LINE}\nown {i}", "a") for i in range(6)] + [(10, words, "a"), (11, words, None), (12, words + " x", "b"), (13, None, "b"), (14, "", "c"), (15, " \n\t", "c"), (16, "two words", "b"), (None, "no id here", "a"), (17, "long " * 3000, "a"), (16, "two words", "b")]
    return _docs(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def test_lines(docs, empty):
    rows = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(docs).collect()}
    assert (0, 2, 1, hashlib.sha256(b"own 0").hexdigest()) in rows
    assert (5, 2, 0, hashlib.sha256(f"{LINE}\nown 5".encode()).hexdigest()) in rows
    assert {(13, 1, 0, hashlib.sha256(b"").hexdigest()), (14, 1, 0, hashlib.sha256(b"").hexdigest())} <= rows
    assert line_report(empty).count() == 0


def test_lines_keep_other_columns(docs, empty):
    clashing = docs.toDF("doc_id", "text", "bitmap", "doc_id_of_bitmap", "N_lines", "n_dropped", "pos", "k1", "kind", "survivor", "k2")
    out = dedup_lines(clashing)
    assert out.columns == [*clashing.columns, "n_lines_", "n_dropped_"]
    assert {(r.doc_id, r["n_lines_"], r["n_dropped_"]) for r in out.collect()} == {(r.doc_id, r.n_lines, r.n_dropped) for r in line_report(docs).collect()}
    assert dedup_lines(empty).count() == 0


def test_near_documents(docs, empty):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(docs).collect()}
    assert {(10, 56, 10, True), (11, 56, 10, False), (12, 57, 10, False), (13, 0, 13, True), (15, 0, 15, True), (16, 1, 16, True), (None, 1, None, True)} <= rows
    assert near_groups(empty).count() == 0


def test_unlike_texts_of_one_id_stay(spark, docs, empty):
    words = " ".join(f"w{i}" for i in range(60))
    rows = _docs(spark, [(1, words, "a"), (1, "quite another text of some more words", "b"), (2, words + " x", "c"), (1, words, "d"), (3, "alone", "e"), (None, words, "f")])
    clashing = rows.toDF("doc_id", "text", "row_number_of_dedup", "component_id", "n", "kept", "key", "id", "sketch", "component", "d1")
    out = dedup_documents(clashing)
    assert out.columns == clashing.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, words), (1, "quite another text of some more words"), (3, "alone"), (0, words)])
    assert dedup_documents(empty).count() == 0 and dedup_documents(docs).where("doc_id in (11, 12)").count() == 0
    groups = {r.doc_id: r.component_id for r in near_groups(rows.unionByName(_docs(spark, [(3, "third text of number three", "a"), (3, words, "a"), (3, "fourth text here", "a"), (9, "third text of number three", "a")]))).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 9: 1, None: None}


def _around_a_passage(own: int):
    """Texts around one frequent passage, each with words of its own, some of them changed a little: similar at about the threshold."""
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(90):
        tail = [f"o{i // 3 if i % 5 == 0 else i}-{j}" for j in range(own + i % 7)]
        texts.append(" ".join([*passage[: 60 - i % 4], *tail]))
    return texts


def _links(texts):
    sets = [set(s.tolist()) for s in shingle_sets([t.encode() for t in texts])]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("own", [4, 9, 30])
def test_members_of_a_large_bucket_meet_exactly(spark, own):
    texts = _around_a_passage(own)
    sets = [s.astype("int64").tolist() for s in shingle_sets([t.encode() for t in texts])]
    members = spark.createDataFrame([(i, i) for i in range(len(texts))], "id long, component long")
    groups = _prefix_joined(members, written(spark.createDataFrame(list(enumerate(sets)), "id long, items array<long>"), "test"), 75, spark.createDataFrame([], "id long, component long"))
    links = _links(texts)
    if links:  # each id's component is the smallest id it reaches
        root = {i: i for pair in links for i in pair}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert {r.id: r.component for r in groups.collect()} == {i: c for i, c in root.items() if i != c}  # the smallest needs no row
        whole = {r.doc_id: r.component_id for r in near_groups(_docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
        assert whole == {i: root.get(i, i) for i in range(len(texts))}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 10), 0) for i in (0, 1, 2, 3, 4, 5, 10, 11, 12, 17)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(empty, labels).count() == 0


def _reshared(sizes, weights=(5, 2, 1)):
    """Targets by sharing, capping and sharing the excess again, in exact fractions."""
    from fractions import Fraction

    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, excess = dict.fromkeys(order, Fraction(0)), set(order), Fraction(3 * sum(sizes.values()), 2)
    while excess and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = sum(max(Fraction(0), target[s] - 2 * sizes[s]) for s in free)
        free -= {s for s in free if target[s] >= 2 * sizes[s]}
        target = {s: min(t, Fraction(2 * sizes[s])) for s, t in target.items()}
    return target


def _mix_holds(rows):
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = _reshared(sizes)
    assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in rows)
    assert all(0 <= t <= 2 * sizes[s] for s, t in want.items()) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mixing(spark, docs, empty):
    rows = mix(docs.dropDuplicates(["doc_id"])).collect()
    _mix_holds(rows)
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, mix(docs).collect())) and mix(docs).count() == docs.count()
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
    many = _docs(spark, [(i * 31 + j, "w " * (1 + (i * j) % 7 * (i + 1)), f"s{i:02}") for i in range(20) for j in range(30)])
    _mix_holds(mix(many).collect())


def test_mixed_documents_follow_the_mix_under_any_column_names(docs):
    clashing = docs.toDF("doc_id", "text", "base", "source", "threshold", "target", "copies", "hash", "__copy", "k", "d")
    out = mixed_documents(clashing)
    assert out.columns == clashing.columns
    took, want = {}, {}
    for r in out.collect():
        took[r.doc_id, r.source] = took.get((r.doc_id, r.source), 0) + 1
    for r in mix(docs).collect():
        if r.copies:
            want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    assert took == want


def test_tokens_and_packing(docs, empty):
    rows = token_round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows][0] is None and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (13, 14, 15)} == {1}
    assert token_round_trip(empty).count() == 0
    pieces = pack(docs).collect()
    at = {}
    for p in pieces:
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024
    long = sorted((p.piece, p.start, p.length) for p in pieces if p.doc_id == 17)
    assert all(n == 1024 for _, _, n in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:]))
    assert pack(empty).count() == 0


def _plain_ids(name, text):
    from tokenizers import Tokenizer

    tok = _plain_ids.__dict__.setdefault(name, Tokenizer.from_file(public_path(name)))
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def _token_docs(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10**6, "a <|endoftext|> b\n<|startoftext|>"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "Ünï cödé!? \t\x85 x\n\n y "), (10**6 + 4, "long word " * 4000)]
    return own.unionByName(spark.createDataFrame(odd, own.schema))


def test_token_files_hold_the_ids_of_the_plain_library(spark):
    docs, start = _token_docs(spark), 0
    want = {}
    for r in docs.orderBy("doc_id").collect():
        ids = _plain_ids("word_bpe_49k.json", r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_round_trip(docs).collect()} == want


def test_packed_pieces_hold_the_ids_of_the_plain_library(spark):
    docs, at = _token_docs(spark), {}
    for r in pack(docs).collect():
        at.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids, place = _plain_ids("byte_bpe_50k.json", r.text), 0
        for k, (piece, start, length, crc) in enumerate(sorted(at.pop(r.doc_id))):
            assert (piece, start) == (k, place) and length <= 1024 and crc == zlib.crc32(ids[start : start + length].tobytes())
            place += length
        assert place == len(ids)
    assert not at


def test_language_model(docs, empty):
    rows = score_documents(docs, rounds=1).collect()
    assert len(rows) == docs.count() and all(r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (13, 14, 15)} == {1}
    assert score_documents(empty).count() == 0


def test_base_columns_of_the_language_model_are_those_of_plain_counts(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))) for r in own.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*t, ""])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*t, ""])
        want[i, held(i), len(t) + 1, sum(counts[w] > 0 for w in [*t, ""]), total, round(base, 4)] += 1
    got = score_documents(own, rounds=1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_language_model_learns_from_long_documents(spark, monkeypatch):
    long = _docs(spark, [(i, " ".join(f"w{(i * j) % 40}" for j in range(5000)), "a") for i in range(1, 7)])
    score = lambda rounds: sum(r.score for r in score_documents(long, rounds=rounds).where("not held_out").collect())
    started = score(0)
    monkeypatch.setattr("lexweave.llm.hmm.SAMPLE_ROUNDS", 0)
    raw = score(0)
    assert started > raw and score(1) > raw


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b<|im_end|>", 0), (1, 0, "user", None, 0), (2, None, None, "x", 0), (2, 1, "assistant", "y", 0), (2, 1, "assistant", "y", 0), (None, 0, "user", "z", 0), (None, 0, "user", "z", 0)], "conv_id long, turn long, role string, text string, record int")
    rows = {r.conv_id: r for r in read_back(format_records(conversation_records(turns))).collect()}
    assert rows[1].n_turns == 2 and rows[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb<|im_end|>\n").hexdigest() and rows[1].loss_chars == 11
    assert read_back(format_records(conversation_records(turns))).where("conv_id is null").count() == 2
    assert rows[2].n_turns == 3 and rows[2].loss_sha256 == hashlib.sha256(b"yy").hexdigest() and rows[None].n_turns == 1
    assert read_back(format_records(conversation_records(turns.limit(0)))).count() == 0
    odd = format_records(spark.createDataFrame([(1, "not json"), (2, '{"what": 1}'), (3, None)], "conv_id long, record string")).collect()
    assert all(r.formatted is None for r in odd)


def test_vectors(spark):
    e = [(0, [1.0, 0.0], 1), (20, [2.0, 0.0], 1), (40, [1.0, 0.1], 1), (60, [0.0, 1.0], 1), (80, [1.0, 0.0], 2), (100, None, 1), (120, [0.0, 0.0], 1), (140, [1.0, None], 1), (160, [float("nan"), 1.0], 1), (180, [1.0, 0.0], None), (200, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, 7, 8) for r in e], "vec_id long, embedding array<float>, label int, list int, n int")
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()}
    assert rows[0] == (3, 0, True) and rows[1] == rows[20] == rows[40] == (3, 0, False)
    assert all(rows[i] == (0, i, True) for i in (60, 80, 100, 120, 140, 160, 180, 200))
    assert near_vectors(table.limit(0)).count() == 0
    found = [(r.rank, r.vec_id) for r in search(table).where("query_id = 0").orderBy("rank").collect()]
    assert found == [(1, 20), (2, 1), (3, 40), (4, 80), (5, 180), (6, 60)]
    assert search(table.limit(0)).count() == 0 and search(table.where("vec_id = 1")).count() == 0


def test_search_broadcasts_no_copies_of_the_queries(spark, monkeypatch):
    for name, value in (("HELD_BYTES", 20000), ("VECTORS", 64), ("QUERIES", 8)):
        monkeypatch.setattr(f"lexweave.llm.additive_ann.{name}", value, raising=False)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)) * 10.0 ** rng.integers(-3, 4, (600, 1))
    v[40], v[60], v[77] = v[40] * 1e100, v[60] * 1e-100, v[80]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(i, x[:3].tolist()) for i, x in enumerate(v[:30], 1000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = search(table)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    have = {}
    for r in found.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert list(have) == [*range(0, 600, 20), 1000, 1020]
    for i, got in have.items():
        same = [(j, x) for j, x in rows if j != i and len(x) == len(rows[i][1] if i < 1000 else rows[600][1])]
        q = dict(rows)[i]
        scores = [(j, float(np.multiply(q, x).cumsum()[-1])) for j, x in same]  # added one after the other
        assert got == sorted(scores, key=lambda x: (-x[1], x[0]))[:20]


def _sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(sql).fetchall()


def _check_quality(before, after, spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in quality_scores(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept == {i for i, p in scores.items() if p == 1}
    good, bad = ({i for i, q in labels.items() if q == v} for v in (1, 0))
    assert good <= kept and len(bad & kept) < len(bad) / 2  # no clean document goes, with some seventy labels to learn from


def _check_lines(before, after, spark, sf):
    want = {r[0]: r[3] for r in _sql(OP1, before)}
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def _check_near(before, after, spark, sf):
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in _sql(OP6, before) if r[3])


def _check_mixing(before, after, spark, sf):
    want = Counter({r[0]: r[4] // r[1] for r in _sql(OP5, before) if r[1] and r[4]})
    assert Counter(r.doc_id for r in after.collect()) == want and sum(want.values())
    words_of = lambda df: df.select(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(words_of(after) / words_of(before) - 1.5) < 0.1


def _check_packing(before, after, spark, sf):
    ids = {r.doc_id: len(_plain_ids("byte_bpe_50k.json", r.text)) for r in before.dropDuplicates(["doc_id"]).collect()}
    held, copies = Counter(), Counter(r.doc_id for r in before.collect())
    spans = {}
    for r in after.collect():
        held[r.doc_id] += r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == Counter({i: ids[i] * n for i, n in copies.items()})
    for places in spans.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 1024
    assert len(spans) <= 1.05 * sum(held.values()) / 1024 + 2


def test_pipeline(spark):
    """Each stage against a plainer way on its own input: SQL of the whole operator, or the plain library."""
    sf = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    checks = (_check_quality, _check_lines, _check_near, _check_mixing, _check_packing)
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=True):
        out = written(stage(spark, docs, sf), "test")
        assert out.count() > 0, name
        if check is not _check_packing:
            assert out.columns == first.columns and [f.dataType for f in out.schema] == [f.dataType for f in first.schema], name
        check(docs, out, spark, sf)
        docs = out
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in docs.collect())


def test_pipeline_takes_odd_rows_and_columns(spark, docs, empty):
    """Null texts and ids, repeated rows, clashing columns, and no rows at all, through every stage."""
    labelled = "/root/testdata/sf0.001"
    odd = docs.toDF("doc_id", "text", "lang", "source", "n_chars", "n_dropped", "bitmap", "hash", "base", "__copy", "row_number_of_dedup")
    for start in (odd, odd.limit(0)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, labelled), "odd")
            assert name == "best-fit packing" or rows.columns == odd.columns
            assert (rows.count() > 0) == (start is odd), name


def test_block_sums(spark):
    want = np.zeros(5000)
    want[[0, 1023, 1024, 4999]] = [10, 20, 30, 40]

    def parts(batches):
        for _ in batches:
            total = np.zeros(5000)
            total[[0, 1023, 1024, 4999]] = [1, 2, 3, 4]
            yield from array_blocks(total)

    blocks = spark.range(10, numPartitions=10).mapInArrow(parts, "block int, values binary")
    assert np.array_equal(summed(blocks, 5000), want)
    assert np.array_equal(summed(blocks.limit(0), 7), np.zeros(7))


@pytest.fixture
def default_batches(spark):
    """Spark's own bound of a batch, before and after."""
    spark.conf.unset(ARROW_BYTES)
    yield
    spark.conf.unset(ARROW_BYTES)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batch_sizes():
    def run(batches):  # inside, as workers cannot import this file
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    return run


def test_workers_get_batches_of_bounded_bytes(spark, default_batches):
    rows = spark.range(0, 600, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 10000) as text")  # 30 MB in one task
    found = in_batches(rows, _batch_sizes(), "bytes long, rows long").collect()
    assert sum(r.rows for r in found) == 600 and max(r.bytes for r in found) < 2 * BATCH_BYTES
    spark.conf.set(ARROW_BYTES, "100000")  # a bound that is set stays
    assert max(r.rows for r in in_batches(rows, _batch_sizes(), "bytes long, rows long").collect()) <= 3


@pytest.mark.parametrize("stage", ["quality classifier", "line dedup", "MinHash near-dedup", "best-fit packing"])
def test_each_stage_with_workers_bounds_their_batches(spark, docs, default_batches, stage):
    dict(corpus_pipeline.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert int(spark.conf.get(ARROW_BYTES)) == BATCH_BYTES
    words = spark.range(0, 600, numPartitions=1).selectExpr("repeat('word ', 10000) as text").mapInArrow(_batch_sizes(), "bytes long, rows long")
    assert max(r.bytes for r in words.collect()) < 2 * BATCH_BYTES


def test_packing_encodes_a_megabyte_at_once(monkeypatch):
    met = []

    class Encoder:
        def encode_with_end(self, texts):
            met.append(sum(map(len, texts.to_pylist())))
            return np.full(len(texts), 2, np.uint32), np.arange(len(texts) + 1)

    monkeypatch.setattr(packing, "encoder", lambda *a: Encoder())
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["word " * 20_000] * 100)], names=["doc_id", "text"])
    out = list(packing._pieces("", 1024)([batch]))
    assert sum(b.num_rows for b in out) == 100 and sum(met) == 10_000_000 and max(met) <= 1_200_000
