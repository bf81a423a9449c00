"""Whitening, alignment and best-fit packing against brute force, on whole tables and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from boutline.llm import alignment, genetic, whitening
from boutline.llm.common import on_workers

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def odd_documents(spark, rows):
    on_workers(spark)
    names = "part number unit units uid a b nth groups links n count best piece place length base ids"
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names.split())
    return spark.createDataFrame([(i, t, *["own"] * len(names.split())) for i, t in rows], schema)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two  blanks \n\n and\tlines\n"), (6, "<|endoftext|> </s> <s> <0x41> <unk>"), (7, "▁ spelled ▁"), (8, "漢字 é ünï 😀 ﬁ x　y\x85z\x1cw"),
    (None, "no id here"), (None, "no id here"), (9, "same text"), (9, "same text"), (10, "x" * 50_000), (11, "word " * 30_000), (12, "trailing "), (13, "\n lead"), (14, "a\x00b\r\nc ​ d"),
]


# Whitening


def brute_whitening(vectors):
    xs = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(xs, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening_of_the_whole_table(spark, sf):
    rows = __spark_entry__.queries()["op11_whitening"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    xs, n, sums, values, vectors = brute_whitening(np.stack(table["embedding"]))
    assert len(rows) == 16 * len(table) and set(rows["n"]) == {n}
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9
    for component, own in rows.groupby("component"):
        own = own.set_index("vec_id").loc[table["vec_id"]]
        want = (xs - sums / n) @ vectors[:, component - 1] / np.sqrt(values[component - 1])
        sign = np.sign(want @ own["whitened"].to_numpy())
        np.testing.assert_allclose(own["whitened"], sign * want, atol=1e-6)
        np.testing.assert_allclose(own["explained"], values[component - 1] / values.sum(), rtol=1e-9)
        assert own["deviation"].tolist() == [sum(int(v) ** 2 for v in row) for row in n * xs - sums]


@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_rotations_give_singular_values(columns, rows, seed):
    r = np.random.default_rng(seed).normal(size=(rows, columns)) * 10.0 ** np.random.default_rng(seed + 1).integers(-6, 6, columns)
    sizes, v = whitening.jacobi(r)
    want = np.linalg.svd(r, compute_uv=False)
    np.testing.assert_allclose(sizes[: len(want)], want, rtol=1e-9, atol=1e-9 * want.max())
    np.testing.assert_allclose(v.T @ v, np.eye(columns), atol=1e-12)
    products = (r @ v).T @ (r @ v)
    assert np.abs(products - np.diag(np.diag(products))).max() <= 1e-12 * want.max() ** 2


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 2.5]), (4, [0.0, -7.0]), (None, [2.0, 2.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(3)
    out = whitening.whiten(table).collect()
    assert Counter(r.vec_id for r in out) == Counter({1: 2, 2: 2, 3: 2, 4: 2, None: 2}) and {r.n for r in out} == {4}
    one = {(r.vec_id, r.component): r for r in out}
    assert one[(1, 1)][2:] == one[(2, 1)][2:]
    xs, n, sums, _, _ = brute_whitening([v for i, v in rows[:5]])
    assert one[(3, 1)].deviation == sum(int(v) ** 2 for v in n * xs[2] - sums)
    for few in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], []):
        same = whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>"))
        assert same.count() == 0 and same.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12 and line[0].identity_error < 1e-9


def test_factors_meet_in_a_tree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 7, 5, 3, 2, 1]).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model, fit = whitening.fit_whitening(whitening.whole_numbers(table))
    many = whitening._factor(fit.repartition(30), model.n, model.sums)
    _, n, _, values, _ = brute_whitening([v for _, v in rows])
    np.testing.assert_allclose(whitening.jacobi(many)[0] ** 2 / n, values, rtol=1e-12)
    np.testing.assert_allclose(model.variances, values, rtol=1e-12)


# Alignment


def spelled(a, b, text):
    """Ids and bytes of the whole text by either library, or None if one does not spell it."""
    if not text:
        return None
    byte_of = alignment._byte_characters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else None


def brute_groups(a, b, text):
    found = spelled(a, b, text)
    if found is None:
        return []
    ids_a, bytes_a, ids_b, bytes_b = found
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def brute_alignment(sides, texts):
    groups = [brute_groups(*sides, t) for t in texts]
    links = [[(x, y) for p, q in g for x in p for y in q] for g in groups]
    count = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, own in zip(groups, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(own), sum(count[x] == best[x[0]] for x in own), sum(count[x] for x in own), text))
    return out


def test_alignment_of_the_whole_table(spark, sf, sides):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(table, brute_alignment(sides, [r.text for r in table])))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = __spark_entry__.queries()["op12_alignment"](spark, sf).select(columns).collect()
    assert Counter(map(tuple, rows)) == want and sum(r.n_links for r in rows) > 1000


@pytest.mark.parametrize("whole", [False, True])
def test_alignment_of_odd_rows(spark, sides, monkeypatch, whole):
    if whole:
        monkeypatch.setattr(alignment.worker_sides(A, B), "divisible", False)
    docs = ODD[:-4] if whole else ODD
    got = Counter(tuple(r) for r in alignment.align(odd_documents(spark, docs).repartition(3), A, B).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(docs, brute_alignment(sides, [t for _, t in docs])))
    assert alignment.align(odd_documents(spark, []), A, B).count() == 0


def test_alignment_in_several_parts(spark, sides):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "unbelievable", "Straße", "tiontion", "x1y2", "désolé"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in alignment.align(rows, A, B).collect()}
    assert [got[i] for i in range(60)] == brute_alignment(sides, texts)


def test_dictionaries_end(spark, monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(alignment, "UNITS", 5)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    caught = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            caught.extend(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["a b c", "c d e f", "a f", None]})])))

    monkeypatch.setattr(alignment, "text_of", lambda d: d)
    alignment.dictionaries(Docs(), True)
    rows = [r for b in caught for r in b.to_pylist()]
    docs, units = [r for r in rows if r["unit"] is None], {(r["part"], r["number"]): r["unit"] for r in rows if r["unit"] is not None}
    back = {r["doc_id"]: "".join(units[(r["part"], int(k))] for k in alignment.unpacked(r["units"])) for r in docs}
    assert back == {1: " a b c", 2: " c d e f", 3: " a f", 4: ""} and len({r["part"] for r in docs}) == 2


@given(st.text(st.sampled_from("ab \n\t\x1c\x85 ▁​é漢.1's"), min_size=1, max_size=24))
@settings(max_examples=300, deadline=None)
def test_units_spell_the_text_and_divide_both_tokenizers(sides, text):
    both = alignment.worker_sides(A, B)
    assert both.divisible
    units = [alignment.unit_of(k) for k in alignment.unit_keys(text)]
    assert "".join(units) == " " + text
    assert [i for u in units for i in both.encode_a(u)] == sides[0].encode(" " + text, add_special_tokens=False).ids
    assert [i for ids in both.encode_b(units) for i in ids] == both.b.encode(text)


# Best-fit packing


def packed_well(rows, texts, tokenizer, window=1024):
    """Checks the pieces of a packing against the texts; returns the number of sequences."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids), 0, -window))[::-1]
        for piece, (start, stop) in enumerate(zip([0, *cuts], cuts)):
            want[(doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values(), default=0) <= window
    return len(at)


def test_best_fit_of_the_whole_table(spark, sf, tokenizer):
    rows = __spark_entry__.queries()["op13_best_fit"](spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = packed_well(rows, texts, tokenizer)
    pieces = Counter(r.length for r in rows)
    first = genetic.fitness(genetic.best_fit({}, pieces, 1024), 1024)[0]
    assert genetic.least_bins(pieces, 1024) <= n <= first and n <= 1.02 * genetic.least_bins(pieces, 1024) + 1


def test_best_fit_of_odd_rows(spark, tokenizer):
    docs = [(i, t) for i, t in ODD if i != 10]
    rows = genetic.pack_best(odd_documents(spark, docs).repartition(3), A).collect()
    packed_well(rows, docs, tokenizer)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert genetic.pack_best(odd_documents(spark, []), A).count() == 0


lengths = st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=12)


@given(lengths, st.integers(0, 999))
@settings(max_examples=60, deadline=None)
def test_steps_keep_every_piece(pieces, seed):
    window, rng = 60, random.Random(seed)
    first = genetic.best_fit({}, pieces, window)
    other = genetic.mutate(first, window, rng, 0.5)
    child = genetic.crossover(first, other, window, rng)
    for packing in (first, other, child):
        assert genetic.contents(packing) == Counter(pieces)
        assert all(genetic.fill(p) <= window and times > 0 for p, times in packing.items())
        assert genetic.least_bins(pieces, window) <= genetic.fitness(packing, window)[0]
    at = genetic.places(child)
    taken = set()
    for length, n in pieces.items():
        for k in range(n):
            run = np.searchsorted(at["key"], length << 44 | k, side="right") - 1
            nth = k - at["first"][run]
            start = at["offset"][run] + nth % at["each"][run] * length
            spots = {(at["sequence"][run] + nth // at["each"][run], x) for x in range(start, start + length)}
            assert not spots & taken
            taken |= spots


def test_islands_pack_tighter_than_best_fit(spark):
    rng = random.Random(2)
    pieces = Counter(rng.randint(300, 420) for _ in range(2000))
    found = genetic.best_packing(spark, pieces)
    assert genetic.contents(found) == pieces
    first = genetic.fitness(genetic.best_fit({}, pieces, 1024), 1024)[0]
    assert genetic.least_bins(pieces, 1024) <= genetic.fitness(found, 1024)[0] < 0.97 * first
