"""Every operator and stage on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boutline.llm import media, minhash, packing, pii, simhash, substrings, tokens, toxicity, urlfilter, warc
from boutline.llm.common import on_workers
from boutline.llm.queries import URL_RULES

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators use inside.
CLASH = "fp rep component node mark anchors anchor starts of_doc of_mark of_component of_digest of_rows score score_ values n_replaced hashes ids part first n digest salt kept low high".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def documents(spark, pairs):
    on_workers(spark)
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *["own"] * len(CLASH)) for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Null and repeated ids, null, empty and blank texts, repeats, 20,000 words and a megabyte without a blank."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    passage = " ".join(f"p{k}" for k in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n"), (None, "no id here"), (None, None), (4, "same text twice"), (4, "same text twice"), (4, "another text of four"), (5, "same text twice"),
        (6, long), (7, long + " end"), (8, "x" * (1 << 20)), (9, passage), (10, f"before {passage} after"), (11, "漢字 é ünï 😀 <|endoftext|>"), (12, "one"),
    ]


def test_simhash(spark, odd):
    rows = simhash.near_duplicates(documents(spark, odd)).collect()
    assert len(rows) == len(odd)
    for r in rows:
        texts = [t or "" for i, t in odd if i == r.doc_id]
        assert r.fingerprint in {f"{simhash.fingerprint(t.encode()):016x}" for t in texts}
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert by[(1, "0" * 16)] == by[(2, "0" * 16)] == by[(3, "0" * 16)] == by[(None, "0" * 16)] == 1
    twice = f"{simhash.fingerprint(b'same text twice'):016x}"
    assert by[(4, twice)] == by[(5, twice)] == 4 and by[(None, f"{simhash.fingerprint(b'no id here'):016x}")] is None


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    pieces = packing.pack(documents(spark, odd).repartition(3), JSON).collect()
    want = sorted(((i if i is not None else -1, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in odd if t is None or len(t) < 1 << 20), key=str)
    got, at = {}, 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at and len(r.ids) == 4 * r.length
        at += r.length
        got.setdefault((r.doc_id if r.doc_id is not None else -1), []).append((r.start, r.doc_tokens, bytes(r.ids)))
    for i, ids in want:
        assert any(b"".join(x for s, n, x in sorted(got[i]) if 4 * n == len(ids))[: len(ids)] == ids for _ in (0,)), i
    assert at == sum(len(x) // 4 for _, x in want) + sum(n for _, n, _ in got[8][:1])


def test_tokens(spark, odd):
    rows = tokens.decode(tokens.encode(documents(spark, odd), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in rows) == sorted((str(i), (t or "").encode()) for i, t in odd)


def test_media(spark, odd):
    rows = media.read_media(media.to_media(documents(spark, odd))).collect()
    assert sorted((str(r.doc_id), bytes(r.payload)[: r.n_bytes]) for r in rows) == sorted((str(i), (t or "").encode()) for i, t in odd)
    assert all(len(r.payload) % 64 == 0 and len(r.payload) and len(r.tracks) == 1 for r in rows)
    broken = spark.createDataFrame([(1, 3, b"abc"), (2, 0, None), (3, 9, b"\x00\x00\x00\x09mdatx")], "doc_id long, n_bytes long, media binary")
    assert all(r.payload is None and r.tracks is None for r in media.read_media(broken).collect())


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_media_of_several_tracks_and_fragments():
    """A second track by half-byte sizes, and a fragmented track whose samples are in movie fragments alone."""
    full = lambda kind, *parts, flags=0, version=0: box(kind, struct.pack(">I", version << 24 | flags), *parts)

    def track(n, codec, *tables):
        head = full(b"tkhd", struct.pack(">IIII", 0, 0, n, 0), bytes(68))
        entry = full(b"stsd", struct.pack(">I", 1), box(codec, bytes(28)))
        return box(b"trak", head, box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), box(b"minf", box(b"stbl", entry, *tables))))

    none = [full(b"stts", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0))]

    def movie(at):
        small = [full(b"stts", struct.pack(">III", 1, 3, 500)), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stz2", b"\0\0\0\4", struct.pack(">I", 3), bytes([0x23, 0x50])), full(b"stco", struct.pack(">II", 1, at)), full(b"stss", struct.pack(">II", 1, 2))]
        extra = box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 250, 4, 0x10000)))
        return box(b"moov", track(1, b"avc1", *none), track(2, b"mp4a", *small), extra)

    head = box(b"ftyp", b"isom", bytes(4))
    first = len(head) + len(movie(0)) + 8
    payload = b"aabbbccccc" + b"WWWWXXXXYYYYYZZ"
    start = first + 10

    def fragment(offset):
        runs = full(b"trun", struct.pack(">IiI", 2, offset, 0), flags=0x5) + full(b"trun", struct.pack(">III", 2, 5, 2), struct.pack(">I", 0)[:0], flags=0x200)
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), runs))

    data = head + movie(first) + box(b"mdat", payload)
    data += fragment(start - len(data))
    one, two = media.read_tracks(memoryview(data))
    assert [bytes(data[a : a + s]) for a, s in two.samples] == [b"aa", b"bbb", b"ccccc"] and two.seconds == 1.5 and [data[a : a + s] for a, s in two.keyframes] == [b"bbb"]
    assert [bytes(data[a : a + s]) for a, s in one.samples] == [b"WWWW", b"XXXX", b"YYYYY", b"ZZ"] and one.seconds == 1.0 and len(one.keyframes) == 1 and (one.codec, two.codec) == ("avc1", "mp4a")


def test_warc(spark, odd):
    on_workers(spark)
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://e.org/\n{i}", t, "own", "own") for i, t in odd], "page_id long, url string, html string, refers_to string, digest string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in rows) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())) for i, t in odd)
    assert all(r.record_type == "response" for r in rows)


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "own"), (1, "http://a.com/en/", "own"), (1, "http://a.net/de/", "own"), (None, "http://example.org/es/x", "own"), (2, None, "own"), (3, "", "own"), (4, "://", "own"), (5, "http://" + "a." * 5000 + "com/en/" + "x" * (1 << 20), "own")], "page_id long, url string, key0 string")
    got = sorted(((str(r.page_id), r.rule, r.verdict) for r in urlfilter.judge(pages, URL_RULES).collect()), key=str)
    want = [("1", "com/en/", "block"), ("1", "com/en/", "block"), ("1", "net/de/", "allow"), ("None", "org/es/", "block"), ("2", None, "allow"), ("3", None, "allow"), ("4", None, "allow"), ("5", "com/en/", "block")]
    assert got == sorted(want, key=str)


def test_pii(spark, odd):
    docs = documents(spark, [*odd, (20, "call 212-555-0100 or 212-555-0100"), (20, "call 212-555-0100 or 212-555-0100")])
    out = pii.pseudonymize(docs, "k")
    assert out.columns == [*docs.columns, "n_replaced_"]
    rows = out.collect()
    assert all(r.n_replaced == "own" and r["values"] == "own" for r in rows)
    last = [r for r in rows if r.doc_id == 20]
    assert len(last) == 2 and last[0].text == last[1].text and last[0].n_replaced_ == 2 and len(set(re.findall(r"\d{3}-\d{3}-\d{4}", last[0].text))) == 1
    assert sorted((str(r.doc_id), r.text) for r in rows if r.doc_id != 20 and r.text is not None) == sorted((str(i), t) for i, t in odd if t is not None)


def test_substrings(spark, odd):
    rows = substrings.remove_repeats(documents(spark, odd)).collect()
    got = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert len(rows) == len(odd) and got[(6, 20_000)] == 0 and got[(7, 20_001)] == 20_000 and got[(10, 62)] == 60 and got[(9, 60)] == 0 and got[(8, 1)] == 0 and got[(1, 0)] == got[(2, 0)] == 0
    docs = documents(spark, odd)
    cut = substrings.cut(docs)
    assert cut.columns == docs.columns and cut.where("starts = 'own' and of_doc = 'own'").count() == len(odd)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.where("doc_id in (7, 10, 1)").collect()} == {7: ("end", 3), 10: ("before after", 12), 1: (None, 0)}


def test_minhash(spark, odd):
    rows = minhash.compare_edited(documents(spark, odd)).collect()
    assert len(rows) == len(odd) and all(len(r.fingerprint) == 256 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.n_chars for r in rows if r.doc_id == 8} == {1 << 20} and len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1


def test_toxicity(spark, odd):
    docs = documents(spark, odd)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    same = {}
    for i, t in [(r.doc_id, r.score) for r in rows if r.doc_id in (1, 2)]:
        same.setdefault("empty", set()).add(t)
    assert len(same["empty"]) == 1


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name, tmp_path):
    """Each stage on odd rows and on an empty table; all but the last give the columns of documents, whatever their names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, odd)
    out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0
    if name != "packing":
        assert out.columns == docs.columns == none.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        assert all(r[c] == "own" for r in rows for c in CLASH)
        assert 0 < len(rows) <= len(odd)
        if name == "simhash_near_dedup":
            kept = sorted((str(r.doc_id), r.text and r.text[:20]) for r in rows)
            assert ("4", "same text twice") in kept and ("5", "same text twice") not in kept and len(rows) == 9
    else:
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, _ in odd}


def test_pipeline_equals_its_stages(spark, sf):
    """The run is the stages one after another; what each drops or cuts is what its operator says of its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf).collect()
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, p in scores.items() if p == 0)
    sets = {r.doc_id: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())] if w for k in range(max(1, len(w) - 4))} for r in kept}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    single = stages["simhash_near_dedup"](spark, spark.createDataFrame(kept, docs.schema), sf).collect()
    assert sorted(r.doc_id for r in single) == sorted(set(group.values()))
    cut = stages["substring_dedup"](spark, spark.createDataFrame(single, docs.schema), sf).collect()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in single}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in cut:
        w = words[r.doc_id]
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = True
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text or "") == [x for x, g in zip(w, gone) if not g] and r.n_chars == len(r.text or "")
    hidden = stages["pii"](spark, spark.createDataFrame(cut, docs.schema), sf)
    pieces = stages["packing"](spark, hidden, sf)
    ran = corpus_pipeline.run(spark, sf)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.crc32("ids")), F.sum("length")).first()
    assert ran.columns == pieces.columns and digest(ran)[0] > 0
    total = lambda df: {r.doc_id: r.n for r in df.select("doc_id", F.col("doc_tokens").alias("n")).distinct().collect()}
    assert total(ran) == total(pieces)
