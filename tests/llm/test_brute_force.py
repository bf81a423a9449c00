"""Operators whose results SQL cannot tell, against plain Python written from their definitions; and queries as they are returned."""

import datetime
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boutline.llm import minhash, pii, simhash
from boutline.llm.common import on_workers
from boutline.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
KEY = "a key"


def feistel(x, a, b, tweak):
    left, right = divmod(x, b)
    noise = lambda i, half: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:14], 16)
    for i in range(1, 9):
        if i % 2:
            left = (left + noise(i, right)) % a
        else:
            right = (right + noise(i, left)) % b
    return left * b + right


def permuted(x, base, n, tweak):
    tweak = f"{tweak}|{n}"
    if n == 1:
        return (x + int(hashlib.sha256(f"{KEY}|{tweak}".encode()).hexdigest()[:14], 16) % (base - 1) + 1) % base
    return feistel(x, base ** (n - n // 2), base ** (n // 2), tweak)


def refill(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in shape)


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def card(v):
    d = re.sub(r"\D", "", v)
    if not luhn(d):
        return v
    n = len(d) - 2
    body = d[0] + str(permuted(int(d[1:-1]), 10, n, "card")).zfill(n)
    return refill(v, body + next(str(c) for c in range(10) if luhn(body + str(c))))


def cards(v):
    groups, out, i = re.findall(r"\d+[ -]*", v), "", 0
    while i < len(groups):
        for size in range(min(19, len(groups) - i), 0, -1):
            t = "".join(groups[i : i + size])
            d = re.sub(r"\D", "", t)
            if 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[ -]{2,}\d", t):
                out, i = out + card(t), i + size
                break
        else:
            out, i = out + groups[i], i + 1
    return out


def phone(v):
    all_digits = re.sub(r"\D", "", v)
    d = all_digits[-10:]
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    kind, areas, a0, exchanges, e0 = ("odd area", 200, 0, 1000, 0) if area < 200 else ("odd exchange", 800, 200, 200, 0) if exchange < 200 else ("phone", 800, 200, 800, 200)
    y = feistel(((area - a0) * exchanges + exchange - e0) * 10000 + line, areas, exchanges * 10000, kind)
    rest, line = divmod(y, 10000)
    whole = f"{rest // exchanges + a0:03d}{rest % exchanges + e0:03d}{line:04d}"
    return refill(v, ("1" if len(all_digits) == 11 else "") + whole)


def ipv4(v):
    o = list(map(int, v.split(".")))
    if max(o) > 255:
        return v
    return ".".join(map(str, struct.pack(">I", feistel(struct.unpack(">I", bytes(o))[0], 65536, 65536, "ipv4"))))


def ssn(v):
    a, g, s = map(int, v.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return v
    y = feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
    rest, s = divmod(y, 9999)
    a, g = divmod(rest, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def date(v):
    tries = [(v[:4], v[5:7], v[8:])] if v[4] == "-" else [(v[6:], v[3:5], v[:2]), (v[6:], v[:2], v[3:5])]
    for k, (y, m, d) in enumerate(tries):
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        first = datetime.date(1700, 1, 1)
        x = (day - first).days
        if not 0 <= x < 146097:
            return v
        o = first + datetime.timedelta(feistel(x, 189, 773, "date"))
        return o.isoformat() if v[4] == "-" else f"{o.day:02d}{v[2]}{o.month:02d}{v[2]}{o.year}" if k == 0 else f"{o.month:02d}{v[2]}{o.day:02d}{v[2]}{o.year}"
    return v


def email(v):
    local, domain = v.split("@", 1)
    out = ""
    for i, run in enumerate(re.findall("[a-z]{1,12}|[0-9]{1,12}|[^a-z0-9]+", local.lower())):
        tweak = f"mail|{domain.lower()}|{i}"
        if run[0].isdigit():
            run = str(permuted(int(run), 10, len(run), tweak)).zfill(len(run))
        elif "a" <= run[0] <= "z":
            x = 0
            for c in run:
                x = x * 26 + ord(c) - 97
            y, run = permuted(x, 26, len(run), tweak), ["a"] * len(run)
            for k in range(len(run) - 1, -1, -1):
                y, c = divmod(y, 26)
                run[k] = chr(97 + c)
            run = "".join(run)
        out += run
    return f"{out}@{domain}"


def test_pii_equals_plain_python(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = [(email, "".join(rng.choice("abz09._-") for _ in range(rng.randint(0, 20))) + rng.choice(["q", "7", "x1"]) + "@" + rng.choice(["e.org", "Mail.Example.com"])) for _ in range(40)]
    cases += [(ipv4, ".".join(str(rng.randint(0, 270)) for _ in range(4))) for _ in range(30)]
    cases += [(ssn, f"{digits(3)}-{digits(2)}-{digits(4)}") for _ in range(30)] + [(ssn, "665-01-0001"), (ssn, "667-99-9999"), (ssn, "666-12-1234"), (ssn, "123-00-1234")]
    cases += [(phone, rng.choice([f"({digits(3)}) ", f"+1 ({digits(3)}) ", f"{digits(3)}-", f"+1-{digits(3)}."]) + f"{digits(3)}{rng.choice('.-')}{digits(4)}") for _ in range(40)]
    cases += [(date, f"{rng.randint(1600, 2200)}-{rng.randint(1, 14):02d}-{rng.randint(1, 32):02d}") for _ in range(30)] + [(date, f"{rng.randint(1, 32):02d}/{rng.randint(1, 32):02d}/{rng.randint(1650, 2150)}") for _ in range(30)]
    for _ in range(40):
        d = digits(rng.randint(12, 18))
        d += next(str(c) for c in range(10) if luhn(d + str(c))) if rng.random() < 0.7 else digits(1)
        cases.append((cards, "-".join(d[i : i + 4] for i in range(0, len(d), 4)) if rng.random() < 0.5 else d))
    valid = lambda n: next(d + str(c) for d in [digits(n - 1)] for c in range(10) if luhn(d + str(c)))
    for _ in range(40):  # card numbers among other digits
        spaced = lambda d: rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4)) if rng.random() < 0.5 else d
        parts = [spaced(valid(rng.randint(13, 19))) if rng.random() < 0.5 else digits(rng.randint(1, 6)) for _ in range(rng.randint(1, 6))]
        cases.append((cards, rng.choice([" ", " ", "-", "  "]).join(parts)))
    cases += [(cards, "4111111111111111 12"), (cards, "12 4111111111111111"), (cards, "1-4111111111111111"), (cards, "7" * 400), (cards, " ".join(["1"] * 300))]
    cases = [(f, v) for f, v in cases if f is not cards or not re.search(r"\d{3}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}|\d{3}-\d{3}-\d{4}", v)]  # what is read as another value first
    texts = [f"see {v}, yes" for _, v in cases]
    rows = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, values string, n_replaced int")
    out = pii.pseudonymize(rows, KEY)
    assert out.columns == ["doc_id", "text", "values", "n_replaced", "n_replaced_"]
    got = {r.doc_id: r for r in out.collect()}
    for i, (f, v) in enumerate(cases):
        want = f(v)
        assert got[i].text == f"see {want}, yes", (f.__name__, v)
        assert (got[i].n_replaced_ > 0) == (want != v) and (f is cards or got[i].n_replaced_ < 2) and got[i].n_replaced == 5 and got[i]["values"] == "x"
    assert pii.pseudonymize(rows, KEY, counted=None).columns == rows.columns


def test_no_valid_number_is_left(spark):
    texts = ["a 4111111111111111 12 b", "12 4111111111111111", "2024-01-01 4111-1111-1111-1111", "4111111111111111 2024-01-01", "no5 12345 2024-01-01", "jörg@x.de, ä.b@müller.de", "212-555-0199 4111 1111 1111 1111 7"]
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    for old, r in zip(texts, rows):
        for gone in re.findall(r"4111[\d -]{12,15}|2024-01-01|jörg|ä\.b|212-555-0199", old):
            assert gone.strip() not in r.text, (old, r.text)
        assert len(r.text) == len(old) and r.n_replaced >= 1
    assert rows[5].text.endswith("@müller.de") and rows[5].text[1] == "ö" and rows[0].text.startswith("a ") and rows[0].text.endswith(" 12 b") and rows[1].text.startswith("12 ")
    assert re.sub(r"\D", "", rows[2].text)[8:] == re.sub(r"\D", "", rows[3].text)[:16] == re.sub(r"\D", "", rows[0].text)[:16]


def chained(values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else v
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_print(text):
    shift = 63 - 7
    empty, top = (1 << shift) - 1, (1 << 63) - 1
    words = [chained([w]) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    hashes = [chained(words[k : k + 5]) & top for k in range(len(words) - 4)] if len(words) >= 5 else [chained(words) & top] if words else []
    least = [min([h for h in hashes if h >> shift == b] + [b << shift | empty]) for b in range(128)]
    full = [x for x in least if x & empty != empty]
    if not full:
        return "0" * 256
    out = []
    for b, x in enumerate(least):
        if x & empty == empty:
            rank = min((chained([struct.pack("<i", b), y >> shift]) & 0x7FFFFFFFFFFF0000) | j for j, y in enumerate(full))
            x = full[rank & 0xFFFF]
        out.append(f"{x & 255:02x}")
    return "".join(out)


def test_minhash_fingerprints_equal_plain_python(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bé", "c\x1cd", "漢"]) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 9, 40, 300, 1500)] + [" \t ", "a b  c\nd e f"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.f for r in rows.select("doc_id", minhash.fingerprint(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_print(t), t


@pytest.fixture(scope="module")
def corpus(spark, sf):
    on_workers(spark)
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_queries_of_tokens_as_returned(spark, sf, corpus):
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in corpus.items()}
    place, seen = [], {i: 0 for i in corpus}
    for r in sorted(QUERIES["op2_packing"](spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        place.append((r.sequence_id * 1024 + r.offset, r.length))
        seen[r.doc_id] += r.length
        assert r.offset + r.length <= 1024
    assert seen == {i: len(x) for i, x in want.items()} and [p for p, _ in place] == np.cumsum([0] + [n for _, n in place])[:-1].tolist()
    ranks = {i: r for i, r in ((__import__("base64").b64decode(a), int(b)) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf).collect()}
    for i, t in corpus.items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_query_of_media_as_returned(spark, sf, corpus):
    rows, stored = {r.doc_id: r for r in QUERIES["op4_media"](spark, sf).collect()}, {}
    for i, t in corpus.items():
        raw = t.encode()
        payload, r = raw + bytes(-len(raw) % 64 if raw else 64), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and r.feature.startswith(f"raw ;{len(payload) / 8000:.6f};{len(payload) // 64};{-(-len(payload) // 16384)};")
        assert stored.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_query_of_simhash_as_returned(spark, sf, corpus):
    marks = {i: simhash.fingerprint(t.encode()) for i, t in corpus.items()}
    group = {i: i for i in marks}
    for _ in range(4):
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf).collect()}
    assert got == {i: (f"{marks[i]:016x}", group[i]) for i in marks}


def test_query_of_substrings_as_returned(spark, sf, corpus):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in corpus.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    rows = {r.doc_id: r for r in QUERIES["op9_substring_dedup"](spark, sf).collect()}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_query_of_minhash_as_returned(spark, sf, corpus):
    rows = {r.doc_id: r for r in QUERIES["op10_minhash"](spark, sf).collect()}
    order = sorted(corpus, reverse=True)
    like = lambda a, b: 1.0 if a == b else 0.0 if "0" * 256 in (a, b) else max(0.0, (sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128 - 2**-8) / (1 - 2**-8))
    for place, i in enumerate(order[:60]):
        t, after = corpus[i], corpus[order[(place + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        prints = plain_print(t), plain_print(edited), plain_print(after)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2])
        assert abs(r.near_edited - like(*prints[:2])) < 1e-12 and abs(r.near_next - like(prints[0], prints[2])) < 1e-12


@pytest.mark.parametrize("crowd", [2, 1000])
@pytest.mark.parametrize("radius, segments", [(2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 4), (6, 3), (6, 4), (1, 1), (0, 4)])
def test_links_lose_no_pair_and_make_none(spark, radius, segments, crowd):
    if crowd == 2 and radius == 6:
        pytest.skip("a ball of three bits around every fingerprint of a crowd")
    rng = random.Random(radius * 10 + segments)
    points = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        points.add(seed)
        for _ in range(rng.choice([1, 3, 12])):
            points.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))))
    points = sorted(points | {0, 1, 3, 7, 1 << 63, (1 << 64) - 1})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    edges = {frozenset((r.a, r.b)) for r in simhash.links(frame, radius, segments, crowd).collect()}
    near = {frozenset((signed(x), signed(y))) for i, x in enumerate(points) for y in points[:i] if (x ^ y).bit_count() <= radius}
    assert edges <= near

    def classes(pairs):
        group = {signed(p): signed(p) for p in points}
        for a, b in (tuple(p) for p in pairs):
            group = {k: group[b] if g == group[a] else g for k, g in group.items()}
        return {frozenset(k for k in group if group[k] == g) for g in group.values()}

    assert classes(edges) == classes(near)
    assert crowd == 2 or edges == near
