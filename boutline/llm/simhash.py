"""SimHash near-duplicates, joined by multi-index hashing.

Contract of the edge cases: a null or empty text and a text of white space have fingerprint zero
and link with each other like any other documents; repeated rows are all kept and share a
component; a row without ``doc_id`` is kept and its component is the smallest id that its
fingerprint reaches (null if there is none); an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import components, release, slices, stored, text_of, unused

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: Differing bits of near-duplicates, parts of a fingerprint that have a table each, and fingerprints of one entry of a table that are fetched.
RADIUS, SEGMENTS, CROWD = 2, 2, 32
#: What the pipeline takes for near-duplicates: the Jaccard likeness of sets of shingles of so many words.
WIDTH, SIMILARITY = 5, 0.8
#: Tasks that the rows of one fingerprint are dealt to.
SALTS = 16
#: Sets of a bucket that are compared with as many others in a task.
BLOCK = 200


def shingles(text: bytes, width: int) -> np.ndarray:
    """The hashes of the shingles of a text in order; a text of at most ``width`` words is one shingle."""
    words = _WORDS(text.lower())
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(line[i:j], 42) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype="<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of the shingle hashes have it set."""
    hashes = shingles(text, width)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), width) for t in batch.column(1)]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return text_of(docs).mapInArrow(run, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with ``radius`` or fewer set, as signed longs."""
    masks = [sum(1 << bit for bit in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """Shift and width of each of the parts that 64 bits are cut into."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def links(points: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints of ``points(fp)`` within ``radius`` bits of each other.

    Of two such fingerprints some segment differs in at most ``radius // segments`` bits. The table has each fingerprint under each of its
    segments; each also asks the table for all values within that ball of each of its segments, and what it fetches is held against it
    in full. An entry of the table with more than ``crowd`` fingerprints would give all pairs of them; it tells those that ask for it, and all
    its own, to meet by whole words instead (``crowded``), which is exact too and makes no pairs.
    """
    bounds = segment_bounds(segments)
    value = lambda i: F.shiftrightunsigned("fp", bounds[i][0]).bitwiseAND(F.lit(-1 if segments == 1 else (1 << bounds[i][1]) - 1).cast("long"))
    own = F.array(*[F.struct(F.lit(i).alias("segment"), value(i).alias("value")) for i in range(segments)])
    table = points.select(F.col("fp").alias("b"), F.inline(own))
    near = [F.array(*[F.lit(m).cast("long") for m in ball(width, min(width, radius // segments))]) for _, width in bounds]

    def asked(i: int) -> Column:
        return F.transform(near[i], lambda m: F.struct(F.lit(i).alias("segment"), value(i).bitwiseXOR(m).alias("value")))

    probes = points.select(F.col("fp").alias("a"), F.inline(F.flatten(F.array(*[asked(i) for i in range(segments)]))))

    keys = ["segment", "value"]
    sizes = table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowds = stored(sizes.select(*keys, F.lit(True).alias("crowd")), "crowds")
    sparse = table.join(crowds, keys, "left_anti").select(*keys, "b", F.lit(False).alias("crowd"))
    entries = sparse.unionByName(crowds.select(*keys, F.lit(None).cast("long").alias("b"), "crowd"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # The files of the fingerprints are small, what each asks is not: by the size of the files it would be broadcast.
    met = stored(probes.join(entries.hint("merge"), keys).where(F.col("crowd") | (F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b").distinct(), "met")
    pairs = met.where("b is not null")
    if crowds.isEmpty():
        return pairs
    whole = met.where("b is null").select(F.col("a").alias("fp"))  # each of a crowd asks for its own value too
    return pairs.unionByName(crowded(whole, radius)).distinct()


def crowded(points: DataFrame, radius: int) -> DataFrame:
    """The same for fingerprints of which very many are alike: by words halfway between two.

    Two fingerprints within ``radius`` share a word that is within ``radius // 2`` of one and the rest of the way from the other. All that
    lie as near to a word are linked to the least of them, and those farther off too; no two of these are more than ``radius`` apart, and
    no pairs are made.
    """
    inner, outer = radius // 2, radius - radius // 2
    far = ball(64, outer)
    count = len(ball(64, inner))  # the masks come by the number of bits
    words = F.transform(F.array(*[F.lit(m).cast("long") for m in far]), lambda m, i: F.struct(F.col("fp").bitwiseXOR(m).alias("word"), (i < count).alias("inner")))
    table = points.select("fp", F.inline(words)).repartition("word")  # nearly all words are single: nothing to combine before
    least = F.min(F.when(F.col("inner"), F.col("fp")))
    hubs = stored(table.groupBy("word").agg(least.alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null").select("word", "b"), "hubs")
    return table.join(hubs.hint("merge"), "word").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: the smallest ``doc_id`` each document reaches by links.

    Components are those of fingerprints, with or without a ``doc_id``. Only fingerprints of several rows or with links
    are joined back, each dealt to ``SALTS`` tasks, as one may be that of very many rows.
    """
    marks = stored(fingerprints(docs), "fingerprints")
    points = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    found = stored(components(links(points.select("fp"))), "found")
    release(docs.sparkSession)
    members = found.select(F.col("node").alias("fp"), "component").unionByName(found.select(F.col("component").alias("fp"), "component").distinct())
    members = members.join(points.select("fp", "rep"), "fp")
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = members.join(least, "component").select("fp", "component_id")
    classes = points.join(linked, "fp", "left").where(F.col("component_id").isNotNull() | (F.col("n") > 1) & F.col("rep").isNotNull())
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    classes = classes.select("fp", F.coalesce("component_id", "rep").alias("component_id")).select("fp", "component_id", salts)
    dealt = marks.select("doc_id", "fp", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)).alias("salt"))
    return dealt.join(classes, ["fp", "salt"], "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _sets(texts: DataFrame, width: int, share: int, fp: bool = False) -> DataFrame:
    """``texts(doc_id, digest, text)`` to ``(doc_id, digest, mark, n, hashes)``: the set of shingles by its size and
    digest, and of its hashes those that ``share`` divides; with ``fp`` the fingerprint too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            sets = [np.unique(shingles(t, width)) for t in told]
            marks = np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in sets], dtype=np.uint64).view(np.int64)
            kept = [h[h % np.uint64(share) == 0].view(np.int64) for h in sets]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in kept]))).astype(np.int32))
            values = pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]))
            sizes = pa.array([len(h) for h in sets], pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(marks), sizes, pa.ListArray.from_arrays(offsets, values)]
            names = ["doc_id", "digest", "mark", "n", "hashes"]
            if fp:
                columns, names = [*columns, pa.array(np.array([fingerprint(t) for t in told], dtype=np.uint64).view(np.int64))], [*names, "fp"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "doc_id long, digest long, mark long, n int, hashes array<long>" + (", fp long" if fp else ""))


def _bucket_links(similarity: float):
    """For the rows ``(mark, hashes)`` of two blocks of a bucket: edges that connect what all its likely pairs connect."""

    def run(rows: pa.Table) -> pa.Table:
        marks = rows.column("mark").to_numpy()
        sets = [np.asarray(h.values) for h in rows.column("hashes")]
        sizes = np.array([len(h) for h in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        postings = np.split(owner[order], np.cumsum(np.bincount(codes))[:-1])
        ends = np.cumsum(sizes)
        group, edges = np.arange(len(sets)), []
        for i in range(1, len(sets)):
            both = np.bincount(np.concatenate([postings[c] for c in codes[ends[i] - sizes[i] : ends[i]]]), minlength=len(sets))[:i]
            alike = np.nonzero(both / (sizes[:i] + sizes[i] - both) >= similarity)[0]
            for j in alike:
                if group[j] != group[i]:
                    edges.append((marks[i], marks[j]))
                    group[group == group[i]] = group[j]
        return pa.table({"a": pa.array([int(a) for a, _ in edges], pa.int64()), "b": pa.array([int(b) for _, b in edges], pa.int64())})

    return run


def alike(texts: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The classes of ``texts(doc_id, digest, text)``, linked by exact likeness of their sets of shingles.

    Returns the rows ``(doc_id, digest, mark, n, fp)``, and ``(node, component)`` of marks. Two sets are linked from a
    Jaccard likeness of ``similarity`` on. No pair is lost: of a set of n, ``need`` = ceil(similarity * n) shingles must
    be shared. A third of the hashes tells first which sets have more than n - need of their own; of the others
    one of the n - need + 1 rarest shingles is in the other set too. Sets that share one are a bucket. Each is
    compared with the least of its bucket; buckets that are not connected by then are compared in full, two blocks of
    ``BLOCK`` sets in a task, without a row for each pair.
    """
    spark = texts.sparkSession
    need = F.ceil(F.col("n") * F.lit(similarity) - 1e-9)
    marks = stored(_sets(texts, width, 1, fp=True).select("doc_id", "digest", "mark", "n", "fp"), "marks")
    own = _sets(texts, width, 3).select("mark", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("mark").alias("mark"), F.max("mark").alias("top"))
    lone = stored(own.where("mark = top").groupBy("mark").agg(F.count("*").alias("lone")), "lone")
    release(spark)
    points = marks.where("n > 0").groupBy("mark").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("n").alias("n"))
    left = points.join(lone, "mark", "left").where(F.coalesce("lone", F.lit(0)) <= F.col("n") - need)
    left = stored(left.select(F.col("rep.doc_id").alias("_id"), F.col("rep.digest").alias("_digest")), "left")
    chosen = texts.join(left, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    sets = stored(_sets(chosen, width, 1).select("mark", "n", "hashes").dropDuplicates(["mark"]), "sets")
    release(spark)

    rows = sets.select("mark", "n", F.explode("hashes").alias("h"))
    known = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(known, "h").groupBy("mark").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("hs"))
    shared = shared.where(F.size("hs") >= need).select("mark", F.explode(F.slice("hs", F.lit(1), (F.size("hs") - need + 1).cast("int"))).alias("x"))
    entries = stored(shared.select(F.col("x.h").alias("h"), "mark"), "entries")
    release(spark)

    hubs = entries.groupBy("h").agg(F.min("mark").alias("hub"))
    pairs = entries.join(hubs, "h").where("mark <> hub").select("mark", "hub").distinct()
    a, b = sets.select("mark", F.col("hashes").alias("ha")), sets.select(F.col("mark").alias("hub"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    near = pairs.join(a, "mark").join(b, "hub").select("mark", "hub", both.alias("o"), (F.size("ha") + F.size("hb")).alias("t"))
    stars = stored(near.where(F.col("o") / (F.col("t") - F.col("o")) >= similarity).select(F.col("mark").alias("a"), F.col("hub").alias("b")), "stars")
    first = components(stars)
    release(spark)

    at = entries.join(first, F.col("mark") == F.col("node"), "left").select("h", "mark", F.coalesce("component", "mark").alias("c"))
    told = [F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("mark")).alias("sign"), F.min("mark").alias("least"), F.max("mark").alias("most")]
    apart = at.groupBy("h").agg(*told).where("low <> high").groupBy("size", "sign", "least", "most").agg(F.min("h").alias("h"))  # of equal buckets one
    place = F.row_number().over(Window.partitionBy("h").orderBy("mark")) - 1
    members = at.join(apart.select("h", "size"), "h").select("h", "mark", F.floor(place / BLOCK).cast("int").alias("block"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    met = members.select("h", "mark", "block", F.explode(others).alias("other")).select("h", "mark", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = met.join(sets.select("mark", "hashes"), "mark").groupBy("h", "i", "j").applyInArrow(_bucket_links(similarity), "a long, b long")
    found = components(stars.unionByName(rest))
    release(spark)
    return marks, found


def bound(marks: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, the classes of sets of ``marks(mark, fp)``, joined where fingerprints are ``links`` of each other: ``(node, component)`` of sets."""
    near = components(links(marks.select("fp").distinct()))
    release(marks.sparkSession)
    rows = marks.select("mark", "fp").distinct().join(found, F.col("mark") == F.col("node"), "left").select("fp", F.coalesce("component", "mark").alias("a"))
    rows = rows.join(near, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("fp"), "a").distinct()
    several = rows.groupBy("fp").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most")
    more = rows.join(several, "fp").where("a <> b").select("a", "b")
    return stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "bound")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns.

    Two documents are near-duplicates if their SimHash fingerprints are linked, as in ``near_duplicates``, or if their sets of
    ``width``-word shingles are alike by the exact check, which also finds the copies whose fingerprints lie further apart.
    It is the row with the smallest ``doc_id``; a row without one is kept where no row of its component has one.
    Of rows alike in ``doc_id`` and text one is kept. Texts without a word are one component.
    """
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marks, found = alike(text_of(docs).select("doc_id", digest.alias("digest"), "text"), width, similarity)
    found = bound(marks, found)
    release(docs.sparkSession)
    at = marks.join(found, F.col("mark") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("component", "mark").alias("component"))
    rows = at.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")).alias("m"))
    own = unused(docs.columns, "of_component", "of_doc", "of_digest", "of_rows")
    component, doc, text, n = own
    kept = best.select(F.col("component").alias(component), F.col("m.doc_id").alias(doc), F.col("m.digest").alias(text), F.col("m.n").alias(n))
    kept = stored(kept, "kept")
    release(docs.sparkSession)
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (digest == F.col(text)))
    several = joined.where(F.col(n) > 1).dropDuplicates([component])
    return joined.where(F.col(n) == 1).unionByName(several).drop(*own)
