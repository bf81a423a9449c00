"""Exact substring dedup: documents streamed over suffix automata of reference shards, word by word.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller ``doc_id``. To broadcast an automaton of every shard to every
document costs the product of both, so documents and shards are brought together by content instead:

1. Each window selects the five-word run in it with the least hash, its anchor; equal windows select
   equal anchors. Anchors that two documents have are found by a pre-aggregated group-by.
2. Only windows with such an anchor go on, as pieces: the words of consecutive windows with one anchor.
   Equal pieces are merged before they are shuffled, so a passage costs one row per task, however
   many documents share it.
3. The distinct pieces of an anchor are a reference shard. Its suffix automaton carries the smallest
   document of each state; the pieces are streamed over it, and wherever the matching statistic reaches
   ``WINDOW`` words, the state tells the smallest document that has the window. Every window that is judged is judged so.
4. An anchor with pieces of over ``SHARD_WORDS`` words in all is divided first: its windows are dealt anew by all their
   five-word runs at once, which only equal windows share. So no automaton grows with the corpus.
5. The marks return to the documents and the covered words are cut out.

Edge cases: a null or empty text has no words; a row without ``doc_id`` is kept whole, and matches
nothing; rows with one ``doc_id`` are each judged, never against one another; an empty table gives an empty result;
other columns are ignored, or passed through by ``cut``. Windows are compared by their words themselves; hashes only
bring them together, and tell pieces of one anchor apart by 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import discard, release, salted, stored, unused

WINDOW = 13
ANCHOR = 5
#: A piece holds so many windows at most; a longer run of windows with one anchor is divided.
MAX_RUN = 64
#: Words of a reference shard at most, which bounds its automaton at some 20 MB.
SHARD_WORDS = 16_000
CHUNK_BYTES = 1 << 19
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_powers: list[np.ndarray] = []
_FIND = re.compile(r"[^\x20\x09-\x0D]+")


def _scales(n: int) -> list[np.ndarray]:
    """Powers of the step of the prefix sums and of its inverse; those kept cover a chunk, longer ones are made for a long text."""
    if not _powers:
        _powers[:] = _power_rows(CHUNK_BYTES + 4096)
    return _powers if len(_powers[0]) >= n else _power_rows(n)


def _power_rows(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.full(n, x, dtype=_U)) for x in (_STEP, _BACK)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Words:
    """The words of some texts: ``line`` holds them with one blank between, ``start`` and ``end`` their places in it,
    ``hashes`` their 64-bit hashes by one prefix sum over all bytes, and ``owner`` the index of their text."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        first = ~blank & np.concatenate(([True], blank[:-1]))
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.owner = np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1
        kept = ~blank | np.concatenate(([False], ~blank[:-1]))  # of blanks the one after a word
        line, blank = np.where(blank, np.uint8(32), data)[kept], blank[kept]
        self.start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        self.end = np.flatnonzero(blank)
        self.line = line.tobytes()
        up, down = _scales(len(line))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum((line.astype(_U) + _U(1)) * up[: len(line)], dtype=_U)))
        self.hashes = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U))

    def spans(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The words from ``first`` to before ``stop``, with one blank between."""
        return [self.line[a:b] for a, b in zip(self.start[first].tolist(), self.end[stop - 1].tolist())]


def runs(hashes: np.ndarray, owner: np.ndarray, whole_key: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and end (one past the last window) of each run of windows with one anchor.

    With ``whole_key`` it is not the least of the hashes of a window's five-word runs but a hash of all of them, in any order.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(hashes) - ANCHOR + 1, _U)
    for k in range(ANCHOR):
        grams = grams * _U(0x2000000036D) + hashes[k : k + len(grams)]
    grams = _mixed(grams)
    least = grams[:n].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        if whole_key:
            least += grams[k : k + n]
        else:
            np.minimum(least, grams[k : k + n], out=least)
    whole = owner[:n] == owner[WINDOW - 1 :]
    turn = (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
    starts = np.flatnonzero(whole & np.concatenate(([True], turn)))
    last = whole & np.concatenate((turn | ~whole[1:], [True]))
    return least[starts], starts, np.flatnonzero(last) + 1


def _divided(anchor: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same windows in runs of at most ``MAX_RUN``."""
    parts = -(-(end - start) // MAX_RUN)
    at = np.repeat(np.arange(len(start)), parts)
    step = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = start[at] + step * MAX_RUN
    return anchor[at], first, np.minimum(first + MAX_RUN, end[at])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if texts:
        yield first, texts[first:]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column]


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, text)``; ``mark`` tells apart rows that share a ``doc_id``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def shared_anchors(rows: DataFrame) -> DataFrame:
    """``(doc_id, anchors)``: for each document its anchors that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, texts in _chunks(_bytes(batch.column(1))):
                words = Words(texts)
                anchors, starts, _ = runs(words.hashes, words.owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(ids[first + words.owner[starts]])], names=["anchor", "doc_id"]
                )

    found = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")
    spread = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    return found.join(spread, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def pieces(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(anchor, doc_id, mark, start, words)``: the words of each run of windows with a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for first, texts in _chunks(_bytes(batch.column(2))):
                words = Words(texts)
                anchor, start, end = runs(words.hashes, words.owner)
                shared = lists.slice(first, len(texts)).flatten().to_numpy().view(_U)
                keep = np.isin(anchor, shared)
                anchor, start, end = _divided(anchor[keep], start[keep], end[keep])
                head = np.searchsorted(words.owner, np.arange(len(texts)))
                who = words.owner[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(ids[first + who]),
                        pa.array(marks[first + who]),
                        pa.array((start - head[who]).astype(np.int32)),
                        pa.array(words.spans(start, end + WINDOW - 1), pa.binary()),
                    ],
                    names=["anchor", "doc_id", "mark", "start", "words"],
                )

    schema = "anchor long, doc_id long, mark long, start int, words binary"
    return rows.join(anchors, "doc_id").select("doc_id", "mark", "text", "anchors").mapInArrow(run, schema)


class SuffixAutomaton:
    """A generalized suffix automaton over any symbols, whose states carry the smallest label of the strings in them."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.low = [1 << 63]

    def add(self, symbols: list[bytes], label: int) -> None:
        own, root = set(symbols), self.next[0]
        if len(own) == len(symbols) and root.keys().isdisjoint(own):  # all new: a chain, and a way into it at each symbol
            first, n = len(self.link), len(symbols)
            self.next.extend([{c: i} for i, c in enumerate(symbols[1:], first + 1)])
            self.next.append({})
            root.update(zip(symbols, range(first, first + n)))
            self.link.extend([0] * n)
            self.length.extend(range(1, n + 1))
            self.low.extend([label] * n)
            return
        last = 0
        for c in symbols:
            last = self._extend(last, c)
            if label < self.low[last]:
                self.low[last] = label

    def _split(self, p: int, c: bytes, q: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.low.append(1 << 63)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: bytes) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.low.append(1 << 63)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def close(self) -> None:
        """Hands each state's label on to its suffixes; call it once all strings are added."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            link = self.link[state]
            if self.low[state] < self.low[link]:
                self.low[link] = self.low[state]

    def lows(self, symbols: list[bytes], width: int) -> list[int | None]:
        """For each position that ends ``width`` symbols: the smallest label of strings that hold them."""
        state, matched, out = 0, 0, []
        for i, c in enumerate(symbols):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            while state and self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if i >= width - 1:
                out.append(self.low[state] if matched >= width else None)
        return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor to ``(anchor, content, lows)``: each anchor's automaton, and its pieces streamed over it."""
    out: list[tuple[int, int, list[int]]] = []
    group: list[tuple[int, list[bytes], int, int]] = []
    at = None

    def close() -> None:
        automaton = SuffixAutomaton()
        for _, symbols, low, _ in group:
            automaton.add(symbols, low)
        automaton.close()
        for content, symbols, _, high in group:
            lows = automaton.lows(symbols, WINDOW)
            if min(lows) < high:
                out.append((at, content, lows))
        group.clear()

    def flushed() -> pa.RecordBatch:
        columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "lows"])

    for batch in batches:
        for anchor, content, words, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != at:
                close()
                at = anchor
            group.append((content, words.split(b" "), low, high))
        if len(out) > 5000:
            yield flushed()
    close()
    if out:
        yield flushed()


def _shards(rows: DataFrame) -> DataFrame:
    """``(anchor, content, words, low, high)`` of distinct pieces, from ``(anchor, content, words, low, high)`` of all."""
    return rows.groupBy("anchor", "content", "words").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _statistics(shards: DataFrame) -> DataFrame:
    """``(anchor, content, lows)``: for each window of a piece the smallest document that has it."""
    dealt = shards.select("anchor", "content", "words", "low", "high").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_settled, "anchor long, content long, lows array<long>")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of crowded anchors to ``(anchor, content, at, key, words, low, high)``, dealt by all five-word runs of a window."""
    for batch in batches:
        for first, lines in _chunks(_bytes(batch.column(2))):
            words = Words(lines)
            key, start, end = _divided(*runs(words.hashes, words.owner, whole_key=True))
            head = np.searchsorted(words.owner, np.arange(len(lines)))
            who = words.owner[start]
            rows = pa.array(first + who)
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - head[who]).astype(np.int32)), pa.array(key.view(np.int64))]
            columns += [pa.array(words.spans(start, end + WINDOW - 1), pa.binary()), batch.column(3).take(rows), batch.column(4).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "at", "key", "words", "low", "high"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, starts)``: the first words of the windows that a smaller ``doc_id`` has too."""
    spark, rows = docs.sparkSession, keyed(docs)
    anchors = stored(shared_anchors(rows), "anchors")
    release(spark)
    found = stored(pieces(rows, anchors).withColumn("content", F.xxhash64("words")), "pieces")
    discard(anchors)
    release(spark)
    shards = stored(_shards(found.select("anchor", "content", "words", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))), "shards")
    release(spark)
    n_words = F.length(F.regexp_replace(F.decode("words", "ISO-8859-1"), "[^ ]", "")) + 1
    crowded = stored(shards.groupBy("anchor").agg(F.sum(n_words).alias("n")).where(F.col("n") > SHARD_WORDS).select("anchor"), "crowded")
    calm = _statistics(shards.join(crowded, "anchor", "left_anti")).select("anchor", "content", F.lit(0).alias("at"), "lows")
    single = shards.join(crowded, "anchor", "left_semi").select("anchor", "content", "words", "low", "high")
    single = stored(single.mapInArrow(_windows, "anchor long, content long, at int, key long, words binary, low long, high long"), "windows")
    finer = _statistics(_shards(single.select(F.col("key").alias("anchor"), F.xxhash64("words").alias("content"), "words", "low", "high")))
    finer = finer.select(F.col("anchor").alias("key"), F.col("content").alias("part"), "lows")
    parts = single.select("anchor", "content", "at", "key", F.xxhash64("words").alias("part"))
    lows = stored(calm.unionByName(salted(parts, finer, ["key", "part"], "content").select("anchor", "content", "at", "lows")), "lows")
    discard(shards, crowded, single)
    release(spark)
    starts = F.expr("filter(transform(lows, (m, i) -> if(m < doc_id, start + at + i, -1)), x -> x >= 0)")
    marked = found.select("anchor", "content", "doc_id", "mark", "start").join(lows, ["anchor", "content"]).select("doc_id", "mark", starts.alias("starts"))
    marked = stored(
        marked.where(F.size("starts") > 0).groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "marked"
    )
    discard(found, lows)
    release(spark)
    return marked


def _left(text: str, starts: pa.ListScalar) -> list[str]:
    """The words of a text that no window from one of ``starts`` covers."""
    words = _FIND.findall(text)
    edges = np.zeros(len(words) + 1, np.int32)
    at = starts.values.to_numpy()
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: ``kept`` is the words left, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, starts in zip(batch.column(1), batch.column(2)):
                words = _FIND.findall(text.as_py())
                left = _left(text.as_py(), starts) if starts.is_valid else words
                for column, value in zip(out, (len(words), len(words) - len(left), " ".join(left))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = keyed(docs).join(repeated_windows(docs), ["doc_id", "mark"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` (and ``n_chars`` made anew), other columns as they are.

    A text that loses no word stays as it is, white space included.
    """
    doc, mark, starts = unused(docs.columns, "of_doc", "of_mark", "starts")
    marked = repeated_windows(docs).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("starts").alias(starts))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(marked, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(mark)), "left").drop(doc, mark)
    names, at = joined.columns, docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = [
                t.as_py() if not s.is_valid else " ".join(_left(t.as_py(), s)) for t, s in zip(batch.column(at), batch.column(len(names) - 1))
            ]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array([len(t or "") for t in texts], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names=names[:-1])

    return joined.mapInArrow(run, docs.schema)
