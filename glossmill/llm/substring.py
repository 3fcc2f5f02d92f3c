"""Substring dedup: documents streamed against an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import words as W
from .cells import cell_counts
from .fmindex import FMIndex, coded
from .scratch import partitions

#: Words of the anchor that sends a window to its shard.
ANCHOR = 6
#: Cells that anchors are counted in, 2**18; more of them keep more windows together on very large inputs.
CELL_BITS = 18
#: A cell is crowded beyond twice the mean by this share of all anchors, or this many.
CROWDED_SHARE, CROWDED = 1 / 16384, 100_000
#: Words indexed at once; a shard is worked off in pieces of whole keys.
WORDS_AT_ONCE = 1_500_000
#: Windows of one passage; longer runs are cut.
WINDOWS_AT_ONCE = 64
#: Where rows without a doc_id stand in the order.
_NO_ID = 2**63 - 1


def _anchors(h: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of one document: its start, and the least hash of its ``anchor``-grams."""
    starts = W.gram_starts(offsets, window)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    least, span, have = W.grams(h, anchor), window - anchor + 1, 1
    while have * 2 <= span:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    return starts, least[starts]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _runs(starts: np.ndarray, keys: np.ndarray, of: np.ndarray, longest: int = WINDOWS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of neighbours in one document with one key, cut after ``longest``."""
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])
    first = np.flatnonzero(fresh)
    if len(first):
        inside = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
        first = np.flatnonzero(inside % longest == 0)
    return first, np.diff(np.append(first, len(starts)))


def _blank_joined(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words with one blank after each, and where each word begins in them."""
    size = words.ends - words.starts + 1
    to = np.cumsum(size)
    source = np.concatenate([words.data, np.zeros(1, np.uint8)])
    out = source[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(words.starts - to + size, size)]
    out[to - 1] = 32
    return out, to - size


def _same_words(words: W.Words, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the bytes of the ``window`` words from each place of ``a`` are those from ``b``; each pair of words is compared once."""
    if not len(a):
        return np.empty(0, bool)
    steps = np.arange(window)
    n_words = len(words.starts)
    pairs, where = np.unique(((a[:, None] + steps) * n_words + b[:, None] + steps).ravel(), return_inverse=True)
    x, y = pairs // n_words, pairs % n_words
    size = words.ends[x] - words.starts[x]
    alike = size == words.ends[y] - words.starts[y]
    some = np.flatnonzero(alike & (x != y))
    n = size[some]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    differs = words.data[np.repeat(words.starts[x[some]], n) + inside] != words.data[np.repeat(words.starts[y[some]], n) + inside]
    alike[np.repeat(some, n)[differs]] = False
    return alike[where.ravel()].reshape(-1, window).all(axis=1)


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the pair of row and key came before, and whether it comes more than once."""
    before, several = np.zeros(len(row), bool), np.zeros(len(row), bool)
    order = np.lexsort((key, row))
    same = (row[order[1:]] == row[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    before[order[1:]] = several[order[1:]] = same
    several[order[:-1]] |= same
    return before, several


SPAN = "doc long, sig long, begin int, end int"


def repeated_spans(docs: DataFrame, dealt: DataFrame, window: int = 13, anchor: int = ANCHOR, crowded_share: float = CROWDED_SHARE, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """Spans of words that a document of smaller ``doc`` has too: ``doc, sig, begin, end``, maybe overlapping.

    ``docs`` has ``doc`` (long), ``sig`` (tells apart rows that share a doc) and ``text``; ``dealt`` are the
    same rows, dealt out by ``doc`` and ``sig``.

    1. Windows with equal words share their least 6-gram, the anchor, by which they meet. Anchors are counted in
       a table of fixed size; windows of crowded cells go by the hash of their own words instead, so a
       common line or a large group of copies is dealt over all shards.
    2. Keys (of anchors, or of crowded windows) and documents are shuffled as hashes, to leave windows that no other
       document has. Crowded windows that stand in an earlier document of the same batch are
       settled there, so a batch sends one row of each.
    3. Runs of windows with a shared key go to the key's shard with their words. A shard indexes those of
       its passages that later documents might repeat, each with the least doc that has it, and streams the passages of
       all but a key's first document against the index. Where the matching statistics reach
       ``window`` words with a smaller doc, the words are reported. A document sends a passage once to a shard, however
       often it repeats it, with the places of the others.

    Words are compared as bytes; hashes only decide where they meet, and which words are compared.
    """
    spark = docs.sparkSession
    n = partitions(spark)

    def anchor_cells(texts: pa.Array) -> np.ndarray:
        words = W.split(texts)
        starts, best = _anchors(W.hashes(words), words.offsets, window, anchor)
        first, _ = _runs(starts, best, np.searchsorted(words.offsets, starts, "right"))
        return _cells(best[first])

    counted = cell_counts(docs, anchor_cells, CELL_BITS, n)
    bound = 2 * counted.mean() + min(CROWDED, counted.sum() * crowded_share)
    crowded = spark.sparkContext.broadcast(np.packbits(counted > bound))

    def keyed(h: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: start, key, whether it is crowded, and its row."""
        starts, key = _anchors(h, words.offsets, window, anchor)
        hot = np.unpackbits(crowded.value)[_cells(key)] > 0
        if hot.any():
            key[hot] = W.grams(h, window)[starts[hot]]
        return starts, key, hot, np.searchsorted(words.offsets, starts, "right") - 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            words = W.split(batch.column("text"))
            h = W.hashes(words)
            starts, key, hot, of = keyed(h, words)
            doc, sig = (batch.column(c).to_numpy() for c in ("doc", "sig"))
            known = np.zeros(len(starts), bool)
            at = np.flatnonzero(hot)
            at = at[np.lexsort((doc[of[at]], key[at]))]
            if len(at):
                head = np.ones(len(at), bool)
                head[1:] = key[at[1:]] != key[at[:-1]]
                least = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
                same = doc[of[least]] < doc[of[at]]
                for j in range(window):
                    same &= h[starts[at] + j] == h[starts[least] + j]
                same[same] = _same_words(words, starts[at[same]], starts[least[same]], window)
                known[at[same]] = True
            told = np.flatnonzero(known)
            first, count = _runs(starts[told], np.zeros(len(told), np.uint64), of[told], len(told) + 1)
            first = told[first]
            row, begin = of[first], starts[first] - words.offsets[of[first]]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(W.signed(W.mix(doc[row].view(np.uint64) ^ sig[row].view(np.uint64))), pa.int64()), "doc": pa.array(doc[row]), "sig": pa.array(sig[row]),
                "begin": pa.array(begin, pa.int32()), "end": pa.array(begin + count + window - 1, pa.int32()),
            })
            rest = np.flatnonzero(~known)
            first = rest[_runs(starts[rest], key[rest], of[rest], len(rest) + 1)[0]]
            first = first[~_repeats(of[first], key[first])[0]]  # a document names a key once
            row, none = of[first], np.full(len(first), -1, np.int32)
            yield pa.RecordBatch.from_pydict({"key": pa.array(W.signed(key[first]), pa.int64()), "doc": pa.array(doc[row]), "sig": pa.array(sig[row]), "begin": pa.array(none), "end": pa.array(none)})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans as they are; of the rows of a key, sorted by doc, those of a key that has two docs or more."""
        last, first_doc, told = None, None, False  # the key that may go on
        waiting: list[pa.Table] = []  # its rows, as long as all are of its first doc
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            is_key = batch.column("begin").to_numpy() < 0
            yield from rows.filter(pa.array(~is_key)).to_batches()
            rows = rows.filter(pa.array(is_key))
            if not rows.num_rows:
                continue
            key, doc = rows.column("key").to_numpy(), rows.column("doc").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cuts[1:], len(key))
            many = doc[cuts] != doc[ends - 1]
            if key[0] == last:
                many[0] |= told or doc[ends[0] - 1] != first_doc
                if many[0] and not told:
                    yield from (b for t in waiting for b in t.to_batches())
                    waiting = []
            else:
                waiting = []
            if len(cuts) > 1 or key[0] != last:
                first_doc, told = doc[cuts[-1]], False
                waiting = [] if len(cuts) > 1 else waiting
            told, last = told or bool(many[-1]), key[-1]
            if not told:
                waiting.append(rows.slice(cuts[-1]))
            yield from rows.filter(pa.array(np.repeat(many, ends - cuts))).to_batches()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            doc, sig = (batch.column(c).to_numpy() for c in ("doc", "sig"))
            spans = batch.column("spans")
            row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            inner = spans.flatten()
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(W.signed(W.mix(doc[row].view(np.uint64) ^ sig[row].view(np.uint64))), pa.int64()), "doc": pa.array(doc[row]), "sig": pa.array(sig[row]),
                "begin": inner.field("begin"), "end": inner.field("end"), "words": pa.nulls(len(row), pa.binary()),
            })
            words = W.split(batch.column("text"))
            starts, key, _, of = keyed(W.hashes(words), words)
            lists = batch.column("keys")
            salt = W.mix(np.arange(batch.num_rows, dtype=np.uint64))
            wanted = lists.flatten().to_numpy().view(np.uint64) ^ np.repeat(salt, lists.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(np.isin(key ^ salt[of], wanted))
            starts, key, of = starts[keep], key[keep], of[keep]
            first, count = _runs(starts, key, of)
            row, start = of[first], starts[first]
            data, at = _blank_joined(words)
            at = np.append(at, len(data))
            text = data.tobytes()
            begin = (start - words.offsets[row]).astype(np.int32)
            said = [text[a : b - 1] for a, b in zip(at[start].tolist(), at[start + count + window - 1].tolist())]
            # a passage that a document has several times goes once, with its other places after a line feed, which no word has
            alike: dict[tuple[int, int, bytes], list[int]] = {}
            for i in np.flatnonzero(_repeats(row, key[first])[1]).tolist():
                alike.setdefault((int(row[i]), int(key[first[i]]), said[i]), []).append(i)
            once = np.ones(len(first), bool)
            for same in alike.values():
                once[same[1:]] = False
                if len(same) > 1:
                    said[same[0]] += b"\n" + begin[same[1:]].tobytes()
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(W.signed(key[first]), pa.int64()), "doc": pa.array(doc[row]), "sig": pa.array(sig[row]),
                "begin": pa.array(begin), "end": pa.array(np.zeros(len(first), np.int32)), "words": pa.array(said, pa.binary()),
            }).filter(pa.array(once))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and doc."""
        places: dict[bytes, int] = {}  # passages of the current key, as places in ``texts``
        texts: list[bytes] = []  # distinct passages of the piece, with the first doc of each and the last doc of its key
        docs_of: list[int] = []
        until: list[int] = []
        streamed: list[tuple] = []  # rows of later documents
        total, current, first_doc, last_doc = 0, None, 0, 0

        def spans(doc, sig, begin, end) -> pa.RecordBatch:  # noqa: ANN001
            return pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "sig": pa.array(sig, pa.int64()), "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32())})

        def judged() -> pa.RecordBatch:
            words, at, _ = coded(texts)
            least, last = np.array(docs_of), np.array(until)
            size = np.diff(at)

            def of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                some = size[chosen]
                to = np.cumsum(some)
                return words[np.repeat(at[chosen] - to + some, some) + np.arange(int(to[-1]))], np.concatenate([[0], to])

            indexed = np.flatnonzero(least < last)
            index = FMIndex(*of(indexed), least[indexed], window)
            doc, sig, place = (np.array([r[i] for r in streamed], np.int64) for i in range(3))
            begin = np.array([b for r in streamed for b in r[3]], np.int64)
            places_of = np.array([len(r[3]) for r in streamed], np.int64)
            asked, where = np.unique(place, return_inverse=True)
            some, bounds = of(asked)
            length, first = index.matching_statistics(some, bounds)
            first[length < window] = np.iinfo(np.int64).max
            # from passages back to the rows that have them
            n = size[place]
            to = np.cumsum(n)
            inside = np.arange(int(to[-1])) - np.repeat(to - n, n)
            hit = first[np.repeat(bounds[:-1][where], n) + inside] < np.repeat(doc, n)
            row = np.repeat(np.arange(len(n)), n)[hit]
            start = inside[hit]
            a, count = _runs(start, np.zeros(len(start), np.uint64), row, len(start) + 1)
            # and on to all places that a row has its passage in
            times = places_of[row[a]]
            to = np.cumsum(times)
            which = np.arange(int(times.sum())) + np.repeat(np.cumsum(places_of)[row[a]] - to, times)
            a, count, begin = np.repeat(a, times), np.repeat(count, times), begin[which]
            return spans(doc[row[a]], sig[row[a]], begin + start[a], begin + start[a] + count + window - 1)

        def close() -> None:
            """Ends a key. One with one passage has no other to be found in; its copies are known already."""
            nonlocal total
            if len(places) < 2:
                del texts[len(until) :], docs_of[len(until) :]
            else:
                total += sum(t.count(b" ") + 1 for t in places)
                until.extend([last_doc] * len(places))

        for batch in batches:
            known: list[tuple] = []
            for key, doc, sig, begin, end, words in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "sig", "begin", "end", "words"))):
                if words is None:
                    known.append((doc, sig, begin, end))
                    continue
                if key != current:
                    close()
                    if total >= words_at_once:
                        if streamed:  # without any, all passages of the piece were settled as equal ones
                            yield judged()
                        texts, docs_of, until, streamed, total = [], [], [], [], 0
                    places, current, first_doc = {}, key, doc
                last_doc = doc
                words, _, more = words.partition(b"\n")
                begins = (begin, *np.frombuffer(more, np.int32).tolist())
                place = places.get(words)
                if place is not None and docs_of[place] < doc:  # all of it stands in an earlier document
                    known.extend((doc, sig, b, b + words.count(b" ") + 1) for b in begins)
                    continue
                if place is None:
                    place = places[words] = len(texts)
                    texts.append(words)
                    docs_of.append(doc)
                if doc > first_doc:
                    streamed.append((doc, sig, place, begins))
            if known:
                yield spans(*zip(*known))
        close()
        if streamed:
            yield judged()

    found = docs.mapInArrow(keys, "key long, doc long, sig long, begin int, end int").repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(shared, "key long, doc long, sig long, begin int, end int")
    is_key = F.col("begin") < 0
    found = found.groupBy("doc", "sig").agg(F.collect_list(F.when(is_key, F.col("key"))).alias("keys"), F.collect_list(F.when(~is_key, F.struct("begin", "end"))).alias("spans"))
    rows = dealt.join(found, ["doc", "sig"])  # with all columns, so that the shuffle of the texts is the one that the caller makes
    rows = rows.mapInArrow(passages, "key long, doc long, sig long, begin int, end int, words binary")
    return rows.repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(search, SPAN)


def dedup_substrings(docs: DataFrame, window: int = 13, with_text: bool = True, crowded_share: float = CROWDED_SHARE, carry: bool = False, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """``docs`` without words of any ``window``-word passage that an earlier document has too.

    A word goes if a window over it has the words of a window in a document of smaller doc_id;
    windows are judged on the input. Returns ``doc_id, n_words, n_removed, kept_sha256`` and, if asked,
    ``kept_text``: the text as it was where nothing goes, else its kept words joined by one
    space (null stays null), and with ``carry`` also ``row``, a struct of the columns as they came.

    A null or empty text has no words. A null doc_id counts as larger than all others (2^63-1 is its equal: neither takes
    words from the other). Rows that repeat a doc_id never remove each other's words, and each gives a row; rows with one doc_id and one
    text are alike and meet in one task, a batch at a time. A text of any length is worked on whole. Further
    columns are ignored.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long")).alias("sig"), F.col("text").cast("string").alias("text"), *([F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")] if carry else []))
    # the last bit of sig says that there is no doc_id; a further column would cost a second shuffle of the texts
    dealt = rows.repartition(n, "doc", "sig")
    spans = repeated_spans(rows.drop("row"), dealt, window, crowded_share=crowded_share, words_at_once=words_at_once).groupBy("doc", "sig").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = dealt.join(spans, ["doc", "sig"], "left").select("doc", "sig", "text", "spans", *["row"] * carry)
    made = [StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())][: 4 + with_text]
    schema = StructType([*made, *([rows.schema["row"]] if carry else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            out: list[tuple] = []
            for doc, sig, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "sig", "text", "spans"))):
                words = (text or "").encode().split()  # bytes are split at exactly ASCII white space
                kept, at = [], 0
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if end > at:
                        kept += words[at : max(at, begin)]
                        at = end
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((None if sig & 1 else doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), text if len(kept) == len(words) else joined.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(4 + with_text)]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("row")] if carry else [])], names=schema.fieldNames())

    return joined.mapInArrow(cut, schema)
