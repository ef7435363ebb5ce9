"""Repeated passages by sparse suffix arrays.

Of all suffixes only those are retained that start at a minimiser: the word position whose next ten words hash lowest among those of
some 50-word window. Equal windows have their minimiser at the same place, so every repeated passage of 50 words holds a retained suffix in
each of its copies. Suffixes whose first ten words no other text has are left out. The others are sorted by the words that follow, and
a second time by the words before, read backwards; no suffix of another text shares more words to the right, or to the left, than the
nearest ones in these orders. Each suffix is extended to both sides by those lengths. The windows within are told apart by their hash, which
names the first document of each, and settles windows whose two sides are shared with different texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, text_slices, whole

PASSAGE, LEAD = 50, 10
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = 28
#: Rows of one text that a task holds until it has seen whether another text follows; longer runs are passed on.
HELD = 500_000
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(11)), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values, from those of powers of two."""
    out, size, part, power = None, 0, hashes, BASE
    step = 1
    with np.errstate(over="ignore"):
        while True:
            if length & step:
                # Append this part behind what is there.
                out = part if out is None else out[:len(part) - size] * power + part[size:] if len(part) > size else part[:0]
                size += step
            if size == length:
                n = max(0, len(hashes) - length + 1)
                return (out ^ (out >> np.uint64(29)))[:n] * BASE if n else hashes[:0]
            part = part[:-step] * power + part[step:] if len(part) > step else part[:0]
            power = power * power
            step *= 2


def minimisers(hashes: np.ndarray, passage: int = PASSAGE, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``passage`` words the place of its minimiser, and the hashes of all leads."""
    leads = rolling(hashes, lead)
    if len(hashes) < passage:
        return np.zeros(0, np.int64), leads
    mask = np.uint64((1 << PLACE_BITS) - 1)
    value = (leads & ~mask) | (np.arange(len(leads), dtype=np.uint64) & mask)  # of equal leads the first
    width, size, low = passage - lead + 1, 1, value
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(low) - (width - size)], low[width - size:])
    return (low & mask).astype(np.int64), leads


def retained_suffixes(texts: DataFrame, passage: int, lead: int) -> DataFrame:
    """(lead, key, pos): the suffixes at minimisers, by the hash of their first words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in text_slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), part):
                places, leads = minimisers(word_hashes(text), passage, lead)
                at = np.unique(places)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(leads[at].view(np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))], names=["lead", "key", "pos"])

    return texts.mapInArrow(gathered(run), "lead bigint, key bigint, pos int")


def gathered(run, rows: int = 50_000):
    """Join the small batches of a step into larger ones."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def array_partitions(frame: DataFrame) -> int:
    return max(2, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_shared_leads(suffixes: DataFrame) -> DataFrame:
    """(key, pos): suffixes whose first words another text has too.

    Suffixes are sorted over all partitions by (lead, key, pos), so a lead of any number of suffixes spreads, and stays where it lies.
    A run of equal leads at an edge of its partition may go on in the next one, and is passed on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, key, told, held = None, None, True, []  # the open run, whether it is passed on, and its rows if not
        for batch in batches:
            if not batch.num_rows:
                continue
            leads, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "key"))
            rows = batch.select(["key", "pos"])
            starts = np.flatnonzero(np.r_[True, leads[1:] != leads[:-1]])
            ends = np.r_[starts[1:], len(leads)] - 1
            shared = keys[starts] != keys[ends]
            if lead is None or lead == leads[0]:
                shared[0] |= told or keys[0] != key
                if shared[0]:
                    yield from held
                    held = []
            else:
                held = []
            yield rows.filter(pa.array(np.repeat(shared, ends - starts + 1)))
            lead, key, told = leads[-1], keys[-1], bool(shared[-1])
            if not told:
                held.append(rows.slice(starts[-1]))
                if sum(b.num_rows for b in held) > HELD:  # one text with this lead very often
                    yield from held
                    told, held = True, []
        yield from held

    return suffixes.repartitionByRange(array_partitions(suffixes), "lead", "key", "pos").sortWithinPartitions("lead", "key", "pos").mapInArrow(gathered(run), "key bigint, pos int")


def packed(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: int) -> pa.Array:
    """For each row the ``sizes`` codes from ``first`` on, onwards or backwards, as bytes."""
    offsets = np.r_[0, np.cumsum(sizes)]
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    flat = codes[np.repeat(first, sizes) + step * at]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def contexts(texts: DataFrame, passage: int, lead: int, rows: int = 20_000) -> DataFrame:
    """(words, key, pos, side): the words from a suffix on (side 0) and, behind its lead, those before it backwards (side 1).

    Both go as far as windows of which the suffix is the minimiser. A word is four bytes of its hash: where two words share
    them, a suffix is extended too far, and the windows' own hashes settle it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in text_slices(batches):
            for key, at, text in zip(batch.column("key").to_pylist(), batch.column("places").to_pylist(), part):
                hashes = word_hashes(text)
                places, leads = minimisers(hashes, passage, lead)
                codes = hashes.astype(np.uint32)
                for i in range(0, len(at), rows):
                    pos = np.sort(np.array(at[i:i + rows], np.int64))
                    low, high = np.searchsorted(places, pos, "left"), np.searchsorted(places, pos, "right") - 1
                    right, left = packed(codes, pos, high + passage - pos, 1), packed(codes, pos - 1, pos - low, -1)
                    heads = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(pos), [None, pa.py_buffer(leads[pos].tobytes())]).cast(pa.binary())
                    left = pa.compute.binary_join_element_wise(heads, left, pa.scalar(b"", pa.binary()))
                    for side, words in enumerate((right, left)):
                        yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(pos), key, np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(pos), side, np.int32))], names=["words", "key", "pos", "side"])

    return texts.mapInArrow(gathered(run, rows), "words binary, key bigint, pos int, side int")


def matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, filled up with zeros, and their numbers."""
    sizes = pa.compute.binary_length(words).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint32)
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 1), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def neighbour_lengths(suffixes: DataFrame, passage: int, rows: int = 20_000) -> DataFrame:
    """(key, pos, side, common): the most words that a suffix shares with one of another text, by its neighbours in sorted order.

    Rows are sorted over all partitions, so equal suffixes of very many texts spread, too. The nearest rows of other texts share the most words. Where
    such a row may lie in another partition, or behind ``rows`` rows of the same text, the whole length is taken.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], False  # rows whose next text isn't known yet; whether the first of them is of the text before
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out, keep = settled(block, before, False)
            yield out
            held, before = [block.slice(keep)], True
        if held:
            yield settled(pa.Table.from_batches(held).combine_chunks().to_batches()[0], before, True)[0]

    def settled(block: pa.RecordBatch, before: bool, last: bool) -> tuple[pa.RecordBatch, int]:
        keys, sides = (block.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side"))
        codes, sizes = matrix(block.column("words"))
        n = len(keys)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])])
        runs = np.diff(np.r_[starts, n])
        previous, following = np.repeat(starts, runs) - 1, np.repeat(starts + runs, runs)
        common = np.full(n, -1, np.int64)
        for other in (previous, following):
            inside = np.flatnonzero((other >= 0) & (other < n))
            j = other[inside]
            same = codes[inside] == codes[j]
            shared = np.where(same.all(axis=1), codes.shape[1], same.argmin(axis=1))
            shared = np.minimum(np.minimum(shared, sizes[inside]), sizes[j])
            common[inside] = np.maximum(common[inside], np.where(sides[inside] == sides[j], shared, 0))
            common[(other < 0) | (other >= n)] = 2 + passage
        # The open run is settled with the next block, if not too long; the row before it stays as its neighbour.
        start = n if last or n - starts[-1] > rows // 2 else starts[-1]
        first, keep = int(before), max(0, start - 1)
        sent = block.slice(first, max(0, start - first))
        out = np.maximum(common - 2 * (sides == 1), -1)[first:first + sent.num_rows]
        return pa.RecordBatch.from_arrays([sent.column("key"), sent.column("pos"), sent.column("side"), pa.array(out.astype(np.int32))], names=["key", "pos", "side", "common"]), keep

    ordered = suffixes.repartitionByRange(array_partitions(suffixes), "side", "words", "key").sortWithinPartitions("side", "words", "key", "pos")
    return ordered.select("words", "key", "pos", "side").mapInArrow(run, "key bigint, pos int, side int, common int")


def extended_windows(texts: DataFrame, passage: int, lead: int) -> DataFrame:
    """(window, first_id, key, start, again): hashes of the windows that lie within the extension of their minimiser, and whether
    the text has had the window before. ``sides`` has the suffixes of the text with the words shared on a side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in text_slices(batches):
            ids, sides = batch.column("first_id"), batch.column("sides")
            for i, (key, text) in enumerate(zip(batch.column("key").to_pylist(), part)):
                hashes = word_hashes(text)
                places = minimisers(hashes, passage, lead)[0]
                pos, side, common = (x.to_numpy(zero_copy_only=False) for x in sides[i].values.flatten())
                shared = np.full((2, len(hashes)), -1, np.int64)
                np.maximum.at(shared, (side, pos), common)
                reach = places - np.arange(len(places))  # words of the window before its minimiser
                start = np.flatnonzero((reach <= shared[1][places]) & (passage - reach <= shared[0][places]))
                whole_hashes = rolling(hashes, passage)[start].view(np.int64)
                again = np.ones(len(start), bool)
                again[np.unique(whole_hashes, return_index=True)[1]] = False
                if len(start):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(whole_hashes), pa.array([ids[i].as_py()] * len(start), ids.type), pa.array(np.full(len(start), key, np.int64)), pa.array(start.astype(np.int32)), pa.array(again)],
                        names=["window", "first_id", "key", "start", "again"],
                    )

    kind = texts.schema["first_id"].dataType.simpleString()
    return texts.mapInArrow(gathered(run), f"window bigint, first_id {kind}, key bigint, start int, again boolean")


def text_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def repeated_windows(docs: DataFrame, passage: int = PASSAGE, lead: int = LEAD) -> tuple[DataFrame, DataFrame]:
    """Windows of distinct texts that occur in other texts, and the distinct texts.

    Windows: (key, start, owner_id, later). The owner is the lowest doc_id that has the window; ``later`` marks all but the first
    occurrence in the owner's text. Texts: (key, first_id, copies), by the hash of the text.
    """
    keyed = docs.select(text_key(docs).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = kept(keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("doc_id").alias("n"), F.max("doc_id").alias("_last")), "texts")
    texts = texts.select("key", "first_id", F.when(F.col("first_id") == F.col("_last"), 1).otherwise(F.greatest("n", F.lit(1))).cast("long").alias("copies"))
    suffixes = kept(retained_suffixes(keyed.select("key", "text"), passage, lead), "suffixes")
    places = with_shared_leads(suffixes).groupBy("key").agg(F.collect_set("pos").alias("places"))
    # One row of each text is read again: the one with the lowest id.
    again = lambda found: keyed.join(found.join(texts, "key"), "key").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    around = kept(contexts(again(places).select("key", "places", "text"), passage, lead), "contexts")
    sides = neighbour_lengths(around, passage).groupBy("key").agg(F.collect_list(F.struct("pos", "side", "common")).alias("sides"))
    windows = kept(extended_windows(again(sides).select("key", "first_id", "sides", "text"), passage, lead), "windows")
    owners = windows.groupBy("window").agg(F.min("first_id").alias("owner_id"), F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    # Written, so that the join below has a shuffle on either side and a passage of very many texts can be split.
    owners = kept(owners.select("window", "owner_id"), "owners")
    later = F.col("again") | ~F.col("first_id").eqNullSafe(F.col("owner_id"))
    repeated = windows.join(owners, "window").select("key", "start", "owner_id", later.alias("later"))
    return repeated, texts


def spans(windows: DataFrame, passage: int) -> DataFrame:
    """(key, start_word, end_word, first_doc_id): windows that overlap or touch, joined. A text's windows are at most its words."""
    order = Window.partitionBy("key").orderBy("start")
    cut = windows.groupBy("key", "start").agg(F.min("owner_id").alias("owner_id")).withColumn("_new", (F.col("start") > F.coalesce(F.lag("start").over(order) + passage, F.lit(-1))).cast("int"))
    numbered = cut.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "_span").agg(F.min("start").alias("start_word"), (F.max("start") + passage).alias("end_word"), F.min("owner_id").alias("first_doc_id")).drop("_span")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, lead: int = LEAD) -> DataFrame:
    """Word spans of each document that also occur in other documents, first occurrences included.

    Per row of ``docs`` and span: doc_id, start_word, end_word (exclusive), n_words, first_doc_id (lowest id that holds a window of the span first).
    A span joins all windows of ``passage`` words (white-space separated, exact) that another text has too. Copies of a whole
    text of at least that length are one span each. Repeats inside one text alone are not reported, nor are texts under ``passage`` words, so
    null and empty texts give no row. Rows of equal doc_id and text are one document, each of them is listed; null ids are listed
    and own no passage where another id has it. Texts are told apart by a 64-bit hash, and windows by another.
    """
    windows, texts = repeated_windows(docs, passage, lead)
    words = F.when(F.btrim(docs["text"], F.lit(" \t\n\x0b\f\r")) == "", 0).otherwise(F.size(F.split(F.btrim(docs["text"], F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")))
    keyed = docs.select("doc_id", text_key(docs).alias("key"), F.coalesce(words, F.lit(0)).alias("n"))
    copied = texts.where("copies > 1").select("key", F.lit(0).alias("start_word"), F.lit(None).cast("int").alias("end_word"), F.col("first_id").alias("first_doc_id"))
    parts = spans(windows, passage).join(texts.where("copies > 1"), "key", "left_anti").select("key", "start_word", "end_word", "first_doc_id")
    found = keyed.join(parts.unionByName(copied), "key").withColumn("end_word", F.coalesce("end_word", "n"))
    return found.where(F.col("end_word") - F.col("start_word") >= passage).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def without_repeats(docs: DataFrame, passage: int = PASSAGE, lead: int = LEAD) -> DataFrame:
    """``docs`` with all its columns, each repeated passage left in its first document only.

    Words of windows that a document of lower id has, or this one before, are cut, with the white space behind them, and ``n_chars`` (where there is one) is set anew.
    Whole copies of texts of at least ``passage`` words stay in the rows with the lowest doc_id. Rows of one id count as one document. Documents of which nothing
    is left go; untouched documents stay as they are, also empty and null ones.
    """
    windows, texts = repeated_windows(docs, passage, lead)
    cuts = spans(windows.where("later"), passage).groupBy("key").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_cuts"))
    plan = texts.join(cuts, "key", "left").where("copies > 1 or _cuts is not null").select("key", "first_id", "copies", F.col("_cuts").alias("cuts"))
    joined = docs.select(text_key(docs).alias("key"), whole(docs).alias("row"), F.col("text")).join(plan, "key", "left")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in text_slices(batches):
            texts, keep = batch.column("text").to_pylist(), []
            columns = batch.column("row").flatten()
            ids = columns[names.index("doc_id")].to_pylist()
            first, copies, cuts = (batch.column(c).to_pylist() for c in ("first_id", "copies", "cuts"))
            for i, text in enumerate(part):
                cut = cuts[i] or []
                if (copies[i] or 0) > 1 and ids[i] != first[i] and len(text.encode("utf-8", "surrogatepass").split()) >= passage:
                    keep.append(False)
                    continue
                if cut:
                    texts[i] = cut_words(text, [(c["start_word"], c["end_word"]) for c in cut])
                keep.append(not cut or bool(texts[i].strip()))
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                sizes = columns[names.index("n_chars")]
                columns[names.index("n_chars")] = pa.array([len(texts[i]) if cuts[i] else v for i, v in enumerate(sizes.to_pylist())], sizes.type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space that follows them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(data[at:starts[a]])
        at = max(at, starts[b])
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
