"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes says so, hence equal texts are cut alike, and a long text is many small chunks. Chunks
are de-duplicated: equal ones are combined in each task before they move, and every identifier is verified to stand for one content only; contents
that share a hash get identifiers of their own. A text is then the ordered list of its chunks' identifiers, and texts are equal where the lists are.
Only these lists (8 bytes for about a kilobyte of text) are grouped and joined; the text itself is not moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept

#: Chunk lengths in bytes. The rolling hash looks back 32 bytes, so no cut depends on what stands before its chunk.
LEAST, MOST, MEAN_BITS = 256, 8192, 10
WINDOW = 32

_seed = np.random.default_rng(13)
#: A 32-bit value per byte; upper-case letters have that of their lower-case form.
GEAR = _seed.integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR[65:91] = GEAR[97:123]


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte: sum over the last 32 bytes of their value, shifted by the distance. Five doublings of the window."""
    out, step = GEAR[data], 1
    while step < WINDOW:
        out[step:] += out[:-step] << np.uint32(step)
        step *= 2
    return out


def cuts(size: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes; ``places``: where the rolling hash would cut (ends, ascending)."""
    ends, last = [], 0
    for place in places.tolist():
        while place - last > MOST:
            last += MOST
            ends.append(last)
        if place - last >= LEAST:
            ends.append(place)
            last = place
    while size - last > MOST:
        last += MOST
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def chunked_texts(texts: list[bytes], bits: int) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
    """Per text: SHA-256 of the lower-cased text, hashes of its chunks, and the chunks."""
    shift = 64 - bits
    joined = b"".join(texts)
    marks = np.flatnonzero(rolling(np.frombuffer(joined, np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1 if joined else np.zeros(0, np.int64)
    start = 0
    for text in texts:
        low, end = text.lower(), start + len(text)  # bytes: A-Z only
        inside = marks[np.searchsorted(marks, start, "right"):np.searchsorted(marks, end, "left")] - start
        parts, last = [], 0
        for stop in cuts(len(low), inside):
            parts.append(low[last:stop])
            last = stop
        yield hashlib.sha256(low).digest(), [(xxhash.xxh3_64_intdigest(p) >> shift) - (1 << 63 if bits == 64 else 0) for p in parts], parts
        start = end


def chunk_table(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, sha (of the normalised text), hashes and bodies of its chunks in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            start, held = 0, 0
            bounds = []
            for i, size in enumerate(pa.compute.coalesce(pa.compute.binary_length(texts), 0).to_pylist()):
                if i > start and held + size > 4 << 20:
                    bounds.append((start, i))
                    start, held = i, 0
                held += size
            bounds.append((start, len(texts)))
            for a, b in bounds:
                if a == b:
                    continue
                shas, hashes, bodies = zip(*chunked_texts([t or b"" for t in texts.slice(a, b - a).to_pylist()], bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(shas, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(bodies, pa.list_(pa.binary()))],
                    names=["doc_id", "sha", "hashes", "bodies"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sha binary, hashes array<bigint>, bodies array<binary>")


def contents(chunks: DataFrame, *columns: Column | str) -> DataFrame:
    """A row per chunk: the given columns, its place, hash and body."""
    each = chunks.select(*columns, F.posexplode(F.arrays_zip("hashes", "bodies")).alias("pos", "c"))
    return each.select(*columns, "pos", F.col("c.hashes").alias("hash"), F.col("c.bodies").alias("body"))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: row (a number of its own), doc_id, sha, recipe (ordered identifiers of its chunks).

    An identifier is the chunk's hash, and a number that tells contents of one hash apart (0 where the hash has one content).
    """
    table = kept(chunk_table(docs, bits).withColumn("row", F.monotonically_increasing_id()), "chunks")
    # Equal contents are combined in each task before they move, and compared in full.
    distinct = contents(table).select("hash", "body").distinct()
    many = kept(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "clashing-hashes")
    plain = table.select("row", "doc_id", "sha", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("nth"))).alias("recipe"))
    if many.isEmpty():
        return plain
    # Only chunks of clashing hashes are looked at again: their contents are numbered, and their places in the texts renamed.
    listed = kept(contents(table, "row").join(many, "hash"), "clashing-chunks")
    named = listed.select("hash", "body").distinct().groupBy("hash").agg(F.array_sort(F.collect_list("body")).alias("all"))
    named = kept(named.select("hash", F.posexplode("all").alias("nth", "body")), "clashing-names")
    renamed = listed.join(named, ["hash", "body"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("nth") + 1))).alias("names"))
    numbered = lambda c, i: F.struct(c["hash"].alias("hash"), F.coalesce(F.try_element_at("names", i), F.lit(0)).alias("nth"))
    return plain.join(renamed, "row", "left").select("row", "doc_id", "sha", F.when(F.col("names").isNull(), F.col("recipe")).otherwise(F.transform("recipe", numbered)).alias("recipe"))


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts have the empty recipe. Of equal texts the
    row of the largest doc_id stays (null ids last), of several rows with this id one; keep_id is its id. No rows, no result. Other
    columns are ignored. ``bits`` of the chunk hash: fewer make clashes, which change no result.
    """
    rows = kept(recipes(docs, bits), "recipes")
    head: Column = F.max(F.struct("doc_id", "row"))
    # Written, so that the join below deals both sides anew and a large group can be split.
    groups = kept(rows.groupBy("recipe").agg(head.alias("head"), F.count("*").alias("group_size")), "recipe-groups")
    named = groups.select(F.xxhash64("recipe").alias("key"), F.col("recipe").alias("same"), "head", "group_size")
    joined = rows.withColumn("key", F.xxhash64("recipe")).join(named, "key").where(F.col("recipe") == F.col("same"))
    return joined.select("doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("head.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
