"""SimHash near-duplicates found by pigeonring chains.

Fingerprints are cut into ``m`` consecutive segments on a ring. If two fingerprints differ in at most ``t`` bits, then
some segment starts a chain whose first ``l`` segments differ in at most ``l * t / m`` bits in total, for every ``l``. A chain's
budget leaves a fixed number of its segments without any difference; each way to place them is one hash-join key.
Pairs that meet are held against all chain budgets before the full Hamming distance is looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept, made, text_slices, whole
from .graph import components

SHINGLE, SEED, DISTANCE, SEGMENTS, CHAIN = 4, 42, 4, 7, 5

#: Values of a key that are joined pair by pair; keys with more are joined by way of stars, with the same components.
CROWD = 256

#: Crowded keys that are broadcast at most; more are joined by a shuffle. Results are equal.
BROADCAST_KEYS = 200_000

# Bits of every byte value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACE = np.arange(8, dtype=np.int64) * 256
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit majority fingerprint of the word shingles of a text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        made_of, count = iter([b" ".join(words)]), 1
    else:
        made_of, count = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, made_of, repeat(SEED)), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, BLOCK):
        # Per byte of the hash, how often each value occurs; then the bits of those values.
        codes = hashes[start:start + BLOCK].view(np.uint8).reshape(-1, 8) + PLACE
        ones += (np.bincount(codes.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *carried: str) -> DataFrame:
    """(doc_id, carried long columns, fp) per row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield made(batch, **{c: batch.column(c) for c in carried}, fp=np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *carried).mapInArrow(run, f"doc_id {kind}, {''.join(f'{c} bigint, ' for c in carried)}fp bigint")


def segments(m: int) -> list[tuple[int, int]]:
    """(offset, width) of ``m`` consecutive segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def equal_places(m: int, distance: int, chain: int) -> list[tuple[int, ...]]:
    """Where a chain that keeps its budgets can have its unchanged segments (offsets from the start, which is one)."""
    changed = chain * distance // m
    places = []
    for rest in combinations(range(1, chain), chain - 1 - changed):
        same = {0, *rest}
        if all(sum(i not in same for i in range(n)) <= n * distance // m for n in range(1, chain + 1)):
            places.append(tuple(sorted(same)))
    return places


def bits(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fps: DataFrame, distance: int, m: int, chain: int) -> DataFrame:
    """(fp, key, start): the values of a chain's unchanged segments, for every start and every way to place them."""
    cut, places = segments(m), equal_places(m, distance, chain)
    keys = []
    for start in range(m):
        for n, place in enumerate(places):
            key = F.lit(start * len(places) + n).cast("long")
            for p in place:
                offset, width = cut[(start + p) % m]
                key = F.shiftleft(key, width).bitwiseOR(bits(F.col("fp"), offset, width))
            keys.append(F.struct(key.alias("key"), F.lit(start).cast("tinyint").alias("start")))
    return fps.select("fp", F.inline(F.array(*keys)))


def near_pairs(left: DataFrame, right: DataFrame, distance: int, m: int, ordered: bool) -> DataFrame:
    """Pairs (a, b) that share a key, keep the budgets of the whole chain from its start, and differ in at most ``distance`` bits.

    Spark sizes exploded keys like the fingerprints they come from, so a merge join is asked for: by that size it would broadcast them.
    """
    cut, left, right = segments(m), left.alias("l"), right.select("key", F.col("fp").alias("other")).alias("r")
    diff = F.col("l.fp").bitwiseXOR(F.col("r.other"))
    within = F.lit(False)
    for start in range(m):
        total, held = F.lit(0), F.lit(True)
        for n in range(1, m):
            offset, width = cut[(start + n - 1) % m]
            total = total + F.bit_count(bits(diff, offset, width))
            held = held & (total <= n * distance // m)
        within = within | ((F.col("l.start") == start) & held)
    apart = F.col("l.fp") < F.col("r.other") if ordered else F.col("l.fp") != F.col("r.other")
    near = (F.col("l.key") == F.col("r.key")) & apart & within & (F.bit_count(diff) <= distance)
    return left.join(right.hint("merge"), near).select(F.col("l.fp").alias("a"), F.col("r.other").alias("b")).distinct()


def similar_fingerprints(fps: DataFrame, distance: int = DISTANCE, m: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values ``fp`` with at most ``distance`` differing bits."""
    rows = chain_keys(fps, distance, m, chain)
    return near_pairs(rows, rows, distance, m, ordered=True)


def connecting_links(fps: DataFrame, distance: int = DISTANCE, m: int = SEGMENTS, chain: int = CHAIN, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between values ``fp`` that join the same components as all pairs within ``distance``.

    A key of up to ``crowd`` values is joined pair by pair. The values of more crowded keys, those of a large group of near copies, are first
    linked in stars: values that are one flip away from the same word are at most two bits apart. In a crowded key only the values
    outside the star component that has most of its rows are then held against all of its rows, as within a component no further link matters.
    """
    rows = chain_keys(fps, distance, m, chain)
    crowded = kept(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded-keys")
    n_crowded = crowded.count()
    crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded.hint("merge")
    links = near_pairs(rows.join(crowded, "key", "left_anti"), rows, distance, m, ordered=True)
    if not n_crowded:
        return links
    full = kept(rows.join(crowded, "key"), "crowded-rows")
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    around = full.select("fp").distinct().select("fp", F.explode(words).alias("word"))
    hubs = around.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("word", "hub")
    stars = around.join(hubs.hint("merge"), "word").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct() if distance >= 2 else links.limit(0)
    stars = kept(stars, "stars")
    named = full.join(components(stars).withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    most = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"))
    rest = named.join(most.select("key", "most.root"), ["key", "root"], "left_anti").select("key", "fp", "start")
    return links.union(stars).union(near_pairs(rest, full, distance, m, ordered=False))


def with_components(fps: DataFrame, distance: int, m: int, chain: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of rows (doc_id, fp)."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(connecting_links(distinct.select("fp"), distance, m, chain))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, m: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other. Copies share a fingerprint and are grouped
    before the join, so a group of copies costs one row whatever its size. Rows with a null doc_id keep a row and link others,
    and never name a component (its id is null only if no member has an id). Repeated rows give repeated rows. Other columns are ignored.
    Every ``m`` and ``chain`` gives the same rows; more segments make longer keys, for larger tables.
    """
    fps = kept(fingerprints(docs, shingle), "fingerprints")
    classes = with_components(fps, distance, m, chain).select("fp", "component_id")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, m: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate component: that of the smallest doc_id (null ids last).

    Of different rows with this id the one of the lowest hash stays, of equal rows one. Rows are told apart by a 64-bit hash of their
    columns (maps left out). Only ids, fingerprints and hashes are grouped; the texts are joined to the rows that stay.
    """
    mark = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    keyed = docs.select(whole(docs).alias("row"), mark.alias("mark"))
    fps = kept(fingerprints(keyed.select("row.doc_id", "row.text", "mark"), shingle, "mark"), "fingerprints")
    classes = with_components(fps, distance, m, chain).select("fp", "root")
    first = fps.join(classes.hint("merge"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("head"))
    return keyed.join(first.select("head.mark"), "mark", "left_semi").dropDuplicates(["mark"]).select("row.*")
