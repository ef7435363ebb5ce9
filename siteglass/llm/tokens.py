"""Token counts of a byte-level BPE without materialising ids.

A text is split into pre-tokens, which the merges never cross. Its token count is therefore the sum, over its distinct pre-tokens, of frequency
times pieces. Texts are taken in blocks of some megabytes: a block lists its distinct pre-tokens once, and each of its documents
holds their places in that list with frequencies, packed to a fraction of the text. The lists are dealt by the pre-tokens' hash, so that all blocks'
copies of a pre-token meet and it goes through the tokenizer once; the piece counts go back to their block, and meet its documents there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import kept, text_slices

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that every Unicode version since 10 puts in the same class. Texts with others are
#: pre-tokenized by the tokenizer itself, whose tables may be older than ours.
STABLE = r"[\x00-ԯḀ-⁯₠-₿℀-⯿　-ヿ一-鿯가-힣＀-￯\U0001F300-\U0001FAFF]*"

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20

#: Pre-tokens given to the tokenizer at once: its results are objects of about a kilobyte.
ENCODED = 2_000


class PreTokens:
    """Splits texts into pre-tokens and special strings, and counts the pieces of a pre-token."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        self.stable = regex.compile(STABLE).fullmatch
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Longest first, as of two special strings at one place the longer is taken.
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def count(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens of a text, and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        counts: Counter = Counter()
        for part in parts:
            if part.isascii() or self.stable(part):
                counts.update(self.find(part))
            else:
                counts.update(part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return counts, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for start in range(0, len(tokens), ENCODED):
            out += map(len, self.tokenizer.encode_batch(tokens[start:start + ENCODED], add_special_tokens=False))
        return out


@lru_cache(maxsize=1)
def pre_tokens_of(path: str) -> PreTokens:
    """One tokenizer in each worker process, whatever the number of its tasks."""
    return PreTokens(path)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, mostly small: a byte each, 255 for those that follow behind as four bytes."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8, n).astype(np.int64)
    if len(data) > n:
        values[values == 255] = np.frombuffer(data, "<i4", offset=n)
    return values


def blocks(docs: DataFrame, tokenizer: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: block, doc_id, n_bytes, special (strings), n, steps and times; and rows of the block's list: block, bucket, n, steps, sizes, tokens.

    ``steps`` are ascending places in the list of the block as packed differences: those of the ``n`` distinct pre-tokens of a document, with
    ``times`` their packed frequencies less one, or those of the ``n`` pre-tokens of one bucket, with ``sizes`` their packed lengths in ``tokens``.
    """
    kind = docs.schema["doc_id"]
    schema = f"block bigint, doc_id {kind.dataType.simpleString()}, n_bytes bigint, special bigint, bucket int, n int, steps binary, times binary, sizes binary, tokens binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = pre_tokens_of(tokenizer), TaskContext.get().partitionId() << 32
        for batch, texts in text_slices(batches, limit=block_bytes):
            places: dict[str, int] = {}
            rows: list[tuple] = []
            for text in texts:
                counts, special = split.count(text)
                at = np.fromiter((places.setdefault(t, len(places)) for t in counts), np.int32, len(counts))
                order = np.argsort(at, kind="stable")
                times = np.fromiter(counts.values(), np.int32, len(counts))[order]
                rows.append((len(text) if text.isascii() else len(text.encode()), special, None, len(at), _steps(at[order]), packed(times - 1), None, None))
            spelled = [t.encode() for t in places]
            bucket = np.fromiter(map(crc32, spelled), np.int64, len(spelled)) % buckets
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    own = [spelled[i] for i in part.tolist()]
                    rows.append((None, None, int(bucket[part[0]]), len(own), _steps(part), None, packed(np.array([len(t) for t in own])), b"".join(own)))
            more = len(rows) - len(texts)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            ids = pa.concat_arrays([batch.column("doc_id"), pa.nulls(more, batch.column("doc_id").type)])
            columns = [pa.array([number] * len(rows), pa.int64()), ids, *[pa.array(c, t) for c, t in zip(zip(*rows), types)]]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "n_bytes", "special", "bucket", "n", "steps", "times", "sizes", "tokens"])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _steps(places: np.ndarray) -> bytes:
    return packed(np.diff(places, prepend=places[:0].dtype.type(0)))


def piece_counts(lists: DataFrame, tokenizer: str) -> DataFrame:
    """(owner, size, at, pieces) of rows of lists, all those of a bucket after another: packed piece counts of the pre-tokens of a row.

    A pre-token is in one bucket, where it goes through the tokenizer once. A task remembers the piece counts of one bucket at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, current = pre_tokens_of(tokenizer), {}, None
        for batch in batches:
            out = []
            for bucket, n, sizes, tokens in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "sizes", "tokens"))):
                if bucket != current:
                    known, current = {}, bucket
                ends = np.cumsum(unpacked(sizes, n)).tolist()
                own = [tokens[a:b] for a, b in zip([0, *ends], ends)]
                new = [t for t in own if t not in known]
                known.update(zip(new, split.pieces([t.decode() for t in new])))
                out.append(packed(np.array([known[t] for t in own])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n"), batch.column("steps"), pa.array(out, pa.binary())], names=["owner", "size", "at", "pieces"])

    return lists.mapInArrow(run, "owner bigint, size int, at binary, pieces binary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level BPE file that every executor has. Counts equal those of the library,
    without added begin or end tokens, truncation or padding; special strings in a text count as one token. A null
    text counts as empty (0 bytes, 0 tokens); repeated rows and null ids stay as they are; other columns are ignored. ``buckets`` of
    pre-tokens: as many as shuffle partitions unless given, so that a task holds its share of the distinct pre-tokens.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = kept(blocks(docs, tokenizer, buckets, block_bytes), "token-blocks")
    lists = table.where(F.col("bucket").isNotNull()).select("block", "bucket", "n", "steps", "sizes", "tokens")
    known = piece_counts(lists.repartition("bucket").sortWithinPartitions("bucket"), tokenizer)

    def summed(rows: pa.Table, listed: pa.Table) -> pa.Table:
        parts = [(unpacked(at, n), unpacked(p, n)) for n, at, p in zip(*(listed.column(c).to_pylist() for c in ("size", "at", "pieces")))]
        pieces = np.zeros(sum(len(p) for _, p in parts), np.int64)
        for at, p in parts:
            pieces[np.cumsum(at)] = p
        packs = zip(*(rows.column(c).to_pylist() for c in ("n", "steps", "times", "special")))
        counts = np.array([special + int((unpacked(times, n) + 1) @ pieces[np.cumsum(unpacked(steps, n))]) for n, steps, times, special in packs], np.int64)
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array(counts > limit, pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    documents = table.where(F.col("bucket").isNull()).select("block", "doc_id", "n_bytes", "special", "n", "steps", "times")
    return documents.groupBy("block").cogroup(known.groupBy("owner")).applyInArrow(summed, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
