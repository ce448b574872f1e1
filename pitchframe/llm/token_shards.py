"""Token ids as wavelet matrices: one compressed, queryable file per shard.

Texts are range-partitioned and sorted by document id. Every task encodes its texts in that
order with the tokenizers library and closes a shard at a document's end once ``SHARD_TOKENS``
are reached. A shard file holds its documents' ids and lengths and one succinct bit-plane per
bit of the ids (stably partitioned plane by plane), each plane with a rank directory and
compressed for itself. ``WaveletMatrix`` answers token access, counting and occurrence lookup
from the file without a second copy of the ids.

Files are the rows of a Parquet table (one file each) in the shared folder, so Spark's commit
protocol covers lost executors. Only the totals of the range partitions (one row each) are
summed over all shards.

Defined results: a null text is empty and holds the end id alone; null ids come first; rows that
share an id follow each other by a hash of the text; other columns are ignored; an empty table gives no files
and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import kept, narrow, shared_dir

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Bits between two entries of a rank directory.
BLOCK = 512
#: Most pieces a worker keeps in each of two generations, and the longest piece it keeps.
CACHE, LONGEST = 500_000, 64
#: New pieces encoded in one string.
RUN = 512
#: Marks that are a pre-token of their own behind a word.
MARKS = ".,;:!?"
#: Stand before the first piece of a text and before a mark; blanks that send a text to the library whole.
HEAD, TAIL = "\r", "\v"
#: Every blank but the space and the line feed, for a regular expression.
OTHER_BLANKS = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
#: Text encoded at once.
TEXT_BYTES = 16 << 20
MAGIC = b"PFWM1\0"


class WaveletMatrix:
    """Bit-planes, highest bit first; in each plane the zeros of the previous order come first."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n = n
        self.planes = planes  # packed bits
        self.zeros: list[int] = []
        self.blocks: list[np.ndarray] = []
        for p in planes:
            ones = np.bitwise_count(p).astype(np.uint32)
            per_block = np.add.reduceat(ones, np.arange(0, max(ones.size, 1), BLOCK // 8)) if ones.size else ones
            self.blocks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))
            self.zeros.append(n - int(self.blocks[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, order = [], ids
        for b in range(bits - 1, -1, -1):
            one = (order & ids.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one))
            order = np.concatenate([order[~one], order[one]])
        return cls(ids.size, planes)

    def ids(self, dtype=np.uint32) -> np.ndarray:
        """All tokens, undoing the partitions from the lowest plane up."""
        low = np.zeros(self.n, dtype)
        for b, p in enumerate(reversed(self.planes)):
            one = np.unpackbits(p, count=self.n).astype(bool)
            zeros = self.n - int(np.count_nonzero(one))
            up = np.empty(self.n, dtype)
            up[~one] = low[:zeros]
            up[one] = low[zeros:] | dtype(1 << b)
            low = up
        return low

    def _rank1(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits: the directory, then part of one block."""
        block = at // BLOCK
        first = block * BLOCK // 8
        part = np.unpackbits(self.planes[plane][first:(at + 7) // 8])[:at - block * BLOCK]
        return int(self.blocks[plane][block]) + int(part.sum())

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for b in range(len(self.planes)):
            ones = self._rank1(b, at)
            bit = self._rank1(b, at + 1) - ones
            token = 2 * token + bit
            at = self.zeros[b] + ones if bit else at - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``end`` lie below the last plane."""
        lo, hi = 0, end
        for b in range(len(self.planes)):
            a, z = self._rank1(b, lo), self._rank1(b, hi)
            bit = token >> (len(self.planes) - 1 - b) & 1
            lo, hi = (self.zeros[b] + a, self.zeros[b] + z) if bit else (lo - a, hi - z)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often ``token`` occurs among the first ``end`` tokens (all of them by default)."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, self.n if end is None else min(end, self.n))
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 where there are fewer."""
        if k < 0 or token >> len(self.planes):
            return -1
        lo, hi = self._range(token, self.n)
        if lo + k >= hi:
            return -1
        at = lo + k
        for b in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - b) & 1
            at = self._select_bit(b, bit, at - self.zeros[b] if bit else at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th zero or one of a plane: search the directory, then one block."""
        blocks = self.blocks[plane].astype(np.int64)
        before = blocks if bit else np.minimum(np.arange(blocks.size) * BLOCK, self.n) - blocks
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK
        bits = np.unpackbits(self.planes[plane][first // 8:(first + BLOCK) // 8])[:self.n - first]
        return first + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]


def pack_shard(ids: np.ndarray, lengths: list[int], bits: int) -> bytes:
    """The file: header, compressed document lengths, compressed planes."""
    wm = WaveletMatrix.build(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(np.array(lengths, np.int64).tobytes())] + [squeeze(p.tobytes()) for p in wm.planes]
    return MAGIC + struct.pack(f"<QQB{len(parts)}Q", ids.size, len(lengths), bits, *map(len, parts)) + b"".join(parts)


def open_shard(file: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """The wavelet matrix and the lengths of the documents, in order."""
    if file[:len(MAGIC)] != MAGIC:
        raise ValueError("not a shard file")
    n, _, bits = struct.unpack_from("<QQB", file, len(MAGIC))
    at = len(MAGIC) + 17
    sizes = struct.unpack_from(f"<{bits + 1}Q", file, at)
    at += 8 * (bits + 1)
    expand, parts = zstandard.ZstdDecompressor().decompress, []
    for size in sizes:
        parts.append(np.frombuffer(expand(file[at:at + size]), np.uint8))
        at += size
    return WaveletMatrix(n, parts[1:]), parts[0].view(np.int64)


class _Encoder:
    """tokenizers over pieces of text; pieces met before are not encoded again.

    A text in which every blank is a space or line feed between two words is cut before each blank,
    where a pre-token begins. Arrow cuts a whole batch and finds its distinct pieces, so only these are
    looked up; numpy puts the ids together. Any other text goes to the library whole.

    A piece is kept by its text without the space before it; one that starts with a line feed has no
    space. ``HEAD`` stands before the first piece of a text and ``TAIL`` before a mark behind a word, a
    pre-token of its own; alone it stands for the end id (such texts hold neither character).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.whole = "|".join([*map(re.escape, special), f"[ \n][ \n]|^[ \n]|[ \n]$|[{OTHER_BLANKS}]"])
        self.bits = max(1, (self.t.get_vocab_size() - 1).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        self.width = np.zeros(self.t.get_vocab_size(), np.int64)  # bytes a token stands for
        for token, i in self.t.get_vocab().items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark = {m: ids.tobytes() for m, ids in zip(MARKS, self._library(list(MARKS)))}
        self.fixed = {TAIL + m: ids for m, ids in self.mark.items()} | {TAIL: np.array([END_ID], self.dtype).tobytes()}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Encode pieces. A word and one mark behind it are two pre-tokens, so the word is learned and the
        mark's ids are put behind it."""
        base = {p: p[:-1] for p in fresh if p[-1:] in MARKS and p[:-1].isalpha()}
        words = dict.fromkeys(base.get(p, p) for p in fresh)
        self._encode([p for p in words if p not in self.known])
        for p, word in base.items():
            self.known[p] = self.known[word] + self.mark[p[-1]]

    def _encode(self, fresh: list[str]) -> None:
        """Encode pieces, many in one string: tokens end where pieces end, so the ids are cut by the
        bytes they stand for. First pieces, and those that end in a blank, are encoded alone."""
        alone = [p for p in fresh if p[:1] == HEAD or p[-1:] == "\n"]
        for p, ids in zip(alone, self._library([p.removeprefix(HEAD) for p in alone])):
            self.known[p] = ids.tobytes()
        rest = [p for p in fresh if not (p[:1] == HEAD or p[-1:] == "\n")]
        runs = [rest[at:at + RUN] for at in range(0, len(rest), RUN)]
        size = np.dtype(self.dtype).itemsize
        for run in runs:
            lead = [p if p[:1] == "\n" else " " + p for p in run]
            ids, = self._library(["".join(lead)])
            ends = np.cumsum([len(p.encode()) for p in lead])
            cut = [0, *(size * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()]
            raw = ids.tobytes()
            for p, x, y in zip(run, cut, cut[1:]):
                self.known[p] = raw[x:y]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of distinct pieces."""
        if len(self.known) > CACHE or not self.known:
            self.known, self.older = dict(self.fixed), self.known
        found = list(map(self.known.get, pieces))
        missing = [at for at, ids in enumerate(found) if ids is None]
        fresh = []
        for at in missing:
            p = pieces[at]
            if p in self.older:
                self.known[p] = self.older[p]
            else:
                fresh.append(p)
        self._learn(fresh)
        for at in missing:
            found[at] = self.known[pieces[at]]
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each followed by the end id, and the length of each."""
        whole = pc.match_substring_regex(texts, self.whole)
        marked = pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n")
        marked = pc.binary_join_element_wise(HEAD, marked, f" {TAIL}", "")
        marked = pc.replace_substring_regex(marked, f"(\\pL)([{MARKS}]) ", f"\\1 {TAIL}\\2 ")
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        each = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary())
        joined = each.take(coded.indices)  # the ids of all pieces, end to end
        _, ends, data = joined.buffers()
        size = np.dtype(self.dtype).itemsize
        ends = np.frombuffer(ends, np.int64)[:len(joined) + 1] // size if len(joined) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, self.dtype, int(ends[-1])) if ends[-1] else np.empty(0, self.dtype)
        offsets = cut.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        if not pc.any(whole).as_py():
            return ids, np.diff(bounds)
        apart = iter(self._library(texts.filter(whole).to_pylist()))
        cuts = iter(zip(bounds.tolist(), bounds[1:].tolist()))
        parts = [np.append(next(apart), self.dtype(END_ID)) if w else ids[slice(*next(cuts))] for w in whole.to_pylist()]
        return np.concatenate(parts), np.array([x.size for x in parts])


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shard table (part, shard, first, n_tokens, doc_ids, file) to ``path``.

    ``part`` counts the range partitions in ascending id order and ``first`` the tokens before
    the shard in its part.
    """
    docs = narrow(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("token_shards", tokenizer), lambda: _Encoder(tokenizer))
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        names: list = []

        def close() -> pa.RecordBatch:
            nonlocal shard, first
            all_ids = np.concatenate(ids)
            file = pack_shard(all_ids, lengths, encoder.bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([all_ids.size], pa.int64()), pa.array([names], pa.list_(id_type)),
                 pa.array([file], pa.binary())],
                names=["part", "shard", "first", "n_tokens", "doc_ids", "file"])
            shard, first = shard + 1, first + all_ids.size
            ids.clear()
            lengths.clear()
            names.clear()
            return out

        size, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            # about TEXT_BYTES of text at once
            bounds = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()) // TEXT_BYTES
            starts = np.flatnonzero(np.diff(bounds, prepend=-1)).tolist() if batch.num_rows else []
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                rows = batch.slice(at, end - at)
                found, many = encoder.encode(rows.column(1))
                done = 0
                for name, n, upto in zip(rows.column(0).to_pylist(), many.tolist(), np.cumsum(many).tolist()):
                    names.append(name)
                    lengths.append(n)
                    size += n
                    if size >= shard_tokens:  # a shard ends at a document's end
                        ids.append(found[done:upto])
                        yield close()
                        size, done = 0, upto
                if done < found.size:
                    ids.append(found[done:])
        if ids:
            yield close()

    (docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
     .repartitionByRange("doc_id", "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h")
     .mapInArrow(run, f"part int, shard int, first long, n_tokens long, doc_ids array<{kind}>, file binary")
     .write.option("maxRecordsPerFile", 1).parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the files under ``path``."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(2).type.value_type
            for at in range(batch.num_rows):
                part, first = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                names = batch.column(2)[at].as_py()
                wm, lengths = open_shard(batch.column(3)[at].as_py())
                ids = wm.ids(np.uint16 if len(wm.planes) <= 16 else np.uint32)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e].astype("<u4").tobytes())
                       for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, id_type), pa.array([part] * len(names), pa.int32()),
                     pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    docs = table.select("part", "first", "doc_ids", "file").mapInArrow(
        run, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    # one row per range partition, so the running total and the broadcast stay small
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards (to the shared folder by default) and return what is read back."""
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, shard_tokens)
    return read_shards(docs.sparkSession, path)
