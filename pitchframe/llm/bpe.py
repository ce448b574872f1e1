"""Byte-level BPE encoding and decoding by speculation and verification.

Per distinct piece of text (blanks plus what follows up to the next blank), cached per worker:

1. *Speculate*: greedy longest match proposes tokens for every pre-token.
2. *Verify*: numpy tests all adjacent proposed token pairs of a batch at once. A pair is
   compatible when no merge crosses its border at any time, which is read off the two tokens'
   merge histories. A sequence whose pairs are all compatible is the exact encoding.
3. Only the words with an incompatible pair are merged exactly, lowest rank first.

The vocabulary file is a parameter (read by path on each worker, never copied).

Defined results: a null text is empty and has no tokens; the end-of-text token's string in a
text is that token; decoding joins the tokens' bytes, invalid UTF-8 becomes U+FFFD; repeated
rows and null ids give a row each; other columns are ignored; an empty table gives an empty
result. Memory is bounded by one batch and the piece cache (``CACHE`` entries), whatever the
length of a text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import narrow

#: Most pieces a worker keeps in each of its two generations.
CACHE = 300_000
#: Longest piece that is cached.
CACHED_CHARS = 64
#: Bytes of a word from which it is merged by itself.
LONG_WORD = 512
#: Rows of one Arrow batch handled together.
ROWS = 256

#: Every blank other than the plain space: one of these next to a space means that the space
#: cannot be cut off, see ``pieces``.
_TOUCHING = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_ASCII_BLANKS = sum(b.isascii() for b in _TOUCHING)


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 characters
    for themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> tuple[str, list[str]]:
    """The text up to its first cut, and what follows each cut, without the space it begins with.

    Cuts are before single spaces: pre-tokens never reach across one. A space that touches
    another blank on its left may belong to a longer run of blanks; a text with such a place
    (and an empty one) is not cut.
    """
    if any(b in text for b in (_TOUCHING[:_ASCII_BLANKS] if text.isascii() else _TOUCHING)):
        return text, []
    first, *rest = text.split(" ")
    return first, rest


class Vocabulary:
    """Tokens, merges and merge histories of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        ids = spec["model"]["vocab"]
        self.pattern = regex.compile(pattern)
        self.size = 1 + max(*ids.values(), *[x["id"] for x in spec["added_tokens"]])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = raw(token)
        self.id = {b: i for i, b in enumerate(self.bytes) if b}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.longest = max(map(len, self.id))
        self.base = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        #: Rank of the merge that makes a token (-1: none) and its two parts.
        self.born = np.full(self.size, -1, np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        made = np.empty(len(spec["model"]["merges"]), np.int64)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((x, y), r)
            made[r] = z
            if self.born[z] < 0:
                self.born[z], self.left[z], self.right[z] = r, x, y
        self.made = made
        keys = np.array([x * self.size + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        cut = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({cut})") if cut else None
        #: Tokens that exact merging of their own bytes does not give back; greedy must not use them.
        self.unreachable = {i for b, i in self.id.items() if len(b) > 1 and self.born[i] < 0}

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of the merges of the pairs; the largest integer where there is none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self._keys, key), self._keys.size - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.iinfo(np.int64).max)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """True where encoding token x's bytes followed by token y's bytes gives [x, y].

        Going back in time, the later-made of the two border tokens is undone (on a tie the right
        one: equal merges run from left to right); a border merge must not be due before either
        token is used up on its own side.
        """
        ok = np.ones(x.size, bool)
        live = np.arange(x.size)
        x, y = x.copy(), y.copy()
        never = np.iinfo(np.int64).max
        used_x, used_y = np.full(x.size, never), np.full(x.size, never)
        while live.size:
            r = self.pair_ranks(x, y)
            bad = (r < used_x) & (r <= used_y) & (r < never)
            ok[live[bad]] = False
            born_x, born_y = self.born[x], self.born[y]
            more = ~bad & ((born_x >= 0) | (born_y >= 0))
            undo_x = born_x > born_y
            used_x = np.where(undo_x, born_x, used_x)[more]
            used_y = np.where(undo_x, used_y, born_y)[more]
            x, y = np.where(undo_x, self.right[x], x)[more], np.where(undo_x, y, self.left[y])[more]
            live = live[more]
        return ok

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids = [], 0, len(word), self.id
        while at < n:
            end = min(n, at + self.longest)
            while (i := ids.get(word[at:end])) is None or i in self.unreachable:
                end -= 1
            out.append(i)
            at = end
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words side by side: in every round each word takes its merge of
        lowest rank, the leftmost on ties. Long words are merged one by one, from a heap."""
        out: list[list[int]] = [[] for _ in words]
        never = np.iinfo(np.int64).max
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        while by_size and len(words[by_size[-1]]) > LONG_WORD:
            i = by_size.pop()
            out[i] = self.merge_long(words[i])
        at = 0
        while at < len(by_size):
            size = max(2, len(words[by_size[at]]))
            end = at
            # words of like length together, so that padding stays small
            while end < len(by_size) and end - at < 4096 and len(words[by_size[end]]) <= size + size // 4:
                end += 1
            rows = np.array(by_size[at:end])
            at = end
            n = np.array([len(words[i]) for i in rows])
            token = np.full((rows.size, int(n.max()) + 1), -1, np.int64)
            token[np.arange(token.shape[1]) < n[:, None]] = self.base[
                np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
            rank = np.where((token[:, :-1] >= 0) & (token[:, 1:] >= 0),
                            self.pair_ranks(token[:, :-1], token[:, 1:]), never)
            while rows.size:
                j = rank.argmin(1)
                line = np.arange(rows.size)
                r = rank[line, j]
                done = r == never
                if done.any():
                    for i, t in zip(rows[done].tolist(), token[done].tolist()):
                        out[i] = [x for x in t if x >= 0]
                    go = ~done
                    rows, token, rank, j, r = rows[go], token[go], rank[go], j[go], r[go]
                    line = np.arange(rows.size)
                    if not rows.size:
                        break
                later = np.arange(token.shape[1] - 1) > j[:, None]
                token[:, :-1] = np.where(later, token[:, 1:], token[:, :-1])
                token[:, -1] = -1
                token[line, j] = self.made[r]
                rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = never
                for x in (np.maximum(j - 1, 0), j):
                    a, b = token[line, x], token[line, x + 1]
                    rank[line, x] = np.where((a >= 0) & (b >= 0), self.pair_ranks(a, b), never)
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word in O(n log n): a heap of (rank, place) over a linked list of tokens;
        an entry whose pair has changed since is passed over."""
        token = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, made, rank = len(token), self.made.tolist(), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((token[i], token[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if token[i] >= 0 else n
            if j >= n or rank.get((token[i], token[j])) != r:
                continue
            token[i], token[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get((token[i], token[k]))) is not None:
                    heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank.get((token[h], token[i]))) is not None:
                heappush(heap, (x, h))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Exact token ids of pre-tokens."""
        proposed = [self.speculate(w) for w in words]
        flat = np.array([t for p in proposed for t in p], np.int64)
        if flat.size < 2:
            return proposed
        owner = np.repeat(np.arange(len(proposed)), [len(p) for p in proposed])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pair // self.size, pair % self.size)[back]
        failed = np.unique(owner[inner[~ok]]).tolist()
        for i, ids in zip(failed, self.merge([words[i] for i in failed])):
            proposed[i] = ids
        return proposed

    def encode_pieces(self, todo: list[str]) -> list[list[int]]:
        """Token ids of pieces without special tokens."""
        split = [[w.encode() for w in self.pattern.findall(p)] for p in todo]
        words = list(dict.fromkeys(w for s in split for w in s))
        ids = dict(zip(words, self.encode_words(words)))
        return [[t for w in s for t in ids[w]] for s in split]


Entry = tuple[int, str, bytes]


class Codec:
    """Encodes batches of texts; what a piece gives is kept for the next batches.

    ``known`` maps a piece (without its leading space) to its token count, its ids joined by
    commas and the bytes they decode to. A full generation becomes ``older``, from which pieces
    still in use move back.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}

    def entry(self, ids: list[int]) -> Entry:
        token = self.v.bytes
        return len(ids), ",".join(map(str, ids)), b"".join([token[i] for i in ids])

    def encode(self, texts: list[str]) -> list[list[Entry]]:
        """Per text the entries of its pieces, in order."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        v, known, older = self.v, self.known, self.older
        cut = []
        for text in texts:
            special = v.cut is not None and any(x in text for x in v.special)
            parts = v.cut.split(text) if special else [text]
            cut.append([(x, []) if x in v.special else pieces(x) for x in parts if x])
        fresh = {p for c in cut for _, rest in c for p in rest if p not in known}
        for p in [p for p in fresh if p in older]:
            known[p] = older[p]
            fresh.discard(p)
        heads = {first for c in cut for first, _ in c if first and first not in v.special}
        todo, first_of = list(fresh), list(heads)
        ids = v.encode_pieces([" " + p for p in todo] + first_of)
        once: dict[str, Entry] = {}
        for p, i in zip(todo, ids):
            (known if len(p) <= CACHED_CHARS else once)[p] = self.entry(i)
        head = {s: self.entry([i]) for s, i in v.special.items()} | {"": (0, "", b"")}
        head |= {p: self.entry(i) for p, i in zip(first_of, ids[len(todo):])}
        out = []
        for c in cut:
            found: list[Entry] = []
            for first, rest in c:
                if first:
                    found.append(head[first])
                found += [known[p] if p in known else once[p] for p in rest] if once else [known[p] for p in rest]
            out.append(found)
        return out


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str,
                id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]), one row per input row.

    ``keep_ids`` adds the ids (array<int>) and the decoded text themselves.
    """
    docs = narrow(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(vocabulary, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, ids, texts, listed, plain = [], [], [], [], []
                for entries in codec.encode(part.column(1).to_pylist()):
                    n.append(sum([e[0] for e in entries]))
                    joined = ",".join([e[1] for e in entries])
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        listed.append(np.fromstring(joined, np.int32, sep=","))
                        plain.append(decoded)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(listed, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
