"""BPE encoding and decoding with public byte-level vocabularies.

Encoding is a backtracking encoder, after the idea published with the Rust crate ``bpe``. An Aho-Corasick automaton of the vocabulary finds
the longest token at each place, for the whole piece in one pass (the automaton holds the tokens backwards and reads the piece from its end,
so that what ends at a place is what begins there); a token may follow another only if merging would not have crossed their bound, which a
pair-compatibility table answers; where it fails, the next shorter token is tried and, where none is left, the one before is given up. A
place that failed is never tried again, so time is linear. A sequence whose neighbours are all compatible is the one that merging by rank
gives, so the result is exact.

Decoding gathers bytes from one blob of all tokens by an offset table, for a whole batch at once.

Texts are first cut by the vocabulary's published pattern. That cut is done on arrays of code points for
a whole chunk of documents; equal pieces of a chunk are encoded once and a bounded table keeps
pieces between chunks. Pieces are told apart by 64-bit hashes, so every text is decoded again and
compared byte by byte; one that differs is encoded anew piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.kernels import chunks, mix

#: The published cut of texts for these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the public vocabulary files lie on this machine; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slots for pieces that a worker keeps between chunks (16 bytes each, and as much again for their ids).
SLOTS = 1 << 21
#: Pairs of tokens that a worker keeps with their compatibility, some 100 bytes each.
PAIRS = 1 << 18


def _byte_letters() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` file or the JSON file of a byte-level BPE without specials."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, added = _byte_letters(), {t["content"] for t in model.get("added_tokens", [])}
        vocab = model["model"]["vocab"]
        if any(c not in letters for t in vocab if t not in added for c in t):
            raise ValueError("not a byte-level vocabulary")
        return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Decoder:
    """The bytes of a vocabulary's tokens: one blob and an offset table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.token], dtype=np.int64)))


class Encoder(Decoder):
    """The tables of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        size = len(self.token)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.sizes = ranks, np.diff(self.offsets).tolist()
        self.shorter = [-1] * size
        for i, t in enumerate(self.token):
            for n in range(len(t) - 1, 0, -1):
                j = ranks.get(t[:n])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        for i, t in enumerate(self.token):
            if len(t) < 2:
                continue
            a = self.shorter[i]
            while a >= 0:
                b = ranks.get(t[len(self.token[a]) :])
                if b is not None and a < i and b < i and self._apart(a, b):
                    self.merged[a, b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.backward = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.backward.add_word(t[::-1].decode("latin-1"), i)
        self.backward.make_automaton()

    def __getstate__(self):
        return self.ranks

    def __setstate__(self, ranks):
        self.__init__(ranks)

    def _apart(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            got = self.merged.get((a, b))
            if got is not None and got < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; kept in the pair table."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self._apart(a, b)
        return got

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        s = data.decode("latin-1")
        pairs = self.pairs
        n, size, shorter = len(data), self.sizes, self.shorter
        first = [-1] * (n + 1)  # the longest token that begins at each place: matches of one end come longest first
        for end, i in self.backward.iter(s[::-1]):
            if first[n - 1 - end] < 0:
                first[n - 1 - end] = i
        failed, out, pos, now, last = bytearray(n + 1), [], 0, first[0], -1
        while pos < n:
            while now >= 0:
                end = pos + size[now]
                if not failed[end]:
                    if last < 0:
                        break
                    got = pairs.get((last, now))
                    if got is None:
                        got = self.compatible(last, now)
                    if got:
                        break
                now = shorter[now]
            if now >= 0:
                out.append(now)
                pos, last, now = end, now, first[end]
            else:
                failed[pos] = 1
                now = out.pop()
                pos -= size[now]
                now, last = shorter[now], out[-1] if out else -1
        return out

    def text(self, text: str) -> list[int]:
        """Ids of one text, cut by the pattern itself; the plain way that the batch way must equal."""
        return [i for p in _pattern().findall(text) for i in self.piece(p.encode())]


@lru_cache(1)
def _pattern():
    return regex.compile(PATTERN)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, dtype=np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for k, p in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(p, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            out[a:b] = k
    return out


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts (byte places) of the pattern's pieces in a chunk of UTF-8 texts, as an array program."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32) if len(at) < len(data) else data
    cls = _classes()[cp]
    n = len(cls)
    head = np.zeros(n + 1, dtype=bool)  # first character of each document
    head[np.searchsorted(at, off[:-1])] = True
    head[n] = True
    change = head[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(change)
    cut = np.zeros(n, dtype=bool)
    cut[run] = True
    white = cls[run] == 0
    ends = np.append(run[1:], n)
    followed = white & ~head[ends]  # white space before something else of the same document
    tail = ends[followed] - 1
    cut[tail] = True  # its last character stands apart ...
    blank = cp[tail] == 32
    cut[tail[blank] + 1] = False  # ... and, if a blank, joins what follows
    one = np.flatnonzero((ends - run == 1) & (cp[run] == 39) & (ends < n))
    for q in one:
        p = run[q]
        if cut[p] and not head[p + 1] and cls[p + 1] == 1:
            two = chr(cp[p + 1]), chr(cp[p + 2]) if p + 2 < n and not head[p + 2] else ""
            size = 1 if two[0] in "sdmt" else 2 if "".join(two) in ("ll", "ve", "re") else 0
            if size:
                cut[p + 1] = False
                if p + 1 + size < n:
                    cut[p + 1 + size] = True
    return at[cut]


_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    within = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        step = _STEP[within & 4095]
        far = within > 4095
        if far.any():
            step = np.where(far, mix((within >> 12).astype(np.uint64)) * step, step)
        return mix(np.add.reduceat(_BYTE[data] * step, starts) + lens.astype(np.uint64))


def gather(src: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of the slices of ``src``."""
    total = int(lens.sum())
    shift = starts - (np.cumsum(lens) - lens)
    return src[np.arange(total, dtype=np.int64) + np.repeat(shift, lens)]


class Batcher:
    """Encodes Arrow batches with one encoder, keeping known pieces between chunks.

    Known pieces lie in a table of two slots each, looked up for all pieces of a chunk at once; their ids lie in one
    pool. A piece that finds no room is encoded again when it is met again; a full pool is emptied.
    """

    def __init__(self, enc: Encoder, slots: int = SLOTS):
        self.enc, self.mask = enc, np.uint64(slots - 1)
        self.hash = np.zeros(slots, dtype=np.uint64)
        self.begin, self.size = np.zeros(slots, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        self.pool, self.used = np.zeros(4 * slots, dtype=np.int32), 0

    def _learn(self, uniq: np.ndarray, ids: np.ndarray, size: np.ndarray) -> int:
        """Adds the new pieces' ids to the pool; where they begin."""
        at = self.used
        if at + len(ids) > len(self.pool):
            self.hash[:], at = 0, 0
            if len(ids) > len(self.pool):
                self.pool = np.zeros(2 * len(ids), dtype=np.int32)
        self.pool[at : at + len(ids)] = ids
        self.used = at + len(ids)
        begin = at + np.cumsum(size) - size
        one, two = (uniq & self.mask).astype(np.int64), ((uniq >> np.uint64(32)) & self.mask).astype(np.int64)
        slot = np.where(self.hash[one] == 0, one, two)
        self.hash[slot] = uniq
        own = self.hash[slot] == uniq  # of several for one slot, the last stays
        self.begin[slot[own]], self.size[slot[own]] = begin[own], size[own]
        return at

    def _chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pieces(data, off)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(off) - 1, dtype=np.int64)
        lens = np.diff(np.append(starts, len(data)))
        h = _piece_hashes(data, starts, lens)
        slot = (h & self.mask).astype(np.int64)
        hit = self.hash[slot] == h
        other = np.flatnonzero(~hit)
        two = ((h[other] >> np.uint64(32)) & self.mask).astype(np.int64)
        slot[other] = two
        hit[other] = self.hash[two] == h[other]
        begin, per = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(~hit)
        fresh = None
        if len(new):
            uniq, first, inv = np.unique(h[new], return_index=True, return_inverse=True)
            first, raw, piece = new[first], data.tobytes(), self.enc.piece
            out = [piece(raw[a : a + n]) for a, n in zip(starts[first].tolist(), lens[first].tolist(), strict=True)]
            size = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
            fresh = np.fromiter((i for x in out for i in x), dtype=np.int32, count=int(size.sum()))
            per[new] = size[inv]
            begin[new] = self.used + (np.cumsum(size) - size)[inv]
            if self.used + len(fresh) > len(self.pool):  # it will be emptied, so what is known is read before
                ids = gather(np.concatenate((self.pool[: self.used], fresh)), begin, per)
                self._learn(uniq, fresh, size)
            else:
                self._learn(uniq, fresh, size)
                ids = gather(self.pool, begin, per)
        else:
            ids = gather(self.pool, begin, per)
        upto = np.concatenate(([0], np.cumsum(per)))
        return ids, np.diff(upto[np.searchsorted(starts, off)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); nulls count as empty texts."""
        parts = list(self.encoded(texts))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate([i for i, _ in parts]), np.concatenate([c for _, c in parts])) if parts else (none.astype(np.int32), none)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same in parts of whole documents, about ``CHUNK`` bytes each, so that a caller need not hold the ids of a whole batch."""
        for _, _, data, off in chunks(texts):
            i, c = self._chunk(data, off)
            wrong = self._differs(i, c, data, off)
            if len(wrong):
                parts, at = [], np.concatenate(([0], np.cumsum(c)))
                for d in range(len(c)):
                    own = i[at[d] : at[d + 1]]
                    if d in wrong:
                        own = np.array(self.enc.text(data[off[d] : off[d + 1]].tobytes().decode()), dtype=np.int32)
                        c[d] = len(own)
                    parts.append(own)
                i = np.concatenate(parts)
            yield i, c

    def _differs(self, ids, counts, data, off) -> set[int]:
        got, ends = self.decode(ids, counts)
        if len(got) == len(data) and (got == data).all() and (ends == off[1:]).all():
            return set()
        a = np.concatenate(([0], ends))
        return {d for d in range(len(counts)) if not np.array_equal(got[a[d] : a[d + 1]], data[off[d] : off[d + 1]])}

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, end of each), by the offset table."""
        lens = (self.enc.offsets[1:] - self.enc.offsets[:-1])[ids]
        upto = np.concatenate(([0], np.cumsum(lens)))
        return gather(self.enc.blob, self.enc.offsets[ids], lens), upto[np.cumsum(counts)]


_held: dict[str, Batcher] = {}


def _batcher(sent: Broadcast) -> Batcher:
    """This worker's tables of the vocabulary that was sent, made once."""
    name, ranks = sent.value
    if name not in _held:
        _held.clear()
        _held[name] = Batcher(Encoder(ranks))
    return _held[name]


def sent_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read by the driver and sent to the workers once an application (fixed in size: about a megabyte)."""
    sc = spark.sparkContext
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    key = (sc.applicationId, name)
    if key not in _sent:
        _sent[key] = sc.broadcast((name, read_ranks(path)))
    return _sent[key]


_sent: dict[tuple[str, str], Broadcast] = {}


def _lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32()), mask=pa.array(null))


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's token ids (array<int>). ``path`` is read by the driver.

    A null text gives null, an empty text the empty array. No id is added: strings of special tokens are
    ordinary text. Texts of any length are encoded whole. A column of the table named ``ids_col`` is replaced;
    rows, repeated or not, each give one row. An empty table gives an empty table.
    """

    sent = sent_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = _batcher(sent)
        for texts in parts:
            ids, counts = b.encode(texts)
            yield _lists(ids, counts, texts.is_null().to_numpy(zero_copy_only=False))

    return docs.withColumn(ids_col, encode(F.col(text_col).cast("string")))


def bpe_decode(docs: DataFrame, path: str = VOCABULARY, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the text of the ids.

    Null gives null, the empty array the empty text. Bytes that aren't UTF-8 (ids that no text gives)
    become U+FFFD; null ids and ids outside the vocabulary are left out. Arrays of any length are decoded whole. A column named
    ``text_col`` is replaced. Rows, repeated or not, give a row each; an empty table gives an empty table.
    """

    sent = sent_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = _batcher(sent)
        for lists in parts:
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
            good = (flat >= 0) & (flat < len(b.enc.token))
            upto = np.concatenate(([0], np.cumsum(good)))
            ends = np.concatenate(([0], np.cumsum(counts)))
            data, to = b.decode(flat[good], np.diff(upto[ends]))
            raw, at = data.tobytes(), np.concatenate(([0], to))
            yield pa.array([raw[at[i] : at[i + 1]].decode(errors="replace") if v else None for i, v in enumerate(lists.is_valid().to_pylist())], pa.string())

    return docs.withColumn(text_col, decode(F.col(ids_col)))


def bpe_round_trip(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the decoded
    ids are the text, byte for byte (null for a null text, as are the others). The text is decoded from
    the ids in the same pass, through the offset table. An empty text has no ids and is its own round trip; texts of any length are
    encoded whole; rows, repeated or not, give a row each; an empty table gives an empty table. Columns of the table with one of
    these three names, ignoring case, are left out for the result's; all others stay."""

    sent = sent_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def both(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = _batcher(sent)
        for texts in parts:
            texts = texts.cast(pa.large_string())
            null = texts.is_null().to_numpy(zero_copy_only=False)
            ids, counts = b.encode(texts)
            same, at = np.ones(len(texts), dtype=bool), np.concatenate(([0], np.cumsum(counts)))
            for a, n, data, off in chunks(texts):
                same[list(a + d for d in b._differs(ids[at[a] : at[a + n]], counts[a : a + n], data, off))] = False
            yield pa.StructArray.from_arrays([_lists(ids, counts, null), pa.array(same, mask=null)], ["ids", "same"])

    out = docs.withColumn("token_ids", both(F.col(text_col).cast("string")))
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "token_ids", "n_tokens", "round_trip")]
    ids = F.col("token_ids.ids")
    return out.select(*rest, ids.alias("token_ids"), F.when(ids.isNotNull(), F.size(ids)).cast("long").alias("n_tokens"), F.col("token_ids.same").alias("round_trip"))
