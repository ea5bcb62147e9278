"""Word hashes of whole texts, and the exchange of sorted key sets between document buckets and key shards.

Documents lie in buckets by id hash; each bucket asks the shards of the key space about its distinct keys, a
sorted run of numbers a shard. A shard merges the runs of all buckets and answers in the
order it was asked, so an answer needs no keys. A key that a third of all documents hold reaches its
shard once a bucket, never once a document, and nothing is collected or broadcast.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Odd multiplier of rolling hashes, and the constants of the mixer.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ASK = "node int, bucket int, kind int, keys binary, vals binary"
REPLY = "bucket int, kind int, node int, vals binary"
ASK_ARROW = pa.schema([("node", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("node", pa.int32()), ("vals", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


class Words:
    """The words of a list of texts as one array of hashes; text i has hashes[at[i]:at[i + 1]]."""

    def __init__(self, texts, lower: bool = False, keep: bool = False):
        counts, parts, kept = [], [np.zeros(0, np.uint64)], []
        for at in range(0, len(texts), 256):  # some texts at a time: word lists take ten times their text
            lists = [(t or "").encode("utf-8", "surrogatepass") for t in texts[at : at + 256]]
            lists = [(t.lower() if lower else t).split() for t in lists]
            counts += map(len, lists)
            parts.append(np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists))))
            if keep:
                kept += lists
        self.n = np.array(counts, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.hashes = np.concatenate(parts)
        self.lists = kept if keep else None

    def of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def starts(self, width: int) -> np.ndarray:
        """Places where a width-word window of one text starts."""
        room = self.at[1:].repeat(self.n) - np.arange(len(self.hashes))
        return np.nonzero(room >= width)[0]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words from each place; the last width - 1 places are short and to be left out."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    shift = lambda x, n: np.concatenate([x[n:], np.zeros(min(n, len(x)), np.uint64)])
    out, done, part, size = np.zeros(len(h), np.uint64), 0, h.copy(), 1
    while True:
        if width & size:
            out = out + shift(part, done) * power(done)
            done += size
        if size * 2 > width:
            return mix(out ^ np.uint64(width))
        part, size = part + shift(part, size) * power(size), size * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the width values from each place (fewer at the end)."""
    out, size = x.copy(), 1
    while size < width:
        step = min(size, width - size)
        out[:-step] = np.minimum(out[:-step], out[step:])
        size += step
    return out


# ---- sorted keys and counts as bytes


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers, high parts in unary and low parts bit by bit: near log2(range / count) + 2 bits each.

    count (4 bytes), low bits (1), first key (8), top (8); low parts as whole bytes, then bit planes; the unary part.
    """
    n = len(keys)
    if not n:
        return b""
    x = keys - keys[0]
    top = int(x[-1])
    low = max(0, (top // n).bit_length() - 1)
    high = (x >> np.uint64(low)).astype(np.int64) if low else x.astype(np.int64)
    whole, odd = divmod(low, 8)
    parts = [n.to_bytes(4, "little"), bytes([low]), int(keys[0]).to_bytes(8, "little"), top.to_bytes(8, "little")]
    if whole:
        parts.append(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :whole].tobytes())
    for bit in range(8 * whole, low):
        parts.append(np.packbits((x >> np.uint64(bit) & np.uint64(1)).astype(bool)).tobytes())
    marks = np.zeros(n + (top >> low) + 1, bool)
    marks[high + np.arange(n)] = True
    parts.append(np.packbits(marks).tobytes())
    return b"".join(parts)


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    n, low, first, top = int.from_bytes(raw[:4], "little"), raw[4], int.from_bytes(raw[5:13], "little"), int.from_bytes(raw[13:21], "little")
    whole, at, plane = low // 8, 21, -(-n // 8)
    parts = np.zeros((n, 8), np.uint8)
    if whole:
        parts[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, at).reshape(n, whole)
        at += n * whole
    x = parts.reshape(-1).view("<u8").astype(np.uint64, copy=False)
    for bit in range(8 * whole, low):
        x |= np.unpackbits(np.frombuffer(raw, np.uint8, plane, at), count=n).astype(np.uint64) << np.uint64(bit)
        at += plane
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -1, at), count=n + (top >> low) + 1)) - np.arange(n)
    return (x | high.astype(np.uint64) << np.uint64(low)) + np.uint64(first)


_SIZES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers over 0 in two bits each where most are small (over 2 in a byte more, over 256 in eight more); else in bytes alike."""
    top = int(x.max()) if len(x) else 0
    size = next(s for s in _SIZES if top < 1 << (8 * s))
    over = x >= 3
    if len(x) / 4 + int(over.sum()) >= len(x) * size:
        return bytes([size]) + x.astype(_SIZES[size]).tobytes()
    code = np.minimum(x, 3).astype(np.uint8)
    more = x[over] - 3
    return b"".join([b"\0", len(x).to_bytes(4, "little"), np.packbits(code & 1).tobytes(), np.packbits(code >> 1).tobytes(), np.minimum(more, 255).astype(np.uint8).tobytes(), more[more >= 255].astype("<i8").tobytes()])


def unpack_ints(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    if raw[0]:
        return np.frombuffer(raw, _SIZES[raw[0]], -1, 1).astype(np.int64)
    n = int.from_bytes(raw[1:5], "little")
    plane = -(-n // 8)
    x = np.unpackbits(np.frombuffer(raw, np.uint8, plane, 5), count=n).astype(np.int64)
    x += 2 * np.unpackbits(np.frombuffer(raw, np.uint8, plane, 5 + plane), count=n).astype(np.int64)
    over, at = np.flatnonzero(x == 3), 5 + 2 * plane
    more = np.frombuffer(raw, np.uint8, len(over), at).astype(np.int64)
    more[more == 255] = np.frombuffer(raw, "<i8", -1, at + len(over))
    x[over] += more
    return x


def bundle(*blobs: bytes) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def unbundle(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


# ---- what a key carries, and how the values that buckets hold of one key become one


class Total:
    """Counts, added up. An answer tells what others hold."""

    @staticmethod
    def pack(vals) -> bytes:
        return pack_ints(vals[0])

    @staticmethod
    def unpack(raw: bytes):
        return (unpack_ints(raw),)

    @staticmethod
    def merge(keys: np.ndarray, vals):
        order = np.argsort(keys)
        k = keys[order]
        first = firsts(k)
        at = np.flatnonzero(first)
        back = np.empty(len(k), np.int64)
        back[order] = np.cumsum(first) - 1
        return k[at], (np.add.reduceat(vals[0][order], at) if len(k) else vals[0],), back

    @staticmethod
    def answer(own, whole) -> bytes:
        return pack_ints(whole[0] - own[0])

    @staticmethod
    def learn(own, raw: bytes):
        return (own[0] + unpack_ints(raw),)


class Least:
    """Pairs (document, place), of which the least counts. An answer holds the pairs that differ from one's own."""

    @staticmethod
    def _wide(x: np.ndarray) -> bytes:
        low = int(x.min()) if len(x) else 0
        if len(x) and int(x.max()) - low >= 1 << 62:
            return b"\1" + x.astype("<i8").tobytes()
        return b"\0" + low.to_bytes(8, "little", signed=True) + pack_ints(x - low)

    @staticmethod
    def _narrow(raw: bytes) -> np.ndarray:
        if raw[0]:
            return np.frombuffer(raw, "<i8", -1, 1).astype(np.int64)
        return unpack_ints(raw[9:]) + np.int64(int.from_bytes(raw[1:9], "little", signed=True))

    @classmethod
    def pack(cls, vals) -> bytes:
        return bundle(*map(cls._wide, vals))

    @classmethod
    def unpack(cls, raw: bytes):
        return tuple(map(cls._narrow, unbundle(raw)))

    @staticmethod
    def merge(keys: np.ndarray, vals):
        order = np.lexsort((vals[1], vals[0], keys))
        k = keys[order]
        first = firsts(k)
        at = order[first]
        back = np.empty(len(k), np.int64)
        back[order] = np.cumsum(first) - 1
        return keys[at], (vals[0][at], vals[1][at]), back

    @classmethod
    def answer(cls, own, whole) -> bytes:
        other = (own[0] != whole[0]) | (own[1] != whole[1])
        return bundle(np.packbits(other).tobytes(), cls._wide(whole[0][other]), cls._wide(whole[1][other]))

    @classmethod
    def learn(cls, own, raw: bytes):
        flags, *new = unbundle(raw)
        other = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(own[0])).astype(bool)
        out = tuple(x.copy() for x in own)
        for x, y in zip(out, new):
            x[other] = cls._narrow(y)
        return out


def firsts(x: np.ndarray) -> np.ndarray:
    """Flags of the first of each run of equal numbers."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def distinct(x: np.ndarray):
    """Distinct sorted numbers, where each run of them starts in the sorted order, and the place of each number among them."""
    order = np.argsort(x)
    s = x[order]
    first = firsts(s)
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(first) - 1
    return s[first], np.flatnonzero(first), back


# ---- the exchange


class Exchange:
    """Buckets ask shards of the key space about their keys and get answers in the order they asked.

    Up to direct buckets, each sends every shard one run. Beyond, a run would be some bytes only and their number is the square of the
    buckets'; then runs go through relays: a relay takes one part in sqrt(n) of the key space from sqrt(n) buckets, merges what
    they hold and asks sqrt(n) shards in their stead. Messages are 2 n sqrt(n) then, and a task holds no more than before.
    """

    def __init__(self, buckets: int, kinds: dict[int, type], direct: int = 8192, bits: dict[int, int] | None = None, summed: tuple = ()):
        """kinds: how values of each kind of key merge. bits: of the keys of a kind, where not 64. summed: kinds whose counts every bucket also gets the sum of, and the number over 0."""
        self.n, self.kinds, self.bits, self.summed = buckets, kinds, bits or {}, summed
        self.fan = 0 if buckets <= direct else math.isqrt(buckets - 1) + 1
        self.parts = self.fan or buckets

    def _cut(self, kind: int, keys: np.ndarray, first: int, parts: int, of: int) -> np.ndarray:
        """Edges in sorted keys of parts first, first + 1, ... of the key space cut evenly in that many."""
        cuts = [(i << self.bits.get(kind, 64)) // of for i in range(first + 1, first + parts)]
        return np.concatenate([[0], np.searchsorted(keys, np.array(cuts, np.uint64)), [len(keys)]])

    def _runs(self, sender: int, node, keys: np.ndarray, kind: int, vals, cut: np.ndarray) -> pa.Table:
        how = self.kinds[kind]
        runs = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if hi > lo or kind in self.summed]
        cols = [[node(i) for i, _, _ in runs], [sender] * len(runs), [kind] * len(runs), [pack_keys(keys[lo:hi]) for _, lo, hi in runs], [how.pack(tuple(v[lo:hi] for v in vals)) for _, lo, hi in runs]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ASK_ARROW)], schema=ASK_ARROW)

    def ask(self, bucket: int, asked: dict) -> pa.Table:
        """Rows of ASK for a bucket; asked: kind -> (sorted distinct keys, values)."""
        node = (lambda i: bucket // self.fan * self.fan + i) if self.fan else (lambda i: i)
        return pa.concat_tables([ASK_ARROW.empty_table(), *(self._runs(bucket, node, keys, kind, vals, self._cut(kind, keys, 0, self.parts, self.parts)) for kind, (keys, vals) in asked.items())])

    def _merged(self, t: pa.Table):
        """Of each kind: senders, their values, where their runs start, merged keys and values, place of each asked key in these."""
        kinds = np.array(t["kind"].to_pylist())
        for kind in sorted(set(kinds.tolist())):
            how, mine = self.kinds[kind], t.filter(pa.array(kinds == kind))
            keys = [unpack_keys(k) for k in mine["keys"].to_pylist()]
            vals = [how.unpack(v) for v in mine["vals"].to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            yield kind, mine["bucket"].to_pylist(), vals, at, *how.merge(np.concatenate(keys), tuple(map(np.concatenate, zip(*vals))))

    def _answers(self, node: int, kind: int, senders, vals, at, back, whole, sums) -> list[tuple]:
        how, out = self.kinds[kind], []
        head = np.array(sums, "<i8").tobytes() if kind in self.summed else b""
        for i, (sender, own) in enumerate(zip(senders, vals)):
            mine = back[at[i] : at[i + 1]]
            out.append((sender, kind, node, head + how.answer(own, tuple(w[mine] for w in whole))))
        return out

    def _match(self, t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        out = []
        for kind, senders, vals, at, _, whole, back in self._merged(t):
            out += self._answers(node, kind, senders, vals, at, back, whole, (whole[0].sum(), (whole[0] > 0).sum()))
        return _reply(out)

    def _relay(self, t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        part = node % self.fan
        out = [ASK_ARROW.empty_table()]
        for kind, _, _, _, keys, whole, _ in self._merged(t):
            first = part * self.fan
            out.append(self._runs(node, lambda i: first + i, keys, kind, whole, self._cut(kind, keys, first, self.fan, self.fan**2)))
        return pa.concat_tables(out)

    def _spread(self, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return REPLY_ARROW.empty_table()
        node = t["node"][0].as_py()
        out = []
        for kind, senders, vals, at, keys, whole, back in self._merged(t):
            got, sums = self._learn(answers, kind, whole, self._cut(kind, keys, node % self.fan * self.fan, self.fan, self.fan**2))
            out += self._answers(node, kind, senders, vals, at, back, got, sums)
        return _reply(out)

    def answer(self, asks: DataFrame) -> DataFrame:
        """Rows of REPLY to rows of ASK."""
        if not self.fan:
            return asks.groupBy("node").applyInArrow(lambda t: self._match(t), REPLY)
        asks = materialize(asks)
        up = asks.groupBy("node").applyInArrow(lambda t: self._relay(t), ASK).groupBy("node").applyInArrow(lambda t: self._match(t), REPLY)
        return materialize(asks.groupBy("node").cogroup(up.groupBy("bucket")).applyInArrow(lambda t, a: self._spread(t, a), REPLY))

    def _learn(self, answers: pa.Table, kind: int, own, cut: np.ndarray):
        rows = sorted(((n, v) for k, n, v in zip(answers["kind"].to_pylist(), answers["node"].to_pylist(), answers["vals"].to_pylist()) if k == kind), key=lambda r: r[0])
        head = 16 if kind in self.summed else 0
        runs = [(lo, hi) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()) if hi > lo or head]
        got = [self.kinds[kind].learn(tuple(v[lo:hi] for v in own), raw[head:]) for (lo, hi), (_, raw) in zip(runs, rows, strict=True)]
        sums = np.sum([np.frombuffer(raw, "<i8", 2) for _, raw in rows], axis=0) if head else None
        return (tuple(map(np.concatenate, zip(*got))) if got else own), sums

    def learn(self, answers: pa.Table, kind: int, keys: np.ndarray, vals):
        """What all buckets hold of the keys a bucket asked for, from its rows of REPLY; and the sums, where the kind has them."""
        return self._learn(answers, kind, vals, self._cut(kind, keys, 0, self.parts, self.parts))


def _reply(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, REPLY_ARROW)], schema=REPLY_ARROW)


def bucketed(docs: DataFrame, id_col: str, text: str, buckets: int) -> DataFrame:
    """(bucket, id, text); a bucket is a set of ids by hash, the same in every run."""
    return docs.select(F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("bucket"), F.col(id_col).alias("id"), F.col(text).alias("text"))
