"""Best-fit packing by bin completion: branch and bound over the histogram of piece lengths."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

CAPACITY = 1024
#: Rows of one length that one ordering cell holds on average.
CELL = 512


# ---- the solver: counts[length] pieces of each length, on the driver; its size is bounded by the capacity alone


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Waste bound: for each a, pieces over cap - a need bins of their own, middling ones share what is left."""
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(cap + 1))
    half, a = cap // 2, np.arange(cap // 2 + 1)
    large, middle = n[cap] - n[cap - a], n[cap - a] - n[half]
    small = total[half] - np.concatenate([[0], total[:half]])
    room = middle * cap - (total[cap - a] - total[half])
    return max(-(-int(total[cap]) // cap), int((large + middle + np.maximum(0, -(-(small - room) // cap))).max()))


def best_fit(counts: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: [(lengths in a bin, bins)], all bins with the same room moving together."""
    open_bins: dict[int, list] = {}
    for s in np.nonzero(counts)[0][::-1].tolist():
        k = int(counts[s])
        if not s:
            continue
        for room in sorted(r for r in open_bins if r >= s):
            while k and open_bins.get(room):
                filling, bins = open_bins[room].pop()
                each = min(room // s, k)
                used = min(bins, k // each)
                if bins > used:
                    open_bins[room].append((filling, bins - used))
                open_bins.setdefault(room - each * s, []).append((filling + (s,) * each, used))
                k -= each * used
            if not k:
                break
        while k:
            each = min(cap // s, k)
            open_bins.setdefault(cap - each * s, []).append(((s,) * each, k // each))
            k -= each * (k // each)
    return [g for groups in open_bins.values() for g in groups]


class Spent(Exception):
    """The search has used up its steps."""


class Packing(NamedTuple):
    """bins: (lengths in a bin, bins) each; bound: no packing has fewer bins; proven: nor than this one (bound reached or search exhausted)."""

    bins: list[tuple[tuple[int, ...], int]]
    bound: int
    proven: bool


def dominated(filling: tuple[int, ...], room: int, others: int) -> bool:
    """Whether some pieces of a filling (none, too) could give way to one larger or equal piece that is left, and fits; others: bits of these sizes.

    The piece's bin would take what gave way, so the filling with the piece is never the worse: Martello and Toth's rule for one piece. It
    raises the sum, or keeps it with fewer pieces, so no two fillings dominate each other.
    """
    every, many = 1, 0  # bits of the sums of all subsets, and of those of two pieces or more
    for x in filling:
        many |= (every & ~1) << x
        every |= every << x
    spare, above, width = room - sum(filling), every << 1, 1  # above: sums raised by 1 .. spare
    while width < spare:
        step = min(width, spare - width)
        above |= above << step
        width += step
    above = above if spare else 0
    return bool((above | many) & others)


def fillings(left: list[tuple[int, int]], room: int, waste, tick):
    """Undominated fillings of room that waste no more than waste() says, each once, large pieces first; left: (size, pieces), sizes falling."""
    sizes = [s for s, _ in left]
    totals = [0] * (len(left) + 1)
    for i in range(len(left) - 1, -1, -1):
        totals[i] = totals[i + 1] + left[i][0] * left[i][1]
    smallest = sizes[-1] if sizes else 1
    others = sum(1 << s for s in sizes)

    def fill(i: int, space: int, done: tuple[tuple[int, int], ...]):
        if space >= smallest:
            top = bisect.bisect_left(sizes, -space, lo=i, key=lambda s: -s)
            low = space - waste() if space < 2 * smallest else 0  # room for one more piece only
            for j in range(top, len(left)):
                s, n = left[j]
                if s < low or space - totals[j] > waste():
                    break
                tick()
                for m in range(min(n, space // s), 0, -1):
                    yield from fill(j + 1, space - m * s, (*done, (s, m)))
        if space <= waste():
            tick()
            whole, free = tuple(s for s, m in done for _ in range(m)), others
            for s, m in done:
                if have[s] == m:
                    free &= ~(1 << s)
            if not dominated(whole, room, free):
                yield whole

    have = dict(left)
    return fill(0, room, ())


def promising(left: list[tuple[int, int]], room: int, tries: tuple[int, ...] = (24, 3, 2)) -> list[tuple[int, ...]]:
    """Some fillings to try first, least waste first: tries of first, second and third pieces from the largest down, then the largest that fit."""
    found, tries = set(), (64, *tries[1:]) if len(left) < 64 else tries

    def fill(i: int, space: int, done: tuple[int, ...]) -> None:
        more = tries[len(done)] if len(done) < len(tries) else 1
        j = bisect.bisect_left(left, -space, lo=i, key=lambda x: -x[0])
        if j == len(left):
            found.add(done)
        for k in range(j, min(j + more, len(left))):
            s, n = left[k]
            fill(k if n > done.count(s) + 1 else k + 1, space - s, (*done, s))
            if s == space:
                break

    fill(0, room, ())
    return sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))[: tries[1]]


def complete_bins(counts: np.ndarray, cap: int = CAPACITY, steps: int | None = 200_000) -> Packing:
    """As few bins as the search finds; with steps None it ends with the fewest there are.

    A node fills the bin of the largest piece left (where next to nothing may be wasted, of the one with the fewest partners) with one
    undominated filling, any number of times; afterwards that filling is done with for this piece. A node goes when bins so far + waste bound reach the incumbent; a filling goes when it wastes more than an
    improvement can spare. Best fit over what is left gives incumbents, first of all over everything. The search ends
    at the waste bound of the whole, exhausted, or after a number of steps (fillings tried) with the best incumbent.
    """
    best = best_fit(counts, cap)
    score, least, taken = sum(m for _, m in best), lower_bound(counts, cap), 0

    def tick(n: int = 1) -> None:
        nonlocal taken
        taken += n
        if steps is not None and taken > steps:
            raise Spent

    def children(left: np.ndarray, used: int, barred: tuple[int, frozenset]):
        """(left, used, filling, times, barred) of each child: some promising ones, then all, best first among the next few."""
        held = [(s, int(left[s])) for s in np.flatnonzero(left)[::-1].tolist()]
        total, at = sum(x * k for x, k in held), 0
        spare = lambda: (score - 1 - used) * cap - total
        if len(held) < 64 and 0 <= spare() < held[-1][0]:
            # Little may be wasted: first the bin of the piece that the fewest pairs complete.
            there = (left > 0).astype(np.int64)
            pairs = np.cumsum(np.convolve(there, there)[: cap + 1])
            at = min(range(len(held)), key=lambda i: pairs[cap - held[i][0]] - (pairs[c] if (c := cap - held[i][0] - spare() - 1) >= 0 else 0))
        s, n = held[at]
        done = barred[1] if barred[0] == s else frozenset()
        rest = [(x, k - (x == s)) for x, k in held if x != s or n > 1]
        ways, some = fillings(rest, cap - s, spare, tick), promising(rest, cap - s)
        while some:
            for f in some:
                if f in done:
                    continue
                done |= {f}
                whole, waste = (s, *f), cap - s - sum(f)
                times = min(int(left[x]) // whole.count(x) for x in set(whole))
                while (times := min(times, spare() // waste) if waste else times) > 0:
                    after = left.copy()
                    for x in set(whole):
                        after[x] -= times * whole.count(x)
                    yield after, used + times, whole, times, (s, done)
                    times -= 1
            some = sorted(itertools.islice(ways, 64), key=lambda f: (-sum(f), len(f)))

    stack, path, seen, known = [], [], 0, {}

    def enter(left: np.ndarray, used: int, barred) -> None:
        """Open a node, unless it can't beat the incumbent."""
        nonlocal best, score, seen
        seen += 1
        kinds = int(np.count_nonzero(left))
        tick(1 + kinds // 8)
        ways = iter(())
        if not kinds:
            if used < score:
                score, best = used, list(path)
        elif used + lower_bound(left, cap) < score and known.get(key := hashlib.blake2b(left.tobytes(), digest_size=16).digest(), score) > used:
            # What was left after fewer or as many bins before needs no second look: its fillings were tried, or barred as tried.
            known[key] = used
            if kinds < 64 or seen % 64 == 1:
                rest = best_fit(left, cap)
                if used + sum(m for _, m in rest) < score:
                    score, best = used + sum(m for _, m in rest), path + rest
            ways = children(left, used, barred)
        stack.append(ways)

    try:
        if score > least:
            enter(counts.astype(np.int64), 0, (0, frozenset()))
        while stack and score > least:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            after, used, whole, times, barred = child
            path.append((whole, times))
            enter(after, used, barred)
    except Spent:
        return Packing(best, least, score == least)
    return Packing(best, least, True)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of each length goes: sorted intervals of ranks, at most capacity x lengths in a bin of them."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for filling, times in bins:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            each = filling.count(s)
            rows.append((s, rank.get(s, 0), base, each, offset))
            rank[s] = rank.get(s, 0) + each * times
            offset += each * s
        base += times
    rows.sort()
    names = ("length", "rank", "base", "each", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


# ---- tokens


class Ids:
    """Token ids of texts as little-endian uint32 bytes, with a bounded cache of chunks.

    A space before a non-space always starts a pre-token of the byte-level pattern, so texts are cut
    there and equal chunks are encoded once. New chunks of a batch are encoded in one call, with the end-of-text token
    between them. Chunks in Latin letters go to tiktoken, which has the same vocabulary as ranks and is faster; any other
    one goes to tokenizers, whose ids are the standard here, as do texts that hold a special token's string.
    """

    _cut = re.compile(r" (?=\S)")
    _odd = re.compile(r" (?:\s|\Z)")
    _plain = re.compile(r"[\x00-\u024f\u2010-\u2027]*")

    def __init__(self, path: str, ranks: str | None, most: int = 300_000):
        import base64

        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_file(path), most
        self.special = {x.content: i for i, x in self.t.get_added_tokens_decoder().items()}
        self.known: dict[str, bytes] = {}
        self.fast = None
        if ranks and len(self.special) == 1:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def chunks(self, new: list[str]) -> list[bytes]:
        """Ids of chunks none of which holds the special token's string."""
        if not self.fast:
            return self.encode(new)
        ((name, end),) = self.special.items()
        plain = [self._plain.fullmatch(x) is not None for x in new]
        ids = np.array(self.fast.encode(name.join(x for x, p in zip(new, plain) if p), allowed_special={name}), "<u4")
        cut = np.nonzero(ids == end)[0]
        raw, at = ids.tobytes(), zip([0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), 4 * len(ids)])
        own = iter(self.encode([x for x, p in zip(new, plain) if not p]))
        return [raw[slice(*next(at))] if p else next(own) for p in plain]

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        firsts, rests, plain = [], [], []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self.encode([t])[0]
            elif t:
                parts = self._cut.split(t) if self._odd.search(t) else t.split(" ")
                plain.append(i), firsts.append(parts[0]), rests.append(parts[1:])
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = list(set().union(*rests).difference(known))
        known.update(zip(new, self.chunks([" " + p for p in new])))
        heads = self.chunks([x for x in firsts if x]) if any(firsts) else []
        head = iter(heads)
        get = known.__getitem__
        for i, f, r in zip(plain, firsts, rests):
            out[i] = (next(head) if f else b"") + b"".join(map(get, r))
        return out


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, end_id: int, cap: int, text: str, id_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids, then end_id, cut to cap; the first piece is the short one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ids_of = _ids(tokenizer, ranks)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            take, cols, texts = [], [[], [], [], []], b.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                for i, own in enumerate(ids_of.batch([t or "" for t in texts[lo : lo + 1000]]), lo):
                    raw = memoryview(own + end)
                    n = len(raw) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n % cap or cap) if start == 0 else cap
                        take.append(i)
                        for c, v in zip(cols, (piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                            c.append(v)
                        start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], [id_col, "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(id_col, F.col(text).alias("__text")).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


_KNOWN: dict[tuple, Ids] = {}


def _ids(path: str, ranks: str | None) -> Ids:
    if (path, ranks) not in _KNOWN:
        _KNOWN[path, ranks] = Ids(path, ranks)
    return _KNOWN[path, ranks]


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 2, cap: int = CAPACITY, text: str = "text", id_col: str = "doc_id", steps: int | None = 200_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, bound, proven), a row for each piece.

    Texts are tokenized once, in place; only piece rows move. The driver sees the histogram of lengths (at most cap
    rows) and returns intervals of ranks. Ranks within a length are counted in cells of about 512 rows plus
    the counts of the cells before, so a length that a third of all pieces share is many cells. Null and empty texts
    are one piece, the end id. Repeated rows are packed each on its own. An empty table gives no rows. Only the id and the
    text are read. bound is the least number of sequences that the waste bound allows; proven, whether the search
    ended with the fewest there are (steps None: always, in a time that can grow beyond any bound).
    """
    rows = materialize(pieces(docs, tokenizer, ranks, end_id, cap, text, id_col))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap rows
    counts = np.zeros(cap + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    plan = complete_bins(counts, cap, steps)
    at = slots(plan.bins)
    cells = F.array(*[F.lit(int(-(-n // CELL) or 1)) for n in counts.tolist()])
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64(id_col, "piece"), F.get(cells, F.col("length").cast("int"))))
    mine = Window.partitionBy("length", "__cell").orderBy(id_col, "piece", "ids_crc32")
    per = rows.groupBy("length", "__cell").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("length").alias("__length"), F.col("__cell").alias("__c"), before.alias("__before"))
    per = broadcast_if_small(per, int(sum(-(-n // CELL) for n in counts.tolist())), 48)
    ranked = rows.withColumn("__rank", F.row_number().over(mine) - 1).join(per, (F.col("length") == F.col("__length")) & (F.col("__cell") == F.col("__c")))
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__rank")).alias("rank"))
    code = at["length"] << 48 | at["rank"]

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(code, length << 48 | rank, side="right") - 1
            k = rank - at["rank"][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at["base"][i] + k // at["each"][i]), pa.array(at["offset"][i] + k % at["each"][i] * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumns({"bound": F.lit(plan.bound).cast("long"), "proven": F.lit(plan.proven)})


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
