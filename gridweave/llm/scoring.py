"""Language-model scores from a weighted backoff automaton of smoothed n-grams.

States are the contexts seen in training, up to order - 1 words, the empty one (the root) included. With c the training
counts and mu a weight for each order,

    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu),    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

h' being h without its first word (Dirichlet smoothing). A seen h w is an arc of state h with log p(w | h), leading to the longest
suffix of h w that is a state; any other word takes the failure arc to h' at log(mu / (c(h) + mu)) and is tried
there; the root has an arc for every word. One pass over a text from left to right carries the state and adds the weights of the
arcs it takes. c(h) is the count of the n-gram h itself, so counts are all that is gathered.

The automaton of a corpus outgrows any machine, so counts lie in shards by n-gram (keyed.py); a bucket of documents asks for those
of its own n-grams, builds the part of the automaton that its texts can reach and traverses that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keyed
from ..plans.ship import ship
from .common import buckets_for
from .language import held_out

#: Stand-ins for a text's end (a token) and for the words before its start (contexts only).
END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
ADD = 0.1
#: MB of stored input a bucket holds.
BUCKET_MB = 7.0


class Tokens:
    """A bucket's token sequences (words, then one end), and their n-grams as hashes of 64 bits cut to a number of bits."""

    def __init__(self, texts, order: int, bits: int):
        w = keyed.Words(texts, lower=True)
        self.n = w.n + 1
        self.at = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.t = np.full(int(self.at[-1]), END, np.uint64)
        inside = np.ones(len(self.t), bool)
        inside[self.at[1:] - 1] = False
        self.t[inside] = w.hashes
        self.order, self.cut = order, np.uint64(64 - bits)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.t)) - self.at[self.doc]

    def grams(self, m: int) -> np.ndarray:
        """Hash of the m tokens that end at each token; places before a text's start count as START."""
        out = np.full(len(self.t), np.uint64(m), np.uint64)
        for back in range(m - 1, -1, -1):
            if back:
                before = np.full(len(self.t), START, np.uint64)
                before[back:] = np.where(self.place[back:] >= back, self.t[:-back], START)
            else:
                before = self.t
            out = keyed.mix(out * np.uint64(keyed.BASE) + before)
        return out >> self.cut

    def keys(self, m: int) -> np.ndarray:
        """Words in full, as their counts are exact; longer n-grams cut."""
        return self.t if m == 1 else self.grams(m)


class Automaton:
    """States, arcs and failure arcs over a bucket's own n-grams.

    gram[m]: the number of each token's m-gram among the bucket's; count[m]: training counts of these; total and kinds: training
    tokens and distinct ones; starts: training texts. A state is an order m and the number of an m-gram; one number more is the
    context of START alone, and order 0 the root. The arc of a state over a word has the number of the n-gram that both make up.
    """

    def __init__(self, k: Tokens, gram: dict, count: dict, total: int, kinds: int, starts: int, mu):
        self.k, self.gram, self.order, ends = k, gram, k.order, k.at[1:] - 1
        p = (count[1] + ADD) / (total + ADD * (kinds + 1))
        self.arc, self.has, self.weight, self.fail = {1: np.log10(p)}, {}, {0: np.zeros(1)}, {}
        lives = {0: np.ones(1, bool)}
        for m in range(1, self.order):
            seen = np.append(count[m], starts)
            lives[m] = seen > 0
            lives[m][gram[m][ends]] = False  # a text's end is no context
            self.weight[m] = np.log10(mu[m - 1] / (seen + mu[m - 1]))
            self.fail[m] = np.zeros(len(seen), np.int32)
            if m > 1:
                self.fail[m][gram[m]] = gram[m - 1]
                self.fail[m][-1] = len(count[m - 1])
        for m in range(2, self.order + 1):
            one = np.empty(len(count[m]), np.int64)  # a token that ends each m-gram
            one[gram[m]] = np.arange(len(k.t))
            state = np.where(k.place[one] > 0, gram[m - 1][one - 1], len(count[m - 1]))
            seen, p = np.append(count[m - 1], starts)[state], p[gram[m - 1][one]]
            p = np.where(lives[m - 1][state], (count[m] + mu[m - 2] * p) / (seen + mu[m - 2]), p)
            self.arc[m], self.has[m] = np.log10(p), count[m] > 0
        self.lives = lives
        self.start = (self.order - 1, len(count[self.order - 1])) if self.order > 1 and starts else (0, 0)

    def traverse(self) -> np.ndarray:
        """Log-probability of each text. Texts go from left to right side by side, each with its state; none looks back."""
        by = np.argsort(-self.k.n, kind="stable")
        start, n = self.k.at[:-1][by], self.k.n[by]
        level, state = np.full(len(n), self.start[0], np.int8), np.full(len(n), self.start[1], np.int32)
        score, falling, top = np.zeros(len(n)), -n, self.order
        for step in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(falling, -step, side="left"))
            at = start[:live] + step
            for m in range(top, 1, -1):
                # Who took an arc of order m is at level m by now (the top: m - 1), so no lower order takes it up again.
                mine = np.flatnonzero(level[:live] == m - 1)
                if not len(mine):
                    continue
                arc = self.gram[m][at[mine]]
                hit = self.has[m][arc]
                go, miss = mine[hit], mine[~hit]
                score[go] += self.arc[m][arc[hit]]
                if m < top:
                    level[go], state[go] = m, arc[hit]
                else:
                    state[go] = self.gram[m - 1][at[go]]
                if len(miss):
                    score[miss] += self.weight[m - 1][state[miss]]
                    level[miss], state[miss] = m - 2, self.fail[m - 1][state[miss]]
            mine = np.flatnonzero(level[:live] == 0)
            if len(mine):
                arc = self.gram[1][at[mine]]
                score[mine] += self.arc[1][arc]
                if top > 1:
                    level[mine], state[mine] = self.lives[1][arc], arc
        out = np.empty(len(n))
        out[by] = score
        return out


def score_texts(docs: DataFrame, train, order: int = 3, mu=(8.0, 4.0), text: str = "text", id_col: str = "doc_id", direct: int = 8192) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; train: which rows are learned from.

    mu has a weight for each order from 2 on. Null and empty texts are one end token. Without training rows, counts are 0 and each token has p = 1: N = V = 0. A
    row is learned once for each time it is there. An empty table gives no rows. Only the id, the text and what train reads
    are read. Counts cover every training text; what the shards gather grows with the corpus and none of it is broadcast.
    Words have hashes of 64 bits. Longer n-grams have log2(tokens) + 20 bits, 48 at least and 64 at most: one in a million shares
    its count with another.
    """
    ship(docs.sparkSession)
    n = buckets_for(docs, text, BUCKET_MB)
    bits = min(64, max(48, int(np.ceil(np.log2(n * BUCKET_MB * 250_000))) + 20))
    ex = keyed.Exchange(n, {m: keyed.Total for m in range(1, order + 1)}, direct, {m: bits for m in range(2, order + 1)}, (1,))
    d = docs.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("bucket"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def load(t: pa.Table):
        k = Tokens(t["text"].to_pylist(), order, bits)
        return k, t["train"].to_numpy(zero_copy_only=False).astype(bool)[k.doc]

    def counted(k: Tokens, trained: np.ndarray, m: int):
        """Sorted n-grams, training counts, the place of each token's among them."""
        keys, _, back = keyed.distinct(k.keys(m))
        return keys, np.bincount(back, trained, len(keys)).astype(np.int64), back.astype(np.int32)

    def ask(t: pa.Table) -> pa.Table:
        k, trained = load(t)
        b = t["bucket"][0].as_py()
        return pa.concat_tables([ex.ask(b, {m: ((own := counted(k, trained, m))[0], own[1:2])}) for m in range(1, order + 1)])

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_arrays([t["id"], *(pa.array([], x) for x in (pa.int64(),) * 3 + (pa.float64(),) * 2)], names)
        k, trained = load(t)
        gram, count = {}, {}
        for m in range(1, order + 1):
            keys, own, gram[m] = counted(k, trained, m)
            (count[m],), sums = ex.learn(got, m, keys, (own,))
            if m == 1:
                total, kinds = sums.tolist()
        ends = k.at[1:] - 1
        a = Automaton(k, gram, count, total, kinds, int(count[1][gram[1][ends[0]]]), mu)
        at = k.at[:-1]
        cols = [np.add.reduceat((count[1] > 0).astype(np.int64)[gram[1]], at), np.full(len(at), total, np.int64), np.add.reduceat(a.arc[1][gram[1]], at), a.traverse()]
        return pa.Table.from_arrays([t["id"], pa.array(k.n), *map(pa.array, cols)], names)

    heard = ex.answer(d.groupBy("bucket").applyInArrow(ask, keyed.ASK))
    return d.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(finish, f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10(docs: DataFrame) -> DataFrame:
    out = score_texts(docs, ~held_out(10, 0))
    return out.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
