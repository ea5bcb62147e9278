"""Substring dedup by relative Lempel-Ziv parsing.

The references are all documents, in an index that holds the first occurrence of every window-word sequence that could repeat: the
document with the least id and the least place in it. The index lies in hash-range blocks (shards); a document is factored
against all of them at once. Its parse goes from left to right: at the first window that the index has from an earlier
document a factor (start, words, reference, place) begins and grows word by word as long as the reference goes on alike,
that is, the window that ends with the next word has its first occurrence one place on in the same reference. A factor is a window
long at least. At its end the windows over the boundary are looked up too, so the next factor begins where the first of them is found, even within
the last one's words. The words of all factors are those in a window with an earlier first occurrence; they go.

Most windows occur once, and indexing them all would cost more than the corpus. Anchors rule them out exactly: of the
k-word grams in a window, the one with the least hash is its anchor (k + span - 1 = window). Equal windows have equal
anchors, so a window whose anchor lies in one document only is in no other and isn't asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import keyed
from ..plans.ship import ship
from .common import buckets_for

OUT = "n_words long, n_removed long, kept_sha256 string, factors string"
LAST = np.iinfo(np.int64).max


class Parse:
    """A bucket's windows and anchors, its documents in the order of their ids; window = gram + span - 1 words."""

    def __init__(self, t: pa.Table, window: int, gram: int, keep: bool = False):
        ids = t["id"].cast(pa.int64()).fill_null(LAST).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.window, span = ids[self.order], window, window - gram + 1
        self.words = w = keyed.Words(t["text"].take(pa.array(self.order)).to_pylist(), keep=keep)
        self.starts = w.starts(window)
        self.doc = w.of()[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        grams = keyed.windows(w.hashes, gram)
        self.anchor = keyed.sliding_min(grams, span)[self.starts]

    def anchors(self):
        """Distinct anchors, sorted; 1, or 2 where two documents of the bucket have them; and the anchor of each window."""
        # Windows next to each other mostly share an anchor: one row for each run.
        first = np.ones(len(self.anchor), bool)
        first[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        keys, at, back = keyed.distinct(self.anchor[first])
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        d = self.ids[self.doc[first]]
        np.minimum.at(low, back, d)
        np.maximum.at(high, back, d)
        return keys, (1 + (low < high).astype(np.int64),), back[np.cumsum(first) - 1] if len(first) else back

    def asked(self, shared: np.ndarray):
        """For windows that may repeat: which they are, distinct sorted hashes, least (id, place) of each, which of those each has."""
        at = np.flatnonzero(shared)
        h = keyed.windows(self.words.hashes, self.window)[self.starts[at]]
        order = np.argsort(h, kind="stable")  # documents and places ascend, so the first of equals is the least
        s = h[order]
        first = keyed.firsts(s)
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(first) - 1
        least = at[order[first]]
        return at, s[first], (self.ids[self.doc[least]], self.places(least)), back

    def places(self, at: np.ndarray) -> np.ndarray:
        return self.starts[at] - self.words.at[self.doc[at]]


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 25, text: str = "text", id_col: str = "doc_id", direct: int = 8192) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, factors) for each row of docs; factors is start:words:reference:place, comma-joined.

    Removes each word in a window of that many words which also starts in a document with a smaller id; judged on the
    input. Null and empty texts have no words. Rows with equal ids are one document, so they do not remove each other's; their places
    coincide. Null ids come last of all. An empty table gives no rows. Only the id (an integer) and the text are read; a bucket holds
    about 4 MB of stored input, a long text more.
    """
    ship(docs.sparkSession)
    n = buckets_for(docs, text)
    d = keyed.bucketed(docs, id_col, text, n)
    ex = keyed.Exchange(n, {1: keyed.Total, 2: keyed.Least}, direct)

    def ask_anchors(t: pa.Table) -> pa.Table:
        keys, vals, _ = Parse(t, window, gram).anchors()
        return ex.ask(t["bucket"][0].as_py(), {1: (keys, vals)})

    def shared(p: Parse, answers: pa.Table) -> np.ndarray:
        keys, vals, back = p.anchors()
        return (ex.learn(answers, 1, keys, vals)[0][0] > 1)[back]

    def ask_windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return keyed.ASK_ARROW.empty_table()
        p = Parse(t, window, gram)
        _, keys, vals, _ = p.asked(shared(p, answers))
        return ex.ask(t["bucket"][0].as_py(), {2: (keys, vals)})

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_removed", "kept_sha256", "factors"]

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_arrays([t["id"], *(pa.array([], x) for x in (pa.int64(), pa.int64(), pa.string(), pa.string()))], names)
        p = Parse(t, window, gram, keep=True)
        at, keys, vals, back = p.asked(shared(p, answers))
        ref, place = (x[back] for x in ex.learn(answers, 2, keys, vals)[0])
        hit = ref < p.ids[p.doc[at]]
        doc, start, ref, place = p.doc[at][hit], p.places(at)[hit], ref[hit], place[hit]
        edges = np.searchsorted(doc, np.arange(len(p.ids) + 1))
        removed, sums, out = [], [], []
        for i, words in enumerate(p.words.lists):
            own = slice(edges[i], edges[i + 1])
            parts = parse(start[own], ref[own], place[own], window)
            kept, last = [], 0
            for s, n_words, *_ in parts:
                kept += words[last:s]
                last = max(last, s + n_words)
            kept = kept + words[last:] if parts else words
            removed.append(len(words) - len(kept))
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            out.append(",".join("%d:%d:%d:%d" % f for f in parts))
        return pa.Table.from_arrays([t["id"].take(pa.array(p.order)), pa.array(p.words.n), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(out, pa.string())], names)

    first = ex.answer(d.groupBy("bucket").applyInArrow(ask_anchors, keyed.ASK))
    second = ex.answer(d.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(ask_windows, keyed.ASK))
    return d.groupBy("bucket").cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(finish, f"{id_col} {kind}, {OUT}")


def parse(start: np.ndarray, ref: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, words, reference, place) from the windows found in a text: where they start, and their first occurrences.

    A factor goes on while the next window is found one place on in the same reference.
    """
    if not len(start):
        return []
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (ref[1:] != ref[:-1]) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(start))) - 1 + window
    return list(zip(start[first].tolist(), words.tolist(), ref[first].tolist(), place[first].tolist()))


def op7(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs)
