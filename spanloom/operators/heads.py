"""Negatives that follow from the statements of one head, found where these lie together: one shuffle by sentence, one by head."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import by_head

#: Statements looked at at once, or those of one head, if these are more.
PORTION = 1_000_000


def _digests(texts) -> list[bytes]:
    return [hashlib.md5(x).digest() for x in texts]


class Heads:
    """The statements of some heads, whole heads each: statement i has the row row[i] of its mention, the tail t[i] and the start ts[i]; h, s and hs are by row.
    Statements are in order of (h, t); tie k, one head and tail, has those from first[k] to first[k + 1], and its head has the ties base[k] to base[k] + size[k] - 1,
    which stand in the pseudo-random ring of the head in this order: place[k] is that of tie k, turned[base[k] + i] the tie of place i."""

    def __init__(self, table, seed: int):
        import numpy as np

        self.h, self.s, self.hs = (table.column(c).to_numpy() for c in ("h", "sent_id", "hs"))
        near = table.column("near").combine_chunks()
        self.row = np.repeat(np.arange(len(self.h)), near.value_lengths().to_numpy() // 2)
        flat = near.flatten().to_numpy().reshape(-1, 2)
        self.t, self.ts = flat[:, 0], flat[:, 1]
        o = np.lexsort((self.t, self.h[self.row]))
        self.row, self.t, self.ts = self.row[o], self.t[o], self.ts[o]
        h = self.h[self.row]
        new = np.r_[True, (h[1:] != h[:-1]) | (self.t[1:] != self.t[:-1])]
        self.tie = np.cumsum(new) - 1
        self.first = np.r_[np.flatnonzero(new), len(h)]
        self.tail, self.head = self.t[self.first[:-1]], h[self.first[:-1]]
        key = np.frombuffer(b"".join(_digests(b"%d|%d|%d" % (seed, *x) for x in zip(self.head.tolist(), self.tail.tolist(), strict=True))), ">u8").reshape(-1, 2)
        self.turned = np.lexsort((self.tail, key[:, 1], key[:, 0], self.head))
        start = np.flatnonzero(np.r_[True, self.head[1:] != self.head[:-1]])
        n = np.diff(np.r_[start, len(self.head)])
        self.base, self.size = np.repeat(start, n), np.repeat(n, n)
        self.place = np.empty(len(self.head), np.int64)
        self.place[self.turned] = np.arange(len(self.head))
        self.place -= self.base
        names = table.column("names").combine_chunks()
        rows = np.r_[np.repeat(np.arange(len(self.h)), names.value_lengths().to_numpy()), self.row]
        entities = np.r_[names.flatten().to_numpy(), self.t]
        self.known = np.unique(entities)
        self.named = np.unique(rows * len(self.known) + np.searchsorted(self.known, entities))

    def names(self, rows, entities):
        """Which of these rows are of a sentence that names the entity beside it, another than the head."""
        import numpy as np

        code = np.minimum(np.searchsorted(self.known, entities), len(self.known) - 1)
        key = rows * len(self.known) + code
        at = np.minimum(np.searchsorted(self.named, key), len(self.named) - 1)
        return (self.known[code] == entities) & (self.named[at] == key)

    def statements(self, ties):
        """(which of the ties, statement): all statements of these ties."""
        import numpy as np

        n = self.first[ties + 1] - self.first[ties]
        r = np.repeat(np.arange(len(ties)), n)
        return r, np.arange(len(r)) + np.repeat(self.first[ties] - (np.cumsum(n) - n), n)

    def least(self, r, i, seed: int):
        """Of the statements i, in groups of ascending number r, the one of each group that is least by the md5 of its id, as (groups, statements)."""
        import numpy as np

        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
        best, n = i[start].copy(), np.diff(np.r_[start, len(r)])
        several = np.flatnonzero(n > 1)
        if len(several):
            j = np.flatnonzero(np.repeat(n > 1, n))
            k = i[j]
            m = self.row[k]
            ids = (hashlib.md5(b"%d|%d|%d|%d|%d" % x).hexdigest().encode() for x in zip(self.h[m].tolist(), self.t[k].tolist(), self.s[m].tolist(), self.hs[m].tolist(), self.ts[k].tolist(), strict=True))
            key = np.frombuffer(b"".join(_digests(b"%d|%b" % (seed, x) for x in ids)), ">u8").reshape(-1, 2)
            o = np.lexsort((key[:, 1], key[:, 0], r[j]))
            best[several] = k[o][np.flatnonzero(np.r_[True, r[j][1:] != r[j][:-1]])]
        return r[start], best


def each_portion(mentions: DataFrame, schema: str, visit: Callable, seed: int) -> DataFrame:
    """Rows that visit(Heads) gives as columns, over all heads, some at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    rows = by_head(mentions, names=True).sortWithinPartitions("h")

    def run(batches):
        import pyarrow as pa

        def of(held):
            if held:
                columns = visit(Heads(pa.Table.from_batches(held), seed))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        held, n = [], 0
        for rb in batches:
            if not rb.num_rows:
                continue
            held.append(rb)
            n += len(rb.column("near").flatten()) // 2
            if n >= PORTION:
                # the last head may go on in the next batch
                whole = pa.Table.from_batches(held).combine_chunks()
                h = whole.column("h").to_numpy()
                cut = int(h.searchsorted(h[-1]))
                if cut:
                    yield from of(whole.slice(0, cut).to_batches())
                    held = whole.slice(cut).to_batches()
                    n = sum(len(x.column("near").flatten()) // 2 for x in held)
        yield from of(held)

    return rows.mapInArrow(run, schema)


def strong_negatives(mentions: DataFrame, seed: int = 1) -> DataFrame:
    """(a_id, b_id, new_t) as pairs.strong_negatives, for every statement of the graph of these mentions: keep the head, replace the tail by the next in the ring of
    the head's neighbours that has a statement whose sentence does not name the replaced tail."""

    def visit(x):
        import numpy as np

        chosen = np.full(len(x.tail), -1)
        left, step = np.flatnonzero(x.size > 1), 1
        while len(left):
            new = x.turned[x.base[left] + (x.place[left] + step) % x.size[left]]
            r, i = x.statements(new)
            k = ~x.names(x.row[i], x.tail[left][r])
            g, best = x.least(r[k], i[k], seed)
            chosen[left[g]] = best
            step += 1
            left = left[(chosen[left] < 0) & (step < x.size[left])]
        a = np.flatnonzero(chosen[x.tie] >= 0)
        b = chosen[x.tie[a]]
        ra, rb = x.row[a], x.row[b]
        return x.h[ra], x.t[a], x.s[ra], x.hs[ra], x.ts[a], x.t[b], x.s[rb], x.hs[rb], x.ts[b]

    rows = each_portion(mentions, ", ".join(f"{c} bigint" for c in ("h", "t", "s", "hs", "ts", "new_t", "s2", "hs2", "ts2")), visit, seed)
    a, b = (F.md5(F.concat_ws("|", *c)) for c in (("h", "t", "s", "hs", "ts"), ("h", "new_t", "s2", "hs2", "ts2")))
    return rows.select(a.alias("a_id"), b.alias("b_id"), "new_t")
