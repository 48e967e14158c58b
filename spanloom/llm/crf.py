"""A linear-chain conditional random field in numpy: unary features in a window, batched training and Viterbi decoding."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Scores of a label sequence: for every token the weights of its neighbours' features by offset, plus transitions."""

    def __init__(self, n_labels: int, reach: int):
        self.n_labels, self.reach = n_labels, reach
        self.features: dict[str, int] = {}
        self.weights = np.zeros((0, 2 * reach + 1, n_labels))
        self.transitions = np.zeros((n_labels, n_labels))
        self.start = np.zeros(n_labels)

    def _emissions(self, per_type: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(B, T, labels) from per-type contributions (types, offsets, labels) and padded type ids (B, T), 0 being padding."""
        b, t = ids.shape
        out = np.zeros((b, t, self.n_labels))
        for o in range(-self.reach, self.reach + 1):
            lo, hi = max(0, -o), min(t, t - o)
            if lo < hi:
                out[:, lo:hi] += per_type[ids[:, lo + o : hi + o], o + self.reach]
        return out

    def fit(self, sequences: list[list[list[str]]], labels: list[list[int]], allowed: np.ndarray, epochs: int = 8, rate: float = 0.2, batch: int = 24, seed: int = 1) -> None:
        """Adagrad on the negative log-likelihood, touching only the features of a batch. sequences: features of every token; allowed: transitions that may occur."""
        rng = np.random.default_rng(seed)
        coded = [[np.array([self.features.setdefault(f, len(self.features)) for f in tok]) for tok in s] for s in sequences]
        n_off, n_lab = 2 * self.reach + 1, self.n_labels
        self.weights = np.zeros((len(self.features), n_off, n_lab))
        gw, gt, gs = (np.full_like(x, 1e-2) for x in (self.weights, self.transitions, self.start))
        bar = np.where(allowed, 0.0, -30.0)
        order = sorted(range(len(coded)), key=lambda i: len(coded[i]))
        batches = []
        for k in range(0, len(order), batch):
            idx = order[k : k + batch]
            lens = np.array([len(coded[i]) for i in idx])
            flat = [f for i in idx for f in coded[i]]
            first = np.concatenate([[0], np.cumsum([len(f) for f in flat])[:-1]])
            feat = np.concatenate(flat)
            token = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
            by_feat = np.argsort(feat, kind="stable")
            used, starts = np.unique(feat[by_feat], return_index=True)
            rows, cols = np.repeat(np.arange(len(idx)), lens), np.concatenate([np.arange(n) for n in lens])
            batches.append((lens, first, feat, token[by_feat], used, starts, rows, cols, np.concatenate([labels[i] for i in idx])))
        for _ in range(epochs):
            for g in rng.permutation(len(batches)):
                lens, first, feat, token, used, starts, rows, cols, y = batches[g]
                b, t = len(lens), int(lens.max())
                # what every token's features say about its neighbours, (tokens, offsets, labels)
                said = np.add.reduceat(self.weights[feat], first, axis=0)
                wide = np.zeros((b, t + 2 * self.reach, n_off, n_lab))
                wide[rows, cols + self.reach] = said
                em = sum(wide[:, self.reach + o : self.reach + o + t, o + self.reach] for o in range(-self.reach, self.reach + 1))
                tr = self.transitions + bar
                etr = np.exp(tr)
                alpha, beta = np.zeros((b, t, n_lab)), np.zeros((b, t, n_lab))
                alpha[:, 0] = self.start + em[:, 0]
                for p in range(1, t):
                    m = alpha[:, p - 1]
                    top = m.max(1, keepdims=True)
                    alpha[:, p] = np.log(np.exp(m - top) @ etr + 1e-300) + top + em[:, p]
                mask = np.arange(t) < lens[:, None]
                last = alpha[np.arange(b), lens - 1]
                z = np.log(np.exp(last - last.max(1, keepdims=True)).sum(1)) + last.max(1)
                for p in range(t - 2, -1, -1):
                    m = beta[:, p + 1] + em[:, p + 1]
                    top = m.max(1, keepdims=True)
                    beta[:, p] = np.where(mask[:, p + 1, None], np.log(np.exp(m - top) @ etr.T + 1e-300) + top, 0.0)
                diff = -np.exp(np.minimum(0.0, alpha + beta - z[:, None, None])) * mask[..., None]
                diff[rows, cols, y] += 1.0
                right = em + beta
                on = mask[:, 1:]
                joint = np.exp(np.minimum(0.0, alpha[:, :-1][on][:, :, None] + tr + right[:, 1:][on][:, None, :] - np.repeat(z, on.sum(1))[:, None, None]))
                d_tr = -joint.sum(0)
                same = rows[1:] == rows[:-1]
                np.add.at(d_tr, (y[:-1][same], y[1:][same]), 1.0)
                padded = np.zeros((b, t + 2 * self.reach, n_lab))
                padded[:, self.reach : self.reach + t] = diff
                # a feature at place p speaks for the token at p - offset
                heard = np.stack([padded[rows, cols + self.reach - o] for o in range(-self.reach, self.reach + 1)], axis=1)
                d_w = np.add.reduceat(heard[token], starts, axis=0)
                gw[used] += d_w * d_w
                self.weights[used] += rate * d_w / np.sqrt(gw[used])
                for w, d, acc in ((self.transitions, d_tr, gt), (self.start, diff[:, 0].sum(0), gs)):
                    acc += d * d
                    w += rate * d / np.sqrt(acc)
        self.transitions += bar
        self.start += np.where(allowed[0], 0.0, -30.0)

    def type_scores(self, types: list[list[str]]) -> np.ndarray:
        """(types + 1, offsets, labels) contributions of token types given by their features; row 0 is padding."""
        out = np.zeros((len(types) + 1, 2 * self.reach + 1, self.n_labels), dtype=np.float32)
        for k, feats in enumerate(types):
            known = [self.features[f] for f in feats if f in self.features]
            if known:
                out[k + 1] = self.weights[known].sum(0)
        return out

    def decode(self, per_type: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best label sequences (B, T) by Viterbi, over padded ids (B, T)."""
        em = self._emissions(per_type, ids)
        b, t, n = em.shape
        score = self.start + em[:, 0]
        back = np.zeros((b, t, n), dtype=np.int8)
        final = score.copy()
        for p in range(1, t):
            total = score[:, :, None] + self.transitions
            back[:, p] = total.argmax(1)
            score = total.max(1) + em[:, p]
            final[lens > p] = score[lens > p]
        out = np.zeros((b, t), dtype=np.int8)
        here = final.argmax(1)
        rows = np.arange(b)
        for p in range(t - 1, -1, -1):
            inside = p < lens
            out[rows[inside], p] = here[inside]
            if p:
                here = np.where(inside, back[rows, p, here], here)
        return out
