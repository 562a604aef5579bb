"""A small causal self-attention model over subword symbols, in numpy: forward pass, gradients, training, block-wise scoring.

The next symbol's probability is two-level: one of CLUSTERS clusters, then one of its MEMBERS. Both levels start from the corpus'
bigram counts (the model's direct path from the current symbol) and add low-rank terms: attention over the symbols before, by
content and by distance, and the embeddings of the current and the previous symbol.

A text is scored in windows of WINDOW symbols that overlap by WINDOW - STEP: the last STEP of a window are scored, each symbol
once, the others are context. Attention is masked to the symbols at or before the query, of the same text.
"""

from __future__ import annotations

import numpy as np

CLUSTERS, MEMBERS, WIDTH = 32, 32, 16
SYMBOLS = CLUSTERS * MEMBERS
_SHIFT = MEMBERS.bit_length() - 1  # MEMBERS is a power of two
STEP, WINDOW = 16, 32
_GAP = (np.arange(STEP)[None, :] + WINDOW - STEP) - np.arange(WINDOW)[:, None]  # keys x queries: how far the key lies behind
_NEAR = _GAP.clip(0).ravel()
#: Row sums of narrow arrays are matrix products: several times as fast as a reduction along the last axis.
_ONES_W, _ONES_C, _ONES_M = (np.ones(n, np.float32) for n in (WINDOW, CLUSTERS, MEMBERS))
_ROWS = 1024  # places that a product sums over at a time: several times as fast as over all
_BLOCKS = 512  # windows at a time


def cluster(pairs: np.ndarray) -> np.ndarray:
    """A permutation of the symbols: MEMBERS at a time with alike successors, by repeated halving along the main axis."""
    x = np.log1p(pairs / (pairs.sum(1, keepdims=True) + 1) * 1000) + np.log1p(pairs.T / (pairs.sum(0)[:, None] + 1) * 1000)
    order = np.arange(SYMBOLS)
    for level in range(int(np.log2(CLUSTERS))):
        size = SYMBOLS >> level
        for at in range(0, SYMBOLS, size):
            part = order[at : at + size]
            y = x[part] - x[part].mean(0)
            axis = np.ones(len(part)) + np.arange(len(part)) / len(part)
            for _ in range(12):
                axis = y @ (y.T @ axis)
                axis /= np.linalg.norm(axis) + 1e-12
            order[at : at + size] = part[np.argsort(axis, kind="stable")]
    return order


def _exp(x: np.ndarray) -> None:
    """In place, of values cut to -60 .. 60."""
    if x.size and (x.max() > 60 or x.min() < -60):
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)


#: Where the pairs of numbers of each symbol's row lie, and of one row more, for no symbol.
_PAIRS = np.arange((SYMBOLS + 1) * WIDTH // 2).reshape(SYMBOLS + 1, WIDTH // 2)


class _Scatter:
    """Sums rows at their symbols, two numbers at a time, as the parts of a complex one; places are found once for all that share them."""

    def __init__(self, at: np.ndarray):
        self.to = _PAIRS.take(at.ravel(), 0).ravel()

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((SYMBOLS + 1, WIDTH), rows.dtype)
        two = np.result_type(rows, np.complex64)
        np.add.at(out.reshape(-1).view(two), self.to, rows.reshape(-1).view(two))
        return out[:SYMBOLS]


class Adam:
    """The optimizer's state beside a model's weights; all steps are taken in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.step = weights, 0
        self.m, self.v, self.spare = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(3))

    def update(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        up, down = rate / (1 - 0.9**self.step), float(1 / np.sqrt(1 - 0.99**self.step))
        for k, g in gradients.items():
            m, v, t = self.m[k], self.v[k], self.spare[k]
            np.subtract(g, m, out=t)
            t *= 0.1
            m += t
            np.multiply(g, g, out=t)
            t -= v
            t *= 0.01
            v += t
            np.sqrt(v, out=t)
            t *= down
            t += 1e-7
            np.divide(m, t, out=t)
            t *= up
            self.w[k] -= t


class Attention:
    LEARNED = (("Q", (SYMBOLS, WIDTH)), ("K", (SYMBOLS, WIDTH)), ("V", (SYMBOLS, WIDTH)), ("R", (SYMBOLS, WIDTH)), ("P", (SYMBOLS, WIDTH)), ("C", (WIDTH, CLUSTERS)), ("M", (CLUSTERS, WIDTH, MEMBERS)), ("far", (WINDOW,)))

    def __init__(self, pairs: np.ndarray, seed: int = 11):
        """pairs: counts of (symbol, next symbol); the last symbol is the end, which also stands before a text."""
        self.order = cluster(pairs)
        self.place = np.empty(SYMBOLS, np.int64)  # symbol -> CLUSTERS x MEMBERS
        self.place[self.order] = np.arange(SYMBOLS)
        p = pairs[np.ix_(self.order, self.order)].astype(np.float64)
        whole = p.sum(0) + 0.5
        whole = whole / whole.sum()
        by = p.reshape(SYMBOLS, CLUSTERS, MEMBERS)
        top = whole.reshape(CLUSTERS, MEMBERS)
        self.to_cluster = np.log((by.sum(2) + 5 * top.sum(1)) / (p.sum(1, keepdims=True) + 5)).astype(np.float32)
        self.to_member = np.log((by + 5 * top / top.sum(1, keepdims=True)) / (by.sum(2, keepdims=True) + 5)).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.w = {k: (rng.normal(0, 0.05 if k in "CM" else 0.3, s) if k != "far" else np.zeros(s)).astype(np.float32) for k, s in self.LEARNED}

    def flat(self) -> np.ndarray:
        """All learned weights in one vector."""
        return np.concatenate([self.w[k].ravel() for k, _ in self.LEARNED])

    def copy(self, flat: np.ndarray | None = None) -> "Attention":
        """The same model with weights of its own, or with those of a flat vector."""
        new = Attention.__new__(Attention)
        new.__dict__ |= self.__dict__
        flat = self.flat() if flat is None else flat
        ends = np.cumsum([int(np.prod(s)) for _, s in self.LEARNED])
        new.w = {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(self.LEARNED, np.split(flat, ends[:-1]))}
        return new

    @property
    def end(self) -> int:
        return int(self.place[SYMBOLS - 1])

    def _reach(self) -> np.ndarray:
        """WINDOW x STEP: the factor of each key for each query by their distance, 0 after the query."""
        far = self.w["far"].copy()
        _exp(far)
        return far.take(_GAP, mode="clip") * (_GAP >= 0)

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """x: B x WINDOW places, valid: which belong to the text, y: B x STEP next places, scored: which of them count.

        The mean loss of the scored places, and its gradient in each learned array. Arrays of attention are B x keys x queries: so no
        product needs a large transposed operand. Places are handled in the order of their cluster.
        """
        w, back, size = self.w, WINDOW - STEP, len(x)
        q_at, before = x[:, back:], x[:, back - 1 : -1]
        quarter, padded = w["Q"] * w["Q"].dtype.type(0.25), np.append(w["P"], np.zeros((1, WIDTH), w["P"].dtype), 0)  # its last row: no symbol before
        q, k, v = quarter.take(q_at, 0), w["K"].take(x, 0), w["V"].take(x, 0)
        a = k @ np.ascontiguousarray(q.transpose(0, 2, 1))
        _exp(a)
        a.reshape(size, -1)[...] *= self._reach().astype(a.dtype).ravel()
        cut = np.flatnonzero(~valid.all(1))
        a[cut] *= valid[cut][:, :, None]
        whole = (a.transpose(0, 2, 1) @ _ONES_W.astype(a.dtype) + a.dtype.type(1e-30)).reshape(-1, 1)
        met = (a.transpose(0, 2, 1) @ v).reshape(-1, WIDTH)
        met /= whole
        led = np.where(valid[:, back - 1 : -1], before, SYMBOLS)
        h = w["R"].take(q_at, 0).reshape(-1, WIDTH)
        h += met
        h += padded.take(led.ravel(), 0)
        n = max(1, int(np.count_nonzero(scored)))
        following = y.ravel()
        by = np.argsort((following >> _SHIFT).astype(np.uint8), kind="stable")
        following, now = following.take(by), q_at.ravel().take(by)
        c = following >> _SHIFT
        at_member, at_cluster = (np.arange(len(by)) * m + i for m, i in ((MEMBERS, following & (MEMBERS - 1)), (CLUSTERS, c)))
        edges = np.searchsorted(c, np.arange(CLUSTERS + 1)).tolist()
        groups = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        h, dead = h.take(by, 0), np.flatnonzero(~scored.ravel().take(by))
        weight, loss = np.full(len(by), 1 / n, h.dtype), np.zeros(len(by), h.dtype)
        weight[dead] = 0
        pc = h @ w["C"]
        pc += self.to_cluster.take(now, 0)
        pm = np.empty((len(by), MEMBERS), h.dtype)
        for g, i in groups:
            np.matmul(h[i], w["M"][g], out=pm[i])
        pm += self.to_member.reshape(-1, MEMBERS).take(now * CLUSTERS + c, 0)
        for p, at, ones in ((pc, at_cluster, _ONES_C), (pm, at_member, _ONES_M)):
            _exp(p)
            p *= (weight / (p @ ones.astype(p.dtype)))[:, None]
            flat = p.reshape(-1)
            hit = flat.take(at)
            loss += np.log(hit * n + 1e-12)
            flat[at] = hit - weight
        loss[dead] = 0
        g = {"M": np.zeros_like(w["M"]), "C": sum(h[i : i + _ROWS].T @ pc[i : i + _ROWS] for i in range(0, len(h), _ROWS))}
        inner, turned = np.empty_like(h), np.ascontiguousarray(w["M"].transpose(0, 2, 1))
        for k_, i in groups:
            np.matmul(h[i].T, pm[i], out=g["M"][k_])
            np.matmul(pm[i], turned[k_], out=inner[i])
        inner += pc @ np.ascontiguousarray(w["C"].T)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        dh = inner.take(place, 0)
        at_query, at_key, at_before = _Scatter(q_at), _Scatter(x), _Scatter(led)
        g["R"], g["P"] = at_query(dh), at_before(dh)
        dh /= whole
        own = np.multiply(met, dh, out=met) @ np.ones(WIDTH, dh.dtype)
        dh = dh.reshape(size, STEP, WIDTH)
        g["V"] = at_key(a @ dh)
        ds = v @ np.ascontiguousarray(dh.transpose(0, 2, 1))
        ds -= own.reshape(size, 1, STEP)
        ds *= a
        g["Q"], g["K"] = at_query(ds.transpose(0, 2, 1) @ k), at_key(ds @ q)
        g["Q"] *= g["Q"].dtype.type(0.25)
        g["far"] = np.bincount(_NEAR, np.ones(size, ds.dtype) @ ds.reshape(size, -1), WINDOW).astype(w["far"].dtype)
        return -float(loss.sum()) / n, g

    def log_probabilities(self, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """places: texts one after another, each led by the end symbol; begins: where. Natural logs, 0 at the leading symbols."""
        n, back = len(places), WINDOW - STEP
        out = np.zeros(n, np.float64)
        ends = np.append(begins[1:], n)
        blocks = np.maximum(0, -(-(ends - begins - 1) // STEP))
        text = np.repeat(np.arange(len(begins)), blocks)
        start = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STEP
        w, reach = self.w, self._reach().astype(np.float32).ravel()
        padded = np.append(w["P"], np.zeros((1, WIDTH), np.float32), 0)  # its last row: no symbol before
        members = np.ascontiguousarray(w["M"])
        quarter, flat = w["Q"] * np.float32(0.25), self.to_member.reshape(-1, MEMBERS)  # take() gathers rows faster than indexing
        for at in range(0, len(start), _BLOCKS):
            s, t = start[at : at + _BLOCKS], text[at : at + _BLOCKS]
            size = len(s)
            keys = s[:, None] + np.arange(-back, STEP)
            first = np.flatnonzero(s - 1 < begins[t])
            x = places.take(keys, mode="clip")
            q_at = x[:, back:]
            score = w["K"].take(x, 0) @ np.ascontiguousarray(quarter.take(q_at, 0).transpose(0, 2, 1))
            _exp(score)
            score.reshape(size, -1)[...] *= reach
            score[first] *= (keys[first] >= begins[t[first]][:, None])[:, :, None]
            score = score.transpose(0, 2, 1)
            h = (score @ w["V"].take(x, 0)).reshape(-1, WIDTH)
            h /= (score @ _ONES_W).reshape(-1, 1)
            h += w["R"].take(q_at, 0).reshape(-1, WIDTH)
            before = x[:, back - 1 : -1].copy()
            before[first, 0] = SYMBOLS
            h += padded.take(before.ravel(), 0)
            here = keys[:, back:].ravel()
            live = np.flatnonzero(keys[:, back:] < (ends[t] - 1)[:, None])
            following = places.take(here.take(live) + 1)
            by = np.argsort((following >> _SHIFT).astype(np.uint8), kind="stable")
            live, following = live.take(by), following.take(by)
            c, m = following >> _SHIFT, following & (MEMBERS - 1)
            edges = np.searchsorted(c, np.arange(CLUSTERS + 1)).tolist()
            h, now = h.take(live, 0), q_at.ravel().take(live)
            row = np.arange(len(live))
            logit = h @ w["C"]
            logit += self.to_cluster.take(now, 0)
            inner = np.empty((len(live), MEMBERS), np.float32)
            for g in range(CLUSTERS):
                np.matmul(h[edges[g] : edges[g + 1]], members[g], out=inner[edges[g] : edges[g + 1]])
            inner += flat.take(now * CLUSTERS + c, 0)
            total = logit.reshape(-1).take(row * CLUSTERS + c).astype(np.float64)
            total += inner.reshape(-1).take(row * MEMBERS + m)
            total -= np.log(np.exp(logit, out=logit) @ _ONES_C)
            total -= np.log(np.exp(inner, out=inner) @ _ONES_M)
            out[here.take(live) + 1] = total
        return out
