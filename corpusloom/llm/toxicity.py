"""Toxicity with a bidirectional gated recurrent network and attention pooling, in numpy.

A word enters by a learned vector of its own, if enough training texts hold it, and by its
characters: the mean of learned vectors of its n-grams, and the sum of those of its first
and last characters. No input is counted from labels; all vectors start at random and are
trained through the network. A text is cut into overlapping windows of ``WINDOW`` words;
each window is read in both directions, attention pools its states, and a logistic output
scores it. A text's score is its highest window's. Arrays are laid out feature by window,
so that a step works on contiguous rows.
"""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_slices, release_memory
from .wordforms import Adam, Forms, number_words

WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIMS, CHAR_DIMS, ATTENTION = 8, 8, 8, 8
#: Rows of the tables of n-gram vectors and of vectors of first and last characters.
BUCKETS, EDGES = 1 << 12, 1 << 15
#: Training texts that must hold a word for it to have a vector of its own.
LEAST_TEXTS = 3
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def windows(sizes: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows: every text is covered, neighbours overlap, the last ends with the text."""
    n = np.where(sizes > window, 1 + -(-(sizes - window) // stride), 1)
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(k * stride, np.maximum(sizes - window, 0)[owner])
    return owner, first, np.minimum(sizes, window)[owner]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """The network's parameters, its forward pass and its gradients."""

    def __init__(self, words: list[str], seed: int = 3):
        """words: those with a vector of their own."""
        rng = np.random.default_rng(seed)
        self.place = {w: k for k, w in enumerate(words)}
        #: Score of a text without words.
        self.blank = 0.5

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        d, h = WORD_DIMS + CHAR_DIMS, HIDDEN
        self.p = {
            "word": normal(max(1, len(words)), WORD_DIMS, scale=0.1),
            "char": normal(BUCKETS, CHAR_DIMS, scale=0.1),
            "edge": normal(EDGES, CHAR_DIMS, scale=0.1),
            "att": normal(ATTENTION, 2 * h, scale=0.3),
            "att_out": normal(ATTENTION, scale=0.3),
            "out": normal(2 * h, scale=0.3),
            "bias": np.zeros(1, dtype=np.float32),
        }
        for side in "fb":
            self.p["in_" + side] = normal(3 * h, d, scale=0.3)
            self.p["in_bias_" + side] = np.zeros((3 * h, 1), dtype=np.float32)
            self.p["move_" + side] = normal(3 * h, h, scale=0.3)

    def own(self, words: list[str]) -> np.ndarray:
        """Places of the words' own vectors, -1 where there is none."""
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of distinct words, worked out for so many at a time that memory stays small."""
        out = np.empty((len(words), WORD_DIMS + CHAR_DIMS), dtype=np.float32)
        for at in range(0, len(words), 16_384):
            some = words[at : at + 16_384]
            own = self.own(some)
            out[at : at + len(some), :WORD_DIMS] = np.where(own[:, None] >= 0, self.p["word"][own], 0)
            out[at : at + len(some), WORD_DIMS:] = self.char_inputs(Forms(some, BUCKETS))
        return out

    def char_inputs(self, forms: Forms) -> np.ndarray:
        return forms.gram_mean(self.p["char"]) + forms.edge_sum(self.p["edge"])

    def input_gradients(self, own: np.ndarray, forms: Forms, d_x: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the vector tables from that of the inputs of distinct words."""
        word = np.zeros_like(self.p["word"])
        word[own[own >= 0]] = d_x[own >= 0, :WORD_DIMS]
        d_char = d_x[:, WORD_DIMS:]
        return {"word": word, "char": forms.gram_gradient(d_char, BUCKETS), "edge": forms.edge_gradient(d_char, EDGES)}

    def _read(self, ids: np.ndarray, live: np.ndarray | None, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (steps, hidden, windows) of one direction; ids (steps, windows)."""
        h, steps, n = HIDDEN, *ids.shape
        table = np.ascontiguousarray((x @ self.p["in_" + side].T).T + self.p["in_bias_" + side])
        move = self.p["move_" + side]
        out = np.empty((steps, h, n), dtype=np.float32)
        state = np.zeros((h, n), dtype=np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            given = np.take(table, ids[t], axis=1, mode="clip")
            mixed = move @ state
            gates = given[: 2 * h] + mixed[: 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            fresh = np.tanh(given[2 * h :] + gates[h:] * mixed[2 * h :])
            new = fresh + gates[:h] * (state - fresh)
            if live is not None:
                new *= live[t]
            if keep is not None:
                keep.append((t, state, gates, fresh, mixed[2 * h :]))
            state = out[t] = new
        return out

    def forward(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ids (steps, windows) are places in x."""
        steps, n = ids.shape
        live = None if sizes.min() == steps else (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._read(ids, live, x, s, kept[s] if keep is not None else None) for s in "fb"], axis=1)
        hidden = np.tanh(np.matmul(self.p["att"], states))
        weight = np.exp(np.einsum("a,tan->tn", self.p["att_out"], hidden))
        if live is not None:
            weight *= live
        weight /= np.maximum(weight.sum(axis=0), 1e-12)
        pooled = np.einsum("tn,tkn->kn", weight, states)
        if keep is not None:
            keep.update(kept=kept, live=live, states=states, hidden=hidden, weight=weight, pooled=pooled)
        return self.p["out"] @ pooled + self.p["bias"]

    def gradients(self, ids: np.ndarray, x: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the vector tables, and that of x."""
        h, p = HIDDEN, self.p
        states, weight, hidden = keep["states"], keep["weight"], keep["hidden"]
        g = {"out": keep["pooled"] @ d_logit, "bias": np.array([d_logit.sum()], dtype=np.float32)}
        d_pool = p["out"][:, None] * d_logit
        d_states = weight[:, None, :] * d_pool
        d_w = np.einsum("kn,tkn->tn", d_pool, states)
        d_score = weight * (d_w - (weight * d_w).sum(axis=0))
        g["att_out"] = np.einsum("tn,tan->a", d_score, hidden)
        d_hidden = d_score[:, None, :] * p["att_out"][:, None] * (1 - hidden * hidden)
        g["att"] = np.einsum("tan,tkn->ak", d_hidden, states, optimize=True)
        d_states += np.matmul(p["att"].T, d_hidden)
        d_x = np.zeros_like(x)
        for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            move, d_move = p["move_" + side], np.zeros_like(p["move_" + side])
            d_table = np.zeros((3 * h, len(x)), dtype=np.float32)
            d_next = np.zeros((h, ids.shape[1]), dtype=np.float32)
            all_ids, all_given = [], []
            for t, state, gates, fresh, mixed in reversed(keep["kept"][side]):
                d_new = d_next + d_states[t, part]
                if keep["live"] is not None:
                    d_new = d_new * keep["live"][t]
                z, r = gates[:h], gates[h:]
                d_fresh = d_new * (1 - z) * (1 - fresh * fresh)
                d_z = d_new * (state - fresh) * z * (1 - z)
                d_r = d_fresh * mixed * r * (1 - r)
                given = np.concatenate([d_z, d_r, d_fresh])
                through = np.concatenate([d_z, d_r, d_fresh * r])
                d_move += through @ state.T
                d_next = d_new * z + move.T @ through
                all_ids.append(ids[t])
                all_given.append(given)
            flat, given = np.concatenate(all_ids), np.concatenate(all_given, axis=1)
            for k in range(3 * h):
                d_table[k] = np.bincount(flat, weights=given[k], minlength=len(x))
            g["move_" + side] = d_move
            g["in_" + side] = d_table @ x
            g["in_bias_" + side] = d_table.sum(axis=1, keepdims=True)
            d_x += d_table.T @ p["in_" + side]
        return g, d_x

    def logits(self, flat: np.ndarray, sizes: np.ndarray, vocab: list[str], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window of texts given as word numbers in a row."""
        owner, first, n = windows(sizes)
        return owner, self.window_logits(flat, first + (np.cumsum(sizes) - sizes)[owner], n, vocab, block)

    def window_logits(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray, vocab: list[str], block: int = 2048) -> np.ndarray:
        x = self.inputs(vocab or ["_"])
        flat = np.append(flat, 0)
        order = np.argsort(n, kind="stable")
        out = np.empty(len(n), dtype=np.float32)
        at = len(order)
        while at > 0:
            steps = max(1, int(n[order[at - 1]]))
            group = order[max(0, at - block) : at]
            at -= len(group)
            place = np.minimum(first[group][None, :] + np.arange(steps)[:, None], len(flat) - 1)
            out[group] = self.forward(flat[place], n[group], x)
        return out

    def held_logits(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray, vocab: list[str], wanted: np.ndarray) -> np.ndarray:
        """Logits of the wanted windows, minus infinity for the others."""
        out = np.full(len(n), -np.inf)
        out[wanted] = self.window_logits(flat, first[wanted], n[wanted], vocab)
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """The score of each text, that of its highest window."""
        flat, sizes, vocab = number_words(texts)
        owner, logit = self.logits(flat, sizes, vocab)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return np.where(sizes > 0, _sigmoid(best), self.blank)


def _best(texts: int, owner: np.ndarray, logit: np.ndarray) -> np.ndarray:
    best = np.full(texts, -np.inf)
    np.maximum.at(best, owner, logit)
    return best


def fit(
    pieces: list[list[str]], owner: np.ndarray, labels: np.ndarray, prior: float, epochs: int = 8, least_steps: int = 240, first_windows: int = 4,
    batch: int = 256, rate: float = 0.01, decay: float = 3e-4, dropped: float = 0.3, held: float = 0.15, seed: int = 3,
) -> BiGru:
    """Train on windows of labelled texts: pieces are windows' words, owner their texts (0, 1, ...), labels of the texts.

    A share ``held`` of the texts is set aside; after each round these are scored, and the
    parameters of the round with the least loss on them count. Not all of a toxic text is
    toxic: the first two rounds read ``first_windows`` windows of each label-1 text, later
    ones those that score near their text's best. A share ``dropped`` of the words is read
    by characters alone, another by their own vectors alone. At the end the bias is moved to where the texts set aside,
    weighted to the share ``prior`` of label 1, have the fewest errors. A text without words
    scores the share of label 1 among such texts, drawn towards ``prior``.
    """
    rng = np.random.default_rng(seed)
    texts = len(labels)
    flat, n, vocab = number_words(pieces)
    first = np.cumsum(n) - n
    aside = np.zeros(texts, dtype=bool)
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero(labels == y))
        aside[mine[: int(held * len(mine))]] = True
    once = np.unique(np.repeat(owner, n).astype(np.int64)[~np.repeat(aside[owner], n)] * max(1, len(vocab)) + flat[~np.repeat(aside[owner], n)])
    known = np.bincount(once % max(1, len(vocab)), minlength=len(vocab))
    net = BiGru([vocab[i] for i in np.flatnonzero(known >= LEAST_TEXTS).tolist()], seed)
    vocab = vocab or ["_"]
    own = net.own(vocab)
    net.p["bias"][0] = np.log(labels.mean() / (1 - labels.mean()))
    adam = Adam(net.p, rate)
    padded = np.append(flat, 0)
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    shuffled = rng.permutation(len(owner))
    place = np.zeros(len(owner), dtype=np.int64)
    by_text = shuffled[np.argsort(owner[shuffled], kind="stable")]
    counts = np.bincount(owner, minlength=texts)
    place[by_text] = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    active = (labels[owner] == 0) | (place < first_windows)
    epochs = max(epochs, -(-least_steps * batch // max(1, int((active & ~aside[owner]).sum()))))
    least, kept = np.inf, {k: v.copy() for k, v in net.p.items()}
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            toxic = np.flatnonzero((labels[owner] == 1) & ~aside[owner])
            logit = np.full(len(owner), -np.inf)
            logit[toxic] = net.window_logits(flat, first[toxic], n[toxic], vocab)
            active = (labels[owner] == 0) | (logit >= _best(texts, owner, logit)[owner] - 1)
        rows = rng.permutation(np.flatnonzero(active & ~aside[owner]))
        for at in range(0, len(rows), batch):
            group = rows[at : at + batch]
            steps = max(1, int(n[group].max()))
            ids = padded[np.minimum(first[group][None, :] + np.arange(steps)[:, None], len(padded) - 1)]
            used, ids = np.unique(ids, return_inverse=True)
            forms = Forms([vocab[i] for i in used.tolist()], BUCKETS)
            draw = rng.random(len(used))
            mine = np.where(draw < dropped, -1, own[used])
            spelt = ((draw < 1 - dropped) | (mine < 0))[:, None]
            x = np.concatenate([np.where(mine[:, None] >= 0, net.p["word"][mine], 0), net.char_inputs(forms) * spelt], axis=1)
            keep: dict = {}
            ids = ids.reshape(steps, -1)
            d = ((_sigmoid(net.forward(ids, n[group], x, keep)) - labels[owner[group]]) / len(group)).astype(np.float32)
            grads, d_x = net.gradients(ids, x, keep, d)
            d_x[:, WORD_DIMS:] *= spelt
            grads |= net.input_gradients(mine, forms, d_x)
            adam.rate = rate * (1 - epoch / epochs)
            adam.step({name: g + decay * net.p[name] * ((g != 0) if name == "word" else 1) if name != "bias" else g for name, g in grads.items()})
        if not aside.any():
            kept = {k: v.copy() for k, v in net.p.items()}
            continue
        best = _best(texts, owner, net.held_logits(flat, first, n, vocab, aside[owner]))[aside]
        loss = float(np.average(np.logaddexp(0, best) - labels[aside] * best, weights=weight[aside]))
        if loss <= least:
            least, kept = loss, {k: v.copy() for k, v in net.p.items()}
    net.p = kept
    judged = aside if len(set(labels[aside].tolist())) == 2 else np.ones(texts, dtype=bool)
    best = _best(texts, owner, net.held_logits(flat, first, n, vocab, judged[owner]))[judged]
    order = np.argsort(best)
    ranked, w, right = best[order], weight[judged][order], labels[judged][order] == 1
    errors = np.concatenate([[0], np.cumsum(w * right)]) + np.concatenate([np.cumsum((w * ~right)[::-1])[::-1], [0]])
    low = np.flatnonzero(errors <= errors.min() + 1e-9)
    cut = int(low[len(low) // 2])
    bare = np.bincount(owner, weights=n, minlength=texts) == 0
    net.blank = float((labels[bare].sum() + prior) / (bare.sum() + 1))
    net.p["bias"] -= np.float32(0.5 * (ranked[max(0, cut - 1)] + ranked[min(len(ranked) - 1, cut)]))
    return net


def _fit_windows(text: str | None, at_most: int) -> list[list[str]]:
    """The words of a text's windows; of more than ``at_most``, that many drawn by a seed of the text."""
    words = words_of(text)
    _, first, n = windows(np.array([len(words)]))
    chosen = range(len(first))
    if len(first) > at_most:
        chosen = np.sort(np.random.default_rng(zlib.crc32((text or "").encode())).choice(len(first), at_most, replace=False)).tolist()
    return [words[first[k] : first[k] + n[k]] for k in chosen]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, text_windows: int, seed: int) -> BiGru | float:
    """Fit on at most ``per_label`` texts of each label and ``text_windows`` windows of each; a constant without two labels.

    Rows are chosen by a hash of id and text, and cut into windows where they are, so the
    sample has a bound in rows and words. Of rows that share id and text one
    is read; an id with both labels counts as both.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    marked = texts.select("id", "h").join(known, "id").distinct()
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0))
    chosen: list = []
    for y in (0, 1):
        chosen += marked.where(F.col("y") == y).orderBy("h", "id").limit(per_label).collect()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], marked.schema)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, 1):
                found = [["\n".join(" ".join(w) for w in _fit_windows(t, text_windows))] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f[0] for f in found], pa.string())], names=["y", "h", "pieces"])

    prior = shares[1] / (shares[0] + shares[1])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 0, 2)), strict=True))
        # equal words share one string, which keeps the sample small
        pieces = [[[sys.intern(w) for w in p.split()] for p in r[2].split("\n")] for r in got]
        owner = np.repeat(np.arange(len(got)), [len(p) for p in pieces])
        net = fit([w for p in pieces for w in p], owner, np.array([r[1] for r in got], dtype=np.int64), prior)
        state = pickle.dumps((list(net.place), net.blank, net.p))
        del got, pieces, owner, net
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["net"])

    rows = texts.join(F.broadcast(ids), ["id", "h"]).select("y", "text", "h", "id").dropDuplicates(["y", "h", "id"]).select("y", "text", "h")
    # the bounded sample is learned from in one task, so that the driver holds the model only
    words, blank, params = pickle.loads(rows.mapInArrow(cut, "y int, h long, pieces string").repartition(1).mapInArrow(learn, "net binary").first()["net"])
    net = BiGru(words)
    net.blank, net.p = blank, params
    return net


def _judge(net: BiGru | float, texts: list[str | None]) -> np.ndarray:
    return net.scores([words_of(t) for t in texts]).astype(np.float64) if isinstance(net, BiGru) else np.full(len(texts), float(net))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_fold: int = 0,
    per_label: int = 2000,
    text_windows: int = 24,
    seed: int = 13,
) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod ``folds`` is not
    ``held_fold``, at most ``per_label`` of each label and ``text_windows`` windows of each
    (the fit's bounds); every whole text is scored, a very long one window by window. Null,
    empty and wordless texts are learned from like any other and score the share of label 1
    among them, drawn towards that of all labels. Without two
    labels to learn from, the score is constant. Rows with a null id are scored, not
    learned from and not held out. Repeated rows are returned each; other columns are not
    read; an empty table gives an empty result. The highest window counts; equal windows
    score alike.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    net = train(docs.where(fold != held_fold), labels.where(fold != held_fold), id_col, text_col, label_col, per_label, text_windows, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, 2):
                s = _judge(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, per_label: int = 2000, text_windows: int = 24, seed: int = 13) -> DataFrame:
    """The documents whose text is not predicted toxic, with all their columns, in one pass; trained as in ``score``.

    Null, empty and wordless texts are judged as in ``score``; repeated rows stay or go
    alike; rows with a null id are judged by their text. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    net = train(docs.where(fold != held_fold), labels.where(fold != held_fold), id_col, text_col, label_col, per_label, text_windows, seed)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, place):
                yield part.filter(pa.array(_judge(net, part.column(place).to_pylist()) < 0.5))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
