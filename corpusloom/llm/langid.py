"""Language identification with a linear-chain conditional random field over words.

Word scores come from affixes, character n-grams and a lexicon, transitions between the
languages of neighbouring words are learned, and forward-backward gives every word's
posterior; a text's language is the one with the largest expected share of its words, so
code-switched texts get the share of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_slices
from .wordforms import Adam, Forms, number_words

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if no character is a letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


class Crf:
    """Weights by feature bucket and label, transitions between labels and start scores."""

    def __init__(self, labels: list[str], buckets: int = 1 << 16):
        self.labels, self.buckets = labels, buckets
        n = len(labels)
        self.p = {
            "gram": np.zeros((buckets, n), dtype=np.float32),
            "affix": np.zeros((buckets, n), dtype=np.float32),
            "word": np.zeros((buckets, n), dtype=np.float32),
            "move": np.eye(n, dtype=np.float32),
            "start": np.zeros(n, dtype=np.float32),
        }

    def _word_bucket(self, forms: Forms) -> np.ndarray:
        return (forms.hashes % np.uint64(self.buckets)).astype(np.int64)

    def emissions(self, forms: Forms) -> np.ndarray:
        out = forms.gram_mean(self.p["gram"]) + self.p["word"][self._word_bucket(forms)]
        for code in forms.affixes:
            out += self.p["affix"][code]
        return out

    def posteriors(self, e: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward on padded sequences e (steps, texts, labels): posteriors, expected moves."""
        steps, texts, n = e.shape
        live = (np.arange(steps)[:, None] < sizes[None, :])[:, :, None]
        x = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.p["move"] - self.p["move"].max())
        a = np.empty_like(x)
        b = np.ones_like(x)
        cur = np.exp(self.p["start"] - self.p["start"].max()) * x[0]
        a[0] = cur / cur.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            cur = (a[t - 1] @ move) * x[t]
            a[t] = cur / cur.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            cur = (x[t + 1] * b[t + 1]) @ move.T
            cur /= cur.sum(axis=1, keepdims=True)
            b[t] = np.where(live[t + 1], cur, 1)
        g = a * b
        g /= g.sum(axis=2, keepdims=True)
        g *= live
        moves = np.zeros((n, n))
        if steps > 1:
            left, right = a[:-1], x[1:] * b[1:]
            norm = np.einsum("tdi,ij,tdj->td", left, move, right, optimize=True)
            weight = live[1:, :, 0] / np.maximum(norm, 1e-30)
            moves = np.einsum("tdi,tdj->ij", left * weight[:, :, None], right, optimize=True) * move
        return g, moves

    def fit(self, texts: list[list[str]], labels: list[int], rounds: int = 60, rate: float = 0.15, span: int = 96, seed: int = 11) -> None:
        """Train on sequences of ``span`` words spliced from pieces of texts, so that labels also change inside."""
        rng = np.random.default_rng(seed)
        pieces = []
        for text, label in zip(texts, labels, strict=True):
            at = 0
            while at < len(text):
                n = int(rng.integers(8, span + 1))
                pieces.append((text[at : at + n], label))
                at += n
        order = rng.permutation(len(pieces))
        flat, sizes, vocab = number_words([pieces[i][0] for i in order])
        truth = np.repeat(np.array([pieces[i][1] for i in order]), sizes)
        short = -len(flat) % span
        word = np.concatenate([flat, np.zeros(short, dtype=flat.dtype)]).reshape(-1, span).T
        truth = np.concatenate([truth, np.zeros(short, dtype=truth.dtype)]).reshape(-1, span).T
        lengths = np.full(word.shape[1], span)
        lengths[-1] -= short
        live = np.arange(span)[:, None] < lengths[None, :]
        n, forms, adam = len(self.labels), Forms(vocab, self.buckets), Adam(self.p, rate)
        told = np.eye(n, dtype=np.float32)[truth] * live[:, :, None]
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:-1][live[1:]], truth[1:][live[1:]]), 1)
        for _ in range(rounds):
            g, moves = self.posteriors(self.emissions(forms)[word], lengths)
            miss = g - told
            by_word = np.stack([np.bincount(word.ravel(), weights=miss[:, :, k].ravel(), minlength=forms.n) for k in range(n)], axis=1)
            by_word = (by_word / len(flat)).astype(np.float32)
            affix, lex = np.zeros_like(self.p["affix"]), np.zeros_like(self.p["word"])
            for code in forms.affixes:
                np.add.at(affix, code, by_word)
            np.add.at(lex, self._word_bucket(forms), by_word)
            grads = {
                "gram": forms.gram_gradient(by_word, self.buckets),
                "affix": affix,
                "word": lex,
                "move": ((moves - seen) / len(flat)).astype(np.float32),
                "start": miss[0].mean(axis=0),
            }
            adam.step({k: v + 1e-6 * self.p[k] for k, v in grads.items()})

    def shares(self, texts: list[list[str]], cells: int = 400_000) -> np.ndarray:
        """Expected share of each label among the words of each non-empty text."""
        flat, sizes, vocab = number_words(texts)
        e = self.emissions(Forms(vocab, self.buckets))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(sizes, kind="stable")
        at = len(order)
        while at > 0:
            longest = int(sizes[order[at - 1]])
            group = order[max(0, at - max(1, min(512, cells // longest))) : at]
            at -= len(group)
            place = np.minimum(starts[group][None, :] + np.arange(longest)[:, None], len(flat) - 1)
            g, _ = self._marginals(e[flat[place]], sizes[group])
            out[group] = g / sizes[group][:, None]
        return out

    def _marginals(self, e: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, None]:
        """Sums over words of the posteriors, with one stored pass."""
        steps = len(e)
        x = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.p["move"] - self.p["move"].max())
        a = np.empty_like(x)
        cur = np.exp(self.p["start"] - self.p["start"].max()) * x[0]
        a[0] = cur / cur.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            cur = (a[t - 1] @ move) * x[t]
            cur /= cur.sum(axis=1, keepdims=True)
            a[t] = cur
        total = np.zeros((x.shape[1], x.shape[2]))
        b = np.ones_like(x[0])
        back = move.T.copy()
        first_end = int(sizes.min())
        for t in range(steps - 1, -1, -1):
            g = a[t] * b
            g /= g.sum(axis=1, keepdims=True)
            if t >= first_end:
                g *= (t < sizes)[:, None]
            total += g
            cur = (x[t] * b) @ back
            cur /= cur.sum(axis=1, keepdims=True)
            b = np.where((t < sizes)[:, None], cur, 1) if t >= first_end else cur
        return total, None


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int, fit_chars: int, seed: int) -> Crf | None:
    """Fit on at most ``per_label`` texts of each language, those with the smallest hash of id and text, and ``fit_chars`` characters of each.

    Of a longer text a piece is drawn by its hash; rows that share id, language and text are
    one, so what comes to the driver is bounded.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = rows.select("id", "lang", "h").withColumn("place", place).where(F.col("place") <= per_label).drop("place").distinct().collect()
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], rows.select("id", "lang", "h").schema)
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - fit_chars, F.lit(0)) + 1).cast("int") + 1
    got = rows.join(F.broadcast(ids), ["id", "lang", "h"]).select("lang", "h", F.substring(F.col("text"), start, F.lit(fit_chars)).alias("text")).dropDuplicates(["lang", "h"]).collect()
    pairs = [(lang, w) for lang, _, text in sorted((r["lang"], r["h"], r["text"]) for r in got) if (w := words_of(text))]
    labels = sorted({lang for lang, _ in pairs})
    if not labels:
        return None
    model = Crf(labels)
    if len(labels) > 1:
        model.fit([w for _, w in pairs], [labels.index(lang) for lang, _ in pairs])
    return model


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    per_label: int = 300,
    fit_chars: int = 20_000,
    seed: int = 5,
) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_fold`` and whose
    language is known, at most ``per_label`` of each and ``fit_chars`` characters of each (the
    fit's bounds). score is the expected share of the words in lang_pred, of equal shares
    that of the first label in order; every whole text is read, a very long one by itself. Texts that are null or have no letter, and all texts
    if nothing could be learned, get ``und`` and score 0. Rows with a null id are predicted,
    not learned from, and not held out. Repeated rows are returned each; other columns are
    not read; an empty table gives an empty result.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    model = train(docs.where(fold != held_fold), id_col, text_col, lang_col, per_label, fit_chars, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in bounded_slices(b, 2, rows=4096)):
            texts = [words_of(t) for t in part.column(2).to_pylist()]
            some = [i for i, w in enumerate(texts) if w] if model else []
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if some:
                share = model.shares([texts[i] for i in some])
                pred[some] = np.array(model.labels, dtype=object)[share.argmax(axis=1)]
                score[some] = np.clip(share.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
