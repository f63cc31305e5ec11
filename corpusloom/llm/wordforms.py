"""Hashed character features of many distinct words at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import xxhash


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def number_words(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers of all texts in a row, words a text, distinct words)."""
    numbers = Numbers()
    get = numbers.__getitem__
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=np.int32)
    at = 0
    for t in texts:
        flat[at : at + len(t)] = np.fromiter(map(get, t), dtype=np.int32, count=len(t))
        at += len(t)
    return flat, sizes, list(numbers)


class Forms:
    """Feature buckets of distinct words: n-grams of 1 to 3 bytes with word marks, affixes, the word.

    Features are computed when first asked for, for lists of some ten thousand words.
    """

    def __init__(self, words: list[str], buckets: int):
        self._raw = [w.encode() for w in words]
        self._flat = np.frombuffer(b"<" + b"><".join(self._raw) + b">", dtype=np.uint8)
        self._sizes = np.array([len(r) + 2 for r in self._raw], dtype=np.int64)
        self._ends = np.cumsum(self._sizes)
        self._starts = self._ends - self._sizes
        self.n, self.buckets = len(words), buckets

    @cached_property
    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, first place of each word) for each length."""
        flat, out = self._flat.astype(np.uint64), []
        for n in (1, 2, 3):
            code = np.zeros(len(flat) - n + 1, dtype=np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + flat[k : len(flat) - n + 1 + k]
            inside = np.ones(len(code), dtype=bool)
            for k in range(1, n):
                inside[self._ends[:-1] - k] = False
            out.append((_bucket(code[inside], n, self.buckets), self._starts - (n - 1) * np.arange(self.n)))
        return out

    @cached_property
    def affixes(self) -> list[np.ndarray]:
        """Buckets of the first and last 1 to 4 bytes."""
        flat, out = self._flat.astype(np.uint64), []
        for n in (1, 2, 3, 4):
            size = np.minimum(n, self._sizes - 2)
            head = tail = np.zeros(self.n, dtype=np.uint64)
            for k in range(n):
                more = k < size
                head = np.where(more, head * np.uint64(257) + flat[np.minimum(self._starts + 1 + k, len(flat) - 1)], head)
                tail = np.where(more, tail * np.uint64(257) + flat[np.maximum(self._ends - 2 - k, 0)], tail)
            out += [_bucket(head, 10 + n, self.buckets), _bucket(tail, 20 + n, self.buckets)]
        return out

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self._raw), dtype=np.uint64, count=self.n)

    @cached_property
    def edges(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words at least that long, 64-bit codes) of the first 2 to 8 and the last 2 to 4 bytes."""
        out = []
        for lengths, start, step, tag in ((range(2, 9), self._starts + 1, 1, 1), (range(2, 5), self._ends - 2, -1, 2)):
            code = np.full(self.n, tag, dtype=np.uint64)
            for n in range(1, lengths.stop):
                byte = self._flat[np.clip(start + step * (n - 1), 0, len(self._flat) - 1)].astype(np.uint64)
                code = (code ^ byte) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
                if n in lengths:
                    long = np.flatnonzero(self._sizes - 2 >= n)
                    out.append((long, code[long]))
        return out

    def edge_sum(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows of each word's first and last bytes."""
        out = np.zeros((self.n, table.shape[1]), dtype=np.float32)
        for word, code in self.edges:
            out[word] += table[(code % np.uint64(len(table))).astype(np.int64)]
        return out

    def edge_gradient(self, by_word: np.ndarray, rows: int) -> np.ndarray:
        """The gradient of edge_sum's table."""
        out = np.zeros((rows, by_word.shape[1]), dtype=np.float32)
        word = np.concatenate([w for w, _ in self.edges])
        code = (np.concatenate([c for _, c in self.edges]) % np.uint64(rows)).astype(np.int64)
        for d in range(by_word.shape[1]):
            out[:, d] = np.bincount(code, weights=by_word[word, d], minlength=rows)
        return out

    def gram_mean(self, table: np.ndarray) -> np.ndarray:
        """Mean over each word's n-grams of the table's rows, summed over n."""
        out = np.zeros((self.n, table.shape[1]), dtype=np.float32)
        for code, first in self.grams:
            out += np.add.reduceat(table[code], first, axis=0) / np.diff(np.append(first, len(code)))[:, None]
        return out

    def gram_gradient(self, by_word: np.ndarray, rows: int) -> np.ndarray:
        """The gradient of gram_mean's table."""
        out = np.zeros((rows, by_word.shape[1]), dtype=np.float32)
        for code, first in self.grams:
            n = np.diff(np.append(first, len(code)))
            owner = np.repeat(np.arange(self.n), n)
            share = by_word / n[:, None]
            for d in range(by_word.shape[1]):
                out[:, d] += np.bincount(code, weights=share[owner, d], minlength=rows)
        return out


def _bucket(code: np.ndarray, tag: int, buckets: int) -> np.ndarray:
    h = (code + np.uint64(tag * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


class Adam:
    """Adam steps for a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
