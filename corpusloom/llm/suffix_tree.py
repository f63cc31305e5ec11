"""Language-model scoring with a probabilistic suffix tree over words.

1. Texts are tokenised once into blocks of bounded size, kept in the shared folder as
   word numbers with the block's own vocabulary (sorted 64-bit hashes) and training counts.
2. Every block asks for corpus counts: it sends its distinct words with its own counts, by
   hash range, to the bucket that adds up those hashes over all blocks, and each bucket
   answers every block that asked and numbers the words, so that blocks send no hashes from
   then on. No table of the corpus is gathered in one place.
3. Level by level, the same is done for contexts of 1, 2, ... words with the words that
   follow. A position goes a level deeper only where the longer context occurs ``least``
   times or more in training texts, and where the shorter one leaves its next word open.
   Next words that the shorter context precedes less often than that are sent as one.
4. A bucket holds whole contexts and tests them: a context is kept if its next-word counts
   diverge from what its suffix predicts by more nats than half a logarithm of its count
   for each next word. Contexts counted ``hot_count`` times or more are split by next word
   over the buckets; the sums of the parts, at most total / hot_count rows, are tested alike.
5. A word is scored in the longest kept context that precedes it: its count there, smoothed
   by the probability that the next shorter context gives. Levels end with the first at
   which no context is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, release_shuffles, sorted_groups, stash, workspace

#: The end of a text, as a token; no word holds a space.
END = b" "
#: Words have numbers of so many bits, from 1 on.
ID_BITS = 40
#: Stands for all next words that are known to be counted less than ``least`` times in a context.
RARE = np.uint64(0)
#: Parts of a power of two in which a suffix's prediction is sent to the test.
STEPS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "block string, docs array<long>, kinds binary, sizes binary, tokens binary, vocab binary, train binary, n_vocab long, n_train long"
ASK = "bucket long, block string, contexts binary, pairs binary, hot binary, next binary, counts binary, prior binary"
ANSWER = "block string, level int, bucket long, ids binary, counts binary, left binary, whole binary, context long, rest long, events long, whole_part long, kept long, gain double, covered double"


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; planes of zeros take no room."""
    planes = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(planes).view("<i8").ravel()


def pack_sorted(codes: np.ndarray) -> bytes:
    """Sorted 64-bit codes as differences."""
    return pack(np.diff(codes, prepend=np.uint64(0)).view(np.int64))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def _pack_block(ids: list, kinds: list, texts: list[bytes]) -> pa.RecordBatch:
    numbers = _Numbers()
    end, get = numbers[END], numbers.__getitem__
    tokens: list[np.ndarray] = []
    for text in texts:
        words = text.lower().split()
        got = np.empty(len(words) + 1, dtype=np.int32)
        got[:-1] = np.fromiter(map(get, words), dtype=np.int32, count=len(words))
        got[-1] = end
        tokens.append(got)
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(tokens)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
    vocab, rank = np.unique(hashes, return_inverse=True)
    flat = rank[flat].astype(np.int32)
    learned = np.repeat(np.array(kinds, dtype=np.int8) == 1, sizes)
    train = np.bincount(flat[learned], minlength=len(vocab)).astype(np.int64)
    name = xxhash.xxh3_128_hexdigest(flat.tobytes() + repr(ids).encode() + vocab.tobytes())
    row = [name, ids, bytes(kinds), sizes.tobytes(), pack(flat), pack_sorted(vocab), pack(train), len(vocab), int(train.sum())]
    types = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def tokenised(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int, block_bytes: int) -> DataFrame:
    """Blocks of tokenised texts; kinds: 1 learned from, 2 held out, 0 neither (null id)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        kinds: list[int] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(i)
                kinds.append(k)
                texts.append(t or b"")
                size += len(texts[-1]) + 8
                if size >= block_bytes:
                    yield _pack_block(ids, kinds, texts)
                    ids, kinds, texts, size = [], [], [], 0
        if ids:
            yield _pack_block(ids, kinds, texts)
        del ids, kinds, texts
        release_memory()

    fold = F.crc32(F.col(id_col).cast("string")) % folds
    kind = F.when(fold == held_fold, 2).when(fold.isNull(), 0).otherwise(1)
    rows = docs.select(F.col(id_col).cast("long"), kind.cast("int"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, BLOCK)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 64-bit codes, numbered."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ordered_pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of rows by context, then next word, as one sort of ranks and words where both fit in 64 bits."""
    codes, rank = np.unique(context, return_inverse=True)
    if len(codes) >= 1 << 24:
        return np.lexsort((word, context))
    return np.argsort((rank.astype(np.uint64) << np.uint64(ID_BITS)) | word)


def spread(ids: np.ndarray) -> np.ndarray:
    """64-bit codes of word numbers, different for different ones."""
    x = ids * _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """Answers of level 0: the corpus counts of every block's vocabulary, and the words' ranks in their bucket as ids."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, train in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                v, t = unpack_sorted(vocab), unpack(train)
                # a block asks only the buckets that it has words of, so there are never more rows than words
                at, first = np.unique(bucket_of(v, buckets), return_index=True)
                ends = np.append(first[1:], len(v))
                yield _record([(k, block, pack_sorted(v[a:b]), pack(t[a:b])) for k, a, b in zip(at.tolist(), first.tolist(), ends.tolist(), strict=True)], "bucket long, block string, vocab binary, train binary")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in sorted_groups(batches, ["bucket"]):
            asked = [unpack_sorted(x) for x in group["vocab"].to_pylist()]
            words, at = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.zeros(len(words), dtype=np.int64)
            np.add.at(counts, at, np.concatenate([unpack(x) for x in group["train"].to_pylist()]))
            ends = np.cumsum([len(p) for p in asked]).tolist()
            places = [at[e - len(p) : e] for p, e in zip(asked, ends, strict=True)]
            out = [(b, 0, bucket, pack_sorted(x.astype(np.uint64)), pack(counts[x]), *[None] * 9) for b, x in zip(group["block"].to_pylist(), places, strict=True)]
            out.append((None, 0, bucket, *[None] * 6, int((counts > 0).sum()), *[None] * 4))
            yield _record(out, ANSWER)

    rows = blocks.select("block", "vocab", "train").mapInArrow(ask, "bucket long, block string, vocab binary, train binary")
    return rows.repartition(min(buckets, 10_000), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWER)


class Walk:
    """A block's positions from level to level: their probability, and what the next level asks.

    got: the answers to the block by level, in order of buckets. hot: for each level from 1
    on, (contexts, left, whole) of the split contexts, sorted.
    """

    def __init__(self, row: dict, total: int, distinct: int, buckets: int, hot_count: int, least: int):
        self.flat, self.sizes = unpack(row["tokens"]), np.frombuffer(row["sizes"], dtype=np.int64)
        self.kinds = np.frombuffer(row["kinds"], dtype=np.int8)
        self.buckets, self.hot_count, self.least = buckets, hot_count, least
        self.learned = np.repeat(self.kinds == 1, self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.flat)) - np.repeat(starts, self.sizes)
        self.got: dict[int, list] = {}
        for r in row["got"]:
            self.got.setdefault(r["level"], []).append(r)
        counts = np.concatenate([unpack(r["counts"]) for r in self.got[0]])
        # ranks of the buckets interleave, so that none need know how many words the others have
        self.ids = np.concatenate([unpack_sorted(r["ids"]) * np.uint64(buckets) + np.uint64(r["bucket"] + 1) for r in self.got[0]])
        if int(self.ids.max()) >> ID_BITS:
            raise ValueError(f"words have numbers beyond {ID_BITS} bits")
        root = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.word_count = counts[self.flat]
        self.base = root[self.flat]
        self.p = self.base.copy()
        self.hash = spread(self.ids)[self.flat]
        self.run, self.run_count = self.hash, self.word_count
        self.fixed = np.zeros(len(self.flat), dtype=bool)

    def asked(self, level: int) -> dict[str, np.ndarray]:
        """The distinct (context, next word) of the open positions, sorted by bucket, context and word."""
        before = np.zeros(len(self.flat), dtype=np.int64)
        before[1:] = self.run_count[:-1]
        at = np.flatnonzero((self.place >= level) & (before >= self.least) & ~self.fixed)
        context, hot = self.run[at - 1], before[at] >= self.hot_count
        # a next word follows the longer context no more often than the shorter one
        word = np.where(self.run_count[at] < self.least, RARE, self.ids[self.flat[at]])
        order = ordered_pairs(context, word)
        bucket = bucket_of(context, self.buckets)
        if hot.any():
            bucket = np.where(hot, bucket_of(spread(context ^ word), self.buckets), bucket)
            order = order[np.argsort(bucket[order], kind="stable")]
        at, context, word, bucket, hot = (v[order] for v in (at, context, word, bucket, hot))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])
        pair = new.copy()
        pair[1:] |= word[1:] != word[:-1]
        pair_of, first = np.cumsum(pair) - 1, np.flatnonzero(pair)
        counts = np.bincount(pair_of, weights=self.learned[at], minlength=len(first)).astype(np.int64)
        prior = np.where(word[first] == RARE, 0, np.rint(-STEPS * np.log2(self.p[at[first]]))).astype(np.int64)
        return {"at": at, "pair_of": pair_of, "group_of": np.cumsum(new) - 1, "pair_group": (np.cumsum(new) - 1)[first], "context": context[new], "hot": hot[new],
                "bucket": bucket[new], "word": word[first], "counts": counts, "prior": prior}

    def step(self, level: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Apply a level's answers."""
        a, got = self.asked(level), self.got.get(level, [])
        empty = np.empty(0, dtype=np.int64)
        counts, left, whole = (np.concatenate([empty, *(unpack(r[k]) for r in got)]) for k in ("counts", "left", "whole"))
        if a["hot"].any():
            some = np.searchsorted(hot[0], a["context"][a["hot"]])
            left, whole = left.copy(), whole.copy()
            left[a["hot"]], whole[a["hot"]] = hot[1][some], hot[2][some]
        at, c = a["at"], counts[a["pair_of"]]
        left, whole = left[a["group_of"]], whole[a["group_of"]]
        kept = whole > 0
        self.p[at[kept]] = (c[kept] + left[kept] * self.p[at[kept]]) / whole[kept]
        self.fixed = np.ones(len(self.flat), dtype=bool)
        self.fixed[at] = left <= 1
        self.run_count = np.zeros(len(self.flat), dtype=np.int64)
        self.run_count[at] = c
        run = np.zeros_like(self.run)
        run[1:] = self.run[:-1] * _MIX + self.hash[1:]
        self.run = run ^ (run >> np.uint64(29))


def summed(context: np.ndarray, word: np.ndarray, counts: np.ndarray, prior: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of rows (context, next word, count, suffix's prediction), repeats added: (contexts, places of rows' contexts, counts of rows, rest, events, whole, gain, covered).

    Counts under ``least``, and those of ``RARE``, are left to the suffix as the rest of the context. The last two, sums of c log(c / p) and of
    p over the words seen, add up over parts of a context as the others do.
    """
    order = ordered_pairs(context, word)
    context, word = context[order], word[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = context[1:] != context[:-1]
    pair = new.copy()
    pair[1:] |= word[1:] != word[:-1]
    first = np.flatnonzero(pair)
    c = np.add.reduceat(counts[order], first)
    owner, n = (np.cumsum(new) - 1)[first], int(new.sum())
    whole = np.bincount(owner, weights=c, minlength=n)
    c = np.where((c >= least) & (word[first] != RARE), c, 0)
    p = 2.0 ** (-prior[order][first] / STEPS)
    seen, events = np.bincount(owner, weights=c, minlength=n), np.bincount(owner[c > 0], minlength=n)
    covered, rest = np.bincount(owner[c > 0], weights=p[c > 0], minlength=n), whole - seen
    gain = np.bincount(owner, weights=c * np.log(np.maximum(c, 1) / p), minlength=n)
    row_pair, row_owner = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    row_pair[order], row_owner[order] = c[np.cumsum(pair) - 1], np.cumsum(new) - 1
    return context[new], row_owner, row_pair, rest.astype(np.int64), events, whole.astype(np.int64), gain, covered


def diverges(rest: np.ndarray, events: np.ndarray, whole: np.ndarray, gain: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Which contexts tell more nats beyond their suffix than half a logarithm of their count for each next word."""
    with np.errstate(divide="ignore", invalid="ignore"):
        told = gain - (whole - rest) * np.log(np.maximum(whole, 1))
        told = told + np.where(rest > 0, rest * np.log(rest / np.maximum(whole, 1) / np.maximum(1 - covered, 1e-12)), 0)
    return (events > 0) & (told > 0.5 * events * np.log(np.maximum(whole, 2)))


def tested(context: np.ndarray, word: np.ndarray, counts: np.ndarray, prior: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """As ``summed``, with the contexts that are kept in place of the sums."""
    *told, gain, covered = summed(context, word, counts, prior, least)
    return *told, diverges(*told[3:], gain, covered)


def _slice_bounds(contexts: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """First contexts of ranges that hold about so many rows each; a context is never cut."""
    order = np.argsort(contexts)
    piece = (np.cumsum(sizes[order]) - sizes[order]) // rows
    first = np.append(True, piece[1:] != piece[:-1])
    return np.unique(contexts[order][first])


def context_counts(joined: DataFrame, level: int, walk, hots: list, hot_count: int, least: int, buckets: int, slice_rows: int) -> DataFrame:
    """Answers of a level from 1 on; rows without a block hold the number of kept contexts, or the parts of split ones.

    A bucket tests its contexts in ranges of about ``slice_rows`` rows.
    """

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            w = walk(row)
            for k in range(1, level):
                w.step(k, hots[k])
            a = w.asked(level)
            ends = np.searchsorted(a["pair_group"], np.arange(len(a["context"]) + 1))
            at, first = np.unique(a["bucket"], return_index=True)
            rows, last = [], np.append(first, len(a["context"]))[1:]
            for k, x, y in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                p, q = int(ends[x]), int(ends[y])
                rows.append((k, row["block"], pack_sorted(a["context"][x:y]), pack(np.diff(ends[x : y + 1])), pack(a["hot"][x:y].astype(np.int64)), pack(a["word"][p:q].view(np.int64)), pack(a["counts"][p:q]), pack(a["prior"][p:q])))
            yield _record(rows, ASK)
            del w, a, rows
        release_memory()

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in sorted_groups(batches, ["bucket"]):
            contexts, sizes, hot = [unpack_sorted(x) for x in group["contexts"].to_pylist()], [unpack(x) for x in group["pairs"].to_pylist()], [unpack(x).astype(bool) for x in group["hot"].to_pylist()]
            word, counts, prior = ([unpack(x).astype(t) for x in group[k].to_pylist()] for k, t in (("next", np.int64), ("counts", np.int32), ("prior", np.int32)))
            ends = [np.append(0, np.cumsum(n)) for n in sizes]
            bounds = _slice_bounds(np.concatenate(contexts), np.concatenate(sizes), slice_rows)
            cuts = [np.append(np.searchsorted(c, bounds), len(c)) for c in contexts]
            c_of = [np.empty(len(w), dtype=np.int64) for w in word]
            left_of, whole_of = ([np.empty(len(c), dtype=np.int64) for c in contexts] for _ in range(2))
            out, n_kept = [], 0
            for s in range(len(bounds)):
                spans = [(int(cut[s]), int(cut[s + 1])) for cut in cuts]
                rows = [(int(e[a]), int(e[b])) for e, (a, b) in zip(ends, spans, strict=True)]
                n = np.concatenate([x[a:b] for x, (a, b) in zip(sizes, spans, strict=True)])
                context, often = (np.repeat(np.concatenate([x[a:b] for x, (a, b) in zip(v, spans, strict=True)]), n) for v in (contexts, hot))
                w, c, p = (np.concatenate([x[a:b] for x, (a, b) in zip(v, rows, strict=True)]) for v in (word, counts, prior))
                codes, owner, c, rest, events, whole, gain, covered = summed(context, w.view(np.uint64), c, p, least)
                kept = diverges(rest, events, whole, gain, covered)
                split = np.zeros(len(codes), dtype=bool)
                split[owner] = often
                kept &= ~split
                # left 1 marks a context with one next word only: no longer context can tell more
                left, weight = np.where((events == 1) & (rest == 0), 1, np.maximum(rest + events, 2)), (whole + events) * kept
                own, g, q = owner[np.cumsum(n) - n], 0, 0
                for k, ((a, b), (x, y)) in enumerate(zip(spans, rows, strict=True)):
                    c_of[k][x:y] = c[q : q + y - x]
                    left_of[k][a:b], whole_of[k][a:b] = left[own[g : g + b - a]], weight[own[g : g + b - a]]
                    g, q = g + b - a, q + y - x
                parts = (x[split].tolist() for x in (codes.view(np.int64), rest, events, whole, gain, covered))
                out += [(None, level, bucket, *[None] * 4, k, r, e, m, None, g_, v) for k, r, e, m, g_, v in zip(*parts, strict=True)]
                n_kept += int(kept.sum())
            del word, counts, prior
            out += [(block, level, bucket, None, pack(c), pack(a), pack(b), *[None] * 7) for block, c, a, b in zip(group["block"].to_pylist(), c_of, left_of, whole_of, strict=True)]
            out.append((None, level, bucket, *[None] * 8, n_kept, None, None))
            yield _record(out, ANSWER)
            release_memory()

    rows = joined.mapInArrow(ask, ASK)
    return rows.repartition(min(buckets, 10_000), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWER)


def split_contexts(answers: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, left, whole) of the contexts that a level split, sorted; no more than training words / hot_count.

    The sums of their parts are tested as those of other contexts are; whole is 0 where the suffix does as well.
    """
    names = ("rest", "events", "whole_part", "gain", "covered")
    parts = answers.where("block is null and context is not null").groupBy("context").agg(*(F.sum(c).alias(c) for c in names))
    rows = parts.collect() if known else []
    code = np.array([r["context"] for r in rows], dtype=np.int64).view(np.uint64)
    rest, events, whole = (np.array([r[c] for r in rows], dtype=np.int64) for c in names[:3])
    gain, covered = (np.array([r[c] for r in rows], dtype=np.float64) for c in names[3:])
    left = np.where((events == 1) & (rest == 0), 1, np.maximum(rest + events, 2))
    weight, order = (whole + events) * diverges(rest, events, whole, gain, covered), np.argsort(code)
    return code[order], left[order], weight[order]


def with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with all answers to them."""
    union = answers[0]
    for more in answers[1:]:
        union = union.union(more)
    got = F.sort_array(F.collect_list(F.struct("level", "bucket", "ids", "counts", "left", "whole")))
    replies = union.where("block is not null").groupBy("block").agg(got.alias("got"))
    return blocks.select("block", "docs", "tokens", "sizes", "kinds").join(replies, "block")


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 1,
    depth: int = 3,
    least: int = 2,
    hot_count: int = 1 << 22,
    block_bytes: int = 8 << 20,
    bucket_words: int = 1 << 19,
    slice_rows: int = 1 << 18,
) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod ``folds`` is not ``held_fold``.
    base_score is the smoothed unigram log10 probability, score that of the suffix tree:
    contexts of up to ``depth`` words that occur ``least`` times or more in training texts
    and pass the divergence test; of equal sides the test keeps the shorter context. What
    is held of the corpus grows with it; no share or number of contexts is a bound. Null and
    empty texts are one end token; very long texts are read whole. Rows with a null doc_id
    are scored but not learned from and count as not held out. Words are known by 64-bit
    hashes. Repeated rows count and are returned each. An empty table gives an empty result;
    other columns are not read.
    """
    space = workspace(docs.sparkSession)
    blocks = stash(tokenised(docs, id_col, text_col, folds, held_fold, block_bytes), space, "blocks")
    found = blocks.agg(F.sum("n_train"), F.sum("n_vocab")).first()
    total, buckets = found[0] or 0, max(1, -(-(found[1] or 0) // bucket_words))
    answers = [stash(word_counts(blocks, buckets), space, "answers0")]
    distinct = answers[0].agg(F.sum("events")).first()[0] or 0
    hots: list = [None]

    def walk(row: dict) -> Walk:
        return Walk(row, total, distinct, buckets, hot_count, least)

    for level in range(1, depth + 1):
        answers.append(stash(context_counts(with_answers(blocks, answers), level, walk, list(hots), hot_count, least, buckets, slice_rows), space, f"answers{level}"))
        kept = answers[-1].agg(F.sum("kept").alias("kept"), F.count("context").alias("split")).first()
        hots.append(split_contexts(answers[-1], kept["split"]))
        release_shuffles(docs.sparkSession)
        if not kept["kept"] and not kept["split"]:
            break

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            w = walk(row)
            for level in range(1, len(hots)):
                w.step(level, hots[level])
            starts = np.cumsum(w.sizes) - w.sizes
            base, full = (np.add.reduceat(np.log10(p), starts) for p in (w.base, w.p))
            known = np.add.reduceat((w.word_count > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(w.kinds == 2), pa.array(w.sizes), pa.array(known), pa.array(np.full(len(starts), total)), pa.array(base), pa.array(full)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del w
        release_memory()

    return with_answers(blocks, answers).mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
