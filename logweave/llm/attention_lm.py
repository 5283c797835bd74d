"""A causal self-attention language model in numpy on subword ids, with the word unigram model it is held against.

A text is its subword ids and an end. An id is read as a symbol (the frequent ones as themselves, the others by hash) and
predicted as a group (likewise, the others in bands of like frequency) and by its own share of the group. Counts over all
training texts give how groups follow symbols; groups that follow the same symbols form a class. Attention over the
context moves the probabilities of the classes away from what the last symbol alone says: their logits are its counted
log-probabilities and what the state adds. Within a class the last symbol's counts decide again.

Context windows are two strides wide and overlap by one; only the later stride's tokens are scored in each, so each token
is scored once, with one to two strides of context, under a causal mask. Windows are batched.

What is learned follows the input: word, id and pair counts cover every training text, and the network is fitted to every
stride of every training text. About PILOT windows, those of least hash, give a common start on the driver; then every
task goes on with all strides of its own partition, and the results are averaged by the windows behind them. Weights, and
with them scores, depend a little on how rows fall into partitions.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import binary_column, byte_view, cut, fold, slices, texts
from logweave.llm.subwords import WordsEncoder

STRIDE, WIDTH = 16, 16  # tokens scored in a window; numbers in a state
SYMBOLS, HASHED = 1024, 32
GROUPS, BANDS = 2048, 32
CLASSES, SINGLE = 32, 8
#: What is taken off each counted pair and given to groups by their own frequency.
DISCOUNT = 0.5
PILOT, EPOCHS = 20_000, 3
BATCH, RATE, RATE_ON = 256, 0.01, 0.003
#: Partitions in which fitted weights are averaged before the driver averages those.
AVERAGES = 16
#: The most frequent words, whose counts every task holds; counts of all others are joined.
HEAD = 100_000
#: Different words that a task counts before it hands them on, and those that it knows the ids of (some 100 MB at the most,
#: as words above LONG bytes are forgotten after their batch).
COUNTED, REMEMBERED, LONG = 200_000, 400_000, 1 << 16
#: Windows that are scored at a time, and bytes of ids (two for each) that a task holds as windows.
STEP, HELD = 128, 1 << 19
#: Windows whose gradients are reckoned at a time (the sums of a batch are the same).
TILE = 128
SEED = 11
TEXT_END = b" "  # no word has a space, so it stands for the end of a text among the words
NAMES = ("embedding", "query", "key", "value", "distance", "out")


@contextmanager
def small_products() -> Iterator[None]:
    """Sets this process up for many small matrix products while the body runs.

    They are faster on one thread: on two they take nearly three times the processor time, on eight sixty times. And freed
    work arrays of up to 16 MB are used again; else each one is a new mapping, which doubles the time.
    """
    put_back = []
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-1, 1 << 24)  # M_TRIM_THRESHOLD
        c.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
        for path in paths:
            lib = ctypes.CDLL(path)
            for form in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
                get, put = getattr(lib, form.format("get"), None), getattr(lib, form.format("set"), None)
                if get and put:
                    put_back.append((put, get()))
                    put(1)
                    break
    except (AttributeError, OSError):  # another C library or system: slower, with the same results
        pass
    try:
        yield
    finally:
        for put, n in put_back:
            put(n)


# --- the network ------------------------------------------------------------------------------------------------------


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = WIDTH
    shapes = {"embedding": (0.3, (SYMBOLS, d)), "query": (d**-0.5, (d, d)), "key": (d**-0.5, (d, d)), "value": (0.3 * d**-0.5, (d, d)), "distance": (0, 2 * STRIDE), "out": (0.1, (d, CLASSES))}
    return {k: rng.normal(0, scale, shape).astype(np.float32) for k, (scale, shape) in shapes.items()}


_BACK = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]  # how far back each key is of each query
_ALLOWED = _BACK >= 0
_NEVER, _MOST, _ONES = np.float32(-1e9), np.float32(60), np.ones(256, np.float32)


def bounded_exp(a: np.ndarray) -> None:
    """exp in place, of _MOST at the most."""
    if a.max(initial=0) > _MOST:
        np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)


def gradients(p: dict[str, np.ndarray], prior: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the target classes y (-1: none) of n windows x and its gradients.

    x: windows (n, 2 * STRIDE), or n + 1 strides in one row that each make a window with the next one: then what two windows
    share is reckoned once. prior: log-probabilities of the classes by symbol; first: whether a window has no earlier
    stride. Windows are gone through TILE at a time, which a processor's own cache holds.
    """
    s, d, n, root = STRIDE, WIDTH, len(first), np.float32(WIDTH**-0.5)
    step, x, y = s if x.ndim == 1 else 2 * s, np.ascontiguousarray(x).ravel(), y.reshape(n, s)
    share = np.float32(1 / max(1, np.count_nonzero(y >= 0)))
    w_q, w_kv = p["query"] * root, np.concatenate([p["key"], p["value"]], axis=1)
    mask = np.where(_ALLOWED, p["distance"][np.maximum(_BACK, 0)], _NEVER)
    loss, g_x, g_mask = 0.0, np.zeros((len(x), d), w_q.dtype), np.zeros(2 * s * s, w_q.dtype)
    g_out, g_q, g_kv = np.zeros_like(p["out"]), np.zeros_like(w_q), np.zeros_like(w_kv)

    def windows(m: np.ndarray, start: int, size: int, left: int = 0, width: int = d) -> np.ndarray:
        """(windows, size, width): of the rows of m each window's from start on, columns from left on."""
        b, item = m.strides
        return np.ndarray(((len(m) - 2 * s) // step + 1, size, width), m.dtype, m, start * b + left * item, (step * b, b, item))

    for at in range(0, n, TILE):
        m = min(TILE, n - at)
        own = slice(at * step, (at + m - 1) * step + 2 * s)
        e = np.take(p["embedding"], x[own], axis=0)
        late = windows(e, s, s).reshape(-1, d)
        q, kv = (late @ w_q).reshape(m, s, d), e @ w_kv
        k, v = windows(kv, 0, 2 * s), windows(kv, 0, 2 * s, d)
        a = q @ k.transpose(0, 2, 1)
        a += mask
        a[first[at : at + m], :, :s] = _NEVER
        bounded_exp(a)
        # attention is a times over; what is left undivided saves going through it again
        over = 1 / (a.reshape(-1, 2 * s) @ _ONES[: 2 * s])
        mean = (a @ v).reshape(-1, d)
        mean *= over[:, None]
        h = mean + late
        prob = h @ p["out"]
        prob += np.take(prior, windows(x[own, None], s, s, 0, 1).ravel(), axis=0)
        bounded_exp(prob)
        target, whole = y[at : at + m].ravel(), 1 / (prob @ _ONES[:CLASSES])
        there = np.flatnonzero(target >= 0)
        cells, flat = there * CLASSES + target[there], prob.reshape(-1)
        loss -= float(np.log(flat[cells] * whole[there] + 1e-30).sum())
        prob *= (whole * (target >= 0) * share)[:, None]
        flat[cells] -= share
        g_out += h.T @ prob
        dh = prob @ p["out"].T
        da = (dh * over[:, None]).reshape(m, s, d)
        dz = da @ v.transpose(0, 2, 1)
        dz -= (((dh * mean) @ _ONES[:d]) * over).reshape(m, s, 1)
        dz *= a
        g_mask += _ONES[:m] @ dz.reshape(m, -1)
        dq, both = (dz @ k).reshape(-1, d), np.empty((m, 2 * s, 2 * d), kv.dtype)
        np.matmul(dz.transpose(0, 2, 1), q, out=both[:, :, :d])
        np.matmul(a.transpose(0, 2, 1), da, out=both[:, :, d:])
        if step == s:
            both, dkv = both.reshape(m, 2, -1), np.zeros_like(kv)
            dkv[:-s].reshape(m, -1)[...] = both[:, 0]
            dkv[s:].reshape(m, -1)[...] += both[:, 1]
        else:
            dkv = both.reshape(-1, 2 * d)
        g_q += late.T @ dq
        g_kv += e.T @ dkv
        dh += dq @ w_q.T
        g_x[own] += dkv @ w_kv.T
        mine = windows(g_x[own], s, s)
        mine += dh.reshape(m, s, d)
    g = {"out": g_out, "query": g_q * root, "key": g_kv[:, :d], "value": g_kv[:, d:]}
    g["distance"] = np.bincount(np.maximum(_BACK, 0).ravel(), g_mask * _ALLOWED.ravel(), 2 * s).astype(w_q.dtype)
    g["embedding"] = np.bincount((x[:, None] * d + np.arange(d)).ravel(), g_x.ravel(), SYMBOLS * d).reshape(SYMBOLS, d).astype(w_q.dtype)
    return loss * float(share), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        rate *= (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


class Symbols:
    """How ids are read (symbol) and predicted (group, and inside it by frequency), from their counts (index: id).

    The last id is the end of a text; the last symbol stands before a text.
    """

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.end, self.start = n - 1, SYMBOLS - 1
        own = SYMBOLS - 1 - HASHED
        self.symbol = (own + np.arange(n) % HASHED).astype(np.int32)
        self.symbol[order[:own]] = np.arange(min(n, own))
        alone = GROUPS - BANDS
        self.group = np.empty(n, np.int32)
        self.group[order[:alone]] = np.arange(min(n, alone))
        weight = np.cumsum(counts[order[alone:]] + 0.5)
        if len(weight):
            self.group[order[alone:]] = alone + np.minimum(weight / weight[-1] * BANDS, BANDS - 1).astype(np.int32)
        total = np.bincount(self.group, counts + 0.5, GROUPS)
        self.share = total / total.sum()
        self.inside = np.log((counts + 0.5) / total[self.group])


class Pairs:
    """What the counts of groups after symbols (SYMBOLS, GROUPS) say: classes of groups, and log-probabilities."""

    def __init__(self, s: Symbols, counts: np.ndarray):
        seen = counts.sum(axis=1, keepdims=True)
        kinds = (counts > 0).sum(axis=1, keepdims=True)
        p = np.maximum(counts - DISCOUNT, 0) / np.maximum(seen, 1)
        p += np.where(seen > 0, np.minimum(DISCOUNT * kinds, seen) / np.maximum(seen, 1), 1) * s.share
        p /= p.sum(axis=1, keepdims=True)
        self.klass = self.classes(s, counts)
        prior = np.zeros((SYMBOLS, CLASSES))
        np.add.at(prior.T, self.klass, p.T)
        with np.errstate(divide="ignore"):
            self.prior = np.log(np.maximum(prior, 1e-30)).astype(np.float32)
            self.within = (np.log(p) - np.log(np.maximum(prior, 1e-30))[:, self.klass]).astype(np.float32)

    @staticmethod
    def classes(s: Symbols, counts: np.ndarray) -> np.ndarray:
        """The SINGLE most frequent groups are classes; the others are put together by the symbols before them."""
        klass = np.arange(GROUPS)
        rest = np.arange(SINGLE, GROUPS)
        before = np.sqrt(counts.T[rest] + 1e-3 * (counts.sum(axis=1) + 1) / (counts.sum() + SYMBOLS))
        before /= np.linalg.norm(before, axis=1, keepdims=True)
        weight = s.share[rest][:, None]
        _, vectors = np.linalg.eigh((before * weight).T @ before)
        points = before @ vectors[:, -WIDTH:]
        # the heaviest groups are the first centres; then each group goes to the nearest one, a few times
        centres = points[: CLASSES - SINGLE].copy()
        for _ in range(10):
            near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            mass = np.bincount(near, weight[:, 0], CLASSES - SINGLE)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points * weight)
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-30)[:, None], centres)
        klass[rest] = SINGLE + near
        return klass


class Model:
    """Symbols and pairs as tasks need them: how windows of ids are made."""

    def __init__(self, s: Symbols, pairs: Pairs):
        self.symbol, self.group, self.start, self.end = s.symbol, s.group, s.start, s.end
        self.inside = s.inside.astype(np.float32)
        self.klass, self.prior, self.within = pairs.klass, pairs.prior, pairs.within

    def windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts with ids data[at[i]:at[i + 1]]: symbols of all strides and one in front (each one place later than its
        id), whether a stride is its text's first, groups (-1 beyond the end) and each text's first stride (and the end)."""
        size = np.diff(at)
        begin = np.concatenate([[0], np.cumsum(-(-(size + 1) // STRIDE))])
        n = int(begin[-1])
        x, y = np.full((n + 1) * STRIDE, self.start, np.int64), np.full(n * STRIDE, -1, np.int64)
        moved = np.repeat(begin[:-1] * STRIDE - at[:-1], size) + np.arange(at[0], at[-1])
        own = data[at[0] : at[-1]]
        group = self.group[own]
        x[np.repeat(begin[:-1] * STRIDE - at[:-1] + STRIDE + 1, size) + np.arange(at[0], at[-1])] = self.symbol[own]
        ends = begin[:-1] * STRIDE + size
        x[begin[:-1] * STRIDE + STRIDE] = self.start
        y[moved] = group
        y[ends] = self.group[self.end]
        first = np.zeros(n, bool)
        first[begin[:-1]] = True
        return x, first, y, begin


def doubled(x: np.ndarray) -> np.ndarray:
    """Windows of two strides, each beginning one stride after the one before."""
    return np.lib.stride_tricks.sliding_window_view(x, 2 * STRIDE)[::STRIDE]


class Scorer:
    """Natural-log probabilities of whole texts, with the projections of all symbols looked up."""

    def __init__(self, p: dict[str, np.ndarray], model: Model):
        e, f = p["embedding"], np.float32
        self.model, self.e = model, e.astype(f)
        self.q = (e @ p["query"] / WIDTH**0.5).astype(f)
        self.kv = np.concatenate([e @ p["key"], e @ p["value"]], axis=1).astype(f)
        self.out = p["out"].astype(f)
        self.mask = np.where(_ALLOWED, p["distance"][np.maximum(_BACK, 0)], -1e9).astype(f)

    def texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of texts with ids data[at[i]:at[i + 1]]: one number each."""
        m = self.model
        x, first, y, begin = m.windows(data, at)
        there = np.flatnonzero(y >= 0)
        total = np.zeros(len(y))
        total[there] = m.within.ravel()[x[STRIDE:][there] * GROUPS + y[there]]
        goal = m.klass[np.maximum(y, 0)]
        for k in range(0, len(first), STEP):
            n = min(STEP, len(first) - k)
            total[k * STRIDE : (k + n) * STRIDE] += self.step(x[k * STRIDE : (k + n + 1) * STRIDE], first[k : k + n], goal[k * STRIDE : (k + n) * STRIDE])
        total[y < 0] = 0
        inside = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), m.inside[data[at[0] : at[-1]]], len(at) - 1) + m.inside[m.end]
        return np.add.reduceat(total, begin[:-1] * STRIDE) + inside

    def step(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, d, s = len(first), WIDTH, STRIDE
        kv, mine = np.take(self.kv, x, axis=0), x[s:]
        b, item = kv.strides
        k, v = (np.ndarray((n, 2 * s, d), kv.dtype, kv, left * item, (s * b, b, item)) for left in (0, d))
        a = np.take(self.q, mine, axis=0).reshape(n, s, d) @ k.transpose(0, 2, 1)
        a += self.mask
        a[first, :, :s] = -1e9
        bounded_exp(a)
        h = (a @ v).reshape(-1, d)
        h *= (1 / (a.reshape(-1, 2 * s) @ _ONES[: 2 * s]))[:, None]
        h += np.take(self.e, mine, axis=0)
        logits = h @ self.out
        logits += np.take(self.model.prior, mine, axis=0)
        if logits.max() > _MOST:
            np.minimum(logits, _MOST, out=logits)
        hit = logits[np.arange(len(mine)), y]
        np.exp(logits, out=logits)
        return hit - np.log(logits @ _ONES[:CLASSES])


# --- what is counted ---------------------------------------------------------------------------------------------------


def words_in(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z in lower case and white space as words_of has it, and where each text's begin (and the end).

    Texts with white space at an end have empty words there.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    at = lists.offsets.to_numpy()
    return lists.values.slice(at[0], at[-1] - at[0]), at.astype(np.int64) - at[0]


def added_up(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): every word and the end of every text (TEXT_END), over all rows of train (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, waiting, rows = 0, [], 0
        for whole in batches:
            ends += whole.num_rows
            for batch in slices(whole):
                words, _ = words_in(batch.column(1))
                found = words.filter(pc.greater(pc.binary_length(words), 0)).value_counts()
                waiting.append(pa.table([found.field(0).cast(pa.binary()), found.field(1)], ["word", "c"]))
                rows += len(found)
                if rows > 2 * COUNTED:
                    waiting = [added_up(waiting)]
                    rows = len(waiting[0])
                    if rows > COUNTED:
                        yield from waiting[0].to_batches()
                        waiting, rows = [], 0
        if ends:
            waiting.append(pa.table([pa.array([TEXT_END], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"]))
            yield from added_up(waiting).to_batches()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class WordCodes(dict):
    """A code for each word (A-Z in lower case): its subword ids and what the counts of the frequent words say of it.

    The tokenizer drops case itself. Beyond REMEMBERED words, or with a very long one, the memory is emptied after a batch.
    """

    def __init__(self, tokenizer: str, head: dict[bytes, int], low: float):
        self.encoder, self.head, self.low = WordsEncoder(tokenizer), head, low
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.words, self.long = [], False
        self.flat, self.begin, self.value = np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = self.words[len(self.value) :]
        if new:
            ids, size = self.encoder.words(["" if w == TEXT_END else w.decode() for w in new])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
            counts = np.array([self.head.get(w, np.nan) for w in new])
            self.value = np.concatenate([self.value, np.log10(counts + 0.5) - self.low])
            self.long |= max(map(len, new)) > LONG
        return got

    def spare(self) -> None:
        if len(self.words) > REMEMBERED or self.long:
            self.start_anew()


ENCODED = "doc_id long, held_out boolean, ids binary, n_tokens long, n_head long, base_head double, rare array<struct<word:binary,m:long>>"


def encode(rows: DataFrame, tokenizer: str, head, total: int, distinct: int) -> DataFrame:
    """Rows (doc_id, text, held_out) with their subword ids and what the counts of the frequent words say (ENCODED)."""
    low = float(np.log10(total + 0.5 * (distinct + 1))) if total else 0.0

    def encoded(codes: WordCodes, batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = words_in(batch.column(1))
        known, texts_here = words.dictionary_encode(), np.arange(batch.num_rows)
        different = codes.of([*known.dictionary.cast(pa.binary()).to_pylist(), b"", TEXT_END])
        code, row = different[known.indices.to_numpy()], np.repeat(texts_here, np.diff(at))
        there = code != different[-2]
        code, row = code[there], row[there]
        begin, size = codes.begin[code], np.diff(codes.begin)[code]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = codes.flat[np.repeat(begin - after[:-1], size) + np.arange(after[-1])]
        borders_of_ids = after[np.searchsorted(row, np.arange(batch.num_rows + 1))]
        # every text's end is a word without ids
        code, row = np.concatenate([code, np.full(batch.num_rows, different[-1])]), np.concatenate([row, texts_here])
        n = np.bincount(row, minlength=batch.num_rows)
        worth = codes.value[code]
        out = np.isnan(worth)
        missing, times = np.unique(row[out] * len(codes.words) + code[out], return_counts=True)
        rare = pa.StructArray.from_arrays([pa.array([codes.words[c] for c in (missing % len(codes.words)).tolist()], pa.binary()), pa.array(times, pa.int64())], ["word", "m"])
        borders = np.searchsorted(missing // len(codes.words), np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                binary_column(ids.view(np.uint8), 2 * borders_of_ids).cast(pa.binary()),
                pa.array(n, pa.int64()),
                pa.array(n - np.bincount(row[out], minlength=batch.num_rows), pa.int64()),
                pa.array(np.bincount(row, np.where(out, 0, worth), batch.num_rows)),
                pa.ListArray.from_arrays(pa.array(borders), rare),
            ],
            ["doc_id", "held_out", "ids", "n_tokens", "n_head", "base_head", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = None
        for whole in batches:
            codes = codes or WordCodes(tokenizer, head.value, low)
            for batch in slices(whole, 1 << 21):
                yield encoded(codes, batch)
                codes.spare()

    return rows.mapInArrow(run, ENCODED)


def id_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id, and as the last one the end, is there; one row for each id goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary + 1, np.int64)
        for batch in batches:
            data, _ = byte_view(batch.column(0))
            n[:vocabulary] += np.bincount(np.frombuffer(data.tobytes(), np.uint16), minlength=vocabulary)
            n[vocabulary] += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    counts = np.zeros(vocabulary + 1)
    for r in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def pair_counts(encoded: DataFrame, s: Symbols) -> np.ndarray:
    """How often each group follows each symbol in column ids, ends included; at most SYMBOLS * GROUPS sums go to the driver."""
    known = encoded.sparkSession.sparkContext.broadcast((s.symbol, s.group, s.start, s.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, group, start, end = known.value
        n = np.zeros(SYMBOLS * GROUPS, np.int64)
        for whole in batches:
            for batch in slices(whole, 1 << 22, "ids"):
                data, at = byte_view(batch.column(0))
                ids, ends = np.frombuffer(data.tobytes(), np.uint16), at // 2
                # each text's symbols behind a start, and its groups before an end
                spread = np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(ends))
                x, y = np.empty(len(ids) + batch.num_rows, np.int64), np.empty(len(ids) + batch.num_rows, np.int64)
                x[spread + 1], y[spread] = symbol[ids], group[ids]
                x[ends[:-1] + np.arange(batch.num_rows)] = start
                y[ends[1:] + np.arange(batch.num_rows)] = group[end]
                n += np.bincount(x * GROUPS + y, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    got = encoded.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS * GROUPS)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(SYMBOLS, GROUPS)


# --- fitting ------------------------------------------------------------------------------------------------------------


def windows_of(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of n + 1 strides, whether the n windows of two have no earlier stride, and target classes (n, STRIDE; -1: none) of packed ids."""
    data, at = byte_view(column)
    x, first, y, _ = model.windows(np.frombuffer(data.tobytes(), np.uint16), at // 2)
    return x, first, np.where(y >= 0, model.klass[np.maximum(y, 0)], -1).reshape(-1, STRIDE)


def pilot(train: DataFrame, model, strides: int, most: int = PILOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About `most` windows of the training texts' strides: those whose hash is below the share that makes so many."""
    below = min(1.0, most / max(1, strides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, HELD, "ids"):
                x, first, y = windows_of(batch.column(0), model.value)
                x = doubled(x)
                h = np.zeros(len(x), np.uint64)
                for k in range(2 * STRIDE):
                    h = (h ^ x[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                mine = np.flatnonzero(h / 2.0**64 < below)
                packed = [[row.tobytes() for row in part[mine].astype(np.int16)] for part in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array(first[mine])], ["x", "y", "first"])

    # equal windows have equal hashes, so a window that fills a share of the corpus comes once, with its number
    got = train.select("ids").mapInArrow(run, "x binary, y binary, first boolean").groupBy("x", "y", "first").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["x"], r["y"], r["first"]))
    read = lambda name, width: np.frombuffer(b"".join(r[name] for r in got), np.int16).reshape(-1, width).astype(np.int64)
    return read("x", 2 * STRIDE), np.array([r["first"] for r in got], bool), read("y", STRIDE)


def fit(train: DataFrame, model: Model, strides: int) -> dict[str, np.ndarray]:
    """Weights for all strides of train (ids); without any they are the initial ones."""
    sent = train.sparkSession.sparkContext.broadcast(model)
    p = initial()
    x, first, y = pilot(train, sent, strides)
    if not len(x):
        return p
    adam, rng = Adam(p), np.random.default_rng(SEED)
    with small_products():
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(order), BATCH):
                mine = order[k : k + BATCH]
                adam.step(gradients(p, model.prior, x[mine], first[mine], y[mine])[1], RATE * (1 - epoch / EPOCHS))
    return averaged(train, p, sent)


def averaged(train: DataFrame, p: dict[str, np.ndarray], model) -> dict[str, np.ndarray]:
    """The mean of the weights that the tasks come to from p, each with all strides of its texts, weighed by windows."""

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in p.items()}
        step, seen = Adam(own), 0
        with small_products():
            for whole in batches:
                for batch in slices(whole, HELD, "ids"):
                    x, first, y = windows_of(batch.column(0), model.value)
                    for k in range(0, len(first), BATCH):
                        step.step(gradients(own, model.value.prior, x[k * STRIDE : (k + BATCH + 1) * STRIDE], first[k : k + BATCH], y[k : k + BATCH])[1], RATE_ON)
                    seen += len(first)
        if seen:
            yield weights_row(seen, own)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(sum(v.size for v in p.values()))
        for batch in batches:
            for m, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += m
                total += m * np.frombuffer(w, np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).tobytes()], pa.binary())], ["n", "w"])

    fitted = train.select("ids").mapInArrow(go_on, "n long, w binary").repartition(AVERAGES).mapInArrow(average, "n long, w binary").collect()
    n = sum(r["n"] for r in fitted)
    mean = sum(r["n"] / n * np.frombuffer(bytes(r["w"]), np.float64) for r in sorted(fitted, key=lambda r: (r["n"], bytes(r["w"]))))
    out, at = {}, 0
    for name in NAMES:
        out[name] = mean[at : at + p[name].size].reshape(p[name].shape).astype(np.float32)
        at += p[name].size
    return out


def weights_row(n: int, p: dict[str, np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([p[k].ravel() for k in NAMES]).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "w"])


# --- scoring ------------------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, tokenizer: str, head_words: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents whose crc32(doc_id as text) mod 5 is not 1 (a null id is learned from). A null text counts
    as empty: its end alone is scored. Repeated rows count and are scored once each; without training texts the counts
    are zero and the network is the initial one; other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    rows = texts(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)))
    counts = cut(word_counts(rows.where("not held_out").select("doc_id", "text")))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    top = counts.orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    # the keys are written with the rows, so they are the same whenever they are read
    encoded = cut(encode(rows, tokenizer, head, total, distinct).withColumn("key", F.monotonically_increasing_id()))
    train = encoded.where("not held_out")
    symbols = Symbols(id_counts(train, vocabulary))
    model = Model(symbols, Pairs(symbols, pair_counts(train, symbols)))
    strides = train.agg(F.coalesce(F.sum(F.floor(F.octet_length("ids") / (2 * STRIDE)) + 1), F.lit(0)).alias("n")).first()["n"]
    scorer = spark.sparkContext.broadcast(Scorer(fit(train, model, int(strides)), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer.value
        for whole in batches:
            for batch in slices(whole, HELD, "ids"):
                data, at = byte_view(batch.column(1))
                with small_products():
                    got = model.texts(np.frombuffer(data.tobytes(), np.uint16), at // 2) / np.log(10)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["key", "score"])

    rest = encoded.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.m").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    low = F.log10(F.lit(total + 0.5 * (distinct + 1)))
    rest = rest.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("n_rest"), F.sum(F.col("m") * (F.log10(F.col("c") + 0.5) - low)).alias("base_rest"))
    scored = encoded.select("key", "ids").mapInArrow(run, "key long, score double")
    narrow = encoded.select("key", "doc_id", "held_out", "n_tokens", "n_head", "base_head")
    return (
        narrow.join(scored, "key")
        .join(rest, "key", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_head") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )
