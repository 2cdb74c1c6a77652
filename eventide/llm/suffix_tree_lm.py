"""Language model scoring with a probabilistic suffix tree.

The tree holds contexts of one to ``DEPTH`` words. A context becomes a candidate if it occurs at least ``LEAST`` times in the
training tokens, so the tree grows with the corpus; under it, next words with a share of at least ``GAMMA`` that occur twice are kept if their
probability differs from the one under the longest retained shorter suffix by ``RATIO``. A context is retained if coding its occurrences with its own
distribution rather than its parent's saves more than the cost of its parameters (a divergence test weighted by its
count). Kept next words get their discounted share; all others share what is left in proportion to the parent, so every
state's distribution sums to one. A token is scored by the longest suffix of the words before it that is a state. The root is the
add-one unigram model that is also the base score.

At scale: tokens meet by the word before them, so that a context and all its suffixes stand in one shard, where they are learned shortest first and
at once score the tokens; the tree needs no tables of runs. Contexts that occur ``WIDE`` times or more would fill a shard: their next words are counted before by a shuffle,
their models (at most ``1 / GAMMA`` words each) are broadcast, and the tokens behind them meet by their shortest context that isn't wide. Each
token is dealt once, or not at all if the word before it is rare. Texts are handled in chunks of ``CHUNK_BYTES``: shards of words send the counts back to the chunks
they come from, shards of contexts send back what they add to each text. Words are 64-bit hashes in the shuffles, tokens codes of a part's distinct words. The texts are
tokenised anew for each step instead of being kept as a table; an input whose rows change their places between two reads is refused.

Defined cases: a null or empty text is the end token alone. Rows with a null id are training rows. Repeated rows count as often as they
occur. Without training tokens every token has probability 1 / (0 + 1 * (0 + 1)) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_words import byte_rule, coded_words, text_slices
from .common import table, written
from .pu_quality import fold

DEPTH = 3
#: Least number of occurrences of a context in the training tokens.
LEAST = 20
#: Least share of a context's occurrences that a kept next word makes up.
GAMMA = 4e-3
#: Factor by which a kept probability differs from the parent's.
RATIO = 1.05
#: Counts taken from every kept next word for those that are not kept.
DISCOUNT = 0.5
#: Occurrences from which a context is learned before the shards are dealt.
WIDE = 1 << 19
#: Bytes of text that are handled together, and that a shard stands for; contexts of a shard are learned in so many pieces, one after the other.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 20 << 20
PIECES = 4
#: Most words that are broadcast with their counts, so that shards can name them by rank.
COMMON = 1 << 18
#: Stands for the end of a text; no word holds a space.
END = " "


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class SuffixTree:
    """The definition in memory, which tests hold the tables against: states and their distributions; words are numbers from 0, unknown ones are negative."""

    def __init__(self, root: np.ndarray, common: np.ndarray, total: int):
        self.root = root  # log10 probabilities of the common words
        self.common = common  # their counts
        self.total = total
        self.width = len(root)
        self.levels: list[dict] = []

    def first_candidates(self, p_min: float) -> None:
        ids = np.flatnonzero(self.common >= max(p_min * self.total, 2))
        self._level(ids.astype(np.int64), self.common[ids], np.full(len(ids), -1))

    def _level(self, keys: np.ndarray, counts: np.ndarray, suffix: np.ndarray) -> None:
        none = np.zeros(0, np.int64)
        self.levels.append({"keys": keys, "counts": counts, "suffix": suffix, "kept": np.zeros(len(keys), bool), "back": np.zeros(len(keys)), "pairs": none, "logs": np.zeros(0)})

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """As :func:`places`, for keys that are never negative: a negative key stands for none."""
        return np.where(wanted >= 0, places(keys, wanted), -1)

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Per depth the candidate before each token, or -1. ``first`` marks the first token of each text."""
        found, last = [], None
        for k, level in enumerate(self.levels):
            if k == 0:
                here = self._find(level["keys"], ids)
            else:
                key = np.where((last >= 0) & (ids >= 0), last * self.width + ids, -1)
                here = self._find(level["keys"], key)
            before = np.concatenate([[-1], here[:-1]]) if len(here) else here
            before[first] = -1
            found.append(before)
            last = before
        return found

    def logs_under(self, depth: int, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probabilities of common words ``ids`` under candidates of ``depth`` (0: the root)."""
        if depth == 0:
            return self.root[ids]
        level = self.levels[depth - 1]
        lower = self.logs_under(depth - 1, level["suffix"][context], ids)
        pair = self._find(level["pairs"], context * self.width + ids)
        own = np.where(pair >= 0, level["logs"][pair] if len(level["logs"]) else 0.0, level["back"][context] + lower)
        return np.where(level["kept"][context], own, lower)

    def learn(self, pairs: np.ndarray, counts: np.ndarray, gamma: float) -> None:
        """Fit the deepest level from the counts of (candidate, next word), coded as one sorted number."""
        depth = len(self.levels)
        level = self.levels[-1]
        context, word = np.divmod(pairs, self.width)
        size = level["counts"][context]
        use = counts >= np.maximum(gamma * size, 2)
        context, word, n, size, code = context[use], word[use], counts[use], size[use], pairs[use]
        own = np.log10((n - DISCOUNT) / size)
        lower = self.logs_under(depth - 1, level["suffix"][context], word)
        use = np.abs(own - lower) >= np.log10(RATIO)
        context, n, size, own, lower, code = context[use], n[use], size[use], own[use], lower[use], code[use]
        m = len(level["keys"])
        mass = np.bincount(context, 10**own, m)
        lower_mass = np.bincount(context, 10**lower, m)
        good = (lower_mass < 1 - 1e-9) & (mass < 1 - 1e-9)
        back = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - lower_mass, 1e-12))
        rest = level["counts"] - np.bincount(context, n, m)
        gain = np.bincount(context, n * (own - lower), m) + rest * back
        cost = np.bincount(context, minlength=m) * np.log10(max(self.total, 10)) / 2
        level["kept"] = good & (gain > cost)
        level["back"] = np.where(level["kept"], back, 0.0)
        stay = level["kept"][context]
        level["pairs"], level["logs"] = code[stay], own[stay]

    def next_candidates(self, pairs: np.ndarray, counts: np.ndarray, p_min: float) -> None:
        """Contexts that are one word longer: the frequent (candidate, next word)."""
        use = counts >= max(p_min * self.total, 2)
        keys, level = pairs[use], self.levels[-1]
        context, word = np.divmod(keys, self.width)
        suffix = level["suffix"][context]
        if len(self.levels) == 1:
            own = self._find(level["keys"], word)
        else:
            own = self._find(self.levels[-1]["keys"], np.where(suffix >= 0, suffix * self.width + word, -1))
        whole = own >= 0
        self._level(keys[whole], counts[use][whole], own[whole])

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 per token; for a token that isn't common, what its root probability is multiplied by."""
        logs = np.where(ids >= 0, self.root[np.maximum(ids, 0)] if self.width else 0.0, 0.0)
        for level, context in zip(self.levels, self.contexts(ids, first)):
            at = np.flatnonzero((context >= 0) & level["kept"][np.maximum(context, 0)]) if len(level["kept"]) else []
            if len(at):
                state, own = context[at], ids[at]
                pair = self._find(level["pairs"], np.where(own >= 0, state * self.width + own, -1))
                logs[at] = np.where(pair >= 0, level["logs"][np.maximum(pair, 0)], level["back"][state] + logs[at])
        return logs


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = byte_rule(b"\t\n\v\f\r")


def _run_key(context: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
    """Keys of the runs of ``length`` words that consist of a context and a word."""
    context, word = context.view(np.uint64), word.view(np.uint64)
    key = (context ^ (context >> np.uint64(29))) * _MIX + word * np.uint64(2 * length + 1)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _zipped(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unzipped(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; it never falls while keys, read as unsigned, rise."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Shards that occur in a rising column, each with its rows."""
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(shard)]):
        yield int(shard[a]), slice(a, b)


class _Chunk:
    """Texts that are handled together: their tokens as codes of the distinct words, the most frequent first."""

    def __init__(self, batch: pa.RecordBatch):
        self.chunk = batch.column("rid")[0].as_py()
        self.doc_id, held = batch.column("doc_id"), batch.column("held_out")
        self.train = ~held.to_numpy(zero_copy_only=False).astype(bool)
        rows, codes, distinct = coded_words(batch.column("text"), _BLANK)
        self.sizes = (np.bincount(rows, minlength=batch.num_rows) + 1).astype(np.int32)
        self.text = np.repeat(np.arange(batch.num_rows, dtype=np.int32), self.sizes)
        all_codes = np.full(len(self.text), len(distinct), np.int32)
        is_word = np.ones(len(self.text), bool)
        is_word[np.cumsum(self.sizes) - 1] = False
        all_codes[is_word] = codes
        n = np.bincount(all_codes, minlength=len(distinct) + 1)
        by = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
        place = np.zeros(len(n), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.codes = place[all_codes]
        self.keys = hash_array(np.array([*distinct.to_pylist(), END], object), categorize=False)[by].view(np.int64)

    def counts(self) -> np.ndarray:
        """How often each distinct word occurs in training texts."""
        return np.bincount(self.codes[self.train[self.text]], minlength=len(self.keys))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    return (_Chunk(part) for part in text_slices(batches, "text", CHUNK_BYTES))


def _in_order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys.view(np.uint64), kind="stable")


def _word_parts(shards: int):
    """The distinct words of each chunk with their counts, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            by = _in_order(chunk.keys)
            keys, n = chunk.keys[by], chunk.counts()[by].astype(np.int32)
            rows = [(s, chunk.chunk, at.stop - at.start, _zipped(keys[at]), _zipped(n[at])) for s, at in _by_shard(_shards(keys, shards))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "chunk", "words", "keys", "n"])

    return run


_COUNTS = "shard int, chunk long, words int, n binary, total long, distinct long, keys array<long>, counts array<long>"
_COUNT_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _word_counts(shard: pa.Table) -> pa.Table:
    """The words' counts in all chunks, sent back to each chunk, and a row with the words that occur at least twice."""
    parts = shard.to_pylist()
    keys, at = np.unique(np.concatenate([_unzipped(p["keys"], np.int64, p["words"]) for p in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unzipped(p["n"], np.int32, p["words"]) for p in parts]), len(keys)).astype(np.int64)
    rows, done = [], 0
    for p in parts:
        rows.append((p["shard"], p["chunk"], p["words"], _zipped(n[at[done : done + p["words"]]]), None, None, None, None))
        done += p["words"]
    more = n >= 2
    rows.append((parts[0]["shard"], None, None, None, int(n.sum()), int(np.count_nonzero(n)), keys[more], n[more]))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _COUNT_TYPES)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def _fitted(context: np.ndarray, n: np.ndarray, lower: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts are retained, what each adds for words that it doesn't keep, which pairs are kept and their log probabilities.

    ``context`` numbers the pairs' contexts, ``size`` has a count for each of these.
    """
    m = len(size)
    own = np.log10((n - DISCOUNT) / size[context])
    use = np.abs(own - lower) >= np.log10(RATIO)
    c, k, o, w = context[use], n[use], own[use], lower[use]
    mass, lower_mass = np.bincount(c, 10**o, m), np.bincount(c, 10**w, m)
    back = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - lower_mass, 1e-12))
    gain = np.bincount(c, k * (o - w), m) + (size - np.bincount(c, k, m)) * back
    cost = np.bincount(c, minlength=m) * (np.log10(max(total, 10)) / 2)
    kept = (mass < 1 - 1e-9) & (lower_mass < 1 - 1e-9) & (gain > cost)
    return kept, np.where(kept, back, 0.0), use & kept[context], own


def _walked(levels: list[dict], word: np.ndarray, before: list[np.ndarray], there: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Log probabilities of tokens under their wide contexts, the length of the first context that isn't wide (0: none is left), and per level
    the rows, context keys and places of the wide contexts. ``before`` are the keys of the words before each token, the nearest first."""
    logs, length, met = logs.copy(), np.where(there[0], 1, 0).astype(np.int8), []
    for k, level in enumerate(levels, 1):
        rows = np.flatnonzero(length == k)
        key = before[k - 1][rows]
        for j in range(k - 2, -1, -1):
            key = _run_key(key, before[j][rows], k - j)
        at = places(level["keys"], key)
        rows, key, at = rows[at >= 0], key[at >= 0], at[at >= 0]
        met.append((rows, key, at, logs[rows]))
        pair = places(level["pairs"], _run_key(key, word[rows], k + 1)) if len(rows) else at
        own = np.where(pair >= 0, level["logs"][pair], 0.0) if len(level["pairs"]) else np.zeros(len(rows))
        logs[rows] = np.where(level["kept"][at], np.where(pair >= 0, own, level["back"][at] + logs[rows]), logs[rows])
        length[rows] = np.where(there[k][rows], k + 1, 0) if k < len(there) else 0
    return logs, length, met


def _before(chunk: _Chunk, far: int, frequent: np.ndarray) -> list[np.ndarray]:
    """Codes of the words 1 to ``far`` places before each token, -1 from the first that isn't frequent or lies in another text."""
    out, ok = [], np.ones(len(chunk.codes), bool)
    for k in range(1, far + 1):
        there = np.zeros(len(chunk.codes), bool)
        there[k:] = chunk.text[k:] == chunk.text[:-k] if k < len(chunk.text) else False
        code = np.roll(chunk.codes, k)
        ok = ok & there & frequent[code]
        out.append(np.where(ok, code, -1).astype(np.int32))
    return out


def _wide_pairs(shared, shards: int):
    """Counts of the words behind the wide contexts of the newest level in training texts, with the words' log probabilities under the shorter contexts, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, roots, levels = shared.value
        for chunk in _chunks(batches):
            at = places(words, chunk.keys)
            root = np.where(at >= 0, roots[at], 0.0)
            codes = _before(chunk, len(levels), at >= 0)
            there = [(c >= 0) & chunk.train[chunk.text] for c in codes]
            word = chunk.keys[chunk.codes]
            rows, context, _, lower = _walked(levels, word, [chunk.keys[c] for c in codes], there, root[chunk.codes])[2][-1]
            known = at[chunk.codes[rows]] >= 0
            rows, context, lower = rows[known], context[known], lower[known]
            key, first, n = np.unique(_run_key(context, word[rows], len(levels) + 1), return_index=True, return_counts=True)
            by = _in_order(key)
            key, first, n = key[by], first[by], n[by]
            parts = [{"shard": s, "pairs": at.stop - at.start, **{c: _zipped(x[at]) for c, x in zip(_PAIR, (key, n, context[first], lower[first]))}} for s, at in _by_shard(_shards(key, shards))]
            yield _rows(parts, _PAIR_PARTS)

    return run


_PAIR = {"key": np.int64, "n": np.int64, "context": np.int64, "lower": np.float64}
_PAIR_PARTS = "shard int, pairs int, key binary, n binary, context binary, lower binary"


def _pair_counts(least: float):
    def run(shard: pa.Table) -> pa.Table:
        parts = shard.to_pylist()
        key, n, context, lower = (np.concatenate([_unzipped(p[c], kind, p["pairs"]) for p in parts]) for c, kind in _PAIR.items())
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(key)).astype(np.int64)
        use = n >= least
        return pa.table([key[use], n[use], context[first][use], lower[first][use]], names=list(_PAIR))

    return run


def _wide_levels(docs: DataFrame, words: np.ndarray, counts: np.ndarray, size: float, total: int, depth: int, least: float, gamma: float, shards: int) -> list[dict]:
    """Model of the contexts that occur at least ``least`` times, level by level."""
    spark = docs.sparkSession
    levels, roots = [], np.log10((counts + 1) / size)
    keys, sizes = words[counts >= least], counts[counts >= least]
    while len(keys) and len(levels) < depth:
        none = {"keys": keys, "back": np.zeros(len(keys)), "kept": np.zeros(len(keys), bool), "pairs": np.zeros(0, np.int64), "logs": np.zeros(0)}
        shared = spark.sparkContext.broadcast((words, roots, [*levels, none]))
        parts = docs.mapInArrow(_wide_pairs(shared, shards), _PAIR_PARTS)
        found = parts.groupBy("shard").applyInArrow(_pair_counts(max(gamma * least, 2)), "key long, n long, context long, lower double").toArrow()
        key, n, context, lower = (found.column(c).to_numpy() for c in ("key", "n", "context", "lower"))
        at = places(keys, context)
        use = n >= np.maximum(gamma * sizes[at], 2)
        kept, back, pair, own = _fitted(at[use], n[use], lower[use], sizes, total)
        by = np.argsort(key[use][pair])
        levels.append({"keys": keys, "back": back, "kept": kept, "pairs": key[use][pair][by], "logs": own[pair][by]})
        deeper = np.flatnonzero(n >= least)
        deeper = deeper[np.argsort(key[deeper])]
        keys, sizes = key[deeper], n[deeper]
    return levels


_TOKENS = "chunk long, doc_id array<long>, train array<boolean>, sizes array<int>, tokens int, words int, codes binary, keys binary"
_PARTS = "shard long, piece int, chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, more array<double>, texts int, tokens int, words int, common int, ranks binary, keys binary, n binary, codes binary, owner binary"


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[t]) for c, t in columns], names=[c for c, _ in columns])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        yield _rows([{"chunk": c.chunk, "doc_id": c.doc_id.to_pylist(), "train": c.train, "sizes": c.sizes, "tokens": len(c.codes), "words": len(c.keys), "codes": _zipped(_planes(c.codes)), "keys": _zipped(c.keys)}], _TOKENS)


def _occurrences(shared, shards: int, depth: int, least: int, size: float):
    """Per chunk the sums that are known, and all tokens behind a frequent context, dealt by their shortest context that isn't wide."""

    def run(tokens: pa.Table, counted: pa.Table) -> pa.Table:
        levels, common, _ = shared.value
        row = tokens.to_pylist()
        if len(row) != 1:
            raise ValueError("the rows of the input changed their places between two reads")
        row = row[0]
        chunk = _Chunk.__new__(_Chunk)
        chunk.keys, chunk.codes = _unzipped(row["keys"], np.int64, row["words"]), _codes(row["codes"], row["tokens"])
        chunk.train, chunk.sizes = np.array(row["train"], bool), np.array(row["sizes"], np.int32)
        texts = len(chunk.sizes)
        chunk.text = np.repeat(np.arange(texts, dtype=np.int32), chunk.sizes)
        n = np.zeros(len(chunk.keys), np.int64)
        parts = sorted(counted.to_pylist(), key=lambda p: p["shard"])
        n[_in_order(chunk.keys)] = np.concatenate([_unzipped(p["n"], np.int64, p["words"]) for p in parts])
        root = np.log10((n + 1) / size)
        codes = _before(chunk, depth, n >= least)
        keys = [chunk.keys[c] for c in codes] if levels else codes
        base = root[chunk.codes]
        logs, length, _ = _walked(levels, chunk.keys[chunk.codes], keys, [c >= 0 for c in codes], base)
        done = length == 0
        out = [{
            "shard": (row["chunk"] + (row["chunk"] >> 33)) % shards, "chunk": row["chunk"], "doc_id": row["doc_id"], "held_out": ~chunk.train, "n_tokens": chunk.sizes.astype(np.int64), "texts": texts,
            "n_known": np.bincount(chunk.text, n[chunk.codes] > 0, texts).astype(np.int64), "base": np.bincount(chunk.text, base, texts), "more": np.bincount(chunk.text, np.where(done, logs - base, 0.0), texts),
        }]
        rows = np.flatnonzero(~done)
        key = chunk.keys[codes[0][rows]]
        for k in range(2, depth + 1):
            far = length[rows] >= k
            key[far] = _run_key(key[far], chunk.keys[codes[k - 1][rows[far]]], k)
        key = key.view(np.uint64) * _MIX
        shard = _shards((key ^ (key >> np.uint64(32))) * _MIX, shards * PIECES)
        by = np.lexsort((codes[0][rows], shard))
        rows, shard = rows[by], shard[by]
        # A word that occurs once makes no pair, so shards needn't know which it is. All others are named by rank or key.
        word = np.where(n[chunk.codes] >= 2, chunk.codes, -1)
        by = np.argsort(common)
        rank = places(common[by], chunk.keys)
        rank = np.where(rank >= 0, by[rank], len(common)) if len(common) else np.zeros(len(chunk.keys), np.int64)
        mark = np.zeros(len(chunk.keys), np.int32)
        owner = chunk.text * np.int32(2) + chunk.train[chunk.text].astype(np.int32)
        for s, at in _by_shard(shard):
            own = rows[at]
            columns = [word[own], *[c[own] for c in codes]]
            used = np.zeros(len(chunk.keys) + 1, bool)
            for c in columns:
                used[c] = True
            used = np.flatnonzero(used[:-1])
            used = used[np.argsort(rank[used], kind="stable")]
            ranks = rank[used].astype(np.int32)
            ranks = ranks[ranks < len(common)]
            rare = used[len(ranks) :]
            mark[used] = np.arange(len(used), dtype=np.int32)
            columns = np.stack([np.where(c >= 0, mark[c], -1) for c in columns]).astype(np.int32)
            out.append({
                "shard": s // PIECES, "piece": s % PIECES, "chunk": row["chunk"], "texts": texts, "tokens": len(own), "words": len(used), "common": len(ranks), "ranks": _zipped(_planes(np.diff(ranks, prepend=np.int32(0)))),
                "keys": _zipped(chunk.keys[rare]), "n": _zipped(n[rare]), "codes": _zipped(_planes(columns)), "owner": _zipped(_planes(owner[own])),
            })
        return pa.Table.from_batches([_rows(out, _PARTS)])

    return run


def _planes(codes: np.ndarray) -> np.ndarray:
    """The bytes of the 32-bit codes, all lowest bytes first, which packs closer."""
    return np.ascontiguousarray(codes.reshape(-1).view(np.uint8).reshape(-1, 4).T)


def _codes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unzipped(raw, np.uint8, 4 * n).reshape(4, -1).T).view(np.int32).reshape(-1)


def _piece(parts: list[dict], model: tuple, depth: int, least: int, gamma: float, size: float, total: int) -> np.ndarray:
    """Learns the contexts of a piece, shorter ones first; what they add to each text of the parts' chunks, one part after the other."""
    levels, common, counts = model
    keys, n = [], []
    for p in parts:
        ranks, rare = np.cumsum(_codes(p["ranks"], p["common"])), p["words"] - p["common"]
        keys += [common[ranks], _unzipped(p["keys"], np.int64, rare)]
        n += [counts[ranks], _unzipped(p["n"], np.int64, rare)]
    keys, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    n = np.concatenate(n)[first]
    codes, owner, train, done, texts = [], [], [], 0, 0
    for p in parts:
        here = np.append(at[done : done + p["words"]].astype(np.int32), np.int32(-1))
        codes.append(here[_codes(p["codes"], (depth + 1) * p["tokens"]).reshape(depth + 1, -1)])
        own = _codes(p["owner"], p["tokens"])
        train.append(own % 2 == 1)
        owner.append(own // 2 + texts)
        done, texts = done + p["words"], texts + p["texts"]
    word, *before = np.concatenate(codes, axis=1)
    owner, train = np.concatenate(owner), np.concatenate(train)
    del codes
    base = np.where(word >= 0, np.log10((n + 1) / size)[word], 0.0)
    logs, length = base.copy(), np.ones(len(word), np.int8)
    if levels:
        wide = np.flatnonzero((places(levels[0]["keys"], keys) >= 0)[before[0]])
        logs[wide], length[wide], _ = _walked(levels, np.where(word >= 0, keys[word], 0)[wide], [keys[b[wide]] for b in before], [b[wide] >= 0 for b in before], base[wide])
    width = len(keys)
    rows, context = np.arange(len(word)), before[0].astype(np.int64)
    for k in range(1, depth + 1):
        if k > 1:
            rows, context = rows[before[k - 1][rows] >= 0], context[before[k - 1][rows] >= 0]
            _, context = np.unique(context * width + before[k - 1][rows], return_inverse=True)
        if not len(rows):
            break
        sizes = np.bincount(context, train[rows])
        go = (sizes[context] >= least) | (length[rows] > k)
        rows, context = rows[go], context[go]
        fit = length[rows] <= k
        mine, under = rows[fit], context[fit]
        named = np.flatnonzero(word[mine] >= 0)
        pairs, some, at = np.unique(under[named] * width + word[mine[named]], return_index=True, return_inverse=True)
        some = named[some]
        n = np.bincount(at, train[mine[named]], len(pairs))
        use = np.flatnonzero(n >= np.maximum(gamma * sizes[under[some]], 2))
        kept, back, pair, own = _fitted(under[some[use]], n[use], logs[mine[some[use]]], np.maximum(sizes, 1), total)
        value = np.full(len(pairs), np.nan)
        value[use[pair]] = own[pair]
        logs_kept = np.full(len(mine), np.nan)
        logs_kept[named] = value[at]
        logs[mine] = np.where(np.isnan(logs_kept), logs[mine] + back[under], logs_kept)
    return np.bincount(owner, logs - base, texts)


def _learned(shared, depth: int, least: int, gamma: float, size: float, total: int):
    """What the contexts of a shard add to each text. Sums of chunks pass."""

    def run(shard: pa.Table) -> pa.Table:
        columns = ["chunk", "doc_id", "held_out", "n_tokens", "n_known", "base", "more"]
        known = pc.is_valid(shard.column("doc_id"))
        passing, sums = shard.filter(known).select(columns), {}
        shard = shard.filter(pc.invert(known)).select(["piece", "chunk", "texts", "tokens", "words", "common", "ranks", "keys", "n", "codes", "owner"])
        for k in range(PIECES):
            parts = shard.filter(pc.equal(shard.column("piece"), k)).to_pylist()
            if parts:
                more = np.split(_piece(parts, shared.value, depth, least, gamma, size, total), np.cumsum([p["texts"] for p in parts])[:-1])
                for p, x in zip(parts, more):
                    sums[p["chunk"]] = sums.get(p["chunk"], 0.0) + x
        return pa.concat_tables([passing, pa.Table.from_batches([_rows([{"chunk": c, "more": x} for c, x in sums.items()], _SUMS)], passing.schema)])

    return run


_SUMS = "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, more array<double>"


def _added(chunk: pa.Table) -> pa.Table:
    """The rows of a chunk's texts from its sums and those of the shards."""
    whole = chunk.filter(pc.is_valid(chunk.column("doc_id")))
    more = np.sum([x.values.to_numpy() for x in chunk.column("more")], axis=0)
    lists = {c: whole.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out", "n_tokens", "n_known", "base")}
    return pa.table([*lists.values(), pa.array(lists["base"].to_numpy() + more)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def scored(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, gamma: float = GAMMA, modulus: int = 7, held: int = 2, hot: float | None = None) -> DataFrame:
    """Every document's fold, token counts, base score and score; ``docs`` has ``doc_id`` and ``text``.

    ``hot`` is the share of the training tokens from which a context is wide; by default ``WIDE`` decides.
    """
    spark, least = docs.sparkSession, max(least, 2)
    held_out = F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(False))
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 + n_bytes // SHARD_BYTES
    parts = docs.mapInArrow(_word_parts(shards), "shard int, chunk long, words int, keys binary, n binary")
    counted = written(parts.groupBy("shard").applyInArrow(_word_counts, _COUNTS), "lm-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    size = float(total + distinct + 1)
    wide = max(WIDE if hot is None else hot * total, least)
    words = counted.where("chunk is null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("x.*")
    tally = np.array([(r["counts"], r["count"]) for r in words.groupBy("counts").count().collect()], np.int64).reshape(-1, 2)
    tally = tally[np.argsort(-tally[:, 0])]
    within = tally[np.cumsum(tally[:, 1]) <= COMMON, 0]
    seldom = within[-1] if len(within) else total + 1
    known = words.where(F.col("counts") >= float(min(max(gamma * wide, 2), seldom))).toArrow()
    keys, counts = (known.column(c).to_numpy() for c in ("keys", "counts"))
    by = np.argsort(keys)
    by = by[counts[by] >= gamma * wide]
    levels = _wide_levels(docs, keys[by], counts[by], size, total, depth, wide, gamma, shards)
    by = np.lexsort((keys, -counts))[: np.count_nonzero(counts >= seldom)]
    shared = spark.sparkContext.broadcast((levels, keys[by], counts[by]))
    chunks = docs.mapInArrow(_tokens, _TOKENS).groupBy("chunk").cogroup(counted.where("chunk is not null").select("shard", "chunk", "words", "n").groupBy("chunk"))
    dealt = chunks.applyInArrow(_occurrences(shared, shards, depth, least, size), _PARTS)
    sums = dealt.groupBy("shard").applyInArrow(_learned(shared, depth, least, gamma, size, total), _SUMS)
    out = sums.groupBy("chunk").applyInArrow(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
