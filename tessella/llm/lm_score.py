"""LM scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training documents: each task counts its own, sorts the keys
and sends one packed block per range of keys; a range's blocks are merged into exact counts in one task. Counts are
quantised on a log scale, and an n-gram with level q enters the filter once for each of 1..q. Every range builds
its own segment of the filter, of `bits` bits an entry whatever the size of the corpus; the number of ranges follows
from the bytes of the texts, so that a task's share is the same at every size. A count is read back by repeated
membership probes for levels 1, 2, ... up to the first miss, so errors are one-sided and fall off with each level.

`max_filter_bytes` bounds what is broadcast and decides on the way only, not on scores: up to it the segments together
are broadcast; beyond it the distinct words and pairs of each block of texts are dealt to the tasks that hold their
segments, and the levels found there go back to the block. The leading bits of a pair's key are those of its first
word, so a word and all pairs after it lie in one range; pairs after one of the words that are frequent in a uniform
sample of documents have leading bits of their own, so that no range is hot. The sample decides on places only.

The model, in quarters of a count: P(w | v) = d(v w) / D(v) + R(v) / D(v) * P(w), P(w) = (c(w) + 1) / (N + V + 1).
d is a pair's stored count less DISCOUNT (pairs seen at least `min_pair` times are stored), R(v) what all d after v leave
of c(v), rounded down to a level and stored as such, D(v) the largest count of c(v)'s level. As all come from stored
levels, the probabilities after any v sum to at most 1, but for false hits of the filter. Where v has no stored pair,
P(w | v) = P(w). The first word of a document follows the end token.

The base score is exact: the `head` most frequent words are broadcast with their exact counts (a fixed bound), words
beyond them are joined by hash, which is free of hot keys since they are rare.

Words are identified by 64-bit hashes. Defined results: null and empty texts are one end token; null ids hash like
the empty text; repeated rows count and are scored once each; without any training token N and V are 0, the
base is 0 and so is the score; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, crc_mod, mix, pick, text_blocks, word_hashes, written

HELD_MODULUS, HELD_REST = 7, 2
MIN_PAIR, LEVEL_BASE = 2, 2**0.25
#: Counts and what is made of them are kept in quarters, in which the discount is whole.
UNIT, DISCOUNT = 4, 3
BITS, HEAD, MAX_FILTER_BYTES = 14, 1_000_000, 256 << 20
FLUSH_TOKENS, RANGE_BYTES = 2_000_000, 16 << 20
HOT_SAMPLE, HOT_PART, HOT_WORDS = 2000, 0.002, 1000
END = np.uint64(0x656E640000000001)
_PAIR, _REST = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9FB21C651E98DF25)
#: The leading bits of a key say in which range it lies.
_LOW = np.uint64((1 << 40) - 1)
#: Distinct integers on the log scale: a count's level is how many of them do not exceed it.
STEPS = np.unique(np.ceil(LEVEL_BASE ** np.arange(248) - 1e-6).astype(np.int64))


def level(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """Levels counted from that of `least` on, which is 1; 0 for smaller counts."""
    return np.maximum(np.searchsorted(STEPS, counts, "right") - np.searchsorted(STEPS, least, "right") + 1, 0)


def floor_of(levels: np.ndarray, least: int = 1) -> np.ndarray:
    """The step that a level stands for; 0 for level 0."""
    at = np.searchsorted(STEPS, least, "right") - 2 + levels
    return np.where(levels > 0, STEPS[np.clip(at, 0, len(STEPS) - 1)], 0)


def most_of(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 for level 0."""
    return np.where(levels > 0, STEPS[np.clip(levels, 0, len(STEPS) - 1)] - 1, 0)


def tokens(buf, starts, lens) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all documents, each followed by the end token; where each document's begin with the total at the end)."""
    words, first = word_hashes(buf, starts, lens, NOT_SPACE)
    out = np.full(len(words) + len(starts), END, np.uint64)
    begin = first + np.arange(len(first))
    doc = np.repeat(np.arange(len(starts)), np.diff(first))
    out[np.arange(len(words)) + doc] = words
    return out, begin


def words_before(toks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    before = np.empty_like(toks)
    before[1:] = toks[:-1]
    before[begin[:-1]] = END
    return before


def pair_keys(before: np.ndarray, toks: np.ndarray, is_hot: np.ndarray) -> np.ndarray:
    keys = mix(before * _PAIR + toks)
    return np.where(is_hot, keys, (keys & _LOW) | (before & ~_LOW))


def rest_keys(words: np.ndarray) -> np.ndarray:
    """Keys of the rests of words, in the words' ranges."""
    return (mix(words ^ _REST) & _LOW) | (words & ~_LOW)


def rest_levels(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of words with their counts and the sums of what is stored after them, which leave DISCOUNT or more."""
    return level(UNIT * counts - sums, DISCOUNT)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """In the order of the keys, so that sorted keys are sorted by range."""
    return (((keys >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)


class Few:
    """Membership in a small set of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] = np.isin(keys[some], self.hashes)
        return out


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _frequent(batches: Iterator[pa.RecordBatch], part: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, starts, lens in text_blocks(batch.column(0)):
            keys, counts = np.unique(tokens(buf, starts, lens)[0], return_counts=True)
            keys = keys[counts >= part * counts.sum()]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["word"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[begin], np.diff(np.append(begin, len(values)))


_COUNTS = "range int, kind string, hashes binary, counts binary, owners binary, sizes binary"


def _count(batches: Iterator[pa.RecordBatch], ranges: int, hot: Few) -> Iterator[pa.RecordBatch]:
    """Blocks of (word hash, count) and (pair key, count), with the first words of the pairs as runs, by range."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush():
        toks, before = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        yield from send("w", *np.unique(toks, return_counts=True), None)
        pairs = pair_keys(before, toks, hot.of(before))
        del toks
        order = np.argsort(pairs)
        pairs, before = pairs[order], before[order]
        del order
        begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        yield from send("p", pairs[begin], np.diff(np.append(begin, len(pairs))), before[begin])

    def send(kind, keys, counts, owner):
        bounds = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(bounds)).tolist()
        rows = []
        for r in full:
            s = slice(bounds[r], bounds[r + 1])
            own, size = _runs(owner[s]) if owner is not None else (keys[:0], counts[:0])
            rows.append((_pack(keys[s]), _pack(counts[s].astype("<u4")), _pack(own), _pack(size.astype("<u4"))))
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(full[at : at + 256], pa.int32()), pa.array([kind] * len(some)), *(pa.array(c, pa.binary()) for c in zip(*some, strict=True))], ["range", "kind", "hashes", "counts", "owners", "sizes"])

    for batch in batches:
        for _, buf, starts, lens in text_blocks(batch.column(0)):
            toks, begin = tokens(buf, starts, lens)
            held.append((toks, words_before(toks, begin)))
            n += len(toks)
            if n >= FLUSH_TOKENS:
                yield from flush()
                n = 0
    if n:
        yield from flush()


#: Fixed by a rule: sets of five of 64 bits.
_MASKS = np.bitwise_or.reduce(np.uint64(1) << np.random.default_rng(5).integers(0, 64, (1 << 16, 5), dtype=np.uint64), axis=1)


class LogBloom:
    """Segments of a Bloom filter by range of keys; each holds every (key, 1..level).

    An entry sets five bits of one 64-bit cell, so a probe is one look.
    """

    def __init__(self, segments: list[np.ndarray], most: int = 255):
        self.most = most  # no key has a higher level
        self.cells = np.array([len(s) for s in segments], np.uint64)
        self.offset = np.append(0, np.cumsum([len(s) for s in segments]))[:-1].astype(np.int64)
        self.data = np.concatenate(segments) if segments else np.zeros(0, np.uint64)

    @staticmethod
    def _place(keys: np.ndarray, levels: np.ndarray | int, cells) -> tuple[np.ndarray, np.ndarray]:
        """(cell, mask) of an entry. cells is below 2^32."""
        h = keys + np.asarray(levels).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return (((h >> np.uint64(32)) * cells) >> np.uint64(32)).astype(np.int64), _MASKS[(h & np.uint64(0xFFFF)).astype(np.int64)]

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray, nbytes: int) -> np.ndarray:
        cells = min(max(1, nbytes // 8), (1 << 32) - 1)
        out = np.zeros(cells, np.uint64)
        todo = levels.astype(np.int64)
        while (live := todo > 0).any():
            keys, todo = keys[live], todo[live]
            at, mask = cls._place(keys, todo, np.uint64(cells))
            np.bitwise_or.at(out, at, mask)
            todo = todo - 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The levels of keys; sorted keys go through the filter from one segment to the next."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.data):
            return out
        part = _range_of(keys, len(self.cells))
        cells, base = self.cells[part], self.offset[part]
        live = np.flatnonzero(cells > 0)
        if len(live) < len(keys):
            keys, cells, base = keys[live], cells[live], base[live]
        for q in range(1, self.most + 1):  # most keys go at the first probes
            at, mask = self._place(keys, q, cells)
            hit = np.flatnonzero((self.data[base + at] & mask) == mask)
            if not len(hit):
                break
            live, keys, cells, base = live[hit], keys[hit], cells[hit], base[hit]
            out[live] = q
        return out


def _merged(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, first words) of sorted blocks; the sort is one of runs that are in order."""
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys = np.concatenate([np.frombuffer(h, np.uint64) for h, *_ in blocks])
    counts = np.concatenate([np.frombuffer(c, "<u4") for _, c, *_ in blocks]).astype(np.int64)
    owners = np.concatenate([np.repeat(np.frombuffer(o, np.uint64), np.frombuffer(s, "<u4")) for *_, o, s in blocks])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin], np.add.reduceat(counts, begin), owners[order][begin] if len(owners) else owners


_BUILT = "range int, words binary, counts binary, keys binary, levels binary, entries long, tokens long, kinds long, hot array<struct<word:long,count:long,sum:long>>"


def _build(batches: Iterator[pa.RecordBatch], min_pair: int, hot: Few) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range: exact counts of its words, the entries of its segment, and what it knows of hot words."""
    current, held = None, {"w": [], "p": []}
    struct = pa.list_(pa.struct([("word", pa.int64()), ("count", pa.int64()), ("sum", pa.int64())]))

    def done():
        words, counts, _ = _merged(held["w"])
        pairs, seen, owners = _merged(held["p"])
        stay = seen >= min_pair
        pairs, seen, owners = pairs[stay], seen[stay], owners[stay]
        q = level(seen, min_pair)
        own, back = np.unique(owners, return_inverse=True)
        sums = np.bincount(back, weights=UNIT * floor_of(q, min_pair) - DISCOUNT, minlength=len(own)).astype(np.int64)
        is_hot = hot.of(own)
        cold = ~is_hot  # they themselves and all of their pairs are here
        keys = np.concatenate([words, pairs, rest_keys(own[cold])])
        levels = np.concatenate([level(counts), q, rest_levels(counts[np.searchsorted(words, own[cold])], sums[cold])])
        told = [{"word": int(w), "count": 0, "sum": int(s)} for w, s in zip(own[is_hot].view(np.int64), sums[is_hot], strict=True)]
        here = hot.of(words)
        told += [{"word": int(w), "count": int(c), "sum": 0} for w, c in zip(words[here].view(np.int64), counts[here], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([_pack(words)]), pa.array([_pack(counts)]), pa.array([_pack(keys)]), pa.array([_pack(levels.astype(np.uint8))]), pa.array([int(levels.sum())]), pa.array([int(counts.sum())]), pa.array([len(words)]), pa.array([told], struct)],
            ["range", "words", "counts", "keys", "levels", "entries", "tokens", "kinds", "hot"],
        )

    for batch in batches:
        for part, kind, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is not None and part != current:
                yield from done()
                held = {"w": [], "p": []}
            current = part
            held[kind].append(block)
    if current is not None:
        yield from done()


def _segments(batches: Iterator[pa.RecordBatch], bits: float, ranges: int, more: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """more: keys and levels of the rests of hot words."""
    place = _range_of(more[0], ranges)
    for batch in batches:
        for part, keys, levels in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "levels")), strict=True):
            keys = np.concatenate([np.frombuffer(keys, np.uint64), more[0][place == part]])
            levels = np.concatenate([np.frombuffer(levels, np.uint8), more[1][place == part]]).astype(np.int64)
            made = LogBloom.segment(keys, levels, int(levels.sum() * bits / 8))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made.tobytes()])], ["range", "segment"])


def _by_count(batches: Iterator[pa.RecordBatch], least: int, most: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            w, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
            stay = (c >= least) & (c <= most if most is not None else True)
            yield pa.RecordBatch.from_arrays([pa.array(w[stay].view(np.int64)), pa.array(c[stay])], ["word", "count"])


class Asked(NamedTuple):
    """What documents ask of the filter: distinct tokens and pairs, sorted, and where each token, the one before it and its pair are there."""

    word: np.ndarray
    back: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    pair_back: np.ndarray
    pair_before: np.ndarray

    @classmethod
    def of(cls, toks: np.ndarray, begin: np.ndarray, hot: Few) -> Asked:
        word, back = _distinct(toks)
        before = np.append(0, back[:-1])
        before[begin[:-1]] = np.searchsorted(word, END)
        pair, pair_back = _distinct(pair_keys(word[before], toks, hot.of(word)[before]))
        pair_before = np.empty(len(pair), np.int64)
        pair_before[pair_back] = before
        return cls(word, back, before, pair, pair_back, pair_before)

    def dealt(self, ranges: int) -> Iterator[tuple[int, slice, slice]]:
        """(range, its words, its pairs), both as slices, for each range that is asked."""
        parts = [_range_of(x, ranges) for x in (self.word, self.pair)]
        bounds = [np.searchsorted(p, np.arange(ranges + 1)) for p in parts]
        for r in np.unique(np.concatenate(parts)).tolist():
            yield r, *(slice(b[r], b[r + 1]) for b in bounds)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and where each value is there."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(values) else np.zeros(0, bool)
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


class Levels(NamedTuple):
    """Of the distinct tokens: their counts and what is left of them; and of the distinct pairs."""

    word: np.ndarray
    rest: np.ndarray
    pair: np.ndarray

    @classmethod
    def read(cls, bloom: LogBloom, word: np.ndarray, pair: np.ndarray, pair_before: np.ndarray | None = None) -> Levels:
        """pair_before: where the words before the pairs are; nothing is stored after words without a rest."""
        rest = bloom.levels(rest_keys(word))
        live = np.flatnonzero(rest[pair_before]) if pair_before is not None else slice(None)
        found = np.zeros(len(pair), np.int64)
        found[live] = bloom.levels(pair[live])
        return cls(bloom.levels(word), rest, found)


class Model:
    def __init__(self, bloom: LogBloom | None, hot: Few, total: int, kinds: int, words: np.ndarray, counts: np.ndarray, min_pair: int):
        self.bloom, self.hot, self.total, self.kinds, self.min_pair = bloom, hot, total, kinds, min_pair
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.words, keys)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == keys, self.counts[at], 0)

    def probabilities(self, asked: Asked, levels: Levels) -> np.ndarray:
        """Of tokens after others, by what the filter says alone."""
        one = (floor_of(levels.word) + 1) / (self.total + self.kinds + 1)
        known = (levels.rest > 0) & (levels.word > 0)
        whole = np.where(known, UNIT * most_of(levels.word), 1)
        rest = np.minimum(floor_of(levels.rest, DISCOUNT), whole)
        seen = np.where(levels.pair > 0, UNIT * floor_of(levels.pair, self.min_pair) - DISCOUNT, 0)
        seen = np.where(known[asked.pair_before], np.minimum(seen, (whole - rest)[asked.pair_before]) / whole[asked.pair_before], 0.0)
        return seen[asked.pair_back] + np.where(known, rest / whole, 1.0)[asked.before] * one[asked.back]

    def scored(self, docs: pa.RecordBatch, toks: np.ndarray, begin: np.ndarray, asked: Asked, levels: Levels, with_rare: bool) -> pa.RecordBatch:
        log_norm = np.log10(self.total + self.kinds + 1)
        exact = self.exact(asked.word)
        base = np.add.reduceat((np.log10(exact + 1) - log_norm)[asked.back], begin[:-1])
        unseen = (exact == 0)[asked.back]
        known = np.add.reduceat((~unseen).astype(np.int64), begin[:-1])
        full = np.add.reduceat(np.log10(self.probabilities(asked, levels)), begin[:-1])
        unseen &= with_rare
        at = np.append(0, np.cumsum(unseen))[begin].astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(at), pa.array(toks[unseen].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [docs.column("doc_id"), docs.column("held_out"), pa.array(np.diff(begin)), pa.array(known), pa.array(base), pa.array(full), rare],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
        )


# ---- a filter that is not broadcast: questions go to its segments ------------------------------


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: the block as an Arrow stream."""
    for batch in batches:
        for row, _, starts, _ in text_blocks(batch.column("text")):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(row, len(starts)))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["docs"])


def _home(docs: bytes, hot: Few) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, Asked]:
    batch = pa.ipc.open_stream(docs).read_next_batch()
    _, buf, starts, lens = next(text_blocks(batch.column("text"), 1 << 40))
    toks, begin = tokens(buf, starts, lens)
    return batch, toks, begin, Asked.of(toks, begin, hot)


def _ask(batches: Iterator[pa.RecordBatch], ranges: int, hot: Few) -> Iterator[pa.RecordBatch]:
    """The distinct words and pairs of each block by range; kind 1, as they come after the segment of the range."""
    for batch in batches:
        for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            *_, asked = _home(docs, hot)
            parts, words, pairs = zip(*((r, _pack(asked.word[w]), _pack(asked.pair[p])) for r, w, p in asked.dealt(ranges)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([1] * len(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(words, pa.binary()), pa.array(pairs, pa.binary())], ["range", "kind", "block", "one", "two"])


def _answer(batches: Iterator[pa.RecordBatch], ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and kind: the segment of the range, then what blocks ask of it."""
    current, made = None, LogBloom([])

    def told(rows: list[tuple]):
        word, pair = (np.frombuffer(b"".join(r[k] for r in rows), np.uint64) for k in (1, 2))
        found = Levels.read(made, word, pair)
        w, p = (np.append(0, np.cumsum([len(r[k]) // 8 for r in rows])) for k in (1, 2))
        levels = [np.concatenate([found.word[a:b], found.rest[a:b], found.pair[c:d]]).astype(np.uint8).tobytes() for a, b, c, d in zip(w[:-1], w[1:], p[:-1], p[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([current] * len(rows), pa.int32()), pa.array(levels, pa.binary())], ["block", "range", "data"])

    for batch in batches:
        rows = []
        for part, kind, block, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != current:
                if rows:
                    yield told(rows)
                current, made, rows = part, LogBloom([]), []
            if kind == 0:
                empty = np.zeros(0, np.uint64)
                made = LogBloom([empty] * part + [np.frombuffer(one, np.uint64)] + [empty] * (ranges - part - 1), most)
            else:
                rows.append((block, one, two))
        if rows:
            yield told(rows)


def _gather(batches: Iterator[pa.RecordBatch], sent, ranges: int, with_rare: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and range: the block's documents (range -1), then the levels from each range."""
    m, docs, found = sent.value, None, {}

    def done():
        batch, toks, begin, asked = _home(docs, m.hot)
        levels = Levels(*(np.zeros(len(x), np.int64) for x in (asked.word, asked.word, asked.pair)))
        for r, w, p in asked.dealt(ranges):
            told, n = np.frombuffer(found[r], np.uint8), w.stop - w.start
            levels.word[w], levels.rest[w], levels.pair[p] = told[:n], told[n : 2 * n], told[2 * n :]
        return m.scored(batch, toks, begin, asked, levels, with_rare)

    for batch in batches:
        for part, data in zip(batch.column("range").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if part < 0:
                if docs is not None:
                    yield done()
                docs, found = data, {}
            else:
                found[part] = data
    if docs is not None:
        yield done()


def score_texts(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", min_pair: int = MIN_PAIR, head: int = HEAD, bits: float = BITS, max_filter_bytes: int = MAX_FILTER_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a condition on doc_id."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col)
    held = held_out if held_out is not None else crc_mod("doc_id", HELD_MODULUS) == HELD_REST
    kind = texts.schema["doc_id"].dataType.simpleString()
    train = texts.where(~held).select("text")
    rows, nbytes = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    ranges = max(1, -(-nbytes // range_bytes))
    sample = train.sample(min(1.0, HOT_SAMPLE / max(rows, 1)), seed=11).mapInArrow(lambda it: _frequent(it, HOT_PART), "word long")
    sample = sample.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    hot = Few(np.array([r["word"] for r in sample.collect()], np.int64).view(np.uint64))  # HOT_WORDS rows
    blocks = train.mapInArrow(lambda it: _count(it, ranges, hot), _COUNTS).repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    built = written(blocks.mapInArrow(lambda it: _build(it, min_pair, hot), _BUILT), "lm-counts")
    total, kinds, entries = (x or 0 for x in built.agg(F.sum("tokens"), F.sum("kinds"), F.sum("entries")).first())
    told = built.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.count").alias("count"), F.sum("h.sum").alias("sum")).where("sum > 0").collect()  # HOT_WORDS rows
    more = rest_keys(np.array([r["word"] for r in told], np.int64).view(np.uint64)), rest_levels(*(np.array([r[c] for r in told], np.int64) for c in ("count", "sum")))
    entries += int(more[1].sum())
    most = int(level(np.array([UNIT * max(total, 1)]))[0]) + 1
    whole = entries * bits / 8 <= max_filter_bytes  # decides on the way only
    segments = built.select("range", "keys", "levels").mapInArrow(lambda it: _segments(it, bits, ranges, more), "range int, segment binary")
    bloom = None
    if whole:
        made = {r["range"]: np.frombuffer(bytes(r["segment"]), np.uint64) for r in segments.toLocalIterator()}  # max_filter_bytes
        bloom = LogBloom([made.pop(r, np.zeros(0, np.uint64)) for r in range(ranges)], most)
    least = 1
    if kinds > head:  # the smallest count whose words, and all more frequent ones, fit the head
        by_level = built.mapInArrow(lambda it: _by_count(it, 1, None), "word long, count long").groupBy(F.floor(F.log2("count")).alias("q")).agg(F.count(F.lit(1)).alias("n"))
        room, least = head, 1 << 62
        for r in sorted(by_level.collect(), key=lambda r: -r["q"]):  # a row for each power of two
            room -= r["n"]
            if room < 0:
                break
            least = 1 << r["q"]
    frequent = built.mapInArrow(lambda it, least=least: _by_count(it, least, None), "word long, count long").toArrow()  # head rows at most
    model = Model(bloom, hot, total, kinds, frequent["word"].to_numpy().view(np.uint64), frequent["count"].to_numpy(), min_pair)
    sent = spark.sparkContext.broadcast(model)
    del frequent, model, bloom

    with_rare = least > 1

    def score(batches):
        m = sent.value
        for batch in batches:
            for row, buf, starts, lens in text_blocks(batch.column("text")):
                toks, begin = tokens(buf, starts, lens)
                asked = Asked.of(toks, begin, m.hot)
                levels = Levels.read(m.bloom, asked.word, asked.pair, asked.pair_before)
                yield m.scored(batch.slice(row, len(starts)), toks, begin, asked, levels, with_rare)

    columns = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    marked = texts.withColumn("held_out", held)
    if whole:
        scored = marked.mapInArrow(score, columns)
    else:
        homes = written(marked.mapInArrow(_homes, "docs binary").withColumn("block", F.monotonically_increasing_id()), "lm-texts")
        asks = homes.mapInArrow(lambda it: _ask(it, ranges, hot), "range int, kind int, block long, one binary, two binary")
        asks = asks.union(segments.select("range", F.lit(0), F.lit(0).cast("long"), "segment", F.lit(b"")))
        answers = asks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "kind").mapInArrow(lambda it: _answer(it, ranges, most), "block long, range int, data binary")
        answers = answers.union(homes.select("block", F.lit(-1), "docs")).repartition(ranges, "block").sortWithinPartitions("block", "range")
        scored = answers.mapInArrow(lambda it: _gather(it, sent, ranges, with_rare), columns)
    if least > 1:  # words beyond the head: their share of the base is added by a join
        scored = written(scored.withColumn("at", F.monotonically_increasing_id()), "lm-scored")
        tail = built.mapInArrow(lambda it: _by_count(it, 1, least - 1), "word long, count long")
        extra = scored.select("at", F.explode("rare").alias("word")).groupBy("at", "word").agg(F.count(F.lit(1)).alias("tf")).join(tail, "word")
        extra = extra.groupBy("at").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("count") + 1)).alias("gain"))
        scored = scored.join(extra, "at", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("gain", F.lit(0.0))})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every pair is stored, those seen once too."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_pair=1)


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLES: dict[str, str] = {}
