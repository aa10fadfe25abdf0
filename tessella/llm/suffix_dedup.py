"""Suffix-array dedup: bytes covered by a string of `size` bytes that starts anywhere else are removed.

Only suffixes that can matter are sorted. A window of `size` bytes has an anchor: where the smallest hash of its
SEED-byte seeds lies (the first such place). Equal windows have equal seeds at their anchors, so

1. every run of windows with one anchor is a row (seed hash, hash of the whole run); seeds that occur once drop out
   in one aggregation;
2. runs whose seed and content repeat are removed whole;
3. one representative of each of the other runs that share a seed with a different run sends its windows: suffixes,
   each a key of PREFIX leading bytes and a hash of the window. Partitions sort them into runs, one for each hash of
   the seed and its place in the window, which equal windows share, and exchange them front-coded (bytes shared with
   the key before are not sent). A seed of very many runs is spread further, by the leading bytes. Each part is
   combined by a tournament of losers that keeps, for every contender, how many words it shares with the last
   winner; words known to be shared are never compared again, and windows found twice are reported to their runs;
4. spans go to their documents, are merged, and the bytes are cut.

The tournament runs in lockstep over many slices of a part, one NumPy operation for all slices.

Windows are told apart by 64-bit hashes within equal leading bytes, runs by two 64-bit hashes.

Defined results: null texts are empty; texts shorter than `size` lose nothing; rows with null ids are treated like
others; repeated rows are copies of each other, so all of their covered bytes go; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, broadcast_if_light, broadcast_if_small, mix, pick, powers, prefix_hash, text_blocks, written

SIZE, SEED, PREFIX = 200, 64, 8
SEED_ROWS, BROADCAST_BYTES = 1_500_000, 48 << 20
#: Classes of a seed from which on it is spread over more parts, and windows of a seed that go to one part.
SPREAD_CLASSES, PLACES = 20_000, 16
LANES = 4096
RUN_WINDOWS = 500_000
#: Windows that meet in one merge, on average.
PART_WINDOWS = 1_000_000
_POS = np.uint64((1 << 24) - 1)


def anchored_runs(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, size: int = SIZE, seed: int = SEED):
    """(document, first window, windows, anchor's distance from the first window, seed hash, content hash) of the runs of windows that share an anchor."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n, width = len(buf), size - seed + 1
    if n < size or not (lens >= size).any():
        return none
    if n > int(_POS):  # a very long text: blocks that overlap by a window
        parts = []
        for d, (s, length) in enumerate(zip(starts.tolist(), lens.tolist(), strict=True)):
            step = int(_POS) - size
            for at in range(0, max(length - size + 1, 0), step):
                piece = buf[s + at : s + min(length, at + step + size - 1)]
                r = anchored_runs(piece, np.zeros(1, np.int64), np.array([len(piece)]), size, seed)
                parts.append((np.full(len(r[0]), d), r[1] + at, *r[2:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
    p = prefix_hash(BYTE_CODE[buf])
    _, down = powers(n + 1)
    h = mix((p[seed:] - p[:-seed]) * down[: n - seed + 1])
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: span - width], low[width - span :])
    anchor = (low & _POS).astype(np.int64)
    windows = len(anchor)
    long = lens >= size
    edge = np.zeros(windows + 1, np.int64)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, np.minimum((starts + lens - size + 1)[long], windows), -1)
    inside = np.cumsum(edge[:windows]) > 0
    new = np.ones(windows, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(inside & new)
    full = np.flatnonzero(lens > 0)
    doc = full[np.searchsorted(starts[full], first, "right") - 1]
    count = np.minimum(np.append(first[1:], windows), (starts + lens - size + 1)[doc]) - first
    a = anchor[first]
    content = mix((p[first + count - 1 + size] - p[first]) * down[first] + mix((count + ((a - first) << 32)).astype(np.uint64)))
    return doc, first - starts[doc], count, a - first, h[a], content


_RUNS = "doc_id {}, text_key long, seed long, content long, first long, windows int, anchor int"


def _scan(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts, lens in text_blocks(batch.column("text"), 1 << 19):
            doc, first, count, anchor, g, c = anchored_runs(buf, starts, lens, size, seed)
            at = pa.array(row + doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first), pa.array(count.astype(np.int32)), pa.array(anchor.astype(np.int32))],
                ["doc_id", "text_key", "seed", "content", "first", "windows", "anchor"],
            )


# ---- front-coded runs and the tournament of losers ---------------------------------------------


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """keys: sorted rows of bytes. (bytes shared with the row before, the other bytes)."""
    n, width = keys.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    tail = keys[np.arange(width)[None, :] >= shared[:, None]]
    return shared.tobytes(), tail.tobytes()


def front_decode(shared: bytes, tail: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, bytes shared with the row before)."""
    shared = np.frombuffer(shared, np.uint8)
    sent = np.arange(width)[None, :] >= shared[:, None]
    keys = np.zeros(sent.shape, np.uint8)
    keys[sent] = np.frombuffer(tail, np.uint8)
    at = np.arange(len(shared))
    for j in range(width):
        keys[:, j] = keys[np.maximum.accumulate(np.where(sent[:, j], at, 0)), j]
    return keys, shared


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], lanes: int = LANES) -> np.ndarray:
    """Merge sorted runs of rows of 64-bit words. runs: (words, number of words shared with the row before).

    Returns, in merged order, (run, row, words shared with the row before it in the merged order) as columns.
    A loser's entry keeps the words it shares with the last winner of its match; a contender that shares more with
    the last output than its rival is the smaller without a look, and equal shares are compared from there on only.
    """
    k = len(runs)
    width = runs[0][0].shape[1]
    total = sum(len(w) for w, _ in runs)
    if not total:
        return np.zeros((0, 3), np.int64)
    size = 1 << max(1, (k - 1).bit_length())
    base = np.append(0, np.cumsum([len(w) for w, _ in runs]))
    words = np.concatenate([w for w, _ in runs] + [np.full((1, width), ~np.uint64(0))])
    share = np.concatenate([s.astype(np.int64) for _, s in runs] + [np.zeros(1, np.int64)])
    # Slices: splitters from all runs together, at whole keys.
    as_bytes = [np.ascontiguousarray(w.astype(">u8")).view(f"S{8 * width}").ravel() for w, _ in runs]
    lanes = max(1, min(lanes, total // 64))
    seen = np.sort(np.concatenate([b[:: max(1, total // (16 * lanes))] for b in as_bytes]))
    cuts = np.unique(seen[np.linspace(0, len(seen) - 1, lanes + 1).astype(np.int64)[1:-1]])
    lanes = len(cuts) + 1
    at = np.zeros((size, lanes), np.int64)
    end = np.zeros((size, lanes), np.int64)
    for r, (w, _) in enumerate(runs):
        mark = np.concatenate([[0], np.searchsorted(as_bytes[r], cuts, "left"), [len(w)]]) + base[r]
        at[r], end[r] = mark[:-1], mark[1:]
    sentinel, lane = total, np.arange(lanes)
    front = np.where(at < end, at, sentinel)

    def play(row_a, share_a, row_b, share_b):
        """Who of two contenders is smaller, and the words that they share with each other."""
        less = share_a > share_b
        common = np.minimum(share_a, share_b)
        open_ = share_a == share_b
        for j in range(width):
            here = np.flatnonzero(open_ & (common == j))
            if not len(here):
                continue
            x, y = words[row_a[here], j], words[row_b[here], j]
            same = x == y
            common[here[same]] = j + 1
            less[here] = x < y
            open_[here[~same]] = False
        less |= open_ & (common == width)
        # ended runs lose to all others
        less = np.where(row_a == sentinel, False, less | (row_b == sentinel))
        return less, np.where((row_a == sentinel) | (row_b == sentinel), 0, common)

    loser_run = np.zeros((size, lanes), np.int64)
    loser_share = np.zeros((size, lanes), np.int64)
    winner = np.broadcast_to(np.arange(size)[:, None], (size, lanes)).copy()
    shares = np.zeros((size, lanes), np.int64)
    level, winners = size, winner
    while level > 1:  # the first tournament: nothing is known to be shared
        a, b = winners[0::2], winners[1::2]
        nxt = np.zeros((level // 2, lanes), np.int64)
        for m in range(level // 2):
            less, common = play(front[a[m], lane], shares[m], front[b[m], lane], shares[m])
            nxt[m] = np.where(less, a[m], b[m])
            loser_run[level // 2 + m], loser_share[level // 2 + m] = np.where(less, b[m], a[m]), common
        level, winners = level // 2, nxt
    top, top_share = winners[0], np.zeros(lanes, np.int64)
    out_row, out_share, out_lane = [], [], []
    while True:
        row = front[top, lane]
        live = np.flatnonzero(row != sentinel)
        if not len(live):
            break
        if len(live) * 2 < len(lane):  # slices that are done leave
            front, at, end, loser_run, loser_share = front[:, live], at[:, live], end[:, live], loser_run[:, live], loser_share[:, live]
            top, top_share, row, lane_ids = top[live], top_share[live], row[live], (lane_ids if out_lane else np.arange(lanes))[live]
            lane = np.arange(len(live))
            live = lane
        elif not out_lane:
            lane_ids = np.arange(lanes)
        out_row.append(row[live]), out_share.append(top_share[live]), out_lane.append(lane_ids[live])
        at[top, lane] += row != sentinel
        nxt = at[top, lane]
        alive = nxt < end[top, lane]
        front[top, lane] = np.where(alive, nxt, sentinel)
        cur, cur_share = top, np.where(alive, share[np.where(alive, nxt, sentinel)], 0)
        node = (cur + size) >> 1
        while node[0] > 0 if len(node) else False:
            rival, rival_share = loser_run[node, lane], loser_share[node, lane]
            less, common = play(front[cur, lane], cur_share, front[rival, lane], rival_share)
            loser_run[node, lane] = np.where(less, rival, cur)
            # an undecided match fixes what the loser shares with the winner; else the loser keeps its share
            loser_share[node, lane] = common
            cur, cur_share = np.where(less, cur, rival), np.where(less, cur_share, rival_share)
            node = node >> 1
        top, top_share = cur, cur_share
    rows, shared, lanes_of = np.concatenate(out_row), np.concatenate(out_share), np.concatenate(out_lane)
    order = np.argsort(lanes_of, kind="stable")
    rows, shared, lanes_of = rows[order], shared[order], lanes_of[order]
    shared[np.append(True, lanes_of[1:] != lanes_of[:-1])] = 0
    run = np.searchsorted(base, rows, "right") - 1
    return np.stack([run, rows - base[run], shared], axis=1)


_SUFFIXES = "part int, shared binary, tails binary, owners binary"


def _asked(first, windows, anchor, spread) -> Column:
    """What is asked of a document, in one number: 32 bits, 12, 12 and 7."""
    return first.bitwiseOR(F.shiftleft(windows.cast("long"), 32)).bitwiseOR(F.shiftleft(anchor.cast("long"), 44)).bitwiseOR(F.shiftleft(spread.cast("long"), 56))


def _suffix_runs(batches: Iterator[pa.RecordBatch], size: int, seed: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs of the asked windows by part; owners: run number (negative: no answer is needed), window."""
    held: list[tuple] = []
    n = 0

    def flush():
        pre, fp, part, owner, win = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((fp, pre, part))
        pre, fp, part, owner, win = pre[order], fp[order], part[order], owner[order], win[order]
        keys = np.stack([pre, fp], axis=1)
        bounds = np.searchsorted(part, np.arange(parts + 1))
        for b in range(parts):
            s = slice(bounds[b], bounds[b + 1])
            if s.start == s.stop:
                continue
            shared, tails = front_code(np.ascontiguousarray(keys[s]).astype(">u8").view(np.uint8).reshape(-1, 16))
            owners = owner[s].astype("<i8").tobytes() + win[s].astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shared], pa.binary()), pa.array([tails], pa.binary()), pa.array([owners], pa.binary())], ["part", "shared", "tails", "owners"])

    for batch in batches:
        numbers, asked = batch.column("numbers"), batch.column("asked")
        for row, buf, starts, lens in text_blocks(batch.column("text"), 1 << 19):
            p = prefix_hash(BYTE_CODE[buf])
            _, down = powers(len(buf) + 1)
            per_row = pc.list_value_length(asked.slice(row, len(starts))).to_numpy(zero_copy_only=False)
            number, ask = numbers.slice(row, len(starts)).flatten().to_numpy(zero_copy_only=False), asked.slice(row, len(starts)).flatten().to_numpy(zero_copy_only=False)
            first = np.repeat(starts, per_row) + (ask & 0xFFFFFFFF)
            count, anchor, spread = (ask >> 32) & 0xFFF, (ask >> 44) & 0xFFF, ask >> 56
            g = mix((p[first + anchor + seed] - p[first + anchor]) * down[first + anchor])
            win = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(first, count) + win
            fp = mix((p[at + size] - p[at]) * down[at])
            pre = np.ascontiguousarray(buf[at[:, None] + np.arange(PREFIX)[None, :]]).view(">u8").ravel().astype(np.uint64)
            place = ((np.repeat(anchor, count) - win) // PLACES).astype(np.uint64)
            more = (mix(pre) & ((np.uint64(1) << np.repeat(spread, count).astype(np.uint64)) - np.uint64(1)))
            part = (mix(np.repeat(g, count) + place + (more << np.uint64(16))) % np.uint64(parts)).astype(np.int32)
            held.append((pre, fp, part, np.repeat(number, count), win))
            n += len(at)
            if n >= RUN_WINDOWS:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: merge the runs of each and report (run number, first window, windows) found twice."""
    current, runs = None, []

    def done():
        decoded, owners, wins = [], [], []
        for shared, tails, own in runs:
            keys, same = front_decode(shared, tails, 16)
            decoded.append((np.ascontiguousarray(keys).view(">u8").astype(np.uint64), np.minimum(same // 8, 2)))
            m = len(keys)
            owners.append(np.frombuffer(own[: 8 * m], "<i8")), wins.append(np.frombuffer(own[8 * m :], "<u2").astype(np.int64))
        base = np.append(0, np.cumsum([len(o) for o in owners]))
        owners, wins = np.concatenate(owners), np.concatenate(wins)
        merged = merge_runs(decoded)
        twice = merged[:, 2] >= 2  # both words shared with the one before
        twice[:-1] |= twice[1:]
        at = base[merged[twice, 0]] + merged[twice, 1]
        owner, win = owners[at], wins[at]
        owner, win = owner[owner >= 0], win[owner >= 0]
        order = np.lexsort((win, owner))
        owner, win = owner[order], win[order]
        if len(owner):
            new = np.append(True, (owner[1:] != owner[:-1]) | (win[1:] != win[:-1] + 1))
            begin = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(owner[begin]), pa.array(win[begin]), pa.array(np.diff(np.append(begin, len(owner))).astype(np.int32))], ["number", "first_window", "windows"])

    for batch in batches:
        for part, shared, tails, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if runs and part != current:
                yield from done()
                runs = []
            current = part
            runs.append((shared, tails, own))
    if runs:
        yield from done()


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans, merged: begins and ends by turns, as little-endian 64-bit numbers."""
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            pairs = spans.values
            begin, end = pairs.field("first").to_numpy(), pairs.field("last").to_numpy()
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            new = np.append(True, begin[1:] > end[:-1])
            out.append(np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cut_id"), batch.column("cut_key"), pa.array(out, pa.binary())], ["cut_id", "cut_key", "spans"])


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text, marks = text or b"", np.frombuffer(spans or b"", "<i8").tolist()
            edges = [0, *marks, len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((len(text), [{"begin": a, "end": b} for a, b in zip(marks[::2], marks[1::2], strict=True)], hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        n, merged, sha, kept = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(merged, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "removed", "kept_sha256", "kept"],
        )


def suffix_dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, removed (spans of bytes), kept_sha256, kept (the bytes that stay, if keep_text)."""
    spark = docs.sparkSession
    seed = min(SEED, max(8, size // 3))
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scanned = texts.where(F.octet_length("text") >= size).mapInArrow(lambda it: _scan(it, size, seed), _RUNS.format(kind))
    scanned = written(scanned, "suffix-runs")
    seeds = scanned.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    seeds = written(seeds.select("seed", (F.col("lo") < F.col("hi")).alias("mixed")), "suffix-seeds")
    shared = scanned.join(broadcast_if_small(seeds, SEED_ROWS), "seed")
    shared = written(shared, "suffix-shared")
    plain = shared.where("NOT mixed").select("doc_id", "text_key", "first", F.col("windows"))
    several = shared.where("mixed")
    place = F.struct("doc_id", "text_key", "first", "windows", "anchor")
    classes = written(several.groupBy("seed", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "suffix-classes")
    copied = several.join(classes.where("n > 1").select("seed", "content"), ["seed", "content"]).select("doc_id", "text_key", "first", "windows")
    wide = F.ceil(F.log2(F.count(F.lit(1)) / SPREAD_CLASSES)).cast("int")
    spread = written(classes.groupBy("seed").agg(wide.alias("spread")).where("spread > 0"), "suffix-spread")  # very common seeds only
    asked = classes.join(broadcast_if_small(spread, SEED_ROWS), "seed", "left").select("at.*", "n", F.coalesce("spread", F.lit(0)).alias("spread"), F.monotonically_increasing_id().alias("number"))
    asked = written(asked.withColumn("number", F.when(F.col("n") == 1, F.col("number")).otherwise(-1 - F.col("number"))), "suffix-asked")
    windows = asked.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(1, -(-windows // PART_WINDOWS))  # each is held as a whole while it is merged
    packed = F.struct("number", _asked(F.col("first"), F.col("windows"), F.col("anchor"), F.col("spread")).alias("asked"))
    by_doc = asked.groupBy(F.col("doc_id").alias("asked_id"), F.col("text_key").alias("asked_key")).agg(F.collect_list(packed).alias("all"))
    by_doc = written(by_doc.select("asked_id", "asked_key", F.col("all.number").alias("numbers"), F.col("all.asked").alias("asked")), "suffix-asked-docs")
    # Repeated rows are equal: whichever of them shows the windows, and if all do, no more than they already lose is found.
    wanted = texts.join(broadcast_if_light(by_doc, 16 * F.size("asked"), BROADCAST_BYTES), F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_key") == F.col("asked_key")))
    runs = wanted.select("text", "numbers", "asked").mapInArrow(lambda it: _suffix_runs(it, size, seed, parts), _SUFFIXES)
    merged = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_combine, "number long, first_window long, windows int")
    merged = merged.select("number", "first_window", F.col("windows").alias("found"))
    partly = merged.join(asked.where("n = 1"), "number").select("doc_id", "text_key", (F.col("first") + F.col("first_window")).alias("first"), F.col("found").alias("windows"))
    spans = plain.unionByName(copied).unionByName(partly)
    spans = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key")).agg(F.collect_list(F.struct("first", (F.col("first") + F.col("windows") - 1 + size).alias("last"))).alias("spans"))
    spans = written(spans.mapInArrow(_merge_spans, f"cut_id {kind}, cut_key long, spans binary"), "suffix-spans")
    cut = texts.join(broadcast_if_light(spans, F.octet_length("spans"), BROADCAST_BYTES), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    span = "array<struct<begin:long,end:long>>"
    return cut.select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, keep_text), f"doc_id {kind}, n_bytes long, removed {span}, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES = {
    "op1_suffix_dedup": """
        WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
        win AS (SELECT doc_id, p, hash(x[p + 1:p + 200]) AS k FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 199)) AS p FROM t WHERE octet_length(x) >= 200)),
        twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        hits AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS new FROM win SEMI JOIN twice USING (k)),
        runs AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits) GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
        cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(hex(x[before + 1:a]), '' ORDER BY a) AS head FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
        SELECT t.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || hex(x[coalesce(last, 0) + 1:]))) AS kept_sha256
        FROM t LEFT JOIN cut USING (doc_id)"""
}
