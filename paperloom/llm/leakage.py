"""Evaluation passages inside a corpus (problem 8).

Every run of ``window`` words of an item is embedded by the CGK random walk: at output step j the walk writes the current
symbol and moves on by one if a random bit of (j, symbol) is set, so that texts at a small edit distance get outputs at a small Hamming
distance, equal texts equal outputs. A repetition of bit-sampling LSH takes ``sample`` positions of the output as its key. In a document
the walk starts at every word; a start that shares a key with an item window is a candidate. With ``max_edits`` edits a span has
``window - max_edits`` to ``window + max_edits`` words. Positions are sampled from the first ``window - max_edits`` of the output, where
the walk can't have left the shortest of these, so one key serves all lengths; every second repetition walks
backwards from the end of the window, as an edit near one end leaves the other alone. Repetitions are added until a simulation
with substituted, inserted and deleted words reaches the target recall.

Candidates are verified by their exact edit distance to the best span from that start (or to that end), all candidates of a batch at once.
Words are compared by 64-bit hashes; that two different words of a corpus of 10^7 words share one has a chance of about 10^-6.

Up to ``BLOCKS`` times ``BLOCK`` item windows (their number is counted first) travel to the tasks, and documents are read once per block
and never shuffled. With more, documents are read once: of their windows those whose key is in a bitmap of fixed size leave
the scan, and meet the item windows in a join on the key. A document is walked in slices of its words, so that
one huge text neither fills a worker nor is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, Hasher, mix64, words
from paperloom.session import cut

#: Item windows sent to the tasks at once, about 200 bytes each, and how often at most.
BLOCK, BLOCKS = 200_000, 4
#: Words looked up at once in a worker, and candidates verified at once.
SLICE, CANDIDATES = 400_000, 50_000
#: Bits of the map that keeps document windows at home, and repetitions that may be needed at most.
MAP_BITS, MOST_REPETITIONS = 26, 256
FAR = 99


class Walk:
    """One repetition: a walk and the sampled output positions, both given by the seed. Odd seeds walk backwards."""

    def __init__(self, window: int, edits: int, sample: int, seed: int) -> None:
        rng = np.random.default_rng([seed, window, edits, sample])
        reach = window - edits
        if reach < 1:
            raise ValueError("max_edits must be less than the window")
        self.back = seed % 2 == 1
        self.at = np.sort(rng.choice(reach, size=min(sample, reach), replace=False))
        self.salts = rng.integers(1, 2**63, size=-(-reach // 64), dtype=np.uint64)
        self.probe = min(3, len(self.at) - 1)  # after so many samples windows that match no item are dropped

    def keys(self, symbols: np.ndarray, starts: np.ndarray, bitmap: np.ndarray | None = None, samples: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``starts``, their keys); a start is a first word, backwards the place behind a last one.

        With a bitmap, windows whose first samples are in no item go early.
        """
        if self.back:
            symbols, starts = symbols[::-1], len(symbols) - starts
        bits = [mix64(symbols ^ s) for s in self.salts]
        which, pos = np.arange(len(starts)), starts.astype(np.int64, copy=True)
        key = np.zeros(len(starts), dtype=np.uint64)
        at = self.at[: samples or len(self.at)]
        taken = 0
        for j in range(int(at[-1]) + 1):
            if j == at[taken]:
                key = (key ^ symbols[pos]) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
                taken += 1
                if taken == self.probe and bitmap is not None:
                    ok = np.flatnonzero(bitmap[(key >> np.uint64(42)).astype(np.int64)])
                    which, pos, key = which[ok], pos[ok], key[ok]
            pos += ((bits[j // 64][pos] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        return which, key

    def ends(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Where the walk starts for windows that start at ``starts``."""
        return starts + window if self.back else starts

    def prefix_bitmap(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        bitmap = np.zeros(1 << 22, dtype=bool)
        if self.probe:
            bitmap[(self.keys(symbols, starts, samples=self.probe)[1] >> np.uint64(42)).astype(np.int64)] = True
        return bitmap


def distances(items: np.ndarray, spans: np.ndarray, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edit distance, length) of the best beginning of each span of ``window`` words, ``most`` more or less; FAR where it is over ``most``.

    ``items`` is (n, window), ``spans`` (n, window + most), of which the first ``room`` symbols count. The edit matrix is filled along its
    diagonals, for all pairs at once; of equal distances the length nearest to the window is taken.
    """
    n, window = items.shape
    wide = 2 * most + 1
    cost = np.full((wide + 2, n), FAR, dtype=np.int16)  # diagonals, with a border on either side
    for d in range(most, wide):
        cost[d + 1] = d - most
    for i in range(1, window + 1):
        before = cost.copy()
        for d in range(wide):
            j = i + d - most
            if j < 0:
                continue
            best = np.minimum(before[d + 2], cost[d]) + 1
            if j > 0:
                best = np.minimum(best, before[d + 1] + (items[:, i - 1] != spans[:, j - 1]))
            cost[d + 1] = np.minimum(best, FAR)
    out, size = np.full(n, FAR, dtype=np.int16), np.full(n, window)
    for off in sorted(range(-most, most + 1), key=lambda x: (abs(x), x)):
        better = (cost[off + most + 1] < out) & (room >= window + off)
        out[better], size[better] = cost[off + most + 1][better], window + off
    out[out > most] = FAR
    return out, size


KINDS = 3


def edited(symbols: np.ndarray, edits: int, kind: int, rng: np.random.Generator) -> np.ndarray:
    """The window after ``edits`` edits at random places: a word replaced (0), put in (1) or left out (2)."""
    x = list(symbols)
    for _ in range(edits):
        at = int(rng.integers(len(x)))
        fresh = rng.integers(1, 2**63, dtype=np.uint64)
        x[at : at + (kind != 1)] = [] if kind == 2 else [fresh]
    return np.array(x, dtype=np.uint64)


def repetitions(window: int, edits: int, sample: int, recall: float, trials: int = 6_000) -> int:
    """How many repetitions reach ``recall`` for windows at ``edits`` edits of whichever kind is found least: simulated, seeds fixed."""
    if edits == 0:
        return 1  # equal windows share every key
    rng = np.random.default_rng([window, edits, sample])
    flat, starts, ends, items = [], [], [], []
    at = 0
    for trial in range(trials):
        item = rng.integers(1, 2**63, size=window, dtype=np.uint64)
        span, edge = edited(item, edits, trial % KINDS, rng), rng.integers(1, 2**63, size=2 * window, dtype=np.uint64)
        flat += [edge[:window], span, edge[window:]]
        starts.append(at + window)
        ends.append(at + window + len(span))
        items.append(item)
        at += 2 * window + len(span)
    text, item = np.concatenate(flat), np.concatenate(items)
    found = np.zeros(trials, dtype=bool)
    for r in range(MOST_REPETITIONS):
        w = Walk(window, edits, sample, r)
        found |= w.keys(text, np.array(ends if w.back else starts))[1] == w.keys(item, w.ends(np.arange(trials) * window, window))[1]
        if min(found[kind::KINDS].mean() for kind in range(KINDS)) >= recall:
            return r + 1
    raise ValueError(f"no {MOST_REPETITIONS} repetitions of {sample} samples reach a recall of {recall} at {edits} edits; take fewer samples")


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, pos, ws): every run of ``window`` words of every item, as hashes. Shorter items have none."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            for i, t in b.itertuples(index=False, name=None):
                ws = hasher(words(t))
                for s in range(0, len(ws) - window + 1, SLICE):
                    at = range(s, min(s + SLICE, len(ws) - window + 1))
                    yield pd.DataFrame({"item": [i] * len(at), "pos": at, "ws": [ws[k : k + window].tobytes() for k in at]})

    return items.where(F.col(text).isNotNull()).select(item, text).mapInPandas(run, f"item {kind}, pos int, ws binary")


class Index:
    """The windows of one block of items, and their keys under every repetition."""

    def __init__(self, rows: list[tuple], window: int, edits: int, sample: int, reps: int) -> None:
        self.items, self.pos, self.window, self.edits = [r[0] for r in rows], [r[1] for r in rows], window, edits
        self.symbols = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint64).reshape(-1, window)
        flat, starts = self.symbols.ravel(), np.arange(len(rows)) * window
        self.walks, self.keys, self.order, self.maps = [], [], [], []
        for r in range(reps):
            w = Walk(window, edits, sample, r)
            key = w.keys(flat, w.ends(starts, window))[1]
            order = np.argsort(key, kind="stable")
            self.walks.append(w)
            self.order.append(order)
            self.keys.append(key[order])
            self.maps.append(np.packbits(w.prefix_bitmap(flat, w.ends(starts, window))))
        self.open: list[np.ndarray] | None = None

    def candidates(self, symbols: np.ndarray, starts: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (which of ``starts``, item window) that share a key in some repetition of the direction, each once."""
        if self.open is None:
            self.open = [np.unpackbits(m).astype(bool) for m in self.maps]
        found = [np.empty(0, dtype=np.int64)]
        for w, keys, order, bitmap in zip(self.walks, self.keys, self.order, self.open):
            if w.back != back:
                continue
            which, key = w.keys(symbols, starts, bitmap)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = hi - lo
            b = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(np.repeat(which, n) * np.int64(len(self.items)) + b)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)


def _spans(symbols: np.ndarray, at: np.ndarray, width: int, back: bool) -> np.ndarray:
    """``width`` symbols from each place on, backwards those before it from the last to the first; beyond the ends any."""
    steps = at[:, None] - 1 - np.arange(width) if back else at[:, None] + np.arange(width)
    return symbols[np.clip(steps, 0, len(symbols) - 1)]


def verified(ix: Index, symbols: np.ndarray, spans: np.ndarray, starts: np.ndarray, back: bool) -> Iterator[tuple]:
    """(place, item window, distance, length) of the candidates that are within the allowed edits; ``spans`` bound the texts."""
    a, b = ix.candidates(symbols, starts, back)
    at = starts[a]
    of = np.searchsorted(spans, at, "left" if back else "right") - 1
    room = at - spans[of] if back else spans[of + 1] - at
    for lo in range(0, len(at), CANDIDATES):
        part = slice(lo, lo + CANDIDATES)
        x = ix.symbols[b[part]]
        near, size = distances(x[:, ::-1] if back else x, _spans(symbols, at[part], ix.window + ix.edits, back), room[part], ix.edits)
        for k in np.flatnonzero(near <= ix.edits):
            n = int(size[k])
            first = int(at[lo + k]) - (n if back else 0)
            yield int(of[lo + k]), first, int(b[lo + k]), int(near[k])


def _texts(batches: Iterator[pd.DataFrame], window: int, edits: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids and first word numbers, bounds, symbols) of texts laid one after the other, about SLICE words at once."""
    hasher = Hasher()
    lap = window + edits - 1  # slices of a text overlap, so that every span is in one
    for b in batches:
        ids, spans, ws = [], [0], []
        for i, t in b.itertuples(index=False, name=None):
            own = WORD.findall(t.lower())
            for at in range(0, max(1, len(own) - lap), SLICE):
                part = own[at : at + SLICE + lap] if len(own) > SLICE else own
                ids.append((i, at))
                ws += part
                spans.append(len(ws))
                if len(ws) >= SLICE:
                    yield ids, np.array(spans), hasher(ws)
                    ids, spans, ws = [], [0], []
        if ws:
            yield ids, np.array(spans), hasher(ws)


def _starts(spans: np.ndarray, least: int, back: bool) -> np.ndarray:
    """Places where a walk of ``least`` words stays in its text."""
    n = np.arange(spans[-1] + 1)
    of = np.searchsorted(spans, n, "left" if back else "right") - 1
    room = n - spans[np.maximum(of, 0)] if back else spans[np.minimum(of + 1, len(spans) - 1)] - n
    return n[room >= least]


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
          window: int = 13, max_edits: int = 0, sample: int = 9, recall: float = 0.95) -> DataFrame:
    """(doc, item, item_pos, doc_pos, distance): the item windows that a document holds within ``max_edits`` word edits.

    One row for each document and item window, with the least distance found and where the span begins; positions count
    words from 0. Windows held without edits are all found; with edits the windows at the largest allowed
    distance are found with the target recall each, and a leaked passage has many windows. Null and empty texts
    and items of fewer than ``window`` words give no rows; rows that share a number are one document, or one item.
    """
    spark = docs.sparkSession
    wins = cut(item_windows(items, item, text, window))
    blocks = -(-wins.count() // BLOCK)
    reps = repetitions(window, max_edits, sample, recall)
    src = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kinds = {"doc": docs.schema[doc].dataType.simpleString(), "item": items.schema[item].dataType.simpleString()}
    schema = f"doc {kinds['doc']}, item {kinds['item']}, item_pos int, doc_pos int, distance int"
    if not blocks:
        found = spark.createDataFrame([], schema)
    elif blocks > BLOCKS:
        found = _joined(src, wins, kinds, schema, window, max_edits, sample, reps)
    else:
        wins = wins.withColumn("block", F.pmod(F.xxhash64("item", "pos"), F.lit(blocks)))
        found = None
        for k in range(blocks):
            rows = [tuple(r) for r in wins.where(F.col("block") == k).select("item", "pos", "ws").toLocalIterator()]
            if rows:
                index = spark.sparkContext.broadcast(Index(rows, window, max_edits, sample, reps))
                part = src.mapInPandas(_scan(index), schema)
                found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc", "item", "item_pos").agg(F.min(F.struct("distance", "doc_pos")).alias("m"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), "item_pos", "m.doc_pos", "m.distance")


def _scan(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: Index = index.value
        both = {w.back for w in ix.walks}
        for ids, spans, symbols in _texts(batches, ix.window, ix.edits):
            best: dict = {}
            for back in both:
                starts = _starts(spans, ix.window - ix.edits, back)
                if len(starts):
                    for k, first, w, near in verified(ix, symbols, spans, starts, back):
                        i, at = ids[k]
                        row, key = (near, first - int(spans[k]) + at), (i, w)
                        if key not in best or row < best[key]:
                            best[key] = row
            yield pd.DataFrame([(i, ix.items[w], ix.pos[w], at, near) for (i, w), (near, at) in best.items()],
                               columns=["doc", "item", "item_pos", "doc_pos", "distance"])

    return run


def _joined(src: DataFrame, wins: DataFrame, kinds: dict, schema: str, window: int, edits: int, sample: int, reps: int) -> DataFrame:
    """The join form, for item windows of any number: both sides keyed by (repetition, key)."""
    walks = [Walk(window, edits, sample, r) for r in range(reps)]
    width, one = window + edits, (1 << MAP_BITS) - 1

    def bit(key: np.ndarray, r: int) -> np.ndarray:
        return ((key >> np.uint64(20)) ^ np.uint64(r * 0x9E3779B1)).astype(np.int64) & one

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = np.frombuffer(b"".join(b["ws"]), dtype=np.uint64)
            for r, w in enumerate(walks):
                key = w.keys(flat, w.ends(np.arange(len(b)) * window, window))[1]
                yield pd.DataFrame({"rep": r, "key": key.view(np.int64), "item": b["item"], "item_pos": b["pos"], "ws": b["ws"]})

    keyed = cut(wins.select("item", "pos", "ws").mapInPandas(of_items, f"rep int, key long, item {kinds['item']}, item_pos int, ws binary"))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(one + 1, dtype=bool)
        for b in batches:
            for r in range(reps):
                bits[bit(b["key"].to_numpy()[b["rep"].to_numpy() == r].view(np.uint64), r)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    full = np.zeros((one + 1) // 8, dtype=np.uint8)  # of set size, one part after the other
    for part in keyed.select("rep", "key").coalesce(16).mapInPandas(mapped, "bits binary").toLocalIterator():
        full |= np.frombuffer(part[0], dtype=np.uint8)
    known = src.sparkSession.sparkContext.broadcast(full)

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(known.value).astype(bool)
        for ids, spans, symbols in _texts(batches, window, edits):
            names, firsts = np.array([i for i, _ in ids], dtype=object), np.array([a for _, a in ids])
            for r, w in enumerate(walks):
                starts = _starts(spans, window - edits, w.back)
                if not len(starts):
                    continue
                which, key = w.keys(symbols, starts)
                ok = bits[bit(key, r)]
                at, key = starts[which[ok]], key[ok]
                of = np.searchsorted(spans, at, "left" if w.back else "right") - 1
                rows = _spans(symbols, at, width, w.back)
                yield pd.DataFrame({"rep": r, "key": key.view(np.int64), "doc": names[of], "at": at - spans[of] + firsts[of],
                                    "room": np.minimum(at - spans[of] if w.back else spans[of + 1] - at, width), "span": [x.tobytes() for x in rows]})

    seen = src.mapInPandas(of_docs, f"rep int, key long, doc {kinds['doc']}, at int, room int, span binary")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            back = b["rep"].to_numpy() % 2 == 1
            x = np.frombuffer(b"".join(b["ws"]), dtype=np.uint64).reshape(-1, window)
            y = np.frombuffer(b"".join(b["span"]), dtype=np.uint64).reshape(-1, width)
            near, size = distances(np.where(back[:, None], x[:, ::-1], x), y, b["room"].to_numpy(), edits)
            b["doc_pos"], b["distance"] = b["at"].to_numpy() - np.where(back, size, 0), near
            yield b[near <= edits][["doc", "item", "item_pos", "doc_pos", "distance"]]

    return seen.join(keyed, ["rep", "key"]).select("rep", "doc", "item", "item_pos", "at", "room", "ws", "span").mapInPandas(check, schema)
