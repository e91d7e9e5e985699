"""Text values that were cut off (problem 9).

Intact values of a bounded sample are cut at random places, or at the length where their source cuts, and give the
positives; as they are they give the negatives. A logistic regression over hashed features is trained on them: closing characters
and words, the form of the last lines, the length against the source's limits and the announced length. Then every record is scored. A source with
a limit has no intact value beyond it to cut there, so a share of the cuts (``LIMITED``) is made as if the place were a limit.

A source's limits are counted over all of its records: a length, in characters or bytes, that at least two per cent
of them and at least five have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

DIMS = 1 << 16
TAIL = 300
#: Shorter values are mostly titles, which a limit hardly reaches; they are learned from as they are only.
SHORT = 120
#: Limits of up to this many sources are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Share of the artificial cuts that stand at a limit, and of those that a sender marked, with what.
LIMITED, MARKED = 0.3, 0.2
MARKS = ("…", " …", "...", " ...", "\ufffd")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
CLOSED = re.compile(r"[.!?。][\"'”’)\]]*\s*$")
STOP = re.compile(r"[.!?。][\"'”’)\]]*(?=\s|$)")


def kind(ch: str) -> str:
    if ch.isdigit():
        return "9"
    if "가" <= ch <= "힣":
        return "h"
    if ch.isalpha():
        return "a" if ch.islower() else "A"
    return ch


def shape(token: str) -> str:
    if token[0].isdigit():
        return "9"
    if not token[0].isalpha():
        return token
    if "가" <= token[0] <= "힣":
        return "h"
    if token.isupper() and len(token) > 1:
        return "AA"
    return "A" if token[0].isupper() else "a"


def features(tail: str, chars: int, lines: int, declared: float | None, at_limit: bool) -> list[int]:
    """Hashed feature numbers of one value; ``tail`` are its last TAIL characters, ``lines`` its line feeds."""
    t = tail.rstrip()
    blank = "blank" if t != tail else ""
    if not t:
        return [0]
    end = kind(t[-1])
    before, _, last = t.rpartition("\n")
    prev = before.rpartition("\n")[2]
    tokens, ptokens = TOKEN.findall(last), TOKEN.findall(prev)
    forms, pforms = [shape(x) for x in tokens], [shape(x) for x in ptokens]
    short = " ".join(forms) if len(forms) <= 7 else "long " + " ".join([*forms[:2], *forms[-2:]])
    sentence = STOP.split(last)[-1].split()
    size = min(len(sentence), 12)
    words = [x.lower() for x in tokens]
    full = min(len(t), TAIL) if chars > TAIL else len(t)
    ann = "none" if declared is None or declared != declared else "more" if declared > chars * 1.06 + 2 else "bit" if declared > chars else "same"
    names = [
        f"end {end}", f"end {end} {blank}", f"end1 {t[-1:]}", f"end2 {t[-2:]}", f"end3 {t[-3:]}", f"end {end} limit {at_limit}", f"end {end} declared {ann}",
        f"limit {at_limit} declared {ann} {STOP.search(t[-3:]) is not None}",
        f"form {short}", f"prev {' '.join(pforms[:5])} {len(pforms) > 5} form {short}", f"prev {' '.join(pforms[-2:])}",
        f"first {' '.join(words[:2])} {end}", f"prevfirst {' '.join(x.lower() for x in ptokens[:2])} {end}", f"last {' '.join(words[-1:])}", f"last2 {' '.join(words[-2:])}",
        f"last3 {' '.join(words[-3:])}", f"size {size} {end}", f"lines {min(lines, 2)} {end} {chars // 40 if chars < 200 else 'more'}",
        f"stop {STOP.search(t) is not None} {end} {min(lines, 1)}", f"caps {last.isupper()} {end}", f"row {'|' in last} {end}", f"full {full < TAIL} {end}",
    ]
    return [xxhash.xxh32_intdigest(x) % DIMS for x in names]


def limits(docs: DataFrame) -> DataFrame:
    """(source, char_limits, byte_limits); the group of rows without source is one source."""
    rows = docs.where("text IS NOT NULL").select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    totals = rows.groupBy(F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("total"))

    def spikes(unit: str) -> DataFrame:
        n = rows.groupBy("source", unit).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
        return n.join(totals, F.col("source").eqNullSafe(F.col("__s"))).where("n * 50 >= total").select(
            "source", F.lit(unit).alias("unit"), F.col(unit).alias("size"))

    def sizes(unit: str) -> Column:  # at most 50 a source
        return F.collect_set(F.when(F.col("unit") == unit, F.col("size")))

    return spikes("chars").unionByName(spikes("bytes")).groupBy("source").agg(sizes("chars").alias("char_limits"), sizes("bytes").alias("byte_limits"))


def observed(docs: DataFrame) -> DataFrame:
    """What the model looks at, of every record with text: its end, its lengths and its source's limits."""
    lim = cut(limits(docs))
    side = F.broadcast(lim) if lim.count() <= BROADCAST_SOURCES else lim
    none = F.array().cast("array<int>")
    rows = docs.where("text IS NOT NULL AND length(text) > 0").join(
        side.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return rows.select(
        "doc_id", "source", "text", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
        (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("lines"), F.col("declared_chars").cast("double").alias("declared"),
        F.coalesce("char_limits", none).alias("char_limits"), F.coalesce("byte_limits", none).alias("byte_limits"))


def at_limit(chars: int, size: int, char_limits, byte_limits) -> bool:
    """A cut by bytes may leave up to three of them, an incomplete character, away."""
    return any(chars == x for x in char_limits) or any(x - 3 <= size <= x for x in byte_limits)


def examples(rows: DataFrame, seed: int) -> DataFrame:
    """(label, features) from rows that are intact as far as one can tell: the announced length holds, or a final stop; no mark of a cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                rng = np.random.default_rng([seed, xxhash.xxh32_intdigest(str(r.doc_id))])
                t = r.text
                # The length is announced as often for cut values as for whole ones: its absence must tell nothing.
                announced, off = rng.random() < 0.4, float(len(t) + rng.integers(1, 40)) if rng.random() < 0.2 else float(len(t))
                out.append((0, features(t[-TAIL:], r.chars, r.lines, off if announced else None, at_limit(r.chars, r.bytes, r.char_limits, r.byte_limits))))
                if len(t) < SHORT:
                    continue
                tries = [int(x) for x in r.char_limits if 40 < x < len(t)] if rng.random() < 0.5 else []
                for _ in range(6):
                    at = tries.pop() if tries else int(rng.integers(40, len(t) - 4))
                    s = t[:at]
                    rest = t[at:].split("\n")[0]
                    # inside a word, number or sentence: what follows on the line goes on, and the sentence isn't over
                    inside = t[at - 1].isalnum() and t[at].isalnum()
                    if not rest.strip() or CLOSED.search(s) or not inside and len(s.rpartition("\n")[2].split()) < 2:
                        continue
                    if rng.random() < MARKED:
                        s = s.rstrip() + MARKS[int(rng.integers(len(MARKS)))]
                    declared = off if rng.random() < 0.4 else None
                    limited = rng.random() < LIMITED or at_limit(at, len(s.encode()), r.char_limits, r.byte_limits)
                    out.append((1, features(s[-TAIL:], len(s), s.count("\n"), declared, limited)))
                    break
            yield pd.DataFrame(out, columns=["label", "features"])

    intact = rows.where(r"(declared = chars OR text RLIKE '[.!?。][\"”’)\\]]*\\s*$') AND NOT text RLIKE '(\\.\\.\\.|…|\ufffd)\\s*$'")
    return intact.mapInPandas(run, "label int, features array<int>")


def train(labels: np.ndarray, feats: list[np.ndarray], share: float = 0.1, rounds: int = 30, rate: float = 0.5, decay: float = 2e-6,
          seed: int = 1) -> np.ndarray:
    """Weights of a logistic regression by AdaGrad over mini-batches; the last weight is the bias.

    ``share`` is the share of truncated values to expect: the positives are weighted to it, as they are made one to one.
    """
    w, g = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-2)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, share * max(1, (labels == 0).sum()) / ((1 - share) * max(1, labels.sum())), 1.0)
    length = np.array([len(f) for f in feats])
    width = int(length.max())
    x = np.full((len(feats), width + 1), DIMS)
    for k, f in enumerate(feats):
        x[k, : len(f)] = f
    pad = np.arange(width + 1)[None, :] > length[:, None]  # of the slots past a row's features only one stays, as bias
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            i = order[lo : lo + 256]
            p = 1 / (1 + np.exp(-(np.where(pad[i], 0, w[x[i]])).sum(1)))
            grad = np.zeros(DIMS + 1)
            np.add.at(grad, x[i][~pad[i]], np.repeat((p - labels[i]) * weight[i], (~pad[i]).sum(1)))
            used = np.flatnonzero(grad)
            step = grad[used] / len(i) + decay * w[used]
            g[used] += step**2
            w[used] -= rate * step / np.sqrt(g[used])
    return w


def score(weights: np.ndarray, feats: list[int]) -> float:
    return float(1 / (1 + np.exp(-(weights[feats].sum() + weights[DIMS]))))


def model(rows: DataFrame, sample: int = 20_000, seed: int = 11) -> np.ndarray:
    """Weights fitted on about ``sample`` records, those whose number's hash falls under the share of all that this is."""
    rows = rows.where("doc_id IS NOT NULL")
    share = min(1.0, sample / max(rows.count(), 1))
    few = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10**9)) < int(share * 10**9))
    got = examples(few, seed).toArrow()
    labels = got.column("label").to_numpy()
    if len(set(labels.tolist())) < 2:
        return np.zeros(DIMS + 1)
    return train(labels, [np.array(f) for f in got.column("features").to_pylist()])


def scores(docs: DataFrame, weights: np.ndarray | None = None, sample: int = 20_000) -> DataFrame:
    """(doc_id, source, score) of every record, null for those with null or empty text.

    Without two kinds of examples to learn from (no intact text of SHORT characters) every score is 0.5.
    """
    rows = observed(docs)
    weights = model(rows, sample) if weights is None else weights
    w = docs.sparkSession.sparkContext.broadcast(weights)
    key, src = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [score(w.value, features(r.tail, r.chars, r.lines, r.declared, r.limit)) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": s})

    hit = F.exists("char_limits", lambda x: x == F.col("chars")) | F.exists("byte_limits", lambda x: F.col("bytes").between(x - 3, x))
    seen = rows.select("doc_id", "source", F.substring(F.col("text"), -TAIL, TAIL).alias("tail"), "chars", "lines", "declared", hit.alias("limit"))
    scored = seen.mapInPandas(run, f"doc_id {key}, source {src}, score double")
    rest = docs.where("text IS NULL OR length(text) = 0").select("doc_id", "source", F.lit(None).cast("double").alias("score"))
    return scored.unionByName(rest)


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source its records, the truncated ones and their share; records without source are one group."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("score") > threshold).alias("truncated"),
        F.round(F.count_if(F.col("score") > threshold) / F.count(F.lit(1)), 6).alias("share"))
