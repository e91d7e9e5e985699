"""Texts that share most of their word sequences (problem 5).

1. Texts of the same words in the same order are one class, found by a hash; only one text of a class goes on.
2. One-permutation hashing: the shingles of a text are dealt to bins by one hash, the least in each bin is kept; an
   empty bin takes the value of another, chosen by a hash of the bin and the attempt alone (optimal densification), so that two
   texts fill it alike. ``rows`` bins in a row make a band, a band's values a bucket.
3. A bucket gives a star: edges from its least class to the others, never all pairs. Stars with one centre are joined.
4. In each star the shingle sets are compared exactly. Two texts similar to the threshold t, of which one is similar to the centre,
   are both similar to 1 - 2 (1 - t) to the centre (Jaccard distance is a metric); pairs among those are looked up by their rarest
   shingles in the star (a prefix index), which costs by the pairs there are, not by all pairs.
5. Members of a bucket that are not similar to its centre could have partners there. They are compared among themselves, again
   by prefix index. So every similar pair that shares a bucket is found; with the default 28 bands of 4 that is 0.9995
   of the pairs at similarity 0.7, and more above.

For groups, not pairs, the similarity of two texts that are both similar to a centre adds nothing, and is not looked for: a bucket of
a hundred thousand variants of one form costs its stars.

Stars and leftovers of more than ``BLOCK`` classes are not held by one task. Their members meet parts of the star with a copy of the centre, and the
prefix index becomes a join on (star, rare shingle), so that what is shuffled grows with the shingles, and a pair meets only if it shares a rare one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, Hasher, mix64
from paperloom.session import cut

#: Classes that one task compares with each other; larger groups are joined by their shingles.
BLOCK = 1_000
#: Class numbers up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_CLASSES = 200_000
EMPTY = np.uint64(2**64 - 1)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def shingles(texts: list[str], words: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(64-bit shingles, number of their text, copy hashes), of all texts at once; shingles may repeat."""
    ws = [WORD.findall(t.lower()) for t in texts]
    copies = [xxhash.xxh3_64_intdigest(" ".join(w)) - 2**63 for w in ws]
    n = np.array([len(w) for w in ws])
    flat = mix64(hasher([x for w in ws for x in w]))
    if len(flat) < words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), copies
    m = len(flat) - words + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(words):
        out = mix64(out + flat[k : k + m] * _ODD[k % 3] + np.uint64(k))
    of = np.repeat(np.arange(len(n)), n)[:m]
    whole = np.arange(m) + words <= np.cumsum(n)[of]
    return out[whole], of[whole], copies


def one_permutation(sh: np.ndarray, of: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """Signatures (texts x bins); a row without shingles stays EMPTY."""
    sig = np.full(texts * bins, EMPTY, dtype=np.uint64)
    at = ((sh >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(sig, of * bins + at.astype(np.int64), (sh << np.uint64(32)) | (sh >> np.uint64(32)))
    first = sig.reshape(texts, bins)
    some = (first != EMPTY).any(axis=1)
    sig = first.copy()
    todo = np.argwhere((sig == EMPTY) & some[:, None])
    attempt = 0
    while len(todo):
        to = (mix64(todo[:, 1].astype(np.uint64) * np.uint64(2**20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        got = first[todo[:, 0], to]
        sig[todo[:, 0], todo[:, 1]] = got
        todo = todo[got == EMPTY]
        attempt += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(sig), np.uint64(b + 1), dtype=np.uint64)
        for j in range(rows):
            k = mix64(k * _ODD[0] + sig[:, b * rows + j])
        keys[:, b] = k
    return keys.view(np.int64)


def signatures(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, copy, buckets) of every text; one with less than ``words`` words has no buckets."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            for part in slices(b["text"]):
                t = b["text"].iloc[part].tolist()
                sh, of, copies = shingles(t, words, hasher)
                sig = one_permutation(sh, of, len(t), bands * rows)
                keys = band_keys(sig, bands, rows)
                yield pd.DataFrame({"id": b["id"].iloc[part], "copy": np.array(copies, dtype=np.int64),
                                    "buckets": [k if s else k[:0] for k, s in zip(keys, sig[:, 0] != EMPTY)]})

    return df.mapInPandas(run, f"id {kind}, copy long, buckets array<long>")


def slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[slice]:
    """Cuts of a batch by its amount of text, at least one row each."""
    total = np.cumsum(texts.str.len().to_numpy())
    lo = 0
    while lo < len(texts):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + chars, "right")))
        yield slice(lo, hi)
        lo = hi


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(copy, shingles): the sorted distinct shingles of every text, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            for part in slices(b["text"]):
                t = b["text"].iloc[part].tolist()
                sh, of, copies = shingles(t, words, hasher)
                at = np.searchsorted(of, np.arange(len(t) + 1))
                yield pd.DataFrame({"copy": np.array(copies, dtype=np.int64),
                                    "shingles": [np.unique(sh[at[k] : at[k + 1]]).tobytes() for k in range(len(t))]})

    return df.select("text").mapInPandas(run, "copy long, shingles binary")


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


def prefix_size(size: int, t: float) -> int:
    """How many of a set's shingles, in any common order, hold one of every set at similarity ``t``."""
    return size - ceil(t * size - 1e-9) + 1


def similar_pairs(names: list[int], sets: list[frozenset], known: list[bool], t: float) -> Iterator[tuple[int, int, float]]:
    """Index pairs at similarity ``t`` or more, by a prefix index over the rarest shingles of the group; pairs of two known ones are left out."""
    count = Counter(x for s in sets for x in s)
    index: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i])):
        s = sets[i]
        seen = set()
        for x in sorted(s, key=lambda x: (count[x], x))[: prefix_size(len(s), t)]:
            for j in index.get(x, ()):
                if j not in seen:
                    seen.add(j)
                    if not (known[i] and known[j]) and len(sets[j]) >= t * len(s) - 1e-9:
                        sim = jaccard(s, sets[j])
                        if sim >= t - 1e-12:
                            yield i, j, sim
            index.setdefault(x, []).append(i)


def unpacked(shingles: bytes) -> frozenset:
    return frozenset(np.frombuffer(shingles, dtype=np.uint64).tolist())


def compare(groups: DataFrame, sets: DataFrame, t: float, centred: bool, every: bool = True) -> DataFrame:
    """(a, b, similarity) of the similar pairs within each group, with a < b.

    ``groups`` holds (gid, copy); with ``centred`` the gid is the centre's copy and members under 1 - 2 (1 - t) to it are
    left to step 5. Without ``every`` pairs of two members that are similar to the centre are left out.
    """
    large = cut(groups.groupBy(F.col("gid").alias("__g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    if not large.limit(1).count():
        return _within_tasks(groups, sets, t, centred, every)
    small = groups.join(large, F.col("gid") == F.col("__g"), "left_anti")
    more = groups.join(large, F.col("gid") == F.col("__g")).drop("__g")
    return _within_tasks(small, sets, t, centred, every).unionByName(_by_shingles(more, sets, t, centred, every))


def _centres(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """A row with the centre's own set for each of ``parts`` (gid and others)."""
    own = sets.select(F.col("copy").alias("gid"), "shingles")
    return parts.join(own, "gid").withColumn("copy", F.col("gid")).withColumn("centre", F.lit(True))


def _within_tasks(groups: DataFrame, sets: DataFrame, t: float, centred: bool, every: bool) -> DataFrame:
    """:func:`compare` for groups that a task can hold."""
    full = groups.join(sets, "copy").withColumn("centre", F.lit(False))
    if centred:
        full = full.where("copy <> gid").unionByName(_centres(groups.select("gid").distinct(), sets))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = pdf["centre"].to_numpy()
        sets_, names = [unpacked(x) for x in pdf["shingles"][~centre]], pdf["copy"][~centre].tolist()
        rows, known = [], [False] * len(names)
        if centred:
            c, own = int(pdf["gid"].iloc[0]), unpacked(pdf["shingles"][centre].iloc[0])
            sim = [jaccard(own, s) for s in sets_]
            rows = [(c, n, x) for n, x in zip(names, sim) if x >= t - 1e-12]
            keep = [i for i, x in enumerate(sim) if x >= 1 - 2 * (1 - t) - 1e-12]
            names, sets_, known = [names[i] for i in keep], [sets_[i] for i in keep], [not every and sim[i] >= t - 1e-12 for i in keep]
        rows += [(names[i], names[j], x) for i, j, x in similar_pairs(names, sets_, known, t)]
        return pd.DataFrame([(min(a, b), max(a, b), x) for a, b, x in rows], columns=["a", "b", "similarity"])

    return full.groupBy("gid").applyInPandas(run, "a long, b long, similarity double")


def _by_shingles(groups: DataFrame, sets: DataFrame, t: float, centred: bool, every: bool) -> DataFrame:
    """:func:`compare` for groups (gid, copy, n) of any size."""
    pairs = "a long, b long, similarity double"
    inner, stars = groups.select("gid", "copy", F.lit(False).alias("near")), None
    if centred:
        dealt = groups.where("copy <> gid").withColumn("part", F.pmod(F.xxhash64("copy"), F.ceil(F.col("n") / BLOCK)).cast("int")).drop("n")
        full = dealt.join(sets, "copy").withColumn("centre", F.lit(False)).unionByName(_centres(dealt.select("gid", "part").distinct(), sets))

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            centre = pdf["centre"].to_numpy()
            own = unpacked(pdf["shingles"][centre].iloc[0])
            out = pdf.loc[~centre, ["gid", "copy"]]
            return out.assign(similarity=[jaccard(own, unpacked(x)) for x in pdf["shingles"][~centre]])

        scored = cut(full.groupBy("gid", "part").applyInPandas(score, "gid long, copy long, similarity double"))
        near = F.col("similarity") >= t - 1e-12
        stars = scored.where(near).select(F.least("gid", "copy").alias("a"), F.greatest("gid", "copy").alias("b"), "similarity")
        inner = scored.where(F.col("similarity") >= 1 - 2 * (1 - t) - 1e-12).select("gid", "copy", near.alias("near"))
        if not every:  # stars of which all are similar to the centre are done
            inner = inner.join(inner.where("NOT near").select("gid").distinct(), "gid", "left_semi")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = (b["shingles"].str.len() // 8).to_numpy()
            yield pd.DataFrame({**{c: np.repeat(b[c].to_numpy(), size) for c in ("gid", "copy", "near")}, "size": np.repeat(size, size),
                                "x": np.frombuffer(b"".join(b["shingles"]), dtype=np.int64)})

    every_x = cut(inner.join(sets, "copy").select("gid", "copy", "near", "shingles").mapInPandas(spread, "gid long, copy long, near boolean, size int, x long"))
    counts = every_x.groupBy("gid", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # Shingles that no other member has come first in the order and find nothing: only their number counts.
    shared = every_x.join(counts, ["gid", "x"])
    place = F.row_number().over(Window.partitionBy("gid", "copy").orderBy("k", "x")) + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("gid", "copy"))
    prefix = shared.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1).select("gid", "x", "copy", "near", "size")
    l, r = prefix.alias("l"), prefix.alias("r")
    meet = l.join(r, (F.col("l.gid") == F.col("r.gid")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.copy") < F.col("r.copy"))
                  & (F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * t - 1e-9) & (F.lit(every) | ~F.col("l.near") | ~F.col("r.near")))
    meet = meet.select(F.col("l.copy").alias("a"), F.col("r.copy").alias("b")).distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["similarity"] = np.array([jaccard(unpacked(x), unpacked(y)) for x, y in zip(b["x"], b["y"])], dtype=float)
            yield b[b["similarity"] >= t - 1e-12][["a", "b", "similarity"]]

    found = meet.join(sets.select(F.col("copy").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("copy").alias("b"), F.col("shingles").alias("y")), "b")
    found = found.select("a", "b", "x", "y").mapInPandas(check, pairs)
    return found.unionByName(stars) if stars is not None else found


class Similar:
    """Classes of copies, and the similar pairs between classes.

    members: (id, copy) for every text of at least ``words`` words; short: the same for the others, which are similar to none; pairs: (a, b, similarity) with a < b, class numbers:
    all similar ones, or without ``every`` as many as connect what all of them connect.
    """

    def __init__(self, df: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 28, rows: int = 4, every: bool = True) -> None:
        self.every = every
        df = df.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")
        sig = cut(signatures(df, words, bands, rows))
        self.short = sig.where(F.size("buckets") == 0).select("id", "copy")
        sig = sig.where(F.size("buckets") > 0)
        self.members = sig.select("id", "copy")
        # One text of each class goes on. Only (id, copy) are shuffled to find it; classes of one text are in no table.
        first = sig.groupBy("copy").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        first = first.withColumnRenamed("copy", "__copy")
        side = F.broadcast(first) if first.count() <= BROADCAST_CLASSES else first
        reps = sig.join(side, F.col("copy") == F.col("__copy"), "left").where("__first IS NULL OR __first = id").select("id", "copy", "buckets")
        entries = reps.select("copy", F.explode("buckets").alias("bucket"))
        buckets = cut(entries.groupBy("bucket").agg(
            F.min("copy").alias("centre"), F.max("copy").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        larger = buckets.where("n > 2").select(F.col("bucket").alias("__b"), "centre")
        if larger.count() <= BROADCAST_CLASSES:
            larger = F.broadcast(larger)
        in_larger = entries.join(larger, F.col("bucket") == F.col("__b")).select("bucket", "centre", "copy")
        # Buckets of two are whole in (centre, last); only larger ones need their members fetched.
        stars = cut(buckets.where("n = 2 AND centre <> last").select(F.lit(None).cast("long").alias("bucket"), "centre", F.col("last").alias("copy")).distinct()
                    .unionByName(in_larger.where("copy <> centre")))
        edges = cut(stars.select(F.col("centre").alias("gid"), "copy").distinct())
        involved = cut(edges.select(F.explode(F.array("gid", "copy")).alias("copy")).distinct())
        few = involved.count() <= BROADCAST_CLASSES
        wanted = reps.join(F.broadcast(involved) if few else involved, "copy", "left_semi").select(F.col("id").alias("__id"))
        texts = df.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("__id"), "left_semi")
        sets = cut(shingle_sets(texts, words).dropDuplicates(["copy"]))
        found = cut(compare(edges, sets, threshold, centred=True, every=every))
        # Step 5: members of larger buckets that are not similar to the centre, where two or more are left.
        tight = found.select(F.col("a").alias("__c"), F.col("b").alias("__m")).unionByName(found.select("b", "a").toDF("__c", "__m"))
        left = stars.where("bucket IS NOT NULL").join(tight, (F.col("centre") == F.col("__c")) & (F.col("copy") == F.col("__m")), "left_anti")
        left = left.select(F.col("bucket").alias("gid"), "copy")
        several = left.groupBy(F.col("gid").alias("__g")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        rest = compare(left.join(several, F.col("gid") == F.col("__g"), "left_semi"), sets, threshold, centred=False)
        self.pairs = cut(found.unionByName(rest).dropDuplicates(["a", "b"]))


def id_pairs(found: Similar) -> DataFrame:
    """(id_a, id_b): every two similar texts, copies among them.

    The size of the result is the number of pairs; for a linear one use :func:`groups`.
    """
    m = found.members.select("id", "copy")
    left, right = m.toDF("id_1", "a"), m.toDF("id_2", "b")
    other = found.pairs.select("a", "b").join(left, "a").join(right, "b").select("id_1", "id_2")
    many = m.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("copy")
    again = m.join(many, "copy", "left_semi").select("id", "copy")
    same = again.toDF("id_1", "a").join(again.toDF("id_2", "b"), (F.col("a") == F.col("b")) & (F.col("id_1") < F.col("id_2"))).select("id_1", "id_2")
    both = other.where("id_1 <> id_2").unionByName(same)
    return both.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, group): the least node of each connected component, of the nodes in (a, b).

    Every round takes the least label among a node's own and its neighbours', then the label of that label;
    rounds end when no label changes. Edges and labels are tables throughout.
    """
    ends = cut(pairs.select("a", "b").unionByName(pairs.select("b", "a").toDF("a", "b")).distinct())
    labels = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("group")))
    while True:
        near = ends.join(labels, ends["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("far"))
        new = cut(step.join(jump, "group", "left").select("node", "old", F.least("group", "far").alias("group")))
        changed = new.where(F.col("old") != F.col("group")).limit(1).count()
        labels = new.select("node", "group")
        if not changed:
            return labels


def groups(found: Similar) -> DataFrame:
    """One row per text that is not null: (id, class_id, group_id), and where all pairs were looked for links. Texts too short for a shingle are a class with
    their copies, but similar to none: they have no links, as they have no pairs.

    class_id is the least id of its copies, group_id the least id of the texts connected to it by similar pairs, links the number of
    other texts that are similar to it, copies included. Linear in the texts and the pairs between classes.
    """
    sizes = found.members.groupBy("copy").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("n"))
    ends = found.pairs.select("a", "b").unionByName(found.pairs.select("b", "a").toDF("a", "b"))
    links = ends.join(sizes.select(F.col("copy").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("links"))
    labels = components(found.pairs)
    per = sizes.join(labels, sizes["copy"] == labels["node"], "left").select("copy", "class_id", "n", F.coalesce("group", "copy").alias("group"))
    named = per.groupBy("group").agg(F.min("class_id").alias("group_id"))
    per = per.join(named, "group").drop("group")
    alone = found.short.groupBy("copy").agg(F.min("id").alias("class_id"))
    short = found.short.distinct().join(alone, "copy").select("id", "class_id", F.col("class_id").alias("group_id"))
    if not found.every:
        return found.members.distinct().join(per, "copy").select("id", "class_id", "group_id").unionByName(short)
    per = per.join(links, per["copy"] == links["a"], "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    return found.members.distinct().join(per, "copy").select("id", "class_id", "group_id", "links").unionByName(short.withColumn("links", F.lit(0).cast("long")))
