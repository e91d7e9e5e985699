"""Repairing text from scanned pages (problem 4).

A hidden Markov model labels the lines of a text as header, page number, body or break. A line is seen by its layout
alone: blank, a number (that of its page or another), a line repeated on pages of its file and of no other, its
capitals, its final stop and its place on the page. The model is fitted by expectation maximisation on a bounded sample of texts,
from set starting values that also serve as pseudo-counts; every text is labelled by its most likely path.

Repeated lines, the word list and the corrections are counted over all texts. A word is taken as misread if it is rare and
becomes a much more frequent word when characters that look alike are made equal. A word broken at a line end is
joined over page furniture, unless the word is known with its hyphen.

What is looked up travels by joins on words, lines and ids; only the ``COMMON`` most frequent words, whose number is
fixed, go to every task, to leave the bulk of the words at home.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.neardup import slices
from paperloom.session import cut

COMMON = 30_000
#: Repeated lines up to this many in all, and in one file, are sent to every task by file; more are joined to the lines of each text.
BROADCAST_LINES, FILE_LINES = 1_000_000, 2_000

HYPHENS = "-\u2010\u00ac\u00ad"
#: A character of a word: an "@" is a misread "a", also at the ends of a word.
CHARACTER = r"(?:[^\W_]|@)"
TOKEN = re.compile(rf"{CHARACTER}+(?:-{CHARACTER}+)*")
WORDISH = re.compile(r"(?:[^\W_]|[-@])+")
_ASCII_WORDS = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in "-@"}
_ASCII_PARTS = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) != "@"}
LINE_HYPHEN = re.compile(rf"[{HYPHENS}][^\S\n]*\n")
OPEN_END = re.compile(rf"({CHARACTER}+(?:-{CHARACTER}+)*)[{HYPHENS}]\s*$")
FIRST = re.compile(rf"\s*({CHARACTER}+(?:-{CHARACTER}+)*)")
#: The end of a sentence that was carried over, as in "Article 4 paragraph / (3).".
CARRIED = re.compile(r"\(\d+\)[.,;:]+")
PAGE_LINE = re.compile(
    r"\W*(?:(?:hal|halaman|hlm|lembar|page|p|pg)\b\W*)?(\d+)(?:\W*(?:dari|of|/)\W*\d+)?\W*", re.I)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
STOPS = (".", ",", ";", ":", "!", "?")
DIGIT = re.compile(r"\d")
ODD = re.compile("[áé@0-9]")
# What scanning makes of a character.
CONFUSIONS = {
    "a": ["á", "@"], "b": ["6"], "d": ["cl"], "e": ["c", "é"], "g": ["9"], "h": ["b"], "i": ["l", "1"], "k": ["lc"], "l": ["1"],
    "m": ["rn"], "n": ["ri"], "o": ["0"], "s": ["5"], "t": ["f"], "u": ["ii"],
    "w": ["vv"], "y": ["v"],
}
# Each character as what the confusions make equal to it. One character at a time, so that equal readings get equal
# skeletons wherever they stand.
SINGLE = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "@": "a", "á": "a", "é": "e", "c": "e", "h": "b", "f": "t", "i": "l", "y": "v"}
SEVERAL = {"u": "ll", "m": "rn", "n": "rl", "k": "le", "d": "el", "w": "vv"}  # in this order: the n of rn is taken apart as well
_SKELETON = str.maketrans(SINGLE | SEVERAL | {"m": "rrl"})


def skeleton(text: str) -> str:
    """The text with characters that look alike made equal."""
    return text.lower().translate(_SKELETON)


def skeleton_column(text: Column) -> Column:
    out = F.translate(F.lower(text), "".join(SINGLE), "".join(SINGLE.values()))
    for a, b in SEVERAL.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def misreading(seen: str, meant: str) -> float | None:
    """How many characters of ``meant`` were confused to give ``seen``; a confusion the other way counts more, and None if none explains it.

    >>> misreading("pernilihan", "pemilihan"), misreading("intemasional", "internasional"), misreading("han", "hari")
    (1.0, 2.5, 2.5)
    """
    far = float("inf")
    best = [[far] * (len(seen) + 1) for _ in range(len(meant) + 1)]
    best[0][0] = 0.0
    for i in range(len(meant) + 1):
        for j in range(len(seen) + 1):
            c = best[i][j]
            if c == far:
                continue
            if i < len(meant):
                if j < len(seen) and meant[i] == seen[j]:
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], c)
                for x in CONFUSIONS.get(meant[i], ()):
                    # a confused character may be confused again for no letter, as i by l and l by 1
                    for y in _AGAIN(x):
                        if seen.startswith(y, j):
                            best[i + 1][j + len(y)] = min(best[i + 1][j + len(y)], c + (1.0 if y == x else 1.5))
            if j < len(seen):
                for x in CONFUSIONS.get(seen[j], ()):
                    if x.isalpha() and meant.startswith(x, i):
                        best[i + len(x)][j + 1] = min(best[i + len(x)][j + 1], c + 2.5)
    return None if best[-1][-1] == far else best[-1][-1]


def _AGAIN(x: str) -> list[str]:
    out = [x]
    for k, ch in enumerate(x):
        out += [x[:k] + y + x[k + 1 :] for y in CONFUSIONS.get(ch, ()) if not y.isalpha() or not y.isascii()]
    return out


# ---------------------------------------------------------------- counts over all texts

def keyed_lines(rows: DataFrame) -> DataFrame:
    """(id, file, page, key) of the lines that may be repeated, each once for a text; the file is a hash of its name.

    A line that ends with a stop and has three words in lower case in a row is the end of a sentence and none of these. Lines are compared
    without their page's number at the start or end, by their skeleton.
    """
    no, size = F.col("page").cast("string"), F.length(F.col("page").cast("string"))
    lines = rows.select("id", "file", "page", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.length("line") > 2) & ~(F.right("line", F.lit(1)).isin(*STOPS) & F.col("line").rlike(r"\p{Ll}\S*\s+\p{Ll}\S*\s+\p{Ll}")))
    line = F.regexp_replace("line", r"\s+", " ")
    lines = lines.withColumn("line", line)
    line = F.when(F.col("line").startswith(F.concat(no, F.lit(" "))), F.substr("line", size + 1)).when(
        F.col("line").endswith(F.concat(F.lit(" "), no)), F.left(F.col("line"), F.length("line") - size)).otherwise(F.col("line"))
    key = F.xxhash64(skeleton_column(F.regexp_replace(line, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return lines.where(F.col("line").rlike(r"\p{L}")).select("id", F.xxhash64("file").alias("file"), "page", key.alias("key"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(file_key, key, n): the lines on several pages of a file and in no other, and in how many texts they are.

    One aggregate of fixed width per line, combined on the map side.
    """
    per = keyed_lines(rows).groupBy("key").agg(F.min("file").alias("file_key"), F.max("file").alias("last"), F.min("page").alias("lo"),
                                               F.max("page").alias("hi"), F.count(F.lit(1)).alias("n"))
    return per.where("file_key = last AND lo <> hi").select("file_key", "key", "n")


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeats``, a map from the keys of repeated lines to their counts: of the whole file where these are few, else of the text's own lines."""
    lines = cut(repeated_lines(rows))
    entries = F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("repeats")
    largest = lines.groupBy("file_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (largest["all"] or 0) <= BROADCAST_LINES and (largest["most"] or 0) <= FILE_LINES:
        return rows.withColumn("file_key", F.xxhash64("file")).join(F.broadcast(lines.groupBy("file_key").agg(entries)), "file_key", "left").drop("file_key")
    own = keyed_lines(rows).join(lines.drop("file_key"), "key").groupBy(F.col("id").alias("__id")).agg(entries)
    return rows.join(own, F.col("id") == F.col("__id"), "left").drop("__id")


def line_key(line: str, page: int | None) -> int:
    """The key that :func:`repeated_lines` gives to the line."""
    line, no = re.sub(r"\s+", " ", line.strip(" ")), str(page)
    if line.startswith(no + " "):
        line = line[len(no) :]
    elif line.endswith(" " + no):
        line = line[: -len(no)]
    key = xxhash.xxh64_intdigest(skeleton(EDGES.sub("", line)), seed=42)  # as Spark hashes a text
    return key - 2**64 if key >= 2**63 else key


def plain_words(text: str) -> list[str]:
    """Words of lower-cased text, still with hyphens in them or at their ends."""
    return text.translate(_ASCII_WORDS).split() if text.isascii() else WORDISH.findall(text)


def whole_lines(text: str) -> str:
    """The text without the words broken at its line ends."""
    out, at = [], 0
    for m in LINE_HYPHEN.finditer(text):
        lo, hi = m.start(), m.end()
        while lo > at and (text[lo - 1].isalnum() or text[lo - 1] in "-@"):
            lo -= 1
        while hi < len(text) and text[hi].isspace():
            hi += 1
        while hi < len(text) and (text[hi].isalnum() or text[hi] == "@"):
            hi += 1
        out.append(text[at:lo])
        at = max(hi, at)
    return " ".join([*out, text[at:]]) if out else text


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): lower-cased words, those with inner hyphens also as a whole; words broken at a line end are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw: Counter = Counter()
            for t in b["text"]:
                raw.update(plain_words(whole_lines(t.lower())))
            count: Counter = Counter()
            for w, n in raw.items():
                if "-" in w:
                    for whole in TOKEN.findall(w):
                        count[whole] += n
                        if "-" in whole:
                            for part in whole.split("-"):
                                count[part] += n
                else:
                    count[w] += n
            yield pd.DataFrame({"word": list(count.keys()), "n": list(count.values())})

    return rows.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame, ratio: int = 20) -> DataFrame:
    """(word, meant): rare words that confused characters make of a word at least ``ratio`` times as frequent.

    Rare is at most 8 in a million of all words, or 4, and asked of words of letters alone; of a more frequent one of five letters or more, as
    a scanner makes that reads one letter wrongly all the time, ten times the ratio is asked, and that one confused character explains it. A word with digits, accents or "@" among its letters, which no
    word of the language has, only needs a counterpart three times as frequent. Of two characters only
    such words are taken, with one character confused and a counterpart of two that makes up 50 in a million of all words, and 10 at least: letters
    behind numbers and abbreviations look the same. A counterpart has letters alone. Words
    meet by their skeletons; of several counterparts the one with fewest confused characters is taken, then the most frequent.
    """
    total = words.agg(F.sum("n").alias("t"))
    plain = F.col("word").rlike(r"^[\p{L}-]+$") & ~F.col("word").rlike("[áé@]")
    odd = F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"[áé@0-9]") & ~F.col("word").rlike("[23478]") & (
        (F.length(F.regexp_replace("word", r"\P{L}", "")) * 2 > F.length("word")) | (F.length("word") == 2))
    keyed = words.where(F.length("word") >= 2).select("word", "n", plain.alias("plain"), odd.alias("odd"), skeleton_column(F.col("word")).alias("s"))
    rare = F.col("n") <= F.greatest(F.lit(4.0), F.col("t") * 8e-6)
    known = keyed.where("plain AND n > 1").select("s", F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    more = F.when(F.col("odd"), F.col("n_meant") >= F.greatest(F.lit(2), F.col("n") * 3)).otherwise(F.col("n_meant") >= F.col("n") * ratio)
    common = ~rare & ~F.col("odd")
    pairs = keyed.where("plain OR odd").crossJoin(F.broadcast(total)).where(~common | (F.length("word") > 4)).join(known, "s").where(more & (F.col("word") != F.col("meant")))
    pairs = pairs.withColumn("common", common).where(~F.col("common") | (F.col("n_meant") >= F.col("n") * ratio * 10))
    short = F.col("odd") & (F.length("word") == 2) & (F.length("meant") == 2) & (F.col("n_meant") >= F.greatest(F.lit(10.0), F.col("t") * 5e-5))
    pairs = pairs.where((F.length("word") > 2) & (F.length("meant") > 2) | short)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = [misreading(w, m) for w, m in zip(b["word"], b["meant"])]
            # a confusion the other way is believed of long words alone
            b["cost"] = [None if c is None or c >= 2.5 and len(w) < 8 or c >= 2 and len(w) < 3 or c > 1 and often else c
                         for c, w, often in zip(cost, b["word"], b["common"])]
            yield b[b["cost"].notna()][["word", "meant", "n_meant", "cost"]]

    told = pairs.select("word", "meant", "n_meant", "common").mapInPandas(explain, "word string, meant string, n_meant long, cost double")
    return told.groupBy("word").agg(F.min_by("meant", F.struct("cost", -F.col("n_meant"), "meant")).alias("meant"))


# ---------------------------------------------------------------- the line model

HEADER, NUMBER, BODY, BREAK = range(4)
SYMBOLS = ["blank", "page edge", "page mid", "num edge", "num mid", "title edge", "title mid", "again edge", "again mid",
           "twice edge", "twice mid", "capital edge", "capital mid", "text", "title stop edge", "title stop mid"]
#: Starting values, in parts of a hundred: how often a state shows a symbol, in the order of SYMBOLS.
EMIT = np.array([
    [0.1, 0.1, 0.1, 0.1, 0.1, 70.0, 12.0, 15.0, 1.0, 0.5, 0.1, 0.3, 0.1, 0.1, 8.0, 1.5],
    [0.1, 85.0, 13.0, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1],
    [0.1, 0.1, 0.3, 1.0, 2.0, 0.2, 0.3, 0.2, 2.0, 1.0, 2.0, 4.0, 6.0, 81.0, 0.1, 0.3],
    [99.0, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1],
]) / 100
STEP = np.array([[1, 2, 85, 12], [3, 1, 60, 36], [2, 5, 80, 13], [2, 3, 92, 3]]) / 100
START = np.array([20, 5, 73, 2]) / 100
#: Starting values count as so many lines when the model is fitted.
PRIOR = 2_000


class LineModel:
    def __init__(self, start=START, step=STEP, emit=EMIT) -> None:
        self.start, self.step, self.emit = (x / x.sum(-1, keepdims=True) for x in (start, step, emit))

    def paths(self, texts: list[list[int]]) -> list[list[int]]:
        """The most likely states of every text (Viterbi), for texts of like length together."""
        step, emit = np.log(self.step), np.log(self.emit).T
        out: list[list[int]] = [[] for _ in texts]
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        for lo in range(0, len(order), 512):
            group = order[lo : lo + 512]
            size = np.array([len(texts[i]) for i in group])
            seen = np.zeros((len(group), size[-1]), dtype=np.int64)
            for k, i in enumerate(group):
                seen[k, : size[k]] = texts[i]
            best = np.log(self.start) + emit[seen[:, 0]]
            back = np.zeros((size[-1], len(group), 4), dtype=np.int8)
            last = best.argmax(1)
            for j in range(1, size[-1]):
                into = best[:, :, None] + step  # from, to
                back[j] = into.argmax(1)
                best = into.max(1) + emit[seen[:, j]]
                last = np.where(size > j, best.argmax(1), last)
            states = np.zeros((len(group), size[-1]), dtype=np.int64)
            for j in range(size[-1] - 1, -1, -1):
                at = np.where(size - 1 == j, last, 0)
                if j + 1 < size[-1]:
                    inner = size - 1 > j
                    at = np.where(inner, back[j + 1][np.arange(len(group)), states[:, j + 1]], at)
                states[:, j] = at
            for k, i in enumerate(group):
                out[i] = states[k, : size[k]].tolist()
        return out

    def refit(self, texts: list[list[int]], rounds: int = 5) -> LineModel:
        """Baum-Welch, with the starting values as pseudo-counts."""
        m = self
        for _ in range(rounds):
            start, step, emit = START * PRIOR / 10, STEP * PRIOR, EMIT * PRIOR
            start, step, emit = start.copy(), step.copy(), emit.copy()
            for seen in texts:
                if not seen:
                    continue
                n = len(seen)
                a, b, c = np.empty((n, 4)), np.ones((n, 4)), np.empty(n)
                for i, o in enumerate(seen):
                    a[i] = (m.start if i == 0 else a[i - 1] @ m.step) * m.emit[:, o]
                    c[i] = a[i].sum()
                    a[i] /= c[i]
                for i in range(n - 2, -1, -1):
                    b[i] = m.step @ (m.emit[:, seen[i + 1]] * b[i + 1]) / c[i + 1]
                g = a * b
                start += g[0]
                np.add.at(emit.T, seen, g)
                for i in range(n - 1):
                    step += a[i][:, None] * m.step * (m.emit[:, seen[i + 1]] * b[i + 1] / c[i + 1])[None, :]
            m = LineModel(start, step, emit)
        return m


def observe(lines: list[str], page: int | None, repeats: dict) -> tuple[list[int], list[str | None]]:
    """The symbol of every line, and the page number that a line holds and nothing else."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    edge = {*full[:3], *full[-4:]}
    seen, numbers = [0] * len(lines), [None] * len(lines)
    for i in full:
        x = lines[i].strip()
        place = 0 if i in edge else 1
        if len(x) < 40 and DIGIT.search(x) and not CARRIED.fullmatch(x) and (m := PAGE_LINE.fullmatch(x)):
            if page is not None and int(m[1]) == page:
                numbers[i] = str(page)
            seen[i] = (1 if numbers[i] else 3) + place
            continue
        stop = x[-1] in STOPS
        n = repeats.get(line_key(x, page), 0) if repeats else 0
        if stop and not n:
            seen[i] = 13
            continue
        capital = False
        if not x[0].islower():
            ws = [w for w in x.split() if w[0].isalnum()]
            capital = sum(w[0].isupper() or w[0].isdigit() for w in ws) >= 0.6 * max(1, len(ws))
            if n and capital and len(ws) > 1:
                seen[i] = (14 if stop else 5) + place
                continue
        if stop:
            seen[i] = 13
        elif n > 2 and not x[0].islower() and x[0] != "(":
            seen[i] = 7 + place
        elif n:
            seen[i] = 9 + place
        else:
            seen[i] = 11 + place if capital else 13
    return seen, numbers


# ---------------------------------------------------------------- one text

def line_ends(lines: list[str], states: list[int]) -> Iterator[tuple[int, str, int, str]]:
    """(line, first half, line of the second half, second half) of words that may be broken at a line end.

    Between the halves only page furniture, breaks and, if they don't go on in lower case, up to two other lines may stand.
    """
    for i, x in enumerate(lines):
        if states[i] in (HEADER, NUMBER):
            continue
        m = OPEN_END.search(x)
        if not m or not any(ch.isalpha() for ch in m[1]):
            continue
        others = 0
        for j in range(i + 1, len(lines)):
            if states[j] in (HEADER, NUMBER, BREAK) or not lines[j].strip():
                continue
            f = FIRST.match(lines[j])
            if f and _goes_on(m[1], f[1]):
                yield i, m[1].lower(), j, f[1].lower()
                break
            others += 1
            if others > 2:
                break


def _goes_on(first: str, second: str) -> bool:
    """Whether a word may go on so: in lower case, in a misread character, or in capitals after capitals."""
    if second[0].isdigit() or second[0] == "@":
        return second[0] in "01569@" and any(ch.isalpha() for ch in second)
    return second[0].islower() or second.isupper() and first.isupper() and len(first) > 1


def label(texts: list[tuple[str, int | None, dict | None]], model: LineModel) -> list[tuple[list[str], list[int], list[str | None]]]:
    """(lines, their states, the page numbers they hold) of every (text, page, repeats)."""
    split = [t.split("\n") for t, _, _ in texts]
    seen = [observe(x, p, r or {}) for x, (_, p, r) in zip(split, texts)]
    return [(x, s, n) for x, s, (_, n) in zip(split, model.paths([s for s, _ in seen]), seen)]


def items(text: str, labelled: tuple, common: frozenset) -> Iterator[tuple[str, str, str]]:
    """(kind, a, b): header and page number lines, possible broken words as halves, and words that are not common."""
    lines, states, numbers = labelled
    for i, s in enumerate(states):
        if s == HEADER:
            yield "header", lines[i].strip(), ""
        elif s == NUMBER and numbers[i]:
            yield "page_number", numbers[i], ""
    low = text.lower()
    halves = list(line_ends(lines, states)) if LINE_HYPHEN.search(text) else []
    if halves:
        cut_at = {i: len(a) for i, a, _, _ in halves}
        skip = {j: len(b) for _, _, j, b in halves}
        rest = []
        for i, x in enumerate(low.split("\n")):
            if i in cut_at:
                x = x.rstrip().rstrip(HYPHENS)
                x = x[: len(x) - cut_at[i]]
            if i in skip:
                x = x.lstrip()[skip[i] :]
            rest.append(x)
        low = "\n".join(rest)
        for _, a, _, b in halves:
            yield "halves", a, b
    found = low.translate(_ASCII_PARTS).split() if low.isascii() else PART.findall(low)
    for w in set(found) - common:
        if (len(w) > 2 or len(w) == 2 and ODD.search(w)) and not w.isdigit():
            yield "word", w, ""


def paragraphs(labelled: tuple, joined: dict[str, str], fixed: dict[str, str]) -> str:
    """The labelled text without page furniture, broken words joined, misread words replaced, and lines put together to paragraphs.

    A paragraph ends at a break, or at a line that ends with a stop or is much shorter than the longest, or before
    a line that opens with a heading or a number in brackets.
    """
    lines, states, _ = list(labelled[0]), labelled[1], labelled[2]

    def repair(m: re.Match) -> str:
        meant = fixed.get(m[0].lower())
        if meant is None:
            return m[0]
        return meant.upper() if m[0].isupper() else meant.capitalize() if m[0][0].isupper() else meant

    for i, a, j, b in line_ends(lines, states):
        whole = joined.get(f"{a} {b}")
        m, f = OPEN_END.search(lines[i]), FIRST.match(lines[j])
        head = lines[i][: m.start()]
        if whole is None:  # the hyphen is the word's own
            whole = f"{m[1]}-{f[1]}"
        elif m[1][0].isupper():
            whole = whole.capitalize()
        lines[i], lines[j] = head + whole, lines[j][f.end() :].lstrip()
    body = [(x.strip(), s) for x, s in zip(lines, states) if s not in (HEADER, NUMBER)]
    width = max((len(x) for x, _ in body), default=0)
    out: list[str] = []
    open_ = False
    for x, s in body:
        if s == BREAK:
            open_ = False
        if not x:  # a line that was joined to the one before is empty, and ends nothing
            continue
        x = PART.sub(repair, x)
        if open_ and not OPENS.match(x):
            out[-1] += (" " if not x[0] in ",.;:" else "") + x
        else:
            out.append(x)
        open_ = not STOPPED_LINE.search(x) and len(x) > 0.6 * width
    return "\n".join(out)


PART = re.compile(rf"{CHARACTER}+")
OPENS = re.compile(r"(?i)(?:\(\d+\)|[a-z]\.\s|pasal\s+\d+[a-z]?\s*\.?$|bab\s+[ivxlc]+\b)")
STOPPED_LINE = re.compile(r"[.!?:;]$")


# ---------------------------------------------------------------- all texts

class Repair:
    """What is needed to repair ``rows`` (id, file, page, text): tables of repeated lines, words and corrections, and the line model."""

    def __init__(self, rows: DataFrame, sample: int = 2_000, seed: int = 5) -> None:
        rows = rows.where(F.col("text").isNotNull())
        self.words = cut(word_counts(rows))
        self.fixes = cut(corrections(self.words))
        self.rows = with_repeats(rows).select("id", "page", "text", "repeats")
        sc = rows.sparkSession.sparkContext
        common = frozenset(r[0] for r in self.words.where(r"word RLIKE '^\\p{L}+$'").orderBy(F.desc("n"), "word").limit(COMMON)
                           .join(self.fixes, "word", "left_anti").select("word").collect())
        self.common = sc.broadcast(common)
        share = min(1, sample / max(rows.count(), 1))
        some = self.rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**15)) < int(10**15 * share))
        self.model = sc.broadcast(LineModel().refit(self._observed(some)))
        self.found = cut(self._items())

    @staticmethod
    def _observed(rows: DataFrame) -> list[list[int]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"seen": [observe(t.split("\n"), _page(p), r)[0] for p, t, r in zip(b["page"], b["text"], b["repeats"])]})

        return rows.mapInPandas(run, "seen array<int>").toArrow().column("seen").to_pylist()

    def _items(self) -> DataFrame:
        model, common = self.model, self.common
        kind = self.rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part in slices(b["text"]):
                    c = b.iloc[part]
                    texts = list(zip(c["text"], map(_page, c["page"]), c["repeats"]))
                    out = {(i, *x) for i, t, y in zip(c["id"], texts, label(texts, model.value)) for x in items(t[0], y, common.value)}
                    yield pd.DataFrame(list(out), columns=["id", "kind", "a", "b"])

        return self.rows.mapInPandas(run, f"id {kind}, kind string, a string, b string")

    def joined(self) -> DataFrame:
        """(a, b, whole, misread): halves that make a word, the word, and whether it had wrong characters.

        Halves known with their hyphen, in the middle of lines, more often than without are no broken word, nor are
        two equal halves never seen as one.
        """
        halves = self.found.where("kind = 'halves'").select("a", "b").distinct()
        n = self.words.select(F.col("word").alias("__w"), "n")
        h = halves.withColumn("whole", F.concat("a", "b")).withColumn("own", F.concat_ws("-", "a", "b"))
        h = h.join(n.select(F.col("__w").alias("whole"), F.col("n").alias("n_whole")), "whole", "left")
        h = h.join(n.select(F.col("__w").alias("own"), F.col("n").alias("n_own")), "own", "left")
        # A whole that was never seen unbroken is looked up by its skeleton.
        known = self.words.where(r"word RLIKE '^\\p{L}[\\p{L}-]*$' AND n > 4").join(self.fixes, "word", "left_anti").select(
            skeleton_column(F.col("word")).alias("s"), "word", "n").groupBy("s").agg(F.max_by("word", F.struct("n", "word")).alias("meant"), F.max("n").alias("n_meant"))
        h = h.join(self.fixes.select(F.col("word").alias("whole"), F.col("meant").alias("fix")), "whole", "left").withColumn("s", skeleton_column(F.col("whole")))
        h = h.join(known, "s", "left")
        own, whole = F.coalesce("n_own", F.lit(0)), F.coalesce("n_whole", F.lit(0))
        meant = F.coalesce("fix", F.when(whole == 0, F.col("meant")), F.col("whole"))
        # A word never seen whole, of which the second half is a word, comes of two lines that don't belong together.
        second = known.select(F.col("meant").alias("b")).unionByName(self.fixes.select(F.col("word").alias("b"))).distinct().withColumn("b_is_word", F.lit(True))
        h = h.join(second, "b", "left").where((whole > 0) | F.col("fix").isNotNull() | F.col("meant").isNotNull() | F.col("b_is_word").isNull())
        return h.where((own <= whole) & ((F.col("a") != F.col("b")) | (whole > 0))).select(
            "a", "b", meant.alias("whole"), (meant != F.col("whole")).alias("misread"))

    def items(self) -> DataFrame:
        """(id, kind, item): kinds hyphenation, misread, header, page_number."""
        f = self.found
        plain = f.where("kind IN ('header', 'page_number')").select("id", "kind", F.col("a").alias("item"))
        words = f.where("kind = 'word'").join(self.fixes, F.col("a") == F.col("word")).select("id", F.lit("misread").alias("kind"), F.col("meant").alias("item"))
        broken = f.where("kind = 'halves'").join(cut(self.joined()), ["a", "b"]).select("id", "whole", "misread")
        hyphens = broken.select("id", F.lit("hyphenation").alias("kind"), F.col("whole").alias("item"))
        both = broken.where("misread").select("id", F.lit("misread").alias("kind"), F.col("whole").alias("item"))
        return plain.unionByName(words).unionByName(hyphens).unionByName(both).distinct()

    def texts(self) -> DataFrame:
        """(id, text): every text in continuous paragraphs; null texts are left out, empty ones stay empty."""
        joined = self.found.where("kind = 'halves'").join(self.joined(), ["a", "b"]).groupBy("id").agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "a", "b"), "whole"))).alias("joined"))  # at most a text's lines
        fixed = self.found.where("kind = 'word'").join(self.fixes, F.col("a") == F.col("word")).groupBy("id").agg(
            F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("fixed"))  # at most a text's words
        model, kind = self.model, self.rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                done = label(list(zip(b["text"], map(_page, b["page"]), b["repeats"])), model.value)
                yield pd.DataFrame({"id": b["id"], "text": [paragraphs(y, j or {}, x or {}) for y, j, x in zip(done, b["joined"], b["fixed"])]})

        return self.rows.join(joined, "id", "left").join(fixed, "id", "left").mapInPandas(run, f"id {kind}, text string")


def _page(p) -> int | None:
    return None if p is None or p != p else int(p)
