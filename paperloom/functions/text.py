"""Text functions as column expressions; all stay in the JVM but ``nfkc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom import config as C

# Patterns that results depend on.
TOKEN = r"[A-Za-z가-힣]+|\d+(?:[/-]\d+)*"
FOOTER = r"(?m)^[\s\-]*\b(?:Halaman|Hal\.|Page|Hal)\s+\d+\s+(?:dari|of|/)\s+\d+[\s\-]*$|^\s*-\s*\d+\s*-\s*$"
PAGE_NUMBER = r"(?m)^\s*\d{1,4}\s*$"
OLD_ARTICLE = r"(?i)(Pasal\s+\d+[A-Za-z]?|Bab\s+[IVXLCDM]+|Pembukaan)"
PREAMBLE, CHAPTER, ARTICLE, PART = r"(?i)\bPembukaan\b", r"(?i)\b(BAB\s+[IVXLCDM]+)\b", r"(?i)\b(Pasal\s+\d+[A-Za-z]?)\b", r"(?i)\b(Bagian\s+[0-9A-Za-z_]+)\b"
SIGNATURE = (r"(?i)^(?:PRESIDEN|MENTERI|GUBERNUR|WALIKOTA|BUPATI|REPUBLIK INDONESIA|DEWAN PERWAKILAN|TTD|SALINAN|Diundangkan|Ditetapkan|"
             r"LEMBARAN NEGARA|BERITA NEGARA|SOEMARDI|SARTONO)")
CITATION = r"(?i)\(\s*(Pasal\s+[A-Za-z0-9]+(?:\s+ayat\s*\([^)]+\))?)\s*[,，]\s*출처\s*[:：]\s*([^,，)]+?\.pdf)\s*[,，]\s*p\.?\s*(\d+)\s*\)"
LAW_TYPE = r"(?i)\b(UUD|UUDS|UURIS|UU|PP|Perpres|Permen[a-zA-Z]*|Kepmen[a-zA-Z]*|Perda|Inpres|Konstitusi)\b"
NUMBER_YEAR = r"(?i)(?:No\.?\s*|Nomor\s+)?(\d+)\s*(?:Tahun\s+|/|-)\s*(\d{4})"
CITED_ARTICLE = r"(?i)Pasal\s+(\d+[A-Za-z]?)"
YEAR = r"\b(19\d{2}|20\d{2})\b"
# Characters dropped and replaced when text is cleaned.
DROPPED, NBSP = "\u00ad\u200b\u200c\u200d\ufeff", "\u00a0"
#: A character that compatibility composition may change: none of ASCII, the ones above, quotes and dashes, Hangul syllables.
COMPOSABLE = r"[^\x00-\x7F\u00A0\u00AD\u200B-\u200D\u2013-\u2015\u2018-\u201F\u2022\uAC00-\uD7A3\uFEFF]"


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(c: Column) -> Column:
    """:func:`nfkc`; only texts with a character that it may change leave the JVM."""
    return F.coalesce(nfkc(F.when(c.rlike(COMPOSABLE), c)), c)


def strip(c: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def visible(c: Column) -> Column:
    """Soft hyphens and zero-width characters dropped, no-break spaces made spaces."""
    return F.translate(c, NBSP + DROPPED, " ")


def clean_chunk(c: Column, compose: bool = True) -> Column:
    """A chunk for display: composed, invisible characters dropped, runs of blanks one blank, stripped; null gives ''."""
    c = composed(c) if compose else c
    return F.coalesce(strip(F.regexp_replace(visible(c), r"[ \t]+", " ")), F.lit(""))


def clean_page(c: Column, compose: bool = True) -> Column:
    """A page before chunking: also page footers and lone page numbers go, blank runs and empty lines are reduced."""
    c = visible(composed(c) if compose else c)
    c = F.regexp_replace(F.regexp_replace(c, FOOTER, ""), PAGE_NUMBER, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")), F.lit(""))


def clean_page_old(c: Column) -> Column:
    """The older page cleaning: blank runs one blank, empty lines gone."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{2,}", "\n")), F.lit(""))


def tokens(c: Column) -> Column:
    """Search terms, lower-cased: runs of Latin letters or Hangul, numbers with their slashes and dashes; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def article_old(c: Column) -> Column:
    """The first article, chapter or preamble named, as written; '' if none."""
    return F.coalesce(F.regexp_extract(c, OLD_ARTICLE, 1), F.lit(""))


def article(c: Column) -> Column:
    """The label by rank, not place: preamble, else chapter, else article, else part; '' if none."""
    return F.coalesce(
        F.when(c.rlike(PREAMBLE), F.lit("Pembukaan")), _none(F.regexp_extract(c, CHAPTER, 1)), _none(F.regexp_extract(c, ARTICLE, 1)),
        _none(F.regexp_extract(c, PART, 1)), F.lit(""))


def is_noise(c: Column) -> Column:
    """Short texts, texts of few letters and digits, and short texts mostly of signature lines."""
    t = strip(F.coalesce(c, F.lit("")))
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    signed = F.size(F.filter(lines, lambda x: x.rlike(SIGNATURE)))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (F.length(t) < C.STRUCT_MIN) | (letters / F.greatest(F.length(t), F.lit(1)) < 0.3) | (
        (signed / F.size(lines) > 0.6) & (F.length(t) < 400))


def folder_collection(c: Column) -> Column:
    """The collection of a folder: an override, else what follows the first underscore, as a slug."""
    slug = F.when(c.contains("_"), F.substr(c, F.instr(c, "_") + 1)).otherwise(c)
    for folder, name in C.FOLDER_OVERRIDES.items():
        slug = F.when(c == folder, F.lit(name)).otherwise(slug)
    return F.concat(F.lit(C.COLLECTION_PREFIX), F.lower(F.regexp_replace(F.regexp_replace(slug, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")))


def source_category(c: Column) -> Column:
    """The collection a file name tells, null if it tells none."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(C.SOURCE_PREFIXES):
        out = F.when(c.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def law_category(c: Column) -> Column:
    """The collection of a kind of law, null if unknown."""
    t = F.lower(c)
    return (
        F.when(t.isin("uud", "uuds", "uuris", "konstitusi"), "constitution").when(t.isin("uu", "pp", "perpres", "perda"), t)
        .when(t.startswith("permen"), "permen").when(t.startswith("kepmen"), "kepmen").when(t == "inpres", "lainnya"))


def chunk_id(path: Column, page: Column, idx: Column) -> Column:
    """Ten hex characters of the path's hash, page and running number."""
    return F.concat(F.substring(F.sha1(path), 1, 10), F.lit("-p"), page, F.lit("-"), idx)


def snippet(c: Column, most: int = C.SNIPPET_CHARS) -> Column:
    """The head of the cleaned text, with an ellipsis if the raw text is longer."""
    return F.concat(F.substring(clean_chunk(c), 1, most), F.when(F.length(c) > most, F.lit("…")).otherwise(F.lit("")))


def short_name(c: Column, most: int = 64) -> Column:
    """A long file name without its middle."""
    head = (most - 1) * 6 // 10
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(most - 1 - head))))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def reading_minutes(c: Column) -> Column:
    """Minutes at 350 characters that aren't blank, at least 1."""
    n = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    return F.greatest(F.lit(1), F.floor(n / 350 + 0.5)).cast("int")


def highlight(c: Column, term: str) -> Column:
    """Every occurrence of ``term`` in any case put in mark tags; an empty term changes nothing."""
    if not term:
        return c
    quoted = "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in term)
    return F.regexp_replace(c, f"(?i)({quoted})", "<mark>$1</mark>")


# References to laws and their classes, links, source numbers and citations in an answer.
LAW_SPANS = [
    (r"\bUUD(?:\s+NRI)?\s+\d{4}\b", "cat-uud"), (r"\bUU(?:\s+(?:No\.?|Nomor))?\s*\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-uu"),
    (r"\bPP(?:\s+(?:No\.?|Nomor))?\s*\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-pp"), (r"(?i)\bPerpres(?:\s+(?:No\.?|Nomor))?\s*\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-perpres"),
    (r"(?i)\bPermen[a-zA-Z]*\s*(?:No\.?\s*)?\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-permen"), (r"(?i)\bKepmen[a-zA-Z]*\s*(?:No\.?\s*)?\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-kepmen"),
    (r"(?i)\bPerda(?:\s+(?:No\.?|Nomor))?\s*\d+(?:\s+Tahun\s+\d{4}|/\d{4})\b", "cat-perda"), (r"\bPasal\s+\d+[A-Z]?(?:\s+ayat\s+\(\d+\))?\b", "law-art"),
]
LINK = r"(?<![\">])(https?://[^\s<)]+[^\s<.,;:!?)])"
SOURCE_NUMBER, CITED = r"\[(\d{1,2})\]", r"\(([^()]*?(?:Pasal|출처)[^()]*?)\)"
#: What each pattern of a line becomes, in the order in which they are tried.
INLINE = [
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"(?<![*\w])\*([^*\n]+?)\*(?!\w)", "<em>$1</em>"), (r"`([^`]+)`", '<code class="ic">$1</code>'),
    *((rx, f'<span class="law-ref {cls}">$0</span>') for rx, cls in LAW_SPANS),
    (LINK, '<a href="$1" target="_blank" rel="noopener noreferrer" class="a-link">$1</a>'),
    (SOURCE_NUMBER, '<a href="#" class="src-ref" data-idx="$1">[$1]</a>'), (CITED, '<span class="cite">$1</span>'),
]


def inline_markup(c: Column) -> Column:
    """A line as HTML: escaped, then bold, italic, code, references to laws, links, source numbers and citations."""
    c = escape_html(c)
    for rx, to in INLINE:
        c = F.regexp_replace(c, rx, to)
    return c


def duration_seconds(c: Column) -> Column:
    """'1h30m', '120s' or a bare number of seconds; null for anything else."""
    t = F.lower(F.trim(c))
    part = lambda u: F.coalesce(F.regexp_extract(t, f"([0-9]+){u}", 1).try_cast("int"), F.lit(0))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(
        t.rlike("^([0-9]+h)?([0-9]+m)?([0-9]+s)?$") & (t != ""), part("h") * 3600 + part("m") * 60 + part("s"))
