"""Text and identifier functions as Column expressions; Arrow UDFs only for Unicode folding, entities and edit distances."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Registrants of preprint servers' DOIs.
PREPRINT_DOI_PREFIXES = ("10.48550/", "10.1101/", "10.21203/", "10.2139/", "10.20944/", "10.36227/", "10.31219/", "10.31234/")
#: The identifiers of a record, in the order in which they decide a match.
ID_FIELDS = ("doi", "pmid", "arxiv_id", "openalex_id", "semantic_scholar_id")


def blank(c: Column) -> Column:
    """Null and empty strings are both missing."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    """The string, or null if it is missing."""
    return F.when(~blank(c), c)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern matches first, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_doi(c: Column) -> Column:
    """The first DOI in a string, lower case, without closing punctuation."""
    return filled(F.lower(F.regexp_replace(found(c, r'(?i)10\.\d{4,9}/[^\s"<>]+'), r"[.,;)\]}]+$", "")))


def normalize_arxiv_id(c: Column) -> Column:
    """A versionless arXiv id from an id, URL or arXiv DOI."""
    inner = F.coalesce(found(c, r"(?i)10\.48550/arxiv\.(.+)$", 1), c)
    new = found(inner, r"(?<![\d.])(\d{4}\.\d{4,5})(v\d+)?(?!\d)", 1)
    old = found(inner, r"(?i)([a-z\-]+(\.[A-Z]{2})?/\d{7})(v\d+)?", 1)
    return F.coalesce(new, F.lower(old))


def normalize_pmid(c: Column) -> Column:
    """The first run of five to nine digits."""
    return found(c.cast("string"), r"(\d{5,9})", 1)


@F.pandas_udf(T.StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


@F.pandas_udf(T.StringType())
def _fold(c: pd.Series) -> pd.Series:
    return c.map(lambda x: x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def strip_markup(c: Column, entities: bool = True) -> Column:
    """Text without tags, entities resolved, white space collapsed; missing text is empty.

    entities=False keeps the expression inside the JVM for text that has none.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    return squeeze(_unescape(bare) if entities else bare)


def strip_scripts(c: Column) -> Column:
    """HTML without script and style elements (F18, its first half)."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")


def html_text(c: Column, entities: bool = True) -> Column:
    """Readable text of an HTML fragment."""
    return strip_markup(strip_scripts(c), entities)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _fold(c)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters that they fold to."""
    marked, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [ch for ch in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(ch)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha():
            marked.append(chr(point))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def fold_letters(c: Column) -> Column:
    """Latin letters without their marks, inside the JVM, so that it can stand in a lambda."""
    marked, plain = _plain_letters()
    return F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), marked, plain)


def normalize_title(c: Column, unicode: bool = True) -> Column:
    """A title's key: lower case, no accents, markup, punctuation or version words.

    unicode=False skips markup entities and accent folding, for titles known to be ASCII.
    """
    text = strip_markup(c, entities=unicode)
    low = F.lower(fold_accents(text) if unicode else text)
    words = F.regexp_replace(low, r"(?U)[^\w\s]", " ")
    return squeeze(F.regexp_replace(words, r"\b(preprint|extended abstract|extended version|full version|v\d+)\b", " "))


def normalize_author_name(c: Column, unicode: bool = True) -> Column:
    """A name in plain lower-case letters, blanks and hyphens."""
    text = F.coalesce(c, F.lit(""))
    return squeeze(F.regexp_replace(F.lower(fold_letters(text) if unicode else text), r"[^a-z\s\-]", " "))


def distinguishing_tokens(title_key: Column) -> Column:
    """Sorted part numbers and number words, which make nearly equal titles different works."""
    parts = F.regexp_extract_all(title_key, F.lit(r"\b(?:part|phase|stage|type|grade|volume|vol)\s+([ivx]+|\d+)\b"), F.lit(1))
    rest = F.regexp_replace(title_key, r"\b(?:part|phase|stage|type|grade|volume|vol)\s+([ivx]+|\d+)\b", " ")
    numbers = F.regexp_extract_all(rest, F.lit(r"\b(\d+[a-z]?)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(parts, numbers)))


def title_bucket(title_key: Column) -> Column:
    """The first six letters, without leading articles and blanks."""
    bare = F.regexp_replace(title_key, r"^(?:(?:a|an|the|towards?|on)\s+)+", "")
    return F.substring(F.replace(bare, F.lit(" "), F.lit("")), 1, 6)


def is_preprint_doi(c: Column) -> Column:
    """Whether a DOI was registered by a preprint server (P10)."""
    own = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for prefix in PREPRINT_DOI_PREFIXES:
        out = out | own.startswith(prefix)
    return out


def redact(c: Column, names: tuple[str, ...] = ("api_key", "apikey", "key", "token", "access_token", "email", "mailto", "password")) -> Column:
    """URL text with the values of credential parameters masked."""
    return F.regexp_replace(c, rf"(?i)\b({'|'.join(names)})=([^&\s]+)", "$1=***")


def seen_key(c: Column) -> Column:
    """16 hexadecimal digits that stand for an identifier (F16)."""
    return F.substring(F.sha1(c), 1, 16)


def seen_keys(doi: Column, arxiv_id: Column, pmid: Column, title_key: Column) -> Column:
    """A key for each identifier of a record, or for its title if it has none (F16)."""
    of_doi = F.when(doi.startswith("10.48550/arxiv."), normalize_arxiv_id(doi))
    ids = F.array_compact(F.array(filled(doi), filled(arxiv_id), filled(pmid), of_doi))
    either = F.when(F.size(ids) > 0, ids).otherwise(F.array_compact(F.array(filled(title_key))))
    return F.array_distinct(F.transform(either, seen_key))


def match_text(c: Column) -> Column:
    """Letters and digits only, lower case, citation markers gone."""
    unmarked = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[(bib[\w.:-]+)\]", " ")
    return F.trim(F.regexp_replace(F.lower(unmarked), r"[^a-z0-9]+", " "))


def clip(c: Column, n: int = 220) -> Column:
    """At most n characters, cut before a word, with an ellipsis."""
    whole = squeeze(F.coalesce(c, F.lit("")))
    head = F.regexp_replace(F.substring(whole, 1, n - 1), r" [^ ]*$", "")
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(head, F.lit("…")))


def slug(c: Column, longest: int = 40) -> Column:
    """Lower-case words joined by hyphens, cut at a word."""
    base = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    base = F.when(base == "", "alert").otherwise(base)
    head = F.substring(base, 1, longest + 1)
    cut = F.when(head.contains("-"), F.regexp_replace(head, r"-[^-]*$", "")).otherwise(F.substring(base, 1, longest))
    return F.when(F.length(base) <= longest, base).otherwise(cut)


def seed_tag(first_author: Column, year: Column, title_key: Column) -> Column:
    """Surname, year and first long title word of a record."""
    surname = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(F.coalesce(filled(first_author), F.lit("paper"))), r"\s+"), -1)), "[^a-z]", "")
    word = F.coalesce(F.get(F.filter(F.regexp_extract_all(title_key, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 3), F.lit(0)), F.lit("paper"))
    return F.substring(F.concat(surname, F.coalesce(year.cast("string"), F.lit("")), F.lit("-"), word), 1, 40)


def inverted_text(words: Column) -> Column:
    """A map of words to their positions, from 0, in an array of words (F21, the other way).

    Words are sorted with their positions and cut where the word changes, so an array's work is that of its sort, and it
    doesn't leave its row. Each step is bound to a lambda's variable, so that it is evaluated once.
    """
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    heads = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["word"] != F.get(s, i - 1)["word"]), i)), lambda i: i.isNotNull())
    run = lambda s, h: F.transform(h, lambda at, k: F.struct(F.get(s, at)["word"].alias("key"), F.transform(F.slice(s, at + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - at), lambda x: x["at"]).alias("value")))
    return F.map_from_entries(once(placed, lambda s: once(heads(s), lambda h: run(s, h))))


def rebuild_abstract(inverted: Column) -> Column:
    """Text from a map of words to positions."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.array_join(F.transform(F.sort_array(placed), lambda s: s["word"]), " "), F.lit(""))


def osa_distance(a: str, b: str) -> int:
    """Edit distance in which neighbouring letters may also change places, each once."""
    before, last, now = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, now = last, now, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
    return now[-1]


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance() of two columns."""
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: A pair is compared only from this length ratio on, and counts from this upper bound on.
LENGTH_GATE, QUICK_GATE = 0.85, 0.9


def title_ratio(a: str | None, b: str | None) -> float:
    """Gestalt similarity of two title keys, 0 where a cheap bound already rules them out."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < LENGTH_GATE * max(len(a), len(b)):
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    return 0.0 if min(matcher.real_quick_ratio(), matcher.quick_ratio()) < QUICK_GATE else matcher.ratio()


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """title_ratio() of two columns of title keys."""
    return pd.Series([title_ratio(x, y) for x, y in zip(a, b, strict=True)])


#: Said to be nondeterministic, so that no plan asks it once for a filter and once for its value, in a worker each.
_similarity_once = F.pandas_udf(title_similarity.func, T.DoubleType()).asNondeterministic()

#: From this length of its second text on, SequenceMatcher passes over frequent letters.
JUNK_FROM = 200


def title_likeness(a: Column, b: Column) -> Column:
    """title_ratio() of title keys; where one is a stretch of the other, as when a subtitle was cut off, it follows from their lengths."""
    least, most = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.coalesce((F.contains(a, b) | F.contains(b, a)) & (least >= LENGTH_GATE * most) & (least > 0) & (most < JUNK_FROM), F.lit(False))
    return F.when(inside, F.lit(2.0) * least / (least + most)).otherwise(_similarity_once(F.when(~inside, a), F.when(~inside, b)))


def split_path(c: Column) -> Column:
    """Segments of a path; a slash between blanks belongs to a name."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "(?<! )/(?! )"), lambda s: s != "")


def safe_filename(url: Column) -> Column:
    """A PDF file name from a URL."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"[^\w.\-]", "_")
    base = F.when(base == "", "paper").otherwise(base)
    return F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))
