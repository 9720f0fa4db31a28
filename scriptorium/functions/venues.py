"""Venue strings to canonical keys and types: an ordered table of patterns, compiled into one chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import filled, let, strip_markup

#: Key, type and pattern over lower-case venue text; the first that matches decides.
VENUE_PATTERNS = (
    ("radiology_ai", "journal", r"radiology[\s.:]*artificial intelligence|radiol\.?\s*artif\.?\s*intell"),
    ("tmi", "journal", r"transactions on medical imaging|ieee trans\.? med\.? imaging|^tmi$"),
    ("tpami", "journal", r"pattern analysis and machine intelligence|^tpami$"),
    ("tnnls", "journal", r"neural networks and learning systems|^tnnls$"),
    ("jmlr", "journal", r"^journal of machine learning research$|^jmlr$|j\.? mach\.? learn\.? res"),
    ("medical_image_analysis", "journal", r"^medical image analysis$|^med\.? image anal\.?$"),
    ("european_radiology", "journal", r"^european radiology$|^eur\.? radiol\.?$"),
    ("jdi", "journal", r"journal of digital imaging|imaging informatics in medicine|^j\.? digit\.? imaging"),
    ("aim", "journal", r"^artificial intelligence in medicine$|^artif\.? intell\.? med\.?$"),
    ("radiology", "journal", r"^radiology$"),
    ("miccai", "conference", r"medical image computing and computer[\s\-]assisted intervention|\bmiccai\b"),
    ("midl", "conference", r"medical imaging with deep learning|\bmidl\b"),
    ("isbi", "conference", r"international symposium on biomedical imaging|\bisbi\b"),
    ("rsna", "conference", r"radiological society of north america|\brsna\b"),
    ("neurips", "conference", r"neural information processing systems|\bneurips\b|\bnips\b"),
    ("iclr", "conference", r"international conference on learning representations|\biclr\b"),
    ("icml", "conference", r"international conference on machine learning(?!\s*(and\b|,|&|for\b|in\b|theory|\(icmla|\(icmlc))|\bicml\b"),
    ("cvpr", "conference", r"computer vision and pattern recognition(?!.*workshop)|\bcvpr\b"),
    ("iccv", "conference", r"international conference on computer vision(?!\s*(and\b|,|&|theory|for\b|in\b|\(visapp|\(cvidl))|\biccv\b"),
    ("eccv", "conference", r"european conference on computer vision|\beccv\b"),
    ("aaai", "conference", r"\baaai\b(?!\s*/\s*acm)"),
    ("ijcai", "conference", r"international joint conference on artificial intelligence|\bijcai\b"),
    ("arxiv", "preprint", r"\barxiv\b"),
    ("medrxiv", "preprint", r"\bmedrxiv\b|\bbiorxiv\b|research square|ssrn|preprints\.org|techrxiv"),
)
#: Tags and display names that differ from the key.
VENUE_TAGS = {"medical_image_analysis": "media", "radiology_ai": "radiology-ai", "european_radiology": "eur-radiol"}
UNTAGGED = ("unknown", "other_journal", "other_conference", "workshop", "preprint", "medrxiv")
VENUE_NAMES = {
    "neurips": "NeurIPS", "icml": "ICML", "iclr": "ICLR", "cvpr": "CVPR", "iccv": "ICCV", "eccv": "ECCV", "miccai": "MICCAI", "midl": "MIDL",
    "tpami": "TPAMI", "tmi": "IEEE TMI", "medical_image_analysis": "MedIA", "radiology_ai": "Radiology: AI", "tnnls": "TNNLS", "jmlr": "JMLR",
    "radiology": "Radiology", "aaai": "AAAI", "ijcai": "IJCAI", "isbi": "ISBI", "european_radiology": "European Radiology",
    "jdi": "J Digit Imaging", "aim": "AI in Medicine", "rsna": "RSNA", "arxiv": "arXiv",
}
#: Order of venue types, and types of a source's own words for them.
TYPE_RANK = {"journal": 3, "conference": 3, "workshop": 2, "preprint": 1}
GENERIC_VENUES = ("unknown", "other_journal", "other_conference")
_NOISE = r"^(\d{4}\s+)?(ieee/cvf\s+)?(proceedings of (the )?)?(\d+(st|nd|rd|th)\s+)?"


def first_pattern(text: Column, patterns, bare: Column | None = None) -> Column:
    """The key of the first pattern found in a text (or in its bare form), or null: an ordered dictionary look-up."""
    chain = F.lit(None).cast("string")
    for key, pattern in reversed([(p[0], p[-1]) for p in patterns]):
        hit = text.rlike(pattern) if bare is None else text.rlike(pattern) | bare.rlike(pattern)
        chain = F.when(hit, key).otherwise(chain)
    return chain


def canonical_venue(venue: Column, hint: Column | None = None, entities: bool = True) -> Column:
    """struct<key, type> of a venue string and its source's own word for its type."""
    said = F.lower(F.coalesce(hint if hint is not None else F.lit(""), F.lit("")))
    types = F.create_map(*[F.lit(x) for k, t, _ in VENUE_PATTERNS for x in (k, t)])
    pair = lambda k, t: F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"))

    def fallback(text: Column, workshop: Column) -> Column:
        return (
            F.when(text.contains("lecture notes in") | said.isin("book series", "book-series"), pair("other_conference", "conference"))
            .when(workshop, pair("workshop", "workshop"))
            .when(said.isin("repository", "preprint", "posted-content", "posted_content"), pair("preprint", "preprint"))
            .when(said.isin("journal", "journal-article", "journalarticle"), pair("other_journal", "journal"))
            .when(said.isin("conference", "proceedings-article", "proceedings", "conference_paper"), pair("other_conference", "conference"))
            .when(text == "", pair("unknown", "preprint"))
            .when(text.rlike("journal|transactions|letters|review|annals"), pair("other_journal", "journal"))
            .when(text.rlike("conference|symposium|proceedings|workshop"), pair("other_conference", "conference"))
            .otherwise(pair("unknown", "preprint"))
        )

    def of(text: Column) -> Column:
        workshop = text.rlike(r"\bworkshops?\b")
        own = lambda key: F.when(workshop & (types[key] == "conference"), "workshop").otherwise(types[key])
        known = lambda key: F.when(key.isNotNull(), F.struct(key.alias("key"), own(key).alias("type"))).otherwise(fallback(text, workshop))
        return let(let(F.regexp_replace(text, _NOISE, ""), lambda bare: first_pattern(text, VENUE_PATTERNS, bare)), known)

    return let(F.lower(strip_markup(venue, entities)), of)


def venue_tag(key: Column) -> Column:
    """Tag of a canonical venue, null for generic ones."""
    tags = F.create_map(*[F.lit(x) for pair in VENUE_TAGS.items() for x in pair])
    return F.when(~key.isin(*UNTAGGED), F.concat(F.lit("venue:"), F.coalesce(F.try_element_at(tags, key), F.replace(key, F.lit("_"), F.lit("-")))))


def venue_display(key: Column, venue: Column, year: Column) -> Column:
    """Name shown for a venue, with its year unless that is part of it."""
    names = F.create_map(*[F.lit(x) for pair in VENUE_NAMES.items() for x in pair])
    base = F.coalesce(F.try_element_at(names, key), filled(venue), F.lit("Unknown venue"))
    text = year.cast("string")
    return F.when(year.isNotNull() & (year != 0) & ~base.contains(text), F.concat(base, F.lit(" "), text)).otherwise(base)


def conference_name(key: Column, year: Column) -> Column:
    """Name of a known venue with its year, or empty."""
    names = F.create_map(*[F.lit(x) for pair in VENUE_NAMES.items() for x in pair])
    name = F.try_element_at(names, key)
    return F.coalesce(F.when(year.isNotNull(), F.concat(name, F.lit(" "), year.cast("string"))), name, F.lit(""))


def type_rank(venue_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair]), venue_type), F.lit(0))
