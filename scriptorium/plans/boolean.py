"""The boolean query language: AND over groups of alternatives, compiled to Columns, SQL or other engines' syntaxes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.plans.vocabulary import MODALITY_SYNONYMS, MODALITY_TERMS, STOPWORDS, TOPIC_SYNONYMS, TOPIC_TERMS

#: Suffixes that a query word loses if four letters remain, and what a title or a body hit counts.
SUFFIXES, TITLE_HIT, BODY_HIT = ("ies", "es", "s", "ing", "ed"), 1.0, 0.6
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-+.]*[A-Za-z0-9+]|[A-Za-z0-9]")
_EXPLICIT = re.compile(r"\bAND\b|;|\bOR\b|\|")


def _bare(part: str) -> str:
    return part.strip().strip("()").strip()


def _expansions():
    for synonyms, table in ((TOPIC_SYNONYMS, TOPIC_TERMS), (MODALITY_SYNONYMS, MODALITY_TERMS)):
        yield from ((pattern, table[key]) for pattern, key in synonyms if key in table)


def parse_groups(text: str | None, expand: bool = True) -> list[list[str]]:
    """Groups of alternatives from explicit syntax (AND, OR, ;, |) or from the words of plain text."""
    said = (text or "").strip()
    if not said:
        return []
    if _EXPLICIT.search(said):
        parts = (re.split(r"\s+OR\s+|\|", _bare(part)) for part in re.split(r"\s+AND\s+|;", said))
        groups = ([a for a in (_bare(alternative).strip('"') for alternative in part) if a] for part in parts)
        return [g for g in groups if g]
    groups = [[phrase] for phrase in re.findall(r'"([^"]+)"', said)]
    rest = re.sub(r'"[^"]+"', " ", said)
    for pattern, others in _expansions() if expand else ():
        if hit := re.search(pattern, rest, re.IGNORECASE):
            groups.append(list(dict.fromkeys([hit[0], *others])))
            rest = f"{rest[: hit.start()]} {rest[hit.end() :]}"
    groups += [[w] for w in _WORD.findall(rest) if len(w) > 1 and w.lower() not in STOPWORDS]
    return list({tuple(t.lower() for t in g): g for g in reversed(groups)}.values())[::-1]


def stem(word: str) -> str:
    low = word.lower()
    return next((low[: -len(s)] for s in SUFFIXES if low.endswith(s) and len(low) - len(s) >= 4), low)


def term_pattern(term: str, lookbehind: bool = True) -> str:
    """A pattern for a term's stems, from a word's start, joined by blanks or hyphens.

    lookbehind=False writes the start of a word out in ASCII, for engines without look-arounds.
    """
    stems = [re.sub(r"([^a-z0-9_])", r"\\\1", stem(w)) + r"\w*" for w in re.split(r"[\s\-]+", term.strip()) if w]
    return (r"(?<!\w)" if lookbehind else r"(^|[^A-Za-z0-9_])") + r"[\s\-]*".join(stems)


@dataclass(frozen=True)
class Query:
    """An AND of OR-groups."""

    groups: tuple[tuple[str, ...], ...]
    label: str = "query"

    @classmethod
    def of(cls, text: str | None, label: str = "query", expand: bool = True) -> Query:
        return cls(tuple(map(tuple, parse_groups(text, expand))), label)

    def hits(self, title: Column, body: Column, lookbehind: bool = True) -> list[Column]:
        """A Column for each group: TITLE_HIT, BODY_HIT or 0."""
        out = []
        for group in self.groups:
            pattern = ("(?iU)" if lookbehind else "(?i)") + "|".join(term_pattern(t, lookbehind) for t in group if t.strip())
            out.append(F.when(F.coalesce(title, F.lit("")).rlike(pattern), TITLE_HIT).when(F.coalesce(body, F.lit("")).rlike(pattern), BODY_HIT).otherwise(0.0))
        return out

    def matches(self, text: Column, lookbehind: bool = True) -> Column:
        """Whether every group occurs, as a filter (Q03)."""
        out = F.lit(True)
        for group in self.groups:
            out = out & text.rlike(("(?iU)" if lookbehind else "(?i)") + "|".join(term_pattern(t, lookbehind) for t in group))
        return out

    def sql(self, text: str) -> str:
        """matches() as DuckDB SQL over an expression."""
        tests = [f"regexp_matches({text}, '(?i)" + "|".join(term_pattern(t, False) for t in g).replace("'", "''") + "')" for g in self.groups]
        return "(" + (" AND ".join(tests) or "TRUE") + ")"

    def _written(self, term, alternative: str, both: str) -> str:
        return both.join("(" + alternative.join(map(term, g)) + ")" for g in self.groups)

    @staticmethod
    def _quoted(term: str) -> str:
        return f'"{term}"' if re.search(r"[ -]", term) else term

    def openalex(self) -> str:
        return self._written(self._quoted, " OR ", " AND ").replace(",", " ")

    def semantic_scholar(self) -> str:
        return self._written(self._quoted, " | ", " + ")

    def pubmed(self) -> str:
        return self._written(lambda t: f'"{t}"[tiab]', " OR ", " AND ")

    def arxiv(self) -> str:
        def term(t: str) -> str:
            spaced = t.replace("-", " ")
            return f'abs:"{spaced}"' if " " in spaced else f"abs:{spaced}"

        return self._written(term, " OR ", " AND ")

    def free_text(self) -> str:
        return " ".join(g[0] for g in self.groups)


def cross_queries(modalities=(), topics=(), free_text: str | None = None) -> list[Query]:
    """A query for each modality and topic; both reliability themes together make one of three groups (Q04)."""
    mods = list(modalities) or list(MODALITY_TERMS)
    tops = list(topics) or ["foundation-model", "vlm", "uncertainty"]
    extra = ((free_text,),) if free_text else ()
    out = []
    for m in mods:
        own = tuple(MODALITY_TERMS.get(m, [m]))
        if sorted(tops) == ["uncertainty", "vlm"]:
            out.append(Query((own, tuple(TOPIC_TERMS["vlm"][:4]), tuple(TOPIC_TERMS["vlm-reliability"])), f"{m}+vlm+uncertainty"))
        else:
            out += [Query((own, tuple(TOPIC_TERMS.get(t, [t])), *extra), f"{m}+{t}") for t in tops]
    return out


def scan_queries() -> list[Query]:
    """The queries of a scheduled scan (Q04)."""
    general = tuple(MODALITY_TERMS["radiology-general"])
    return [
        *cross_queries(["cxr", "ct", "mammo"], ["foundation-model", "vlm", "uncertainty"]),
        Query((general, tuple(TOPIC_TERMS["uncertainty"])), "radiology+uncertainty"),
        Query((general, ("foundation model", "vision-language")), "radiology+fm/vlm"),
        Query((("radiology", "medical"), ("vision-language", "VLM", "multimodal large language model"), tuple(TOPIC_TERMS["vlm-reliability"])), "radiology+vlm+reliability"),
    ]
