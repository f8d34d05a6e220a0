"""What differs by language, as data: word sets for reading text, and connectives of time. Unknown languages read as English."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from lattica.functions import text


@dataclass(frozen=True)
class Connective:
    """relation: how the first event stands to the second; role: adverb (of the later clause), subordinate (opens a clause) or preposition."""

    relation: str
    role: str
    kind: str
    conditional: bool = False


@dataclass(frozen=True)
class Language:
    code: str
    name: str
    stop_words: tuple = ()
    prepositions: tuple = ()
    articles: tuple = ()
    copulas: tuple = ()
    possessives: tuple = ()
    pronouns: tuple = ()
    deixis_verbs: tuple = ()
    it_verbs: tuple = ()
    equality: tuple = ()
    interrogatives: tuple = ()
    connectives: dict = field(default_factory=dict)
    conditional_markers: tuple = ()
    time_nouns: tuple = ()


# English word sets and connectives of time.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "shall", "it", "its", "this", "that", "these", "those", "there", "their", "they", "them", "of", "to",
    "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "above", "below", "between", "under",
    "again", "further", "then", "once", "here", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "but", "because", "until", "while", "about", "against", "down",
    "out", "off", "over",
)
POSSESSIVES = ("its", "his", "her", "their", "theirs", "our", "your", "my", "mine")
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "its", "their", "theirs")
IT_VERBS = ("show", "prove", "mean", "suggest", "indicate", "demonstrate", "reveal", "confirm", "imply", "illustrate", "reflect")
DEIXIS_VERBS = IT_VERBS + (
    "result", "lead", "cause", "enable", "allow", "prevent", "require", "involve", "affect", "surprise", "shock", "please", "anger", "upset", "annoy",
)
SEQUENTIAL = (
    "then", "subsequently", "afterwards", "afterward", "next", "first", "finally", "later", "soon", "eventually", "thereafter", "henceforth",
    "subsequent", "ultimately", "presently",
)
PRECEDING = ("previously", "earlier", "beforehand", "prior", "already")
SUBORDINATE = {
    "after": ("after", "succession"), "since": ("after", "succession"), "once": ("before", "conditional"), "until": ("meets", "simultaneous"),
    "till": ("meets", "simultaneous"), "when": ("overlaps", "simultaneous"), "whenever": ("overlaps", "simultaneous"), "while": ("during", "simultaneous"),
    "whilst": ("during", "simultaneous"), "as": ("overlaps", "simultaneous"), "as soon as": ("meets", "succession"), "as long as": ("during", "simultaneous"),
    "so long as": ("during", "simultaneous"), "by the time": ("before", "precedence"), "now that": ("after", "succession"), "every time": ("overlaps", "simultaneous"),
}
PREPOSITIONAL = {"before": ("before", "precedence"), **{w: ("during", "simultaneous") for w in ("during", "throughout", "within", "between")}}
TOGETHER = {"meanwhile": "overlaps", "meantime": "overlaps", "at the same time": "equals", "in the meantime": "overlaps"}
CONDITIONAL = ("if", "when", "whenever", "unless", "provided", "assuming", "suppose", "given that", "in case")
TIME_NOUNS = (
    "noon", "midnight", "dawn", "dusk", "sunrise", "sunset", "morning", "afternoon", "evening", "night", "today", "tomorrow", "yesterday",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december", "year", "month", "week", "day", "hour", "minute", "second",
    "years", "months", "weeks", "days", "hours", "minutes", "seconds", "christmas", "easter",
)


def english() -> Language:
    time = {w: Connective("before", "adverb", "sequential", w == "then") for w in SEQUENTIAL}
    time |= {w: Connective(r, "adverb", "simultaneous") for w, r in TOGETHER.items()}
    time |= {w: Connective("after", "adverb", "precedence") for w in PRECEDING}
    time |= {w: Connective(r, "subordinate", k) for w, (r, k) in SUBORDINATE.items()}
    time |= {w: Connective(r, "preposition", k) for w, (r, k) in PREPOSITIONAL.items()}
    return Language(
        "en", "English", STOP_WORDS, text.PP, text.ARTICLES, text.COPULA_VERBS, POSSESSIVES, PRONOUNS, DEIXIS_VERBS, IT_VERBS, ("same", "equal", "identical", "equivalent"),
        ("who", "whom", "whose", "what", "which", "where", "when", "why", "how"), time, CONDITIONAL, TIME_NOUNS,
    )


KNOWN: dict[str, Language] = {"en": english()}


def register(language: Language) -> None:
    KNOWN[language.code] = language


def get(code: str = "en") -> Language:
    if code not in KNOWN:
        warnings.warn(f"no language {code!r}: reading as English", stacklevel=2)
    return KNOWN.get(code, KNOWN["en"])


def available() -> list[str]:
    return sorted(KNOWN)


def register_deixis(code: str, verbs: tuple, it_verbs: tuple) -> None:
    """Verbs after which this, that (verbs) or it (it_verbs) stand for what was said, not for a thing."""
    from dataclasses import replace

    KNOWN[code] = replace(get(code), code=code, deixis_verbs=tuple(verbs), it_verbs=tuple(it_verbs))
