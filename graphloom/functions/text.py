"""Full-text and string predicates as native expressions. Each is false on null, also in its negated form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.predicates import P

#: What parts tokens: anything that is neither letter nor decimal digit. Tokens have two characters or more.
SEPARATOR = r"[^\p{L}\p{Nd}]"


def tokens(col: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.filter(F.split(F.lower(col), SEPARATOR), lambda t: F.length(t) >= 2)


def _query_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^\w]|_", query.lower()) if len(t) >= 2]


def _pair(name: str, test) -> tuple:
    def make(value: str) -> P:
        return P(lambda c, k: c.isNotNull() & F.coalesce(test(c, value), F.lit(False)), name, lambda: negated(value))

    def negated(value: str) -> P:
        return P(lambda c, k: c.isNotNull() & ~F.coalesce(test(c, value), F.lit(False)), f"not {name}", lambda: make(value))

    return make, negated


def _contains(c: Column, query: str) -> Column:
    if not query.strip():
        raise ValueError("textContains needs something to look for")
    words = _query_tokens(query)
    if not words:
        return F.lit(False)
    # The tokens stand once in the expression, outside any lambda: they are made once per row.
    return F.size(F.array_except(F.array(*map(F.lit, words)), tokens(c))) == 0


def marked(held: Column) -> Column:
    """Tokens as text, each between spaces of its own; tokens hold no spaces, so a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(held, "  "), F.lit(" "))


def _phrase(c: Column, query: str) -> Column:
    words = _query_tokens(query)
    if not words:
        return F.lit(False)
    return marked(tokens(c)).contains(" " + "  ".join(words) + " ")


def fuzzy_distance(term: str) -> int:
    """Edits allowed: none below 3 characters, one below 6, else two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def _near(c: Column, term: str) -> Column:
    term = term.strip()
    most = fuzzy_distance(term)
    return F.levenshtein(c, F.lit(term), most).between(0, most) if most else c == term


text_contains, text_not_contains = _pair("textContains", _contains)
text_contains_prefix, text_not_contains_prefix = _pair("textContainsPrefix", lambda c, v: F.exists(tokens(c), lambda t: t.startswith(v.strip().lower())))
text_contains_regex, text_not_contains_regex = _pair("textContainsRegex", lambda c, v: F.exists(tokens(c), lambda t: t.rlike(rf"\A(?:{v})\z")))
text_contains_fuzzy, text_not_contains_fuzzy = _pair("textContainsFuzzy", lambda c, v: F.exists(tokens(c), lambda t: _near(t, v.lower())))
text_contains_phrase, text_not_contains_phrase = _pair("textContainsPhrase", _phrase)
text_prefix, text_not_prefix = _pair("textPrefix", lambda c, v: c.startswith(v.strip()))
text_regex, text_not_regex = _pair("textRegex", lambda c, v: c.rlike(rf"\A(?:{v})\z"))
text_fuzzy, text_not_fuzzy = _pair("textFuzzy", lambda c, v: _near(F.trim(c), v))
