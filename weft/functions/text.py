"""URI, markdown, HTML, date and literal functions as column expressions; all but html_lead() and shorten_to_tokens() stay in the JVM."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate
from math import floor
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.html import lead

if TYPE_CHECKING:
    from tokenizers import Tokenizer

RESOURCE = "http://dbpedia.org/resource/"
ONTOLOGY = "http://dbpedia.org/ontology/"


def _chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_uri(c: Column) -> Column:
    """Percent-decoding once; unchanged where it can't be decoded. + is no space."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def encode_uri(c: Column) -> Column:
    """Local name percent-encoded (slash kept, . and ' too are encoded); unchanged if it already has a %."""
    name = F.replace(c, F.lit(RESOURCE), F.lit(""))
    coded = _chain(F.url_encode(name), [("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A"), (".", "%2E")])
    return F.when(name.contains("%"), name).otherwise(coded)


def strip_entity(c: Column) -> Column:
    return F.trim(_chain(c, [("<", ""), (">", ""), (RESOURCE, ""), (ONTOLOGY, "")]))


def strip_entity_name(c: Column) -> Column:
    """strip_entity() with _ for spaces and without quotation marks, as names are compared."""
    return _chain(strip_entity(c), [(" ", "_"), ('"', ""), ("'", "")])


def strip_prefixes(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\b[A-Za-z]+:(?=[A-Za-z])", ""))


def local_name(c: Column) -> Column:
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def simple_label(c: Column) -> Column:
    """Cut at ( and at a comma, then without the words that hold a full stop."""
    cut = F.trim(F.substring_index(F.substring_index(c, "(", 1), ",", 1))
    return F.array_join(F.filter(F.split(cut, " "), lambda w: ~w.contains(".")), " ")


def normal_value(c: Column) -> Column:
    """For comparing: no resource prefix or leading colon, _ as space, lower case, trimmed."""
    plain = F.regexp_replace(F.replace(c, F.lit(RESOURCE), F.lit("")), "^:", "")
    return F.trim(F.lower(F.replace(plain, F.lit("_"), F.lit(" "))))


def md_links(c: Column, part: int = 2) -> Column:
    """Labels (part 1) or targets (part 2) of [label](:Target) links."""
    return F.regexp_extract_all(c, F.lit("\\[([^\\]]*)\\]\\(:([^)]*)\\)"), F.lit(part))


def md_to_text(c: Column) -> Column:
    """Markdown to plain text: links become labels, emphasis and images go, four entities, empty parentheses and runs of spaces."""
    c = F.regexp_replace(c, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    c = F.regexp_replace(c, "\\*\\*([^*]+)\\*\\*", "$1")
    c = F.regexp_replace(c, "\\*([^*]+)\\*", "$1")
    c = _chain(c, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")])
    c = F.regexp_replace(c, "\\( *\\)", "")
    return F.trim(F.regexp_replace(c, " +", " "))


#: Classes of elements that hold no prose.
DROPPED = ("ext-phonos", "IPA", "IPA-label", "Inline-Template", "reference")


def _lead(pages: pd.Series) -> pd.Series:
    return pd.Series([lead(x, DROPPED) for x in pages], dtype=object)


def html_lead(c: Column, encode: bool = False) -> Column:
    """The paragraphs of the first <article> or <section> as markdown links and text, by the structure of the page (weft/functions/html.py). Elements of the DROPPED
    classes go with all they hold, links to pages that don't exist lose their target; with encode, targets are percent-encoded."""
    text = F.pandas_udf(_lead, "string")(c)
    if not encode:
        return text
    pieces = F.regexp_extract_all(text, F.lit("(?s)(\\]\\(:[^)]*\\)|\\]|[^\\]]+)"), F.lit(1))
    target = lambda x: F.concat(F.lit("](:"), encode_uri(F.regexp_extract(x, "^\\]\\(:([^)]*)\\)$", 1)), F.lit(")"))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("](:"), target(x)).otherwise(x)), "")


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit('<a href="([^"]*)"'), F.lit(1))


#: Replacements in decoded model output, in their order.
REPAIRS = (("<s>", ""), ("</s>", ""), ("<pad>", ""), (" ;", ";"), ("; ", ";"), (" .", "."), ('" ', '"'), ("  ", " "))
_SIGNS = (('=" ', '="'), (" : ", ":"), (" :", ":"), (": ", ":"), (" #", "#"), ("< ", "<"), ("</ ", "</"), ("= ", "="), ("<? ", "<?"), ("# ", "#"), (" >", ">"), (" <", "<"), (" =", "="), ("/ ", "/"), ("/ ", "/"))
_ENDS = ((' "/>', '"/>'), (' ">', '">'))
_CARETS = ((":<", ": <"), (" ^", "^"), ("^ ", "^"), ("><", "> <"))
_STOPS = ((". ", "."), (" .", "."))
_QUOTES = (("\\\\'", "'"), ("\\'", "'"), ("\\'", "'"), ('\\\\"', '"'), ('\\"', '"'), ('\\"', '"'))
#: Those of markup syntaxes: what a model says, what is compared while it trains, what is scored (special tokens stay in these two), and lines before they are parsed, without or with a
#: space before each name.
REPAIRS_MODEL = (("<s>", ""), ("</s>", ""), ("<pad>", ""), *_SIGNS[:-1], *_ENDS, *_CARETS)
REPAIRS_TRAINED = (*_SIGNS, *_ENDS, *_CARETS)
REPAIRS_SCORED = (*_SIGNS, *_ENDS, (' " ', ' "'), (' ":"', '":"'), *_CARETS, *_STOPS, *_QUOTES, ("  a", " a"))
REPAIRS_LINE = (("<s>", ""), ("</s>", ""), *_SIGNS, *_ENDS, (' ":"', '":"'), *_CARETS, (' " ', ' "'), *_STOPS, ("  a", " a"))
REPAIRS_NAMES = (("<s>", ""), ("</s>", ""), (":", " :"), _SIGNS[0], *_SIGNS[3:], *_ENDS, (' ":"', '":"'), *_CARETS, (' " ', ' "'), *_STOPS)


def repair_decoded(c: Column, repairs: tuple[tuple[str, str], ...] = REPAIRS, trim: bool = True) -> Column:
    """Decoded model output: special tokens go, spaces around signs are put right, in the order given."""
    return F.trim(_chain(c, list(repairs))) if trim else _chain(c, list(repairs))


def escape_literal(c: Column) -> Column:
    return _chain(c, [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"')])


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "")


#: Month names of the date formats below.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Dates as people write them: a day with or without its ordinal ending and a month by name or abbreviation in either order, then the year; or numbers with one sign between them.
_NAMED = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "September" else "Sep(?:t(?:ember)?)?" for m in MONTHS) + r")\b\.?"
_DAY, _YEAR = r"[0-9]{1,2}(?:st|nd|rd|th)?\b\.?", r"[0-9]{4}(?![0-9])"
_WRITTEN = rf"(?i)(?<![\p{{L}}0-9])(?:{_DAY}\s+(?:of\s+)?{_NAMED},?\s+{_YEAR}|{_NAMED}\s+{_DAY},?\s+{_YEAR}|[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}(?![0-9])|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2{_YEAR})"


def _read_date(x: Column) -> Column:
    """The ISO form of one written date; null if there is no such day, or if two numbers below 13 leave open which one is the month (with full stops the day is first)."""
    numbers = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    n = lambda i: F.get(numbers, F.lit(i)).cast("int")
    name = F.lower(F.regexp_extract(x, "(?i)(" + "|".join(m[:3] for m in MONTHS) + ")", 1))
    month = F.element_at(F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m[:3].lower(), i)]), name)
    iso = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd").cast("string")
    day_first = x.contains(".") | (n(0) > 12) | (n(0) == n(1))
    return (
        F.when(name != "", iso(n(1), month, n(0)))
        .when(F.length(F.get(numbers, F.lit(0))) == 4, iso(n(0), n(1), n(2)))
        .when(day_first, iso(n(2), n(1), n(0)))
        .when(n(1) > 12, iso(n(2), n(0), n(1)))
    )


def dates_in(c: Column) -> Column:
    """ISO dates, sorted, for every date of a closed list of forms: 1994-08-29 (or with / and .), 29.08.1994, 29/08/1994, 08/29/1994, 29 August 1994, 29th of Aug 1994, Aug. 29th, 1994, in any letter
    case. Partial dates and ambiguous ones (05/06/1994) are left out; nothing is filled in from the clock."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(c, F.lit(_WRITTEN), F.lit(0)), _read_date))))


def long_date(c: Column) -> Column:
    return F.date_format(c, "dd MMMM yyyy")


def year_of(c: Column) -> Column:
    """The first four characters before a hyphen."""
    return F.substring(F.substring_index(c, "-", 1), 1, 4)


#: Small letters of the Cyrillic and Greek scripts, and Latin ones that are no letter with an accent, in Latin letters as is usual in ASCII.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "i", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "ts", "џ": "dz",
    "α": "a", "ά": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "έ": "e", "ζ": "z", "η": "e", "ή": "e", "θ": "th", "ι": "i", "ί": "i", "ϊ": "i", "ΐ": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "ό": "o", "π": "p", "ρ": "r",
    "σ": "s", "ς": "s", "τ": "t", "υ": "u", "ύ": "u", "ϋ": "u", "ΰ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o", "ώ": "o",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h",
}


def romanised(c: Column) -> Column:
    """The text in small letters, those of ROMAN in Latin ones; accents stay. One pass for letters that become one letter, a replacement for each of the others; ASCII text is only made small."""
    single, longer = {a: b for a, b in ROMAN.items() if len(b) == 1}, [(a, b) for a, b in ROMAN.items() if len(b) > 1]
    small = F.lower(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), _chain(F.translate(small, "".join(single), "".join(single.values())), longer)).otherwise(small)


def folds_into(text: Column, value: Column) -> Column:
    """Whether the text contains the value but for case, accents and script (Cyrillic and Greek against Latin letters). Where both are ASCII, case alone is left to look over, without a
    collation."""
    folded = F.contains(F.collate(romanised(text), "UNICODE_CI_AI"), F.collate(romanised(value), "UNICODE_CI_AI"))
    return F.when(text.rlike("[^\\x00-\\x7F]") | value.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.contains(F.lower(text), F.lower(value)))


def shorten(c: Column, budget: int) -> Column:
    """Drops sentences from the end until the text has `budget` characters at most; the first sentence always stays."""
    sentences = F.split(c, "(?<=[.]) ")
    step = lambda a, s: F.when((F.length(a) + F.length(s) + 1 <= budget) & ~a.endswith("\u0000"), F.concat(a, F.lit(" "), s)).otherwise(F.when(a.endswith("\u0000"), a).otherwise(F.concat(a, F.lit("\u0000"))))
    return F.replace(F.aggregate(F.slice(sentences, 2, F.size(sentences)), F.get(sentences, F.lit(0)), step), F.lit("\u0000"), F.lit(""))


def prompt(entity: Column, text: Column, prefix: str | None = None) -> Column:
    """Model input; with a prefix, a task's name stands before it in the place of the marks."""
    if prefix is not None:
        return F.concat(F.lit(f"{prefix}: "), entity, F.lit(" : "), text)
    return F.concat(F.lit("<s>"), entity, F.lit(" : "), text, F.lit("</s>"))


def _fitting(n: int, fits: Callable[[int], bool]) -> int:
    """The largest number up to n that fits, 0 if none does; more parts never make fewer tokens, so halving finds it."""
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


#: Characters of a text's head for each token of the budget, and of what is encoded at once at most, if the budget is not yet used up.
_HEAD, _HEAD_MOST = 6, 1 << 16
#: Where a byte-level tokenizer with the usual pattern cuts in any case: between a letter or digit (of scripts that all versions of Unicode know) and white space or a full stop that follows.
_SURE = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-џぁ-ゔァ-ヺ一-龥가-힣])(?=[\s.])")


class _Sizes:
    """How many tokens beginnings of texts have, told by one encoding of a text's head.

    A byte-level tokenizer with the usual pattern cuts texts between a letter or digit and white space or a full stop, whatever stands further on. So what stands before such a place has
    the tokens that end before it, and a text has no fewer than its beginning up to there. Other tokenizers, other places and texts with special tokens are encoded as they are."""

    def __init__(self, tokenizer: Tokenizer):
        about = json.loads(tokenizer.to_str())
        split, model = about.get("pre_tokenizer") or {}, about.get("model") or {}
        self.plain = about.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        self.marks = [t["content"] for t in about.get("added_tokens") or []]
        self.plain = self.plain and all(about.get(k) is None for k in ("truncation", "padding", "post_processor"))
        self.tokenizer = tokenizer

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, text: str, most: int) -> tuple[Callable[[int], bool], int]:
        """Whether the first i characters of a text have `most` tokens or fewer, and how many characters were encoded to tell."""
        if not self.plain or most < 0 or any(m in text for m in self.marks):
            return lambda i: self.whole(text[:i]) <= most, len(text)
        n, end, ends = _HEAD * (most + 1), 0, []
        while True:
            n = min(n, len(text))
            place = len(text) if n == len(text) else next((m.start() for m in _SURE.finditer(text, n, n + _HEAD_MOST)), None)
            if place is None:  # no place to cut near
                place = len(text)
            end, ends = place, [b for _, b in self.tokenizer.encode(text[:place], add_special_tokens=False).offsets]
            if len(ends) > most or end == len(text):
                break
            n = 2 * end

        def fits(i: int) -> bool:
            if i >= end:
                return len(ends) <= most if i == end or len(ends) > most else self.whole(text[:i]) <= most
            return bisect_right(ends, i) <= most if _SURE.match(text, i) else self.whole(text[:i]) <= most

        return fits, end


def shorten_to_tokens(c: Column, added: Column, budget: int, path: str, special: int = 2) -> Column:
    """Drops sentences (what stands between full stops) from the end until tokens, special ones and `added` come to budget at most; a text that fits stays as it is. path: a tokenizers
    file. Null texts stay null; a first sentence that doesn't fit leaves an empty text."""

    def run(texts: pd.Series, more: pd.Series) -> pd.Series:
        sizes = _sizes(path)

        def cut(t: str | None, n: float) -> str | None:
            if t is None:
                return t
            most = floor(budget - special - n)
            fits, seen = sizes.of(t, most)
            if fits(len(t)):
                return t
            parts = [x for x in t.split(".") if x][:-1]
            joined, ends = ".".join(parts), list(accumulate(len(x) + 1 for x in parts))
            if not (t.startswith(joined) or joined.startswith(t[: seen + 1])):  # full stops that were left out
                fits, _ = sizes.of(joined, most)
            kept = _fitting(len(parts), lambda k: fits(ends[k - 1] - 1))
            return joined[: ends[kept - 1] - 1] if kept else ""

        return pd.Series([cut(t, 0 if pd.isna(n) else n) for t, n in zip(texts, more, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(c, added)


@lru_cache(maxsize=2)
def _sizes(path: str) -> _Sizes:
    return _Sizes(_tokenizer(path))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
