"""Text expressions that stay inside the JVM: trimming, wording bands, regex spans with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, functions as F

# The characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Regex flags: ignore case by Unicode rules, Unicode \b \s \d \w, and "." stops at \n only.
FLAGS = "(?iuUd)"
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# Marks put around matches; :func:`unmarked` keeps them out of the texts that are searched.
_OPEN, _PART, _NEITHER = "\x01", "\x02", "\x03"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql(value) -> str:
    return sql_text(value) if isinstance(value, str) else repr(value)


def text_array(values: Iterable[str]) -> Column:
    """A literal array of strings (one expression, however long the list)."""
    return F.expr(f"array({', '.join(map(_sql, values))})")


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends; null stays null."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def non_empty(value: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(value, F.lit(""))


def normal_form(text: Column) -> Column:
    """The form in which two texts count as the same text: lower case, trimmed."""
    return strip(F.lower(text))


def clip(text: Column, length: int) -> Column:
    """First ``length`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def percent(share: Column) -> Column:
    """0.953 -> '95.3%'."""
    return F.format_string("%.1f%%", share * 100)


def contains_any(text: str, phrases: Iterable[str]) -> str:
    """SQL: does the text hold any of the phrases?"""
    return "(" + " or ".join(f"contains({text}, {sql_text(p)})" for p in phrases) + ")"


def folded(text: Column) -> Column:
    """Lower case as regexes see it: letters that fold to ASCII i, s and k are folded too."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")))


def stems(phrases: Iterable[str]) -> dict[str, str]:
    """A word of each (lower-case) phrase such that few words stand for all of them: a text without the word lacks the phrase.

    Longer words are rarer, so a phrase is known by a word of five letters or more where it has one.
    """
    left = dict.fromkeys(phrases)
    words = {p: [w for w in p.split(" ") if len(w) >= 5] or [p] for p in left}
    known: dict[str, str] = {}
    while left:
        count: dict[str, int] = {}
        for w in dict.fromkeys(w for p in left for w in words[p]):
            count[w] = sum(w in p for p in left)
        best = max(count, key=lambda w: (count[w], len(w), w))
        known |= {p: best for p in left if best in p}
        left = {p: None for p in left if best not in p}
    return known


def phrases_in(lowered: Column, phrases: Sequence[str], held: Callable[[str], Column] | None = None) -> Column:
    """Those of ``phrases`` that occur in the (already lower-cased) text, joined for :func:`cut_phrases`, in the given order.

    ``held`` tells what is known of the text beforehand: a phrase is searched for only where it is true.
    """
    # A test a phrase rather than a loop over them, and a text rather than an array without its nulls: Spark interprets loops
    # and filters, with all that they hold.
    def holds(phrase: str) -> Column:
        found = lowered.contains(F.lower(F.lit(phrase)))
        return found if held is None else held(phrase) & found

    return F.concat_ws(_OPEN, *[F.when(holds(p), F.lit(p + _PART)) for p in phrases])


def cut_phrases(joined: Column) -> Column:
    """The array of the phrases joined by :func:`phrases_in`; empty where there are none."""
    whole = F.substring(joined, F.lit(1), F.length(joined) - 1)
    return F.when(joined != "", F.split(whole, _PART + _OPEN, -1)).otherwise(F.array().cast("array<string>"))


def by_first_letter(alternatives: Sequence[str], as_regex) -> str:
    """An alternation grouped by first letter, so that at any place only one group is tried.

    Alternatives with different first letters cannot match at the same place: grouping keeps their order.
    """
    groups: dict[str, list[str]] = {}
    for words in alternatives:
        groups.setdefault(words[0], []).append(words)
    return "|".join(
        f"{re.escape(letter)}(?:{'|'.join(as_regex(w)[len(re.escape(letter)):] for w in members)})"
        for letter, members in groups.items()
    )


def phrase_regex(phrases: Iterable[str], flags: str = "(?iu)") -> str:
    """One regex for many literal phrases, on word boundaries, longest phrase first at any position."""
    distinct = sorted(dict.fromkeys(p.lower() for p in phrases), key=len, reverse=True)
    return f"{flags}(?<!{_WORD})(?:{by_first_letter(distinct, re.escape)})(?!{_WORD})"


def words_regex(phrase: str) -> str:
    """A literal phrase whose words may be separated by any white space."""
    return _SPACE.join(re.escape(w) for w in phrase.split(" "))


def unmarked(text: Column) -> Column:
    """The text without the two control characters used as marks (replaced one for one)."""
    clean = F.translate(text, _OPEN + _PART, _NEITHER * 2)
    return F.when(text.contains(_OPEN) | text.contains(_PART), clean).otherwise(text)


def pieces(text: Column, regex: str, group: int = 0) -> Column:
    """The text cut before every match; each piece after the first tells match, group and what follows.

    One pass marks all matches, and cutting at a plain character needs no regex.
    """
    marked = F.regexp_replace(text, F.lit(regex), F.lit(f"{_OPEN}$0{_PART}${group}{_PART}"))
    return F.split(marked, _OPEN, -1)


def matched(cut: Column) -> Column:
    """True when :func:`pieces` found a match."""
    return F.size(cut) > 1


SPAN = "struct<text:string,start:int,end:int,text_start:int>"


def spans(cut: str, look_ahead: bool = False) -> str:
    """SQL for the character spans of the matches, from the column ``cut`` that holds the pieces.

    The lengths of match and rest, summed from the left, give every offset without leaving the JVM.
    ``text`` is the group's text and ``text_start`` where it begins if it ends with the match. Matches seen by
    look-ahead may overlap: there the group is the match and the rest repeats it.
    """
    width = "length(p[1])" if look_ahead else "length(p[0])"
    step = "length(p[2])" if look_ahead else "length(p[0]) + length(p[2])"
    return f"""
        aggregate(
          transform(slice({cut}, 2, size({cut})), p -> split(p, {sql_text(_PART)}, -1)),
          named_struct('at', length({cut}[0]), 'spans', cast(array() as array<{SPAN}>)),
          (acc, p) -> named_struct(
            'at', acc.at + {step},
            'spans', array_append(acc.spans, named_struct(
              'text', p[1], 'start', acc.at, 'end', acc.at + {width},
              'text_start', acc.at + {width} - length(p[1])))),
          acc -> acc.spans)"""


def first_piece(cut: str) -> Column:
    """The parts of the first match of a column of :func:`pieces`, null where there is none: for :func:`per_span`."""
    return F.expr(f"if(size({cut}) > 1, split({cut}[1], {sql_text(_PART)}, -1), null)")


def per_span(cut: str, first: str, make: Callable[[str, str, str, str], str], empty: str) -> str:
    """SQL: the array of what ``make`` says of the text, start, end and text_start of every match in the column ``cut``.

    A single match, the usual case, is told without the loops over matches, which Spark interprets. ``first`` is the column of
    :func:`first_piece`.
    """
    start = f"length({cut}[0])"
    end = f"({start} + length({first}[0]))"
    one = make(f"{first}[1]", start, end, f"({end} - length({first}[1]))")
    many = make("s.text", "s.start", "s.end", "s.text_start")
    return f"case when size({cut}) = 2 then array({one}) when size({cut}) > 2 then transform({spans(cut)}, s -> {many}) else {empty} end"


def title_case(text: str) -> str:
    """SQL: capital after every character that is not a letter, lower case elsewhere."""
    # The letters are bound once, so that they are not cut apart again for each of them.
    return (
        f"transform(array(split(lower({text}), '')), letters -> array_join(transform(letters, (c, i) -> "
        f"if(i = 0 or not get(letters, i - 1) rlike '\\\\p{{L}}', upper(c), c)), ''))[0]"
    )


def sql_lookup(key: str, table: dict) -> str:
    """SQL: value of a small literal table for ``key``, null when unlisted."""
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return f"element_at(map({pairs}), {key})"


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small literal table for ``key``."""
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    value = F.element_at(F.expr(f"map({pairs})"), key)
    return value if default is None else F.coalesce(value, F.lit(default))
