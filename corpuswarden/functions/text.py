"""Lines, matches and offsets as SQL expressions.

A match's line number needs its offset, which Spark's regex functions do not return.
Instead a marker character is put in front of every match, the text is cut at its
newlines, and the marker's array index is the line. Each step is one linear pass.

The functions take and return SQL expression text: the rulebook builds thousands of
expression nodes, and one parsed string costs a single call into the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from corpuswarden.schema import SNIPPET_CHARS

# Noncharacters that Unicode reserves for internal use. Should a text hold the marker
# itself, `unmarked` swaps it for its twin; no pattern tells the two apart.
MARK = chr(0xFDD0)
TWIN = chr(0xFDD1)
# Ends a match, where a pattern also has text to pass over.
STOP = chr(0xFDD2)

# The characters removed from both ends of a snippet.
WHITESPACE = "".join(chr(n) for n in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))

# Letters outside ASCII that a case-blind pattern takes for i, s or k. A text holding
# one of them skips the lower-case prefilter and goes straight to the pattern.
FOLDING = tuple(chr(n) for n in (0x130, 0x131, 0x17F, 0x212A))


def quote(value: str) -> str:
    """A SQL string literal; a dollar and brace would be taken for a variable."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\u007b")
    return f"'{escaped}'"


def regex(pattern: str) -> str:
    """Literal of a pattern with Unicode classes in which only the newline ends a line."""
    return quote("(?Ud)" + pattern)


def matches_regex(value: str, pattern: str) -> str:
    return f"({value} rlike {regex(pattern)})"


def all_of(*conditions: str) -> str:
    return "(" + " and ".join(conditions) + ")" if conditions else "true"


def any_of(*conditions: str) -> str:
    return "(" + " or ".join(conditions) + ")"


def contains_any(text: str, needles) -> str:
    return any_of(*[f"contains({text}, {quote(n)})" for n in needles])


def unmarked(text: str) -> str:
    return f"replace(replace({text}, {quote(MARK)}, {quote(TWIN)}), {quote(STOP)}, {quote(TWIN)})"


def until_last(text: str, end: str) -> str:
    """The text up to its last `end`, which a match cannot go beyond; empty without one."""
    return f"left({text}, length({text}) - length(substring_index({text}, {quote(end)}, -1)))"


def strip(value: str) -> str:
    return f"btrim({value}, {quote(WHITESPACE)})"


def snippet(value: str, chars: int = SNIPPET_CHARS) -> str:
    return f"substring({strip(value)}, 1, {chars})"


def lines(text: str) -> str:
    return f"split({text}, {quote(chr(10))})"


def let(name: str, value: str, body: str) -> str:
    """Bind `value` to `name` for `body`.

    Catalyst may copy an aliased expression into a lambda, where it would run again
    for each element. A lambda variable is bound exactly once.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def marked_lines(text: str, pattern: str, lead: str = "", skip: str = "") -> str:
    """The lines of `text` with a marker before each match.

    `lead` is leading blank space a pattern needs for its anchor; the marker goes
    after it so that the line is that of the first visible character.

    `skip` is what an opening that does not match may pass over at once, since every
    opening in it fails for the same reason. Without it a pattern would search on from
    each of them, in time quadratic in the text. A skipped stretch comes out between a
    marker and a stop with nothing between them, and both are removed.
    """
    if skip:
        groups = re.compile(_plain(lead)).groups + re.compile(_plain(pattern)).groups
        first = 1 + re.compile(_plain(lead)).groups
        full = f"{lead}(?:({pattern})|({skip}))"
        before = "$1" if first == 2 else ""
        made = (f"regexp_replace({text}, {regex(full)}, "
                f"{quote(f'{before}{MARK}${first}{STOP}${groups + 2}')})")
        return lines(f"replace(replace({made}, {quote(MARK + STOP)}, ''), {quote(STOP)}, '')")
    if lead:
        return lines(f"regexp_replace({text}, {regex(lead + '(' + pattern + ')')}, "
                     f"{quote('$1' + MARK + '$2')})")
    return lines(f"regexp_replace({text}, {regex(pattern)}, {quote(MARK + '$0')})")


def _plain(pattern: str) -> str:
    """The pattern for counting its groups: possessive repeats and atomic groups taken off."""
    return re.sub(r"(?<=[*+}?])[+]", "", pattern).replace("(?>", "(?:").replace("\\z", "$")


def matching_lines(text: str, pattern: str, lead: str = "",
                   keep: Callable[[str], str] | None = None, skip: str = "") -> str:
    """Distinct line numbers on which a match starts; `keep` tests the line's text."""
    mark = quote(MARK)
    test = f"contains(l, {mark})"
    if keep is not None:
        test = all_of(test, keep(f"replace(l, {mark}, '')"))
    numbered = (f"transform({marked_lines(text, pattern, lead, skip)}, "
                f"(l, i) -> if({test}, i + 1, null))")
    return f"filter({numbered}, n -> n is not null)"


def match_lines(text: str, pattern: str, lead: str = "", skip: str = "") -> str:
    """Line number of every match, in match order, repeats included."""
    mark = quote(MARK)
    repeats = f"length(l) - length(replace(l, {mark}, ''))"
    return (f"flatten(transform({marked_lines(text, pattern, lead, skip)}, (l, i) -> "
            f"if(contains(l, {mark}), array_repeat(i + 1, {repeats}), "
            f"cast(array() as array<int>))))")


def matches(text: str, pattern: str, groups: dict[str, int], window: int = 0,
            name: str = "m", lead: str = "", skip: str = "") -> tuple[str, dict[str, str]]:
    """Array with one struct per match, and the names of its fields for a lambda `name`.

    Fields are `line`, the named groups (group 0 is the match) and, given a `window`,
    `tail`: that many characters after the match. The tail is taken with a lookahead,
    so it does not take part in the next match. Every group costs a pass over the text.
    What a pattern passes over by `skip` comes back with empty groups and is left out.
    """
    if skip:
        first = 1 + re.compile(_plain(lead)).groups
        full = regex(f"{lead}(?:({pattern})|{skip})")
        taken = [0, *groups.values()]
        columns = ", ".join(f"regexp_extract_all({text}, {full}, {first + g})" for g in taken)
        kept = f"filter(arrays_zip({columns}), z -> z.`0` <> '')"
        fields = {field: f"{name}.`1`.`{i}`" for i, field in enumerate(groups, 1)}
        return (f"arrays_zip({match_lines(text, pattern, lead, skip)}, {kept})",
                {"line": f"{name}.`0`", **fields})
    full = pattern
    wanted = dict(groups)
    if window:
        full = f"(?:{pattern})(?=((?s:.{{0,{window}}})))"
        wanted["tail"] = re.compile(pattern).groups + 1
    columns = [match_lines(text, pattern)]
    columns += [f"regexp_extract_all({text}, {regex(full)}, {g})" for g in wanted.values()]
    fields = {field: f"{name}.`{i}`" for i, field in enumerate(["line", *wanted])}
    return f"arrays_zip({', '.join(columns)})", fields


def first_match_line(text: str, pattern: str, lead: str = "") -> str:
    """Line of the first match, null when there is none."""
    return f"array_min({matching_lines(text, pattern, lead)})"
