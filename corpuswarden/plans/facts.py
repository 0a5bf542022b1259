"""One pass over the texts: every probe's evidence as rows of one narrow table.

The relational checks never read a text again. They join and group this table, which
holds keys, line numbers and short snippets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from corpuswarden.catalog import CHECK_IDS
from corpuswarden.functions import paths, text as tx
from corpuswarden.plans.rulebook import RULES, Rule

LINE_BITS = 32
NO_FACTS = "cast(array() as array<struct<kind:string,a:string,b:string,line:int,snippet:string>>)"


def fact(kind: str, a: str = "null", b: str = "null", line: str = "null",
         snippet: str = "null") -> str:
    """One fact; `kind` is a name, the other arguments are expressions."""
    return (f"named_struct('kind', '{kind}', 'a', cast({a} as string), 'b', cast({b} as string), "
            f"'line', cast({line} as int), 'snippet', cast({snippet} as string))")


def when(condition: str, facts: str) -> str:
    return f"if({condition}, {facts}, {NO_FACTS})"


class FileColumns:
    """The columns every probe may use; they are computed once per file."""

    rel = "rel"
    text = "_text"
    low = "_low"
    test = "_test"

    def __init__(self):
        self._flags: dict[tuple, tuple[str, str]] = {}
        self._late: dict[str, str] = {}

    def _flag(self, kind: str, values: tuple[str, ...], made: str) -> str:
        name = self._flags.setdefault((kind, values), (f"_{kind}{len(self._flags)}", made))[0]
        return name

    def suffix(self, values) -> str:
        return self._flag("suffix", tuple(values), paths.has_suffix("rel", values))

    def part(self, values) -> str:
        return self._flag("part", tuple(values), paths.has_part("rel", values))

    def holds(self, needles, fold: bool = False) -> str:
        if fold:
            return tx.any_of("_fold", tx.contains_any("_low", needles))
        return tx.contains_any("_text", needles)

    def late(self, name: str, made: str) -> str:
        """A column computed from the flags, in a projection of its own."""
        self._late[name] = made
        return name

    def made(self) -> list[str]:
        """What the columns are computed by, besides the text itself."""
        return [made for _, made in self._flags.values()] + list(self._late.values())

    def apply(self, files: DataFrame) -> DataFrame:
        base = files.selectExpr(
            "repo", "rel",
            f"{tx.unmarked('text')} as _text",
            "lower(text) as _low",
            f"{tx.contains_any('text', tx.FOLDING)} as _fold",
            f"{paths.is_test('rel')} as _test",
            *[f"{made} as {name}" for name, made in self._flags.values()],
        )
        if not self._late:
            return base
        return base.selectExpr("*", *[f"{made} as {name}" for name, made in self._late.items()])


def in_scope(rule: Rule, c: FileColumns) -> str:
    """Path tests first, then the literals, then the pattern."""
    tests = []
    if rule.suffixes:
        tests.append(c.suffix(rule.suffixes))
    if not rule.docs:
        tests.append(f"not {c.suffix(paths.DOC_SUFFIXES)}")
    if not rule.tests:
        tests.append(f"not {c.test}")
    if rule.skip:
        tests.append(f"not {c.part(rule.skip)}")
    if rule.server:
        tests.append(c.part(paths.SERVER_MARKERS))
    tests.append(c.holds(rule.needles, rule.fold))
    if not rule.skip_over:
        tests.append(tx.matches_regex(c.text, rule.lead + rule.pattern))
    if rule.without:
        tests.append(f"not {tx.matches_regex(c.text, rule.without)}")
    return tx.all_of(*tests)


def rule_lines(rule: Rule, text: str) -> str:
    """Line numbers of the rule's surviving matches in one text."""
    if not rule.per_match:
        return tx.matching_lines(text, rule.pattern, rule.lead, rule.keep_line, rule.skip_over)
    found, m = tx.matches(text, rule.pattern, rule.groups, rule.window, skip=rule.skip_over)
    kept = [f"not {tx.matches_regex(m['tail'], guard)}" for guard in rule.guards]
    if rule.every_guard:
        kept = [tx.any_of(*kept)]
    if rule.keep_match is not None:
        kept.append(rule.keep_match(m))
    return f"transform(filter({found}, m -> {tx.all_of(*kept)}), m -> {m['line']})"


def rule_probe(c: FileColumns, checks: Iterable[str] | None = None,
               rules: Iterable[Rule] | None = None) -> str:
    """Rule facts of one file, one per (check, line), of all rules or of those given.

    A key packs the check's catalog position above the line number, so duplicates
    fall to a hash set over longs and no shuffle is needed: a file is one row.
    """
    wanted = set(CHECK_IDS if checks is None else checks)
    keys = []
    for rule in RULES if rules is None else rules:
        if rule.check in wanted:
            base = CHECK_IDS.index(rule.check) << LINE_BITS
            packed = f"transform({rule_lines(rule, c.text)}, n -> cast(n as bigint) + {base}L)"
            keys.append(f"if({in_scope(rule, c)}, {packed}, cast(array() as array<bigint>))")
    packed = c.late("_keys", f"array_distinct(flatten(array({', '.join(keys)})))")

    ids = ", ".join(tx.quote(i) for i in CHECK_IDS)
    check = f"element_at(array({ids}), cast(shiftright(k, {LINE_BITS}) as int) + 1)"
    line = f"cast(k & {(1 << LINE_BITS) - 1}L as int)"
    located = fact("rule", check, line=line,
                   snippet=tx.snippet(f"element_at(s.lines, {line})"))
    bound = f"named_struct('lines', {tx.lines(c.text)}, 'keys', {packed})"
    return when(f"size({packed}) > 0", tx.let("s", bound, f"transform(s.keys, k -> {located})"))


Probe = Callable[[FileColumns], str]


def extract(files: DataFrame, *probes: Probe) -> DataFrame:
    """FACTS of `files`: one scan, one projection, one explode, no shuffle."""
    columns = FileColumns()
    made = [probe(columns) for probe in probes]
    found = made[0] if len(made) == 1 else f"flatten(array({', '.join(made)}))"
    return (
        columns.apply(files)
        .select("repo", "rel", F.explode(F.expr(found)).alias("fact"))
        .select("repo", "rel", "fact.*")
    )
