"""A caller's own rules and checks, taken up by the rule scan and the whole audit.

A plugin brings catalog rows and what finds them: pattern rules, probes that leave facts
of one file, and operators that make findings from the facts of all files. Inside
`with plugged(spark, plugin):` they belong to the engine: they come out of `rule_scan` and
`findings_all`, and are counted, gated and stored like the others.

A plugin is tried before it is taken. Ids must be new, severities and fix classes known, and
rules must name checks. Patterns must be valid, and their time on a text of openings that
never close must grow no faster than the text: a pattern that searches on from each of
them would hold a task for hours.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden import catalog
from corpuswarden.plans import audit, rulebook
from corpuswarden.plans.facts import Probe, extract, rule_probe
from corpuswarden.plans.rulebook import Rule
from corpuswarden.schema import FILES, FINDINGS, FIX_CLASSES, SEVERITIES

ID = r"[A-Z][0-9]{1,3}"
TRIAL_CHARS = 20_000  # of the shorter of two trial texts; the other is four times as long
TRIAL_SECONDS = 1.0  # below this no growth is judged
MOST_GROWTH = 8.0  # between the two; a linear pattern takes four times as long, a quadratic sixteen

Operator = Callable[[DataFrame, DataFrame], DataFrame]


class PluginError(ValueError):
    """What is wrong with a plugin."""


@dataclass(frozen=True)
class Check:
    """A row of the catalog. `domain` names the domain of the id's letter, if that is new."""

    id: str
    severity: str
    fix_class: str
    title: str
    why: str = ""
    fix: str = ""
    domain: str = ""


@dataclass(frozen=True)
class Plugin:
    """Checks and what finds them.

    A probe is an expression for an array of facts; facts of kind `local` are findings by
    themselves, with the check in `a`. An operator gets all facts and all paths (repo,
    rel) and returns findings. Its facts should have kinds of the plugin's own name.
    """

    name: str
    checks: tuple[Check, ...]
    rules: tuple[Rule, ...] = ()
    probes: tuple[Probe, ...] = ()
    operators: tuple[Operator, ...] = ()


def validate(spark: SparkSession, plugin: Plugin) -> None:
    """Raise PluginError if the plugin cannot be taken."""
    known, own = set(catalog.CHECK_IDS), [check.id for check in plugin.checks]
    for check in plugin.checks:
        if not re.fullmatch(ID, check.id):
            raise PluginError(f"{check.id}: an id is a capital letter and a number")
        if check.id in known or own.count(check.id) > 1:
            raise PluginError(f"{check.id}: the id is taken")
        if check.severity not in SEVERITIES or check.fix_class not in FIX_CLASSES:
            raise PluginError(f"{check.id}: unknown severity or fix class")
        if check.id[0] not in catalog.DOMAINS and not _domains(plugin).get(check.id[0]):
            raise PluginError(f"{check.id}: its letter has no domain yet, so name one")
    for rule in plugin.rules:
        if rule.check not in known | set(own):
            raise PluginError(f"{rule.check}: a rule without a check")
        if not rule.needles or not all(rule.needles):
            raise PluginError(f"{rule.check}: a rule needs literals that a match holds")
        if rule.fold and any(needle != needle.lower() for needle in rule.needles):
            raise PluginError(f"{rule.check}: literals looked for in lower case must be lower case")
        with _taken(Plugin("trial", plugin.checks)):
            _try_pattern(spark, rule)
    if plugin.probes:
        _try(f"{plugin.name}: probes", lambda: extract(
            spark.createDataFrame([], FILES), *plugin.probes).collect())
    for operator in plugin.operators:
        files = spark.createDataFrame([], FILES)
        made = _try(f"{plugin.name}: operator", lambda: operator(
            extract(files, *plugin.probes, audit.root_texts_probe), files.select("repo", "rel")))
        if [(f.name, f.dataType) for f in made.schema] != [(f.name, f.dataType) for f in FINDINGS]:
            raise PluginError(f"{plugin.name}: an operator returns the columns of a finding")


def _domains(plugin: Plugin) -> dict[str, str]:
    return {check.id[0]: check.domain for check in plugin.checks if check.domain}


def _try(what: str, run: Callable):
    try:
        return run()
    except PySparkException as error:
        raise PluginError(f"{what}: {str(error).splitlines()[0]}") from error


def _try_pattern(spark: SparkSession, rule: Rule) -> None:
    """Run a rule over texts of one opening after the other."""
    pieces = [f"{needle}{gap}" for needle in rule.needles for gap in ("", " ", "\n", "(", "'", '"')]
    suffix = rule.suffixes[0] if rule.suffixes else ".ts"

    def seconds(chars: int) -> float:
        rows = [("r", f"server/{k}{suffix}", piece * (chars // len(piece))) for k, piece in enumerate(pieces)]
        probed = extract(spark.createDataFrame(rows, FILES), lambda c: rule_probe(c, rules=[rule]))
        began = time.monotonic()
        _try(f"{rule.check}: pattern", lambda: probed.agg(F.count(F.lit(1))).collect())
        return time.monotonic() - began

    seconds(1000)  # compiles the plan
    short, long = seconds(TRIAL_CHARS), seconds(4 * TRIAL_CHARS)
    if long > TRIAL_SECONDS and long > MOST_GROWTH * short:
        raise PluginError(f"{rule.check}: its time grows faster than the text ({short:.2f} s, {long:.2f} s "
                          "on four times as much); use possessive repeats or `skip_over`")


@contextmanager
def _taken(plugin: Plugin) -> Iterator[None]:
    held = [catalog.CHECKS, catalog.CHECK_IDS, rulebook.RULES, audit.OWN_PROBES, audit.OWN_OPERATORS]
    sizes = [len(items) for items in held]
    domains = {letter: name for letter, name in _domains(plugin).items() if letter not in catalog.DOMAINS}
    catalog.DOMAINS.update(domains)
    for check in plugin.checks:
        catalog.CHECKS.append((check.id, check.severity, check.fix_class, "plugin", True, check.title))
        catalog.CHECK_IDS.append(check.id)
        catalog.ADVICE[check.id] = (check.why, check.fix)
        catalog.SEVERITY_OF[check.id] = check.severity
    rulebook.RULES.extend(plugin.rules)
    audit.OWN_PROBES.extend(plugin.probes)
    audit.OWN_OPERATORS.extend(plugin.operators)
    try:
        yield
    finally:
        for items, size in zip(held, sizes):
            del items[size:]
        for check in plugin.checks:
            del catalog.ADVICE[check.id], catalog.SEVERITY_OF[check.id]
        for letter in domains:
            del catalog.DOMAINS[letter]


@contextmanager
def plugged(spark: SparkSession, plugin: Plugin) -> Iterator[None]:
    """The engine with the plugin, for plans that are made inside; plugins may be nested.

    A plan keeps what it was made with, so it may run after the context is left.
    """
    validate(spark, plugin)
    with _taken(plugin):
        yield

