"""Predicates on the shape of one value: credentials, tokens, logged arguments, SQL.

Like the text functions they take and return SQL expression text.
"""

from __future__ import annotations

from corpuswarden.functions.text import all_of, any_of, let, matches_regex, quote, regex, until_last

# Patterns of values that are not live credentials.
KNOWN_EXAMPLE = r"(?i)example|sample|dummy|placeholder|specimen|your[-_]|xxxx|(.)\1{5,}"
PLACEHOLDER = (
    r"(?i)(your[-_ ]?|example|placeholder|changeme|dummy|sample|fake|\btest\b|test[-_]?key"
    r"|not[-_]?real|ci[-_]?only|localhost|xxxx|\.\.\.|process\.env|os\.environ"
    r"|import\.meta\.env|\$\{|\{\{)"
)
# Looked for up to the last closing bracket only, or every opening would be searched to
# the end of a value without one.
BRACKETED = r"<[^>]+>"
# A repeated group recurses in Java, so words joined by a separator are written as
# one character class with lookaheads; a value may be a megabyte long.
NOT_A_CREDENTIAL = (
    r"^(?=[a-z]+[A-Z])(?!.*[A-Z](?![a-z]{2}))[a-z]{2}[A-Za-z]*$"        # camelCase words
    r"|^(?!\.)(?!.*\.\.)(?!.*\.$)(?=[^.]*\.[^.]*\.)[\w.-]+$"            # dotted name
    r"|[\[\]<>{}()#]"                                                  # selector, template
    r"|^(?=[^_]*_)(?!.*__)(?!.*_$)[A-Z][A-Z0-9_]*$"                     # UPPER_CONSTANT
    r"|^https?://"                                                      # address
    r"|^[\w.+-]+@[\w.-]+\.\w+$"                                         # mail address
)
LOWER_CONSTANT = r"^(?!.*[_-]{2})(?!.*[_-]$)[a-z][a-z0-9_-]*$"
MIN_DISTINCT = 8
MIN_ENTROPY = 3.5

# Quoted spans, and the identifiers that must not be logged.
QUOTED = r"'[^']*'|\"[^\"]*\"|`[^`]*`"
SENSITIVE = (
    r"\b(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token"
    r"|refresh[_-]?token|token|authorization|ssn|credit[_-]?card)\b"
)
AFTER_CHARS = 12

# Lines that use a service role key, lines that only describe one.
SERVER_ONLY = r"[\"']server-only[\"']"
KEY_IN_CODE = r"process\.env|import\.meta\.env|createClient|eyJ|=|:"
KEY_IN_PROSE = r"(?i)<[a-z]+>|you need|add the|copy the|paste|set up|configure"

# An interpolation, and one that starts with a module constant.
INTERPOLATION = r"\$\{[^}]{0,80}\}"
CONSTANT_INTERPOLATION = r"^\$\{\s*[A-Z][A-Z0-9_]{2,}\b"


def entropy(value: str) -> str:
    """Base-2 entropy of the characters of `value`, 0.0 for the empty string."""
    chars = f"array_distinct(split({value}, ''))"
    share = f"(length({value}) - length(replace({value}, ch, ''))) / length({value})"
    total = (f"aggregate(transform({chars}, ch -> {share}), 0D, "
             f"(acc, p) -> acc - p * log2(p))")
    return f"if(length({value}) > 0, {total}, 0D)"


def distinct_chars(value: str) -> str:
    return f"if(length({value}) > 0, size(array_distinct(split({value}, ''))), 0)"


def is_known_example(value: str) -> str:
    return matches_regex(value, KNOWN_EXAMPLE)


def is_credential(value: str) -> str:
    """The cheap patterns first; entropy is computed only for what they let through."""
    return all_of(
        f"not {matches_regex(value, PLACEHOLDER)}",
        f"not {matches_regex(until_last(value, '>'), BRACKETED)}",
        f"not {matches_regex(value, NOT_A_CREDENTIAL)}",
        f"not {matches_regex(value, LOWER_CONSTANT)}",
        f"{distinct_chars(value)} >= {MIN_DISTINCT}",
        f"{entropy(value)} >= {MIN_ENTROPY}",
    )


def _is_strict_json(value: str) -> str:
    """Whether `value` is one JSON value and nothing else.

    Spark's reader stops at the end of a value and takes single quotes. Inside a list
    and inside an object it must read on to the closing bracket, and no text closes both
    early. What is left without strings holds no quote.
    """
    bare = (f"regexp_replace(regexp_replace({value}, {quote(r'[\\].')}, ''), "
            f"{quote(r'\"[^\"\x00-\x1f]*\"')}, '')")
    return all_of(f"get_json_object(concat('[', {value}, ']'), '$[0]') is not null",
                  f"get_json_object(concat('{{\"v\":', {value}, '}}'), '$.v') is not null",
                  f"not contains({bare}, '\"')", f"not contains({bare}, {quote(chr(39))})")


def jwt_role(token: str) -> str:
    """The `role` claim of an unverified token, null when its payload is no strict JSON.

    Of several claims of that name the last one counts.
    """
    segment = f"translate(split_part({token}, '.', 2), '-_', '+/')"
    padded = f"concat({segment}, repeat('=', cast(pmod(-length({segment}), 4) as int)))"
    payload = f"make_valid_utf8(cast(try_to_binary({padded}, 'base64') as string))"
    claims = "map_entries(from_json(p, 'map<string,string>'))"
    last = f"try_element_at(filter({claims}, e -> e.key = 'role'), -1).value"
    return let("p", payload, f"if({_is_strict_json('p')}, {last}, null)")


def is_public_jwt(token: str) -> str:
    return f"coalesce({jwt_role(token)} = 'anon', false)"


def logs_sensitive(line: str) -> str:
    """A sensitive identifier outside quotes whose value can reach the log."""
    bare = f"regexp_replace({line}, {quote(QUOTED)}, {quote(chr(39) * 2)})"
    use = regex(rf"(?i)(!![\s\S]?)?{SENSITIVE}(?=([\s\S]{{0,{AFTER_CHARS}}}))")
    uses = f"arrays_zip(regexp_extract_all({bare}, {use}, 1), regexp_extract_all({bare}, {use}, 2))"
    leaks = all_of(
        "u.`0` = ''",
        f"not {matches_regex('u.`1`', r'^[?]*[.]length')}",
        "not " + matches_regex("u.`1`", r"^\s*:\s*''"),
    )
    return f"exists({uses}, u -> {leaks})"


def uses_service_key(line: str) -> str:
    """Code that holds the key, not prose about it, and not a private server-side read."""
    return all_of(
        f"not {matches_regex(line, KEY_IN_PROSE)}",
        matches_regex(line, KEY_IN_CODE),
        any_of(f"not contains({line}, 'process.env.')", f"contains({line}, 'NEXT_PUBLIC')"),
    )


def interpolates_variable(statement: str) -> str:
    """False only when every interpolation starts with an upper-case constant."""
    parts = f"regexp_extract_all({statement}, {quote(INTERPOLATION)}, 0)"
    constant = matches_regex("p", CONSTANT_INTERPOLATION)
    return any_of(f"size({parts}) = 0", f"not forall({parts}, p -> {constant})")


def may_be_one_edit_from(name: str, words) -> str:
    """A cheap necessary test: two strings one edit apart share a form with one letter less."""
    forms = sorted({w[:i] + w[i + 1:] for w in words for i in range(len(w))} | set(words))
    listed = ", ".join(quote(f) for f in forms)
    shorter = f"concat(left({name}, i - 1), substring({name}, i + 1))"
    return (f"({name} in ({listed}) or ({name} <> '' and exists(sequence(1, length({name})), "
            f"i -> {shorter} in ({listed}))))")


def one_edit_from(name: str, words) -> str:
    """The first of `words`, in order, one edit away from `name`; null when there is none.

    A swap of two neighbouring letters counts as one edit. Every swap of every word is
    a key of one literal map, so only plain edits are computed per row.
    """
    swaps: dict[str, str] = {}
    for word in sorted(words):
        for i in range(len(word) - 1):
            swapped = word[:i] + word[i + 1] + word[i] + word[i + 2:]
            if swapped != word:
                swaps.setdefault(swapped, word)
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in swaps.items())
    listed = ", ".join(quote(w) for w in sorted(words))
    edited = (f"array_min(filter(array({listed}), w -> abs(length(w) - length({name})) <= 1 "
              f"and levenshtein({name}, w, 1) = 1))")
    return f"least({edited}, try_element_at(map({pairs}), {name}))"


def below(digits: str, limit: int) -> str:
    """A run of digits of any length, compared as a number."""
    significant = f"ltrim('0', {digits})"
    number = f"try_cast(concat('0', {significant}) as bigint)"
    return f"coalesce(length({significant}) <= 18 and {number} < {limit}, false)"
