"""URL filter: rules for hosts and paths, and character language models for the rest.

Two variable-order Markov models of characters are learned from the distinct urls that a
rule decides, one from the accepted and one from the rejected, each url counting as often
as it occurs. A character is predicted from the `ORDER` characters before it; every order
is smoothed with the one below by Witten-Bell (a context with few occurrences or many
different successors gives more weight to the shorter one), down to a uniform alphabet.
A url's score is the difference of the two log-likelihoods over its number of
characters, its end included. The threshold is the score that best parts the accepted
from the rejected urls of a fifth of the decided ones, which the models haven't seen.

Everything is DataFrame functions. The models are tables: one row per distinct gram of
all urls, the undecided included, so each has its smoothed score and scoring is one join.
Lower orders are sums of the highest; no context has more successors than the alphabet,
so windows over contexts are small. Texts of grams are combined before every shuffle.
The grams are broadcast if there are at most `BROADCAST_GRAMS` and joined by a shuffle
beyond that, where AQE splits common grams. Logarithms are rounded to millionths, so sums
don't depend on their order.

Null, empty and very long urls: null is empty, an empty url is its end alone, long ones
are scored whole. A url without rules or a table without accepted and rejected urls:
scores are 0 and so is the threshold. A score equal to the threshold is accepted. Repeated
rows get equal results, and each of them counts; page ids may be null or repeated. Only
the id and the url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuswarden.llm.common import ascii_lower
from corpuswarden.session import write_once

ORDER = 4  # characters of the longest context
BROADCAST_GRAMS = 1_000_000  # grams of five characters and a number each
FOLDS = 5  # one of them sets the threshold
BINS = 2000  # scores are compared with the threshold in hundredths, at most so many each way

# Fixed value: the rules of the contract (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, the host A-Z lower-cased; empty without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Index of the longest rule that fits the host or a domain above it, and the path.

    The rules become one expression, so there should be some hundred of them at most.
    """
    found = F.lit(None).cast("int")
    for index, (_, rule) in sorted(enumerate(rules), key=lambda item: len(item[1][1])):
        domain, slash, start = rule.partition("/")
        fits = (host == domain) | host.endswith("." + domain)
        found = F.when(fits & path.startswith(slash + start), index).otherwise(found)
    return found


def _pick(index: Column, values: list[str]) -> Column:
    """The value at `index`, by equality; null for null."""
    out = F.lit(None).cast("string")
    for at, value in enumerate(values):
        out = F.when(index == at, value).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """(gram, ...) of every character of every url, with the `order` characters before it.

    Before the url stand as many marks of a start, and one mark of an end after it.
    """
    padded = F.concat(F.lit("\x02" * order), "url", F.lit("\x03"))
    return urls.withColumn("padded", padded).withColumn("at", F.explode(
        F.sequence(F.lit(1), F.length("url") + 1))).withColumn(
        "gram", F.substr("padded", F.col("at"), F.lit(order + 1))).drop("padded", "at")


def model(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, gain): how many millionths of a nat likelier its last character is accepted.

    `urls` is (url, yes, no): how often a url counts as accepted and as rejected.
    """
    sums = [F.sum("yes").alias("yes"), F.sum("no").alias("no")]
    longest = write_once(_grams(urls, order).groupBy("gram").agg(*sums))
    below = None
    for k in range(order + 1):
        last = F.substr("gram", F.lit(order + 1 - k))
        grams = longest if k == order else longest.groupBy(last.alias("gram")).agg(*sums)
        context = Window.partitionBy(F.left("gram", F.lit(k)))
        for side in ("yes", "no"):
            grams = grams.withColumn(f"{side}_all", F.sum(side).over(context)).withColumn(
                f"{side}_kinds", F.count(F.when(F.col(side) > 0, 1)).over(context))
        if below is None:
            # The alphabet is what occurs in any url; so many kinds are spread over it.
            alphabet = F.count(F.lit(1)).over(context).cast("double")
            grams = grams.withColumn("p_yes", 1 / alphabet).withColumn("p_no", 1 / alphabet)
        else:
            grams = grams.withColumn("shorter", F.substr("gram", F.lit(2))).join(below, "shorter")
        for side in ("yes", "no"):
            kinds, base = F.col(f"{side}_kinds"), F.col(f"p_{side}")
            grams = grams.withColumn(f"p_{side}", F.when(F.col(f"{side}_all") > 0, (
                F.col(side) + kinds * base) / (F.col(f"{side}_all") + kinds)).otherwise(base))
        below = grams.select(F.col("gram").alias("shorter"), "p_yes", "p_no")
    gain = F.round(F.log(F.col("p_yes") / F.col("p_no")) * 1e6).cast("long")
    return below.select(F.col("shorter").alias("gram"), gain.alias("gain"))


def _fold(url: Column) -> Column:
    """Whether a url is kept from learning, to set the threshold."""
    return F.conv(F.left(F.md5(url), F.lit(8)), 16, 10).cast("long") % FOLDS == 0


def _bin(score: Column) -> Column:
    """Scores in hundredths of a nat, rounded down; far ones share the last bins."""
    return F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(score * 100.0))).cast("long")


def threshold(scored: DataFrame) -> int:
    """The bin from which on urls are accepted: where both classes are judged best.

    `scored` is (bin, yes, no). The shares of accepted urls at or above and of rejected
    urls below a bin are added, and the threshold stands in the middle between the best
    bin and the occupied one below. Of equal sums the one nearest 0 counts, then the
    smaller. Without urls of both classes it is 0.
    """
    bins = scored.groupBy("bin").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(
        "yes > 0 or no > 0")  # at most 2 * BINS + 1 rows, so one task takes them
    order = Window.orderBy("bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    right = F.coalesce(F.sum("no").over(before), F.lit(0)) / F.sum("no").over(Window.partitionBy())
    wrong = F.coalesce(F.sum("yes").over(before), F.lit(0)) / F.sum("yes").over(Window.partitionBy())
    middle = F.ceil((F.col("bin") + F.coalesce(F.lag("bin").over(order), F.col("bin"))) / 2)
    best = bins.select(middle.cast("long").alias("bin"), F.round(right - wrong, 9).alias("gained")).where(
        "gained is not null").orderBy(F.desc("gained"), F.abs("bin"), "bin").first()
    return best["bin"] if best else 0


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, rule, score, verdict) per row of `pages`.

    `score` is the bin of the language models' difference, and the verdict follows it
    where no rule fits.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"))
    host, path = parts(F.col("url"))
    seen = rows.groupBy("url").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "rule", rule_of(host, path, rules))
    said = _pick(F.col("rule"), [verdict for verdict, _ in rules])
    seen = write_once(seen.select("url", *[
        F.when(said == word, F.col("copies")).otherwise(0).alias(side)
        for side, word in (("yes", "allow"), ("no", "block"))], _fold(F.col("url")).alias("kept")))
    learned = [F.when(F.col("kept"), 0).otherwise(F.col(side)).alias(side) for side in ("yes", "no")]
    gains = write_once(model(seen.select("url", *learned), order))
    if gains.count() <= BROADCAST_GRAMS:
        gains = F.broadcast(gains)
    summed = _grams(seen.select("url"), order).join(gains, "gram").groupBy("url").agg(
        F.sum("gain").alias("gain"))
    scores = write_once(summed.select("url", _bin(
        F.col("gain") / 1e6 / (F.length("url") + 1)).alias("score")))
    held = seen.where("kept and (yes > 0 or no > 0)").join(scores, "url")
    least = threshold(held.select(F.col("score").alias("bin"), "yes", "no"))
    out = rows.join(scores, "url").withColumn("host", host).withColumn("path", path)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(_pick(F.col("rule"), [v for v, _ in rules]),
                         F.when(F.col("score") >= least, "allow").otherwise("block"))
    return out.withColumn("rule", rule).select(
        "id", "url", "host", "path", _pick(F.col("rule"), [text for _, text in rules]).alias("rule"),
        "score", verdict.alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def _order_sql(k: int) -> str:
    """The smoothed probabilities of the grams of `k` characters and one more."""
    sums, context = "sum(yes) as yes, sum(no) as no", f"partition by left(gram, {k})"
    base = ("1.0 / cast(count(*) over () as double) as b_yes, 1.0 / cast(count(*) over () as double) as b_no"
            if k == 0 else "b.p_yes as b_yes, b.p_no as b_no")
    join = "" if k == 0 else f"join m{k - 1} b on b.gram = substr(g.gram, 2)"
    return f"""
m{k} as (
  select gram, case when yes_all > 0 then (yes + yes_kinds * b_yes) / (yes_all + yes_kinds) else b_yes end as p_yes,
         case when no_all > 0 then (no + no_kinds * b_no) / (no_all + no_kinds) else b_no end as p_no
  from (select g.gram as gram, yes, no, {base}, sum(yes) over c as yes_all, sum(no) over c as no_all,
               count(*) filter (yes > 0) over c as yes_kinds, count(*) filter (no > 0) over c as no_kinds
        from (select substr(gram, {ORDER + 1 - k}) as gram, {sums} from longest group by 1) g {join}
        window c as ({context.replace("gram", "g.gram")})))"""


ORACLE = f"""
with p as (
  select page_id, coalesce(url, '') as url,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
h as (
  select page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(verdict, rule, domain, start) as (values {", ".join(
    f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')"
    for verdict, rule in RULES)}),
urls as (
  select url, host, path, count(*) as copies from h group by all),
ruled as (
  select url, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as said
  from urls join rules r on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, start)
  group by url),
seen as (
  select url, cast('0x' || left(md5(url), 8) as bigint) % {FOLDS} = 0 as kept, rule, said,
         case when said = 'allow' then copies else 0 end as yes,
         case when said = 'block' then copies else 0 end as no
  from urls left join ruled using (url)),
grams as (
  select url, substr(repeat(chr(2), {ORDER}) || url || chr(3), i, {ORDER + 1}) as gram, yes, no, kept
  from (select *, unnest(range(1, length(url) + 2)) as i from seen)),
longest as (
  select gram, sum(case when kept then 0 else yes end) as yes, sum(case when kept then 0 else no end) as no
  from grams group by 1),{",".join(map(_order_sql, range(ORDER + 1)))},
scores as (
  select url, greatest(-{BINS}, least({BINS}, cast(floor(
           sum(cast(round(ln(p_yes / p_no) * 1e6) as bigint)) / 1e6 / (length(url) + 1) * 100.0) as bigint))) as score
  from grams join m{ORDER} using (gram) group by url),
bins as (
  select score, sum(yes) as yes, sum(no) as no from seen join scores using (url)
  where kept and (yes > 0 or no > 0) group by 1),
gained as (
  select cast(ceil((score + coalesce(lag(score) over (order by score), score)) / 2) as bigint) as score, round(
           coalesce(sum(no) over before, 0) / nullif(sum(no) over (), 0)
           - coalesce(sum(yes) over before, 0) / nullif(sum(yes) over (), 0), 9) as gained
  from bins window before as (order by score rows between unbounded preceding and 1 preceding)),
least_score as (
  select coalesce((select score from gained where gained is not null
                   order by gained desc, abs(score), score limit 1), 0) as least)
select page_id, h.host, h.path, seen.rule,
       coalesce(said, case when score >= (select least from least_score) then 'allow' else 'block' end) as verdict,
       score
from h join seen using (url) join scores using (url)
"""
