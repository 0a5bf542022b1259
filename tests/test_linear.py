"""Every rule and probe takes time linear in a file, and skipping changes no result."""

import random
import time

import pytest

from corpuswarden.functions import shapes, text as tx
from corpuswarden.operators import schema_checks as schema
from corpuswarden.plans import audit
from corpuswarden.plans.facts import extract
from corpuswarden.plans.rulebook import RULES

SIZE = 2_000_000
SECONDS = 20

# Openings that are never closed, by the suffix of the file they stand in.
OPENINGS = {
    ".ts": ["setInterval(a ", "catch (", "catch(e) x ", "jwt.sign(", "res.cookie(", "fetch(", "await fetch(",
            "`select a ", "`${a} select b ", "'insert into a ", "console.log(", "res.json(", "new Response(",
            "it('a ", "it('a', ", "redirect(", ".select('", "// TODO", "\n", " ", "db.a(", "\ndb.a()   ",
            "db.", "<", "token = '", "token='aaaaaaaaaaaaaaaa<", '"eyJ', "md5(", "createHash('md5')", "from 'a",
            "require('a", "import 'a", ".from('t').eq(", ".from('t')", "while (true", "NEXT_PUBLIC_", "sk-"],
    ".py": ["except ", "except:\n", "except a:\n\n", "jwt.decode(", "jwt.decode(verify ", "f'select a ",
            "requests.get(", "# a = 1\n", "# a = 1\nx\n", "import a\n", "\n from ", "set_cookie(", "os.getenv('"],
    ".sql": ["create policy ", "create policy a on b ", "create policy x on ", "create index ", "create index i on t(",
             "create index i on t ", "storage.buckets ", "create table ", "alter table ", "on x ", "select * from ", ";"],
    ".rules": ["allow read ", "allow read,\n", "\n", "allow a: if "],
    ".env": ["debug = true ", "DEBUG=true\n,", "\n", "A=1\n"],
}


@pytest.mark.parametrize("suffix", OPENINGS)
def test_unclosed_openings(spark, suffix):
    rows = [("r", f"src/f{k}{suffix}", opening * (SIZE // len(opening)))
            for k, opening in enumerate(OPENINGS[suffix])]
    files = spark.createDataFrame(rows, "repo string, rel string, text string").repartition(len(rows), "rel").cache()
    assert files.count() == len(rows)
    began = time.time()
    extract(files, *audit.PROBES).write.format("noop").mode("overwrite").save()
    took = time.time() - began
    files.unpersist()
    # All files together, on four cores, beside whatever else the machine does.
    assert took < SECONDS * len(rows) / 4, took


# (the pattern as first written, the linear one, what it passes over, pieces of texts)
PAIRS = [
    (r"setInterval\([^,]+,\s*(\d+)\s*\)", *[(r.pattern, r.skip_over) for r in RULES if r.check == "C5"][0],
     ["setInterval(", "f", ",", " ", "10", ")", "\n"]),
    (r"catch\s*\([^)]*\)\s*\{\s*\}", *[(r.pattern, r.skip_over) for r in RULES if r.check == "R5"][0],
     ["catch(", "catch (", "e", ")", ") {", "{}", " ", "}", "\n"]),
    (r"except[^\n:]*:\s*\n\s*pass\b", *[(r.pattern, r.skip_over) for r in RULES if r.check == "R5"][1],
     ["except", "except E:", " ", ":", "\n", "\n  pass", "pass ", "x"]),
    (r"jwt\.decode\((?![^)]*verify)[^)]*\)", *[(r.pattern, r.skip_over) for r in RULES if r.skip_over and r.check == "A2"][0],
     ["jwt.decode(", "a", "verify", ")", "\n"]),
    (r"(?is)create\s+policy\s+.*?on\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?(.*?);", schema.POLICY, schema.POLICY_SKIP,
     ["create policy ", "on ", "x", "t ", ";", "\n", "true", '"']),
    (r"(?is)storage\.buckets[^;]*?\btrue\b", schema.PUBLIC_BUCKET, schema.PUBLIC_BUCKET_SKIP,
     ["storage.buckets", " ", "true", ";", "x", "\n"]),
    (schema.CREATE_INDEX, schema.CREATE_INDEX, schema.CREATE_INDEX_SKIP,
     ["create index ", "i ", "on ", "t", "(", "a", ")", ";", "\n"]),
]


@pytest.mark.parametrize("first,linear,skip,pieces", PAIRS)
def test_linear_patterns_match_what_the_plain_ones_do(spark, first, linear, skip, pieces):
    rng = random.Random(4)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old, o = tx.matches("text", first, {"match": 0})
    new, n = tx.matches("text", linear, {"match": 0}, skip=skip)
    shown = lambda found, f: f"transform({found}, m -> concat({f['line']}, ':', {f['match']}))"
    rows = df.selectExpr("text", f"{shown(old, o)} as a", f"{shown(new, n)} as b").collect()
    assert sum(bool(r.a) for r in rows) > 20
    assert [r.text for r in rows if r.a != r.b] == []


def test_bracketed_values_are_found_as_before(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("<>a") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").selectExpr(
        "v", "v rlike '<[^>]+>' as a",
        f"{tx.matches_regex(tx.until_last('v', '>'), shapes.BRACKETED)} as b").collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)
