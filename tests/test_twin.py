"""A planted repository and its clean twin, from stored bytes to findings."""

import base64
import json

import pytest

from corpuswarden.catalog import CHECKS, SEVERITY_OF
from corpuswarden.operators import findings as fnd
from corpuswarden.plans import audit
from corpuswarden.sources import tree

# Credential-shaped text is joined at run time so that no file holds a whole one.
KEY = "AK" + "IA" + "9QWZ4HTNBV7RPLKD"
LONG = "export function f() {\n" + "  step()\n" * 620 + "}\n"
BLOCK = "  const total = items.map((item) => item.price)\n  const taxed = total.map((price) => price + 1)\n  save(taxed)\n"


def _token(role):
    part = lambda claims: base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=")
    return ".".join([part({"alg": "HS256"}), part({"iss": "host", "role": role}), "Zq81kLmPx"])


# What each file plants: path -> (text, the checks it is reported under).
PLANTED = {
    "package.json": (json.dumps({"scripts": {"test": "echo no test specified && exit 1"}, "dependencies": {
        "next": "15", "react": "19", "@supabase/supabase-js": "2", "recat": "1", "no-such-package-x": "1"}}),
        ["P1", "P2", "P3", "T1"]),
    "package-lock.json.bak": ("", []),
    ".env": ("DEBUG=true\nA=1\n", ["S3", "X1"]),
    "next.config.js": ("module.exports = {\n  productionBrowserSourceMaps: true,\n}\n", ["S6", "X2"]),
    "supabase/migrations/1.sql": (
        "create table orders (id int, owner int);\ncreate policy p on orders for all using (true);\n"
        "insert into storage.buckets (id, public) values ('x', true);\nselect * from orders\n",
        ["D1", "D2", "D4", "C3"]),
    "firestore.rules": ("service x {\n  allow read, write: if true;\n}\n", ["D9"]),
    "src/lib/keys.ts": (f'export const aws = "{KEY}"\nexport const t = "{_token("service_role")}"\n', ["S1"]),
    "src/lib/client.ts": (
        "import './keys'\nconst k = process.env.NEXT_PUBLIC_SERVICE_ROLE_KEY\nconst a = createClient(u, SERVICE_ROLE)\n"
        "const s = process.env.HIDDEN_SETTING\n", ["S2", "D3", "S5"]),
    "src/app/page.tsx": (
        "import { a } from '../lib/client'\nimport { b } from '../lib/big'\nimport '../lib/db'\n"
        "setInterval(refresh, 500)\nredirect(req.query.next)\nconsole.log('user', password)\nconsole.log(1)\n",
        ["C5", "X3", "O1", "O3"]),
    "src/app/api/orders/route.ts": (
        "while (true) { poll() }\nexport const dynamic = 'force-dynamic'\n"
        "// TODO limit\nres.cookie('sid', v)\nres.status(500).json({ e: err.message })\n"
        "const o = { origin: '*' }\njwt.verify(t, 'short')\ncreateHash('md5').update(password)\n"
        "try { go() } catch (e) {}\ndb.orders.insert(row)\nclient.from('orders').select('id').eq('owner', me)\n"
        "const r = await fetch(u)\nuse(r)\n",
        ["R2", "R3", "C4", "C6", "H5", "A3", "O2", "A5", "A2", "A6", "R5", "R9", "C2"]),
    "src/lib/db.ts": ("run(`SELECT a FROM orders WHERE id = ${input}`)\n", ["D8"]),
    "src/lib/big.ts": (LONG, ["H7"]),
    "src/lib/dead.ts": ("export {}\n", []),
    "src/lib/dead-old.ts": ("// const a = 1;\n" * 6, ["H2", "H3", "H6"]),
    "src/lib/copies.ts": ((BLOCK + "next()\n") * 4, ["H8"]),
    "tests/cart.test.ts": ("it('adds', () => {\n  add(1)\n})\n", ["T2"]),
}
# Repository-wide checks, reported against no single file; history comes as tables.
WIDE = ["R1", "O4", "O5", "T3", "H1", "S4"]

CLEAN = {
    "package.json": json.dumps({"scripts": {"test": "vitest run"}, "dependencies": {
        "next": "15", "react": "19", "@supabase/supabase-js": "2"}}),
    "package-lock.json": '{"packages": {"node_modules/react": {"version": "19"}}}',
    ".gitignore": ".env\nnode_modules\n", ".env": "A=1\n", ".env.example": "HIDDEN_SETTING=\nSERVICE_ROLE_KEY=\n",
    ".github/workflows/ci.yml": "on: push\n",
    "next.config.js": "module.exports = { headers: [{ key: 'X-Frame-Options', value: 'DENY' }] }\n",
    "supabase/migrations/1.sql":
        "create table orders (id int, owner int);\nalter table orders enable row level security;\n"
        "create policy p on orders for all using (owner = auth.uid());\ncreate index i on orders (owner);\n",
    "src/lib/client.ts":
        f'export const anon = "{_token("anon")}"\nexport const s = process.env.HIDDEN_SETTING\n',
    "src/lib/admin.ts": "import 'server-only'\nexport const k = process.env.SERVICE_ROLE_KEY\n",
    "src/app/error.tsx": "export default function Oops() { return <ErrorBoundary /> }\n",
    "src/app/page.tsx": "import { anon } from '../lib/client'\nimport { k } from '../lib/admin'\nsetInterval(refresh, 60000)\n",
    "src/app/api/health/route.ts": "export const GET = () => Response.json({ ok: true })\n",
    "src/app/api/orders/route.ts":
        "const r = await fetch(u, { signal })\nif (!r.ok) throw new Error('failed')\n"
        "res.cookie('sid', v, { httpOnly: true, sameSite: 'lax' })\n"
        "await db.query('select id from orders where id = $1 limit 5', [id])\n"
        "client.from('orders').select('id').eq('owner', me).limit(5)\n",
    "sentry.server.config.ts": "import * as S from '@sentry/node'\nS.init()\n",
    "tests/orders.test.ts": "it('adds', () => {\n  expect(add(1)).toBe(2)\n})\n",
}
# Checks of style that may fire on sound code.
ADVISORY = ("H7", "O3", "C6", "T2", "H8")


@pytest.fixture(scope="module")
def found(spark):
    stored = [("planted", rel, bytearray(text.encode())) for rel, (text, _) in PLANTED.items()]
    stored += [("clean", rel, bytearray(text.encode())) for rel, text in CLEAN.items()]
    raw = tree.as_raw(spark.createDataFrame(stored, "repo string, rel string, content binary"))
    commits = spark.createDataFrame([("planted", "1", False), ("clean", "1", False), ("clean", "2", False)],
                                    "repo string, commit_id string, shallow boolean")
    added = spark.createDataFrame([("planted", ".env"), ("clean", "src/a.ts")], "repo string, path string")
    registry = spark.createDataFrame([("npm", n) for n in ("next", "react", "@supabase/supabase-js", "recat")],
                                     "ecosystem string, name string")
    return audit.findings_all(tree.ingest_files(tree.path_ignore(raw)), raw.select("repo", "rel"),
                              commits=commits, added_paths=added, registry=registry).cache()


def expected(spark):
    rows = [("planted", check, rel) for rel, (_, checks) in PLANTED.items() for check in checks]
    rows += [("planted", check, ".") for check in WIDE]
    return spark.createDataFrame(rows, "repo string, check_id string, file string")


def test_every_planted_defect_of_the_worst_kind_is_found(spark, found):
    have = {r.check_id for r in found.where("repo = 'planted'").collect()}
    planted = {c for _, checks in PLANTED.values() for c in checks} | set(WIDE)
    computed = {c[0] for c in CHECKS if c[4]}
    assert {c for c in computed if SEVERITY_OF[c] == "P0"} <= planted
    assert {c for c in planted if SEVERITY_OF[c] == "P0"} - have == set()
    assert len(planted & have) >= 0.9 * len(planted), planted - have


def test_recall_and_sites(spark, found):
    want = expected(spark)
    row = fnd.recall_precision(want, found.where("repo = 'planted'")).first()
    assert row.recall >= 0.9 and row.precision >= 0.95
    sites = fnd.site_recall(want, found).collect()
    assert [r.check_id for r in sites if not r.on_site and r.check_id not in WIDE] == []


def test_the_clean_twin_is_clean(spark, found):
    wrong = [(r.check_id, r.file, r.line) for r in found.where("repo = 'clean'").collect()
             if r.check_id not in ADVISORY]
    planted = {c for _, checks in PLANTED.values() for c in checks} | set(WIDE)
    assert not [w for w in wrong if SEVERITY_OF[w[0]] == "P0"]
    assert len(wrong) <= 0.05 * len(planted), wrong
