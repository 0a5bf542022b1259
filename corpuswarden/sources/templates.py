"""Line and file templates from which the test tables become a corpus of source files.

Placeholders: {id} event id, {h} md5 of the event id, {U} the same in upper case,
{m3} {m5} {m7} event id modulo 3, 5, 7, {c} number of the component in the same group
of files, {g} number of that group.
"""

import base64
import json


def _segment(**claims) -> str:
    raw = json.dumps(claims, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


_HEAD = _segment(alg="HS256", typ="JWT")
_ANON = _segment(iss="host", role="anon")


def _payload(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


# Payloads that are no strict JSON, or name a claim twice: the last one counts.
_ODD = [_payload(p) for p in (
    '{"role":"anon"}x', '{"role":"anon","role":"service_role"}', '{"role":"service_role","role":"anon"}',
    "{'role':'anon'}", '{"a":{"role":"x"},"role":"anon"}', '{"role":"anon"},{}')]
_SERVICE = _segment(iss="host", role="service_role")

# Credential-shaped text is joined at run time so that no file holds a whole one.
LINES = [
    "  const r{id} = await fetch(url{id});",
    "  if (!r{id}.ok) return null;",
    "  setInterval(tick, {id}0);",
    '  console.log("step {id}");',
    '  console.log("auth", token);',
    '  console.log("present", !!token, password.length, { secret: "" });',
    '  res.cookie("sid", v{id}, { maxAge: 9 });',
    '  res.cookie("sid", v{id}, { httpOnly: true, sameSite: "lax" });',
    "  db.query(`SELECT * FROM orders WHERE id = ${v{id}}`);",
    "  run(`DELETE FROM t{m3} WHERE id = ${MAX_ID} and k = 1`)",
    "  run(`${col} UPDATE t{m5} SET a = {id}`)",
    '  cur.execute(f"SELECT a FROM users WHERE id = {uid}")',
    '  run("DELETE FROM t{m3} where a = " + name{id})',
    "  try { go() } catch (e) {}",
    "  try {\n    go()\n  } catch (e) { }",
    "try:\n    go({id})\nexcept Exception:\n    pass",
    "  while (true) { step({id}) }",
    "while True:",
    "  // TODO {id}",
    "# FIXME {id}",
    "  // const x{id} = call({id});",
    "  // a = {id};\n  // b = call(a);\n  // if (b) {\n  //   run(b);\n  // }\n  // return b;",
    'import { a } from "@/components/U{c}"',
    "  const u{id} = process.env.VAR_N{m7};",
    'key = os.getenv("PY_VAR{m5}")',
    '  const q = await client.from("t{m5}").select("*");',
    '  q.from("t{m5}").eq("user_id", u).order("created").gt("id", 1)',
    "create table t{m5} (id int, user_id int);",
    "alter table t{m3} enable row level security;",
    "create policy p{id} on t{m5} for all using (true);",
    "create policy q{id} on t{m5} for select using (true);",
    "insert into storage.buckets (id, public) values ('b{id}', true);",
    'create index i{id} on t{m3} (user_id, "created");',
    "  res.redirect(req.query.next);",
    '  redirect(searchParams.get("to"))',
    "  res.status(500).json({ error: err.stack });",
    "  return new Response(JSON.stringify({ e: err.message }))",
    "requests.get(url)",
    "requests.post(url, timeout=5)",
    '  origin: "*"',
    '  "Access-Control-Allow-Origin": "*"',
    'allow_origins=["*"]',
    "app.use(cors())",
    'api_key = "{h}"',
    'PASSWORD_CHANGE = "password_change"',
    '  jwt.verify(t, "literal")',
    "jwt.decode(t{id})",
    "jwt.decode(t, verify=False)",
    '  algorithms: ["none"]',
    '  export const dynamic = "force-dynamic"',
    "  cache: 'no-store'",
    '  it("case {id}", () => {',
    "    expect(x).toBe(1)",
    "  const mockData = [];",
    "  md5(password{id})",
    '  createHash("md5").update(pass)',
    'const k{id} = "AK' + 'IA{U16}"',
    'stripe = "sk_li' + 've_{h}"',
    "model sk" + "-{h}",
    "hub gh" + "p_{h}",
    "chat xox" + "b-{h}",
    'map "AI' + 'za{h}Xyz"',
    "-----BEGIN " + "PRIVATE KEY-----",
    'jwt{id} = "' + _HEAD + "." + _SERVICE + '.{h}"',
    'jwt{id} = "' + _HEAD + "." + _ANON + '.{h}"',
    "  const s = process.env.NEXT_PUBLIC_SERVICE_ROLE_KEY;",
    *[f'jwt{{id}} = "{_HEAD}.{odd}.{{h}}"' for odd in _ODD],
    "  db.orders.insert(v{id});",
    "select * from logs{m3}",
    "select * from logs limit 5",
    "  allow read, write: if true;",
    "DEBUG = true",
    'set_cookie("a", {id})',
    'set_cookie("a", 1, httponly=True)',
    "ordinary prose line {m3}",
    'token = "user.name.part{id}"',
    'secret: "aaaaaaaaaaaaaaaabb"',
    'k = "AK' + 'IAEXAMPLEEXAMPLE12"',
    "  productionBrowserSourceMaps: true,",
    'import "server-only"',
    "  const admin = createClient(url, SERVICE_ROLE);",
    "if (!user) {\n  throw new Error('unauthorized request rejected by the gate')\n}",
    "def helper{id}(): return {id}",
    "from .util{c} import helper",
    '  const g = require("../util{c}")',
    "  allow get, list: if  true ;",
    "  allow read: if request.auth != null;",
    "create table if not exists public.t{m7} (id int, owner uuid);",
    "create policy w{id} on t{m7} for update with check (true);",
    "create unique index u{id} on public.t{m5} (created);",
    '  q.from("t{m7}").order("owner")',
    "alter table t{m7} disable row level security;",
]

# Root-level files of a repository: (path, variants); null means the file is absent.
ROOT_FILES = [
    ("package.json", [
        '{"name":"app{g}","scripts":{"test":"vitest run"},"dependencies":{"next":"15.0.0",'
        '"react":"19.0.0","@supabase/supabase-js":"2.0.0","left-lib-{g}":"1.0.0"},'
        '"devDependencies":{"typescript":"5.0.0","recat":"1.0.0"}}',
        '{"scripts":{"test":"echo \\"Error: no test specified\\" && exit 1"},"dependencies":'
        '{"express":"4.0.0","axois":"1.0.0","local-lib":"file:../lib","flask":"1"}}',
        None,
        '{"dependencies":{"vite":"5.0.0","firebase":"10.0.0","lodash":"4.0.0","prisma":"5.0.0"},'
        '"optionalDependencies":{"ghost-pkg-{g}":"1.0.0"}}',
        '{"dependencies": {',
    ]),
    ("package-lock.json", [
        None,
        '{"lockfileVersion":3,"packages":{"":{"name":"app","hasInstallScript":true},'
        '"node_modules/sharp{g}":{"hasInstallScript":true},"node_modules/a":{"version":"1"}}}',
        None,
    ]),
    ("requirements.txt", [
        None,
        "fastapi==0.1\n# note\n-r other.txt\nrequets>=2\n\nnum{g}x==1\n",
        "flask\nnumppy\n",
        None,
    ]),
    ("pyproject.toml", [
        None, None,
        '[project]\nname = "x"\nversion = "1"\ndjango = ">=4"\npandsa = "^2"\nflask = "1"\n',
    ]),
    (".gitignore", ["node_modules\n.env\n*.pem\n", "# note\nnode_modules\n", None,
                    ".env*\n/.env\nserver.key/\n"]),
    (".env", ["SECRET=x{g}\nDEBUG=true\n", None, "A=1\nGENERATE_SOURCEMAP=true\n"]),
    ("certs/server.pem", ["pem {g}", None]),
    ("certs/server.key", [None, "key {g}", "key"]),
    (".env.example", ["VAR_N1=\nVAR_N2 = 2\nPY_VAR1=\n", None, "# none\n  VAR_N3=1\n"]),
    ("next.config.js", [
        "module.exports = {\n  productionBrowserSourceMaps: true,\n}\n", None,
        "module.exports = { headers: ['X-Frame-Options'] }\n", None, None,
    ]),
    ("vercel.json", [None, None, None, "{}"]),
    ("supabase/config.toml", [None, "project_id = 'p{g}'\n", None]),
    ("firestore.rules", [None, None, "service x {\n  allow read, write: if true;\n}\n", None]),
    (".github/workflows/ci.yml", ["on: push\n", None, None]),
    ("src/app/error.tsx", [None, "export class ErrorBoundary {}\n", None, None]),
    ("sentry.server.config.ts", [None, None, 'import * as S from "@sentry/node"\n', None]),
    ("src/app/api/health/route.ts", [None, "export const GET = () => ok\n", None]),
    ("settings.py", ["\n\nDEBUG = True\n", None]),
    ("yarn.lock", [None, None, "# lock\n", None, None]),
    ("bun.lockb", [None, None, None, None, None, "lock"]),
    (".vercel/project.json", [None, "{}", None, None]),
    ("pkg/__init__.py", ["VERSION = 1\n", None]),
    ("pages/_app.tsx", [None, None, "export default App\n"]),
    ("__tests__/a.test.ts", [None, None, None, "it('works', () => {\n  expect(1)\n})\n"]),
    ("src/test22.ts", ["export {}\n", None]),
    ("src/test.ts", ["import './test22'\n", None]),
    ("src/mytest22.ts", ["import './mytest'\n", None, None]),
    ("src/mytest.ts", ["import './test'\n", None, None]),
    ("src/tool_{g}.py", ['if __name__ == "__main__":\n    run()\n', "x = 1\n"]),
]

# Consecutive events step through the lines by a stride that shares no factor with them. The
# number of lines shares none with the number of paths, so each line comes to each path.
STRIDE = 11
LINES_PER_FILE = 32
FILES_PER_GROUP = 18

# Paths by block number modulo FILES_PER_GROUP; {b} block, {s} the group's first block + 1.
PATHS = [
    "src/app/api/u{b}/route.ts",
    "src/components/U{b}.tsx",
    "lib/u{b}.py",
    "db/migrations/{b}.sql",
    "tests/u{b}.test.ts",
    "config/u{b}.conf",
    "rules/f{b}.rules",
    "src/latest/u{b}.js",
    "src/components/U{s}-fixed.tsx",
    "server/handler{b}.py",
    "config/s{b}.yml",
    "docs/n{b}.md",
    "scripts/run{b}.py",
    "src/util{b}.ts",
    "src/page{b}.tsx",
    "web{b}/vite.config.ts",
    "db/seeds/{b}.sql",
    "db/views/{b}.sql",
]
