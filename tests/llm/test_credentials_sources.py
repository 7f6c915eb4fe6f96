import base64
import random
import string

import pytest

pytest.importorskip("weirflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from weirflow.llm import credentials as C  # noqa: E402
from weirflow.llm import sourcefiles as S  # noqa: E402

R = random.Random(5)


def value(n, alphabet=string.ascii_letters + string.digits):
    return "".join(R.choice(alphabet) for _ in range(n - 3)) + "aZ7"


def test_forms():
    v = value(32)
    p = "Marble" + "#4821x"
    basic = base64.b64encode(f"svc:{p}".encode()).decode()
    good = [
        f'api_key = "{v}"', f"API_KEY={v}", f"  token: {v}", f'"args": ["--secret", "{v}"]', f"--password={p}", f"<secret>{v}</secret>", f'<entry key="pass" value="{p}"/>', f"# old token: {v}", f"// password was {p} until May", f"url = 'postgres://app:{p}@db.x.test/y'",
        f"curl -H 'Authorization: Bearer {v}' x", f'"Authorization": "Basic {basic}"', f"curl -u svc:{p} https://x.test", f'call("{"AKI" + "A"}{value(16, string.ascii_uppercase + string.digits)[:13].upper()}Q7Z")', f"secret_ref: {basic}  # base64", f'@Value("{v}") String secret;', f"mysql -uroot -p{p} < x",
    ]
    for line in good:
        assert C.places("x\n" + line) == [2], line
        assert v not in C.redact(line) and p not in C.redact(line)
        assert C.spans(C.redact(line)) == []


def test_no_cases():
    h = "".join(R.choice("0123456789abcdef") for _ in range(64))
    for line in [
        "token = os.environ['X_TOKEN']", "const token = process.env.API_TOKEN;", "password: ${DB_PASSWORD}", "secret: {{ vault.secret }}", 'apiKey: "YOUR_API_KEY"', "API_KEY=<your-key-here>", 'secret = "****************"', "token = «REDACTED:key»", f"# commit {h[:40]}", f"// sha256 of x: {h}",
        f"integrity sha512-{h}==", f"image_digest: sha256:{h}", "const KEY_RE = /\\bAKIA[0-9A-Z]{16}\\b/;", "-----BEGIN PUBLIC KEY-----", f'icon = "data:image/png;base64,{h}"', "key_stream: visible", "token_count = 4096", "private_key_path: /run/secrets/x", "password: z.string().min(10)", "const nextToken = cursor.token + 9;",
        "password = getpass()", "TOKEN=${TOKEN}", "url = 'postgres://${user}:${pass}@x.test/y'", "", "registry_key = 'oversized'", "session_token = true",
    ]:
        assert C.places(line) == [], line


def test_unnamed_values():
    for v in (value(40), value(24), "".join(R.choice("0123456789abcdef") for _ in range(45)) + "aa1"):
        for line in (f'connect("{v}")', f"DSN_SIG = '{v}'", f"open {v} now", f'["{v}",', f'"{v}",'):
            assert C.places(f"x\n{line}\ny") == [2] and v not in C.redact(line), line
    blob = "".join(f'  "{value(76)}",\n' for _ in range(5))
    assert C.places(f"X = [\n{blob}]") == []
    h = "".join(R.choice("0123456789abcdef") for _ in range(40))
    for line in (f'pin("{h}")', 'find("getUserByEmailAddress2ForWorkspaceV3")', "packages/worker-155f/src/lib/cacheEntry2Index.go", 'use("0b9cf1a2-5d3e-4f60-8a7b-91c2d3e4f506")', 'f("the quick brown fox jumps over 13 lazy dogs")', f"sha512-{value(60)}"):
        assert C.places(line) == [], line


def test_the_gate_lets_through_all_that_spans_finds(spark):
    import re

    p = "Xk39dLq2mZ7t"
    basic = base64.b64encode(f"svc:{p}".encode()).decode()
    texts = [f"DEPLOY_PAT={p}", f"open {'r'}k_{value(20)} now", f'f("{basic[:8]}" +\n  "{basic[8:]}")', f'f("AKI" +\n "A{value(16, string.ascii_uppercase + string.digits)[:13]}Q7Z")', f"x://u:{p}@h.test", f"-u svc:{p}", f"pwd: {p}", f"<cred>{p}</cred>", f"my.key = {p}"]
    texts += [f"{name}{sep}{p}" for name in ("passphrase", "PWD", "client_secret", "authToken", "bearer", "app.key", "MyPass", "deploy-pat", "storageKey", "credential") for sep in ("=", ": ", " => ")]
    found = [t for t in texts if C.spans(t)]
    assert len(found) >= len(texts) - 3, [t for t in texts if t not in found]
    assert [t for t in found if not re.search(C.GATE, t)] == []
    df = spark.createDataFrame(list(enumerate(found)), "k int, t string")
    assert {r.k for r in C.credential_lines(df, "k", "t").collect()} == set(range(len(found)))


def test_values_beyond_the_former_bounds():
    long = value(700)
    assert C.places(f"url = 'amqp://{'u' * 300}:{long}@h.test/x'") == [1] and long not in C.redact(f"url = 'amqp://{'u' * 300}:{long}@h.test/x'")
    assert C.places(f'const token = "{value(260)}" +\n  "{value(30)}";') == [1]
    assert C.places("password = '" + "correct horse2battery_staple".replace(" ", "-") * 9 + "'") == [1]


def test_blocks_pieces_and_encodings():
    body = "\n".join(value(64) for _ in range(4))
    block = f"a\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\nb"
    assert C.places(block) == [2] and C.redact(block).startswith("a\n«REDACTED") and C.redact(block).endswith("\nb")
    v = value(40)
    pieces = f'x = 1\nconst auth = "{v[:20]}" +\n  "{v[20:]}"; // apiKey\ny = 2'
    assert C.places(pieces) == [2]
    out = C.redact(pieces)
    assert v[:20] not in out and v[20:] not in out and out.count("\n") == pieces.count("\n") and "const auth =" in out
    assert C.places(f"- name: API_KEY\n  value: {v}") == [2]


def test_credential_columns(spark):
    v = value(32)
    df = spark.createDataFrame([(1, None), (2, ""), (3, f'token = "{v}"\ntoken = "{v}"'), (4, "x" * 300_000 + f'\npassword = "{v}"')], "k int, t string")
    assert sorted((r.k, r.line_no) for r in C.credential_lines(df, "k", "t").collect()) == [(3, 1), (3, 2), (4, 2)]
    got = {r.k: r.o for r in df.select("k", C.redacted(F.col("t")).alias("o")).collect()}
    assert got[1] is None and got[2] == "" and v not in got[3]


WORDS = "alpha beta gamma delta rank split merge table queue index".split()


def source(seed, n=12):
    r = random.Random(seed)
    return "\n".join(f"export function {r.choice(WORDS)}{r.randint(1, 999)}({r.choice(WORDS)}) {{\n  const {r.choice(WORDS)} = {r.choice(WORDS)}({r.choice(WORDS)}, {r.randint(1, 99)});\n  return {r.choice(WORDS)}.{r.choice(WORDS)};\n}}" for _ in range(n))


def test_evidence():
    assert S.evidence("a.ts", "// Code generated by gen. DO NOT EDIT.\nx") == "generated"
    assert S.evidence("a.ts", '// Keep in sync with the generated client; edit this file by hand.\nconst B = "Code generated by";') is None
    assert S.evidence("x.yaml", "lockfileVersion: '9.0'\n") == "lock"
    assert S.evidence("x.map", '{"version":3,"sources":["a.ts"],"mappings":"AA"}') == "map"
    assert S.evidence("x.js", "var a=1;function f(b){return b+a}" * 40) == "minified"
    assert S.evidence("d.py", "X = [\n" + "\n".join(f'  {{"id": {i}, "score": {i * 7}, "kind": "a"}},' for i in range(30)) + "\n]") == "data"
    assert S.evidence("D.java", "public class D {\n" + "\n".join(f"  public String getA{i}() {{ return this.a{i}; }}" for i in range(20)) + "\n}") == "repeated"
    assert S.evidence("conf.json", "{\n" + ",\n".join(f'  "{w}Key": {i}' for i, w in enumerate(WORDS)) + "\n}") is None
    assert S.evidence("dist/bundle.js", source(1)) is None
    assert S.evidence("x", None) is None and S.evidence("x", "  ") is None and S.evidence(None, source(2)) is None


def test_evidence_beyond_the_first_lines():
    licence = [f"Licence term {i} applies to all users of this work." for i in range(40)]
    mark = "Code generated by gen. DO NOT EDIT."
    code = "\n" + source(8)
    assert S.evidence("a.go", "\n".join(f"// {x}" for x in licence) + f"\n\n// {mark}" + code) == "generated"
    assert S.evidence("a.c", "/*\n" + "\n".join(licence) + f"\n{mark}\n*/" + code) == "generated"
    assert S.evidence("a.php", "<?php\n" + "\n".join(f"# {x}" for x in licence) + f"\n# {mark}" + code) == "generated"
    assert S.evidence("a.ts", "\n".join(f"// {x}" for x in licence) + code + f"\n// {mark}") is None
    body = "\n".join(f"  {w}{i}: {w}" for i in range(60) for w in WORDS)
    assert S.evidence("deps.yaml", f"settings:\n{body}\nlockfileVersion: '9.0'\n") == "lock"
    assert S.evidence("x.map", '{"version":3,"names":["' + "n" * 5000 + '"],"sources":["a.ts"],"mappings":"AA"}') == "map"


def test_copies(spark):
    lib = source(100, 30)
    changed = lib.replace("return", "return void 0 ||", 1)
    rows = [(i, f"w{i}", "vendor/x.ts", lib) for i in range(3)] + [(10, "w9", "src/mine.ts", changed), (11, "w0", "src/a.ts", source(7, 30)), (12, "w1", "src/b.ts", None), (13, "w1", None, ""), (14, "w0", "again.ts", source(7, 30)), (15, "w5", "tiny.ts", "x")]
    df = spark.createDataFrame(rows, "file_id long, workspace string, relpath string, content string")
    assert {r.file_id for r in S.not_handwritten(S.examined(df)).collect()} == {0, 1, 2, 10}
    assert S.not_handwritten(S.examined(df.limit(0))).count() == 0


def test_winnowing_guarantee():
    a, b = source(3, 40), "let q = 1;\n" + source(4, 10) + source(3, 40) + source(5, 10)
    fa, fb = set(S.fingerprints(a)), set(S.fingerprints(b))
    assert len(fa & fb) >= 0.9 * len(fa)
    assert S.fingerprints("") == S.fingerprints(None) == []
