import hashlib
import random
import re
import string

from callscope.llm import queries, secrets

RULES = (("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def base(text):
    out = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(RULES) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_query_small(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = queries.op5_secrets(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base(docs[r.doc_id])
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("markov")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k, *_ in RULES)
        assert [int(s.split(":")[1]) for s in own] == sorted(int(s.split(":")[1]) for s in own)


def test_edge_cases(spark, sf_small):
    rng = random.Random(1)
    rand = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    texts = [None, "", "🙂é token = 'abcdef' x", "secret=token:abcdef", "PassWord: short", "password=token=abc api_key=\"A.b-c_d=\"",
             "AKIA" + "A" * 15, "AKIAAKIA" + "Z9" * 9, "a" * 23 + "g" + "0f" * 12, "ＴＯＫＥＮ=abcdefgh ſecret=abcdefgh", "token=abcdef" * 700,
             "x " + rand(44) + " y", "getUserNameFromRequestHandler default_session_buffer_size", "deadbeef" * 3 + " " + "word " * 50_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 2)], "doc_id long, text string, spans int")
    ratios = secrets.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    rows = secrets.scan(docs, ratios).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "markov"] == base(r.text)
    by = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert by[11] == ["markov"] and by[12] == []
    red = {r.doc_id: r.text for r in secrets.redact(secrets.scan(docs, ratios)).collect()}
    assert red[2] == "🙂é [SECRET]' x" and red[11] == "x [SECRET] y" and red[12] == texts[12] and red[1] == ""
    assert secrets.scan(docs.limit(0), ratios).count() == 0


def test_models_tell_random_strings(spark, sf_small):
    ratios = secrets.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    score = lambda s: sum(ratios[ord(a) * 128 + ord(b)] for a, b in zip(s, s[1:]))
    rng = random.Random(2)
    chars = string.ascii_letters + string.digits
    rand = ["".join(rng.choice(chars) for _ in range(rng.randint(24, 60))) for _ in range(500)]
    plain = ["_".join(rng.choices(secrets.IDENTIFIERS, k=rng.randint(3, 6))) for _ in range(500)]
    assert sum(score(s) > secrets.MARGIN for s in rand) > 480
    assert sum(score(s) > secrets.MARGIN for s in plain) < 10


def test_no_python_on_the_main_path(spark, sf_small):
    plan = queries.op5_secrets(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_random_part_of_an_ordinary_run(spark, sf_small):
    ratios = secrets.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    secret, path = "x8Kd02LmQz71RtYp45VbNc93", "static/public/import/package/version/release"
    texts = [f"see {path}/{secret} here", f"{path.replace('/', '_')}={secret}", f"{secret}-{path.replace('/', '-')}", f"{path}/{secret}/{path}",
             f"{path}/{path}", path.replace("/", "_") + "=" + path.replace("/", "-")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.redact(secrets.scan(docs, ratios)).collect()}
    for i, r in rows.items():
        assert [s.kind for s in r.spans] == (["markov"] if i < 4 else []) and secret not in r.text
    assert rows[0].text == "see [SECRET] here" and rows[4].text == texts[4]


def test_more_text_does_not_narrow_the_words(spark, monkeypatch):
    """The bound counts words, not their occurrences."""
    words = [a * 3 + b * 2 for a in "bcdfg" for b in "kl"]
    docs = spark.createDataFrame([(1, " ".join(words * 100))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    monkeypatch.setattr(secrets, "WORDS", len(words))
    got = {r.s for r in secrets._ordinary(docs, labels, "text", "doc_id", "quality").collect()}
    assert got >= set(words)


def test_rules_dates_and_repeats_are_ordinary(spark, sf_small):
    ratios = secrets.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    texts = ["-" * 40, "=" * 20, "_" * 300, "A" * 30, "2024-01-01_2024-12-31-report-final-version", "release-2023-11-05-version-000123", "/" * 25,
             "session_20240101_20241231_update"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.text: [s.kind for s in r.spans] for r in secrets.scan(docs, ratios).collect()} == {t: [] for t in texts}
