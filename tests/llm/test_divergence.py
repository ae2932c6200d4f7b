import random
import re
from collections import Counter, defaultdict

from callscope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(best)]
    return sorted(out)


def check(spark, rows, min_docs=2, top=3, **blocks):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    out = divergence.audit(df.selectExpr("*", "1 as term", "2 as n", "lang as item", "source as value"), min_docs=min_docs, top=top, **blocks)
    got = sorted(tuple(r) for r in out.collect())
    assert [t[1] for t in out.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert got == expected(rows, min_docs, top)
    return got


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "dog", "über", "Über", "日本", "a1b", "x_y", "É", "z", "tail", "q-r", "\x85"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = "hot" if rng.random() < 0.34 else f"s{rng.randrange(sources)}"
        rows.append((" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice([source, source, None])))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1, 120, 6) + [("", "no", "a"), (None, "no", "b"), ("... 123", "no", None), ("solo", "one", "only"), ("solo", "one", "only")]
    rows += rows[:10]
    got = check(spark, rows)
    assert {("no", "a", "pair", "b", 0, 2), ("no", "a", "pair", "", 0, 1)} <= set(got)


def test_many_cells(spark):
    check(spark, corpus(2, 150, 12), group_block=2, term_block=3)


def test_no_kept_terms_and_empty_tables(spark):
    assert {r[4] for r in check(spark, corpus(3, 30, 4), min_docs=1000)} == {0}
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    long = "Wort über alles, " * 3000
    rows = [(long, "de", "a"), (long + " neu", "de", "b"), ("wort", "de", "b")]
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "WINDOW", 10)
    assert b"".join(divergence.windows(long.encode())) == long.encode()
    check(spark, rows, min_docs=1)


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(7 * 10**11, 10**13, 10**6)], "n long, total long, v long")
    got = df.select(divergence._share(df.n, df.total, df.v, 10**9, 5)).first()[0]
    assert got == 1 + 10**9 * (7 * 10**11 + 5) // (10**13 + 5 * 10**6)
