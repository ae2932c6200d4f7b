import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.llm import fim

MARKS = tuple(s.encode() for s in fim.SENTINELS)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(key, text, percent=50):
    """Straight from the definition, with string slices."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, schema, percent=50):
    df = spark.createDataFrame(rows, schema)
    out = fim.restore(fim.transform(df, percent=percent)).collect()
    got = sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in out))
    at = schema.split(", ").index("text string")
    want = sorted(repr((r[0], *expected(r[0], r[at], percent), r[at] or "")) for r in rows)
    assert got == want
    return out


CASES = [None, "", " ", " \n ", "a", " a", "a ", "a b", "é ß 日本 🙂🙂 x", "<P> a b", "a <S", "a<M>", "<", ">", "< S> <M > P>", "　 x\x0by\x0c z\x85",
         "one  two\tthree\r\nfour ", "S> a b <", "<S <P <M"]


def test_cases(spark):
    rows = [(i * 7 + k, t, "clash", 1.0) for i, t in enumerate(CASES) for k in range(7)] + [(None, "a b c", "x", None), (3, "a b c", "x", 0.0), (3, "a b c", "x", 0.0)]
    for percent in (50, 100):
        out = check(spark, rows, "doc_id long, text string, form string, n double", percent)
        assert {r.form for r in out} == {"plain", "spm", "psm"}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(df)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n<>PSMé日"), max_size=30), st.data())
def test_rotation_and_back(text, data):
    raw = text.encode()
    cuts = fim.Cuts(raw)
    units = UNIT.findall(text)
    assert cuts.n == len(units)
    a, b = sorted((data.draw(st.integers(0, cuts.n)), data.draw(st.integers(0, cuts.n))))
    low, high = cuts.end(a), cuts.end(b)
    assert (raw[:low].decode(), raw[:high].decode()) == ("".join(units[:a]), "".join(units[:b]))
    if any(m in raw for m in MARKS):
        return
    p, m, s = raw[:low], raw[low:high], raw[high:]
    assert fim.arrange(raw, low, high, "psm", MARKS) == b"<P>" + p + b"<S>" + s + b"<M>" + m
    assert fim.arrange(raw, low, high, "spm", MARKS) == b"<S>" + s + b"<P>" + p + b"<M>" + m
    for form in ("psm", "spm"):
        assert fim.rearrange(bytes(fim.arrange(raw, low, high, form, MARKS)), form, MARKS) == raw


def test_windows_and_pieces_of_a_reversal_do_not_show(monkeypatch):
    raw = ("word  é\n " * 300).encode()
    whole = fim.Cuts(raw)
    ends = [whole.end(k) for k in range(whole.n + 1)]
    monkeypatch.setattr(fim, "WINDOW", 7)
    monkeypatch.setattr(fim, "SWAP", 3)
    cuts = fim.Cuts(raw)
    assert (cuts.n, [cuts.end(k) for k in range(cuts.n + 1)]) == (whole.n, ends)
    assert fim.characters(cuts.data) == len(raw.decode())
    view = np.frombuffer(bytearray(raw), np.uint8).copy()
    fim.rotate(view, 10, 333, 1001)
    assert view.tobytes() == raw[:10] + raw[333:1001] + raw[10:333] + raw[1001:]


def test_a_very_long_text(spark):
    text = "mot é 日本\n" * 600_000
    out = check(spark, [(i, text) for i in (1, 4)], "doc_id long, text string", 100)
    assert all(r.form != "plain" for r in out)


def test_sentinels_that_cannot_be_found_again_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)
