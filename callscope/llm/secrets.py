"""Secret scans with DataFrame functions alone: fixed patterns, and character Markov
models that tell random strings from ordinary identifiers.

Two first-order models over the characters of a candidate (a run of 20 or more
characters of identifiers and encodings) are trained from labelled samples: random
strings (digests of running numbers in the usual encodings) and ordinary identifiers
(distinct words of labelled good documents, alone and put together as programs do, and
ruled lines, repeated characters, dates, versions and numbered names).
A candidate is a span of kind ``markov``, as a whole, if the log-likelihood ratio of any
part of it exceeds a margin: ordinary parts before or after do not hide a random one.

Defined results: a null text is empty; spans are counted in code points, end
exclusive; repeated rows have equal spans; without labelled documents the identifiers
are the fixed words alone; an empty table gives an empty table; an input column that
has the name of an output column is replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the scan, in the order of the kinds.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIERS = ("get set user name value index count list config client server request response handler factory service "
               "manager builder default option message session buffer stream parser format update delete create select "
               "insert return static public private import package version release document controller").split()

#: Bound of the labelled documents that words are taken from, of the distinct words, and of the random strings.
DOCUMENTS, WORDS, RANDOM = 2_000, 50_000, 20_000
#: Dates that ordinary names are made of, and ruled lines of each character.
DATES, RULES = 2_500, 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate is random if a part of it is so many times (as a logarithm) likelier under that model.
MARGIN = 12.0
_BLOCK = 64


def _random(spark: SparkSession, n: int) -> DataFrame:
    raw = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    b64 = F.regexp_replace(F.base64(raw), "\\s", "")
    forms = F.array(F.hex(raw), F.lower(F.hex(raw)), b64, F.translate(b64, "+/", "-_"), F.translate(F.upper(b64), "+/=", ""))
    return spark.range(n).select(F.explode(forms).alias("s"))


def _ordinary(docs: DataFrame, labels: DataFrame | None, text: str, key: str, label: str) -> DataFrame:
    spark = docs.sparkSession
    words = spark.createDataFrame([(w,) for w in IDENTIFIERS], "w string")
    if labels is not None:
        good = (labels.where(F.col(label) == 1).select(key).where(F.col(key).isNotNull()).distinct()
                .orderBy(F.xxhash64(key), key).limit(DOCUMENTS))
        found = docs.join(F.broadcast(good), key).select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))
        words = words.unionByName(found.distinct().orderBy(F.xxhash64("w"), "w").limit(WORDS))
    n = F.abs(F.hash("w")) % 1000
    other = F.element_at(F.array(*[F.lit(w) for w in IDENTIFIERS]), (n % len(IDENTIFIERS) + 1).cast("int"))
    forms = F.array("w", F.concat_ws("_", F.lower("w"), other), F.concat(other, F.initcap("w")), F.concat_ws("/", other, "w"),
                    F.concat_ws("-", F.lower("w"), other), F.upper(F.concat_ws("_", other, "w")), F.concat("w", n.cast("string")))
    return words.select(F.explode(forms).alias("s")).where(F.col("s").rlike(r"^[A-Za-z0-9+/_=-]+$"))


def _written(spark: SparkSession) -> DataFrame:
    """Ruled lines and repeated characters, dates, versions and numbered names."""
    day, word = F.expr("date_add(date'1995-01-01', cast(id * 5 as int))"), F.element_at(F.array(*[F.lit(w) for w in IDENTIFIERS]), (F.col("id") % len(IDENTIFIERS) + 1).cast("int"))
    iso = F.date_format(day, "yyyy-MM-dd")
    dated = F.array(F.concat_ws("_", iso, F.date_format(F.date_add(day, 364), "yyyy-MM-dd")), F.concat_ws("-", iso, word, F.concat(F.lit("v"), F.col("id") % 20)),
                    F.concat(F.translate(iso, "-", "/"), F.lit("/"), word), F.concat_ws("_", word, F.translate(iso, "-", "")),
                    F.concat_ws("-", word, F.lpad(F.col("id").cast("string"), 6, "0")))
    rules = F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.repeat(c, 100))
    return (spark.range(DATES).select(F.explode(dated).alias("s"))
            .unionByName(spark.range(RULES).select(F.explode(rules).alias("s")).where("s <> ''")))


def train(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", label: str = "quality") -> list[float]:
    """The log-likelihood ratio of every pair of ASCII characters (128 x 128, row by
    row): random against ordinary, with add-one smoothing over the alphabet."""
    samples = (_random(docs.sparkSession, RANDOM).withColumn("random", F.lit(1))
               .unionByName(_ordinary(docs, labels, text, key, label).unionByName(_written(docs.sparkSession)).withColumn("random", F.lit(0))))
    chars = samples.select("random", F.split("s", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"),
                                                        lambda a, b: F.ascii(a) * 128 + F.ascii(b))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count().collect()  # at most 2 x 66 x 66 rows
    alphabet = [ord(c) for c in ALPHABET]
    seen = {(r["random"], r["pair"]): r["count"] for r in counts}
    from math import log

    out = [0.0] * (128 * 128)
    for a in alphabet:
        total = [sum(seen.get((k, a * 128 + b), 0) for b in alphabet) + len(alphabet) for k in (0, 1)]
        for b in alphabet:
            out[a * 128 + b] = log((seen.get((1, a * 128 + b), 0) + 1) / total[1]) - log((seen.get((0, a * 128 + b), 0) + 1) / total[0])
    return out


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _starts(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: array of (start, s), every match of the pattern.  The lengths of
    what lies between matches and of the matches are summed up in two levels."""
    p, hit = F.lit(pattern), F.col(text).rlike(pattern)
    df = df.withColumn("__s", F.when(hit, F.regexp_extract_all(text, p, F.lit(0))))
    df = df.withColumn("__gap", F.when(hit, F.transform(F.split(text, pattern, -1), F.length)))
    # before match i: the gap in front of it, and the match before it
    df = df.withColumn("__d", F.expr("""transform(__s, (s, i) -> element_at(__gap, i + 1) + if(i = 0, 0, length(element_at(__s, greatest(i, 1)))))"""))
    df = df.withColumn("__blocks", F.expr(f"transform(sequence(0, (size(__d) - 1) div {_BLOCK}), b -> slice(__d, b * {_BLOCK} + 1, {_BLOCK}))"))
    df = df.withColumn("__sums", F.transform("__blocks", _sum))
    df = df.withColumn("__bases", F.expr("transform(__sums, (x, b) -> aggregate(slice(__sums, 1, b), 0, (a, v) -> a + v))"))
    df = df.withColumn("__at", F.expr("flatten(transform(__blocks, (x, b) -> transform(x, (v, i) -> "
                                      "element_at(__bases, b + 1) + aggregate(slice(x, 1, i + 1), 0, (a, y) -> a + y))))"))
    df = df.withColumn(out, F.arrays_zip(F.col("__at").alias("start"), F.col("__s").alias("s")))
    return df.drop("__s", "__gap", "__d", "__blocks", "__sums", "__bases", "__at")


def _spans(matches: str, kind: str, keep: str = "true") -> Column:
    order = KINDS.index(kind) + 1
    return F.expr(f"transform(filter(coalesce({matches}, array()), m -> {keep}), m -> named_struct('start', m.start, 'kind_no', {order}, "
                  f"'end', m.start + length(m.s), 'kind', '{kind}'))")


def scan(docs: DataFrame, ratios: list[float], text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: array of (start, kind_no, end, kind), by start and then kind."""
    given = [c for c in docs.columns if c != out]
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    for pattern, name in ((ASSIGN, "__assign"), (ACCESS, "__access"), (HEX, "__hex"), (CANDIDATE, "__run")):
        df = _starts(df, "__t", pattern, name)
    group = "regexp_extract(m.s, '(?i)^(?:password|passwd|secret|token|api_?key)[\"\\']?\\\\x20*[:=]\\\\x20*[\"\\']?([A-Za-z0-9+/_.=-]+)$', 1)"
    df = df.withColumn("__llr", F.from_json(F.lit(json.dumps(ratios)), "array<double>"))
    # the largest sum over a run of pairs: the best that ends here, and the best so far
    score = ("aggregate(zip_with(slice(split(m.s, ''), 1, length(m.s) - 1), slice(split(m.s, ''), 2, length(m.s) - 1), "
             "(a, b) -> element_at(__llr, ascii(a) * 128 + ascii(b) + 1)), "
             "named_struct('here', 0D, 'best', 0D), (x, v) -> named_struct('here', greatest(x.here + v, 0D), 'best', greatest(x.best, x.here + v)), x -> x.best)")
    df = df.withColumn(out, F.array_sort(F.concat(
        _spans("__assign", "assign", f"length({group}) >= 6"), _spans("__access", "access"), _spans("__hex", "hex"),
        _spans("__run", "markov", f"{score} > {MARGIN}D"))))
    return df.select(*given, out)


def redact(docs: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    t = F.col(text)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        new = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(
            F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).alias("out"))
        inside = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], new).otherwise(inside)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["pos"] + 1, F.length(t)))
    done = F.aggregate(spans, start, step, rest)
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t))
