"""Text features: token frequency, vocabulary, bag of words, IDF, TF-IDF
(E1-E5, F1, G1, G2, I1, D4, D5) and running term counts over call prefixes.

Term matrices are kept **sparse and long** — ``(key..., term, tf)`` with only
non-zero counts — instead of one dense column per word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.scalar import col_, occurrences
from callscope.operators import sequence
from callscope.plans import blocked
from callscope.session import cut_lineage, spread

#: default tokenizer: runs of letters, lower-cased (the morphological analyser
#: of the source pipeline is not available; pass ``tokenizer=`` to plug one in)
TOKEN_PATTERN = r"(\p{L}+)"

Tokenizer = Callable[[Column], Column]


def default_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(TOKEN_PATTERN), 1)


def term_frequency(docs: DataFrame, text: str = "text",
                   tokenizer: Tokenizer | None = None) -> DataFrame:
    """Corpus frequency ``(term, frequency)``.  ``tokenizer`` maps a text
    column to an ``ARRAY<STRING>`` column (built-in expression or pandas UDF); the default
    one is applied to Arrow batches (``letter_runs``), whose distinct terms alone go on."""
    if tokenizer is None:
        letters = letter_ranges(docs.sparkSession)

        def run(batches):
            table = letter_table(letters)
            for batch in batches:
                for _, texts in text_slices(batch, batch.column(0)):
                    runs = letter_runs(texts, table)[0].dictionary_encode()
                    count = np.bincount(runs.indices.to_numpy(), minlength=len(runs.dictionary))
                    yield pa.RecordBatch.from_arrays([runs.dictionary, pa.array(count.astype(np.int64))], ["term", "n"])

        counted = spread(docs.select(text)).select(F.lower(text)).mapInArrow(run, "term string, n long")
        return counted.groupBy("term").agg(F.sum("n").alias("frequency"))
    return (spread(docs.select(text)).select(F.explode(tokenizer(F.col(text))).alias("term")).filter(F.length("term") > 0)
            .groupBy("term").agg(F.count(F.lit(1)).alias("frequency")))


#: Code points, bytes of texts that are cut into runs at once, and the stretches of letters once they are known.
CODE_POINTS, RUN_BYTES = 0x110000, 16 << 20
_RANGES: list[np.ndarray] = []


def letter_ranges(spark: SparkSession) -> np.ndarray:
    """First code points of the stretches of letters and of those of other characters, in
    turn, as the patterns of SQL tell them apart (one small job for the first caller)."""
    if not _RANGES:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")  # surrogates are no characters
        found = (spark.range(CODE_POINTS).where("id not between 55296 and 57343").where(char.rlike(LETTERS_ONLY))
                 .agg(F.collect_list("id")).first()[0])
        table = np.zeros(CODE_POINTS + 1, np.int8)
        table[found] = 1
        _RANGES.append(np.flatnonzero(np.diff(table, prepend=0)).astype(np.int32))
    return _RANGES[0]


def letter_table(ranges: np.ndarray) -> np.ndarray:
    """Whether a code point is a letter."""
    edge = np.zeros(CODE_POINTS + 1, np.int8)
    edge[ranges[::2]], edge[ranges[1::2]] = 1, -1
    return np.cumsum(edge, dtype=np.int8)[:CODE_POINTS].astype(bool)


def text_slices(batch, texts):
    """(first row, texts) of about ``RUN_BYTES`` together."""
    texts = texts.cast(pa.string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + RUN_BYTES, side="right")) - 1)
        yield at, texts.slice(at, stop - at)
        at = stop


def letter_runs(texts, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The maximal runs of letters of all texts (without nulls), and the row of each."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends -= ends[0]
    letter = np.concatenate([table[:128], np.zeros(128, bool)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):  # every byte of a longer character is marked as the character is
        more = [data[np.minimum(lead + k, size - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        first = data[lead].astype(np.int32)
        n = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.select([n == 2, n == 3], [(first & 0x1F) << 6 | more[0], (first & 0x0F) << 12 | more[0] << 6 | more[1]],
                         (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2])
        found = table[np.minimum(code, len(table) - 1)]
        for k in range(4):
            letter[np.minimum(lead[found & (n > k)] + k, size - 1)] = True
    inside = np.empty(size + 1, bool)  # a letter behind a letter of the same text
    inside[0] = inside[size] = False
    np.logical_and(letter[1:], letter[:-1], out=inside[1:size])
    inside[ends[:-1]] = False
    start = np.flatnonzero(letter & ~inside[:size])
    stop = np.flatnonzero(letter & ~inside[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    return runs, np.searchsorted(ends, start, side="right") - 1


def vocabulary(freq: DataFrame, top_k: int | None = None,
               max_percent: float | None = None) -> DataFrame:
    """Terms by frequency (desc, ties by term) with the cumulative
    percent of all occurrences and the rank; keep the top ``k`` and/or the
    terms whose cumulative percent is at most ``max_percent``.

    With ``top_k`` the ordering is a distributed top-k and the running sum runs
    over k rows only; otherwise a blocked running sum over all terms."""
    total = freq.agg(F.sum("frequency").alias("__total"))
    order = [F.col("frequency").desc(), F.col("term").asc()]
    if top_k is not None:
        top = freq.orderBy(*order).limit(top_k)
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        v = top.select("term", "frequency", F.sum("frequency").over(w).alias("__cum"),
                       F.row_number().over(Window.orderBy(*order)).alias("rank"))
    else:
        blk = F.struct((-F.col("frequency")).alias("f"), F.substring("term", 1, 1).alias("t"))
        v = blocked.running_sum(freq.withColumn("__one", F.lit(1)), [], order, blk,
                                {"__cum": "frequency", "rank": "__one"}).drop("__one")
    v = v.crossJoin(F.broadcast(total)).withColumn("cum_percent", F.lit(100.0) * F.col("__cum") / F.col("__total"))
    if max_percent is not None:
        v = v.filter(F.col("cum_percent") <= F.lit(max_percent))
    return v.select("term", "frequency", "cum_percent", F.col("rank").cast("long").alias("rank"))


#: a term made of letters only can match only inside one maximal run of letters
LETTER_RUN = r"(\p{L}+)"
LETTERS_ONLY = r"^\p{L}+$"


def bag_of_words(docs: DataFrame, vocab: DataFrame, keys: str | Sequence[str] = "doc_id",
                 text: str = "text", regex: bool = False, method: str = "auto", lower: bool = True, packed: bool = False) -> DataFrame:
    """Sparse counts ``(keys..., term, tf)`` of every vocabulary word in
    every text — non-overlapping occurrences of the word as a literal substring
    (``regex=True``: as a regular expression) of the text in lower case, the form
    that ``term_frequency`` counts (``lower=False``: as it is).

    Terms made of letters alone are counted by letter runs, at a cost that does not
    grow with their number (``bag_of_words_by_runs``); each other term, and every
    regular expression, by one scan of each text.  ``method`` "runs" or "scan" takes
    one way for all terms.  ``packed``: ``(keys..., terms, tf)``, arrays in a row for each
    key that has a term (see ``tfidf`` and ``sparse_vectors``)."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    d = docs.select(*ks, F.lower(text).alias(text)) if lower else docs.select(*ks, text)
    if packed:
        few = None if regex or method == "scan" else _plain_terms(vocab)
        if few is None:
            return pack(bag_of_words(docs, vocab, ks, text, regex, method, lower), ks, "tf")
        return _named(_packed(d, few, ks, text), few, ks)
    if regex or method == "scan":
        if method == "runs":
            raise ValueError("method='runs' counts literal terms only")
        return _by_scan(d, vocab, ks, text, regex)
    if method == "runs":
        return bag_of_words_by_runs(d, vocab, ks, text)
    by_runs = bag_of_words_by_runs(d, vocab.filter(F.col("term").rlike(LETTERS_ONLY)), ks, text)
    if letters_only(vocab):
        return by_runs
    return by_runs.unionByName(_by_scan(d, vocab.filter(~F.col("term").rlike(LETTERS_ONLY)), ks, text, False))


def _by_scan(docs: DataFrame, vocab: DataFrame, ks: list[str], text: str, regex: bool) -> DataFrame:
    terms = vocab.select("term").distinct()
    return (docs.crossJoin(terms).select(*ks, "term", occurrences(F.col(text), F.col("term"), regex).alias("tf"))
            .filter(F.col("tf") > 0))


#: Terms that go along with the tasks, letters of a run that is looked up along with others, runs counted at once.
TASK_TERMS, SHORT_RUN, RUN_CHUNK = 1 << 16, 64, 1 << 18


def bag_of_words_by_runs(docs: DataFrame, vocab: DataFrame, keys: str | Sequence[str] = "doc_id",
                         text: str = "text") -> DataFrame:
    """Literal counts of letters-only terms without scanning each text once per
    term.  Such a term can only match inside one maximal run of letters, and
    left-to-right non-overlapping matching restarts at every non-letter, so

        tf(doc, term) = sum over letter runs r of doc:  m(doc, r) * count(term in r)

    The runs of a text are counted where the text is read (``_count_runs``): nothing but
    a row's counts is shuffled, as arrays, to meet rows of equal keys.  The vocabulary goes
    along with the tasks up to ``TASK_TERMS`` terms; larger ones are joined with the substrings
    of the distinct runs (``_runs_by_join``).  Terms with non-letters must use ``method="scan"``."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    terms = vocab.select("term").where("term is not null").distinct()
    few = _few(terms)
    if few is None:
        runs = spread(docs.select(*ks, text)).select(*ks, F.regexp_extract_all(F.col(text), F.lit(LETTER_RUN), 1).alias("__runs"))
        return _runs_by_join(runs, terms, ks)
    return _long(_packed(docs, few, ks, text), few, ks)


def _few(terms: DataFrame) -> list[str] | None:
    """The distinct terms, at most ``TASK_TERMS`` of them."""
    few = sorted(r.term for r in terms.limit(TASK_TERMS + 1).collect())  # at most so many terms
    return few if len(few) <= TASK_TERMS else None


def _plain_terms(vocab: DataFrame) -> list[str] | None:
    """The terms of a vocabulary of letters-only, distinct terms that go along with the tasks."""
    terms = [r.term for r in vocab.select("term").limit(TASK_TERMS + 1).collect()]  # at most so many terms
    if len(terms) > TASK_TERMS or None in terms or len(set(terms)) < len(terms) or not letters_only(vocab):
        return None
    return sorted(terms)


def _named(packed: DataFrame, terms: list[str], ks: list[str]) -> DataFrame:
    """(keys.., terms, tf) of packed rows."""
    return packed.select(*ks, F.transform("__t", lambda t: F.element_at(_literal(terms), t + 1)).alias("terms"), F.col("__n").alias("tf"))


def pack(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """(keys.., terms, value): the rows of a key as two arrays."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    both = df.groupBy(*ks).agg(F.collect_list(F.struct("term", value)).alias("__e"))
    return both.select(*ks, F.col("__e.term").alias("terms"), F.col(f"__e.{value}").alias(value))


def unpack(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """(keys.., term, value): the reverse of ``pack``."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    each = df.select(*ks, F.explode(F.arrays_zip("terms", value)).alias("__e"))
    return each.select(*ks, F.col("__e.terms").alias("term"), F.col(f"__e.{value}").alias(value))


def _term_numbers(side: DataFrame, number: str) -> dict | None:
    """{term: number} of a table of few, distinct terms."""
    rows = side.select("term", number).where("term is not null").limit(TASK_TERMS + 1).collect()  # at most so many terms
    found = dict(map(tuple, rows))
    return found if len(rows) <= TASK_TERMS and len(found) == len(rows) else None


def _packed(docs: DataFrame, terms: list[str], ks: list[str], text: str) -> DataFrame:
    """(keys.., __t, __n), a row for each key that has a term: places of its terms, ascending, and their counts."""
    counted = _count_runs(spread(docs.select(*ks, text)), terms, letter_ranges(docs.sparkSession), ks, text)
    return _merge_equal(counted, max(len(terms), 1), ks)


def _literal(terms: list[str]) -> Column:
    """Letters-only terms as one constant array."""
    return F.split(F.lit(" ".join(terms)), " ")


def _long(packed: DataFrame, terms: list[str], ks: list[str], value: str = "tf") -> DataFrame:
    """A row for each term of the packed rows."""
    each = packed.select(*ks, F.explode(F.arrays_zip("__t", "__n")).alias("__e"))
    return each.select(*ks, F.element_at(_literal(terms), F.col("__e.__t") + 1).alias("term"), F.col("__e.__n").alias(value))


def _lists(sizes: np.ndarray, values: np.ndarray, kind=None):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values), type=kind)


def _count_runs(docs: DataFrame, terms: list[str], letters: np.ndarray, ks: list[str], text: str) -> DataFrame:
    """(keys.., __t, __n) of every row with a term.  The distinct runs of a batch meet the terms by
    their substrings of the terms' lengths; the rest is array arithmetic."""
    schema = T.StructType([*(docs.schema[k] for k in ks), T.StructField("__t", T.ArrayType(T.IntegerType())),
                           T.StructField("__n", T.ArrayType(T.LongType()))])
    size, step, short, chunk = max(len(terms), 1), max(1, DENSE_BATCH // max(len(terms), 1)), SHORT_RUN, RUN_CHUNK

    def run(batches):
        table = letter_table(letters)
        words, places = pa.array(terms, pa.string()), {t: i for i, t in enumerate(terms)}
        of = {n: np.array([i for i, t in enumerate(terms) if len(t) == n]) for n in sorted({len(t) for t in terms})}
        sets = {n: words.take(pa.array(i)) for n, i in of.items()}

        def matches(distinct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(run, term, count), by run: a term's places in a run, or what does not overlap of them."""
            length = pa.compute.utf8_length(distinct).to_numpy()
            order = np.argsort(-length, kind="stable")
            ordered, length = distinct.take(pa.array(order)), length[order]
            long = int(np.searchsorted(-length, -short, side="left"))
            found = [np.array([k * size + places[t] for k, word in enumerate(ordered.slice(0, long).to_pylist()) for n in of
                               for i in range(len(word) - n + 1) if (t := word[i:i + n]) in places], np.int64)]
            for n, own in of.items():
                for i in range(max(0, short - n + 1)):
                    stop = int(np.searchsorted(-length, -(i + n), side="right"))
                    if stop <= long:
                        break
                    at = pa.compute.index_in(pa.compute.utf8_slice_codeunits(ordered.slice(long, stop - long), i, i + n), value_set=sets[n])
                    at = at.fill_null(-1).to_numpy()
                    hit = np.flatnonzero(at >= 0)
                    found.append((hit + long) * size + own[at[hit]])
            pair, count = np.unique(np.concatenate(found), return_counts=True)
            for j in np.flatnonzero(count > 1):
                k, t = divmod(int(pair[j]), size)
                if len(terms[t]) > 1:
                    count[j] = ordered[k].as_py().count(terms[t])
            return order[pair // size], pair % size, count

        for whole in batches:
            for base, texts in text_slices(whole, whole.column(whole.schema.get_field_index(text))):
                flat, row = letter_runs(texts, table)
                flat = flat.dictionary_encode()
                word, term, count = matches(flat.dictionary)
                by = np.argsort(word, kind="stable")
                term, count = term[by], count[by]
                many = np.bincount(word, minlength=len(flat.dictionary))
                start, code = np.cumsum(many) - many, flat.indices.to_numpy()
                for at in range(0, len(texts), step):
                    first, last = np.searchsorted(row, [at, at + step])
                    rows = min(step, len(texts) - at)
                    tf = np.zeros(rows * size)
                    for c in range(first, last, chunk):
                        some = code[c:min(c + chunk, last)]
                        n = many[some]
                        pick = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        tf += np.bincount(np.repeat(row[c:min(c + chunk, last)] - at, n) * size + term[pick], count[pick], len(tf))
                    cell = np.flatnonzero(tf)
                    found = np.bincount(cell // size, minlength=rows)
                    some = np.flatnonzero(found)
                    kept = [whole.column(whole.schema.get_field_index(k)).take(pa.array(base + at + some)) for k in ks]
                    yield pa.RecordBatch.from_arrays([*kept, _lists(found[some], (cell % size).astype(np.int32)),
                                                      _lists(found[some], tf[cell].astype(np.int64))], schema.names)

    return docs.select(*ks, text).mapInArrow(run, schema)


def _merge_equal(packed: DataFrame, size: int, ks: list[str]) -> DataFrame:
    """Adds up the rows of equal keys.  They lie behind one another; a task holds the sums
    of one key and a batch at a time."""
    schema = T.StructType(packed.schema.fields)
    first = F.row_number().over(Window.partitionBy(*ks).orderBy(F.lit(0))) == 1

    def add_up(batch):
        new = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        if new.all():
            return batch
        places, counts = batch.column(len(ks)), batch.column(len(ks) + 1)
        key = np.repeat(np.cumsum(new) - 1, places.value_lengths().to_numpy())
        cell, at = np.unique(key * size + places.flatten().to_numpy(), return_inverse=True)
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, at, counts.flatten().to_numpy())
        start = np.flatnonzero(new)
        sizes = np.bincount(cell // size, minlength=len(start))
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(start)) for i in range(len(ks))), _lists(sizes, (cell % size).astype(np.int32), places.type),
                                           _lists(sizes, total, counts.type), pa.array(np.ones(len(start), bool))], schema=batch.schema)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch], schema=batch.schema).combine_chunks().to_batches()[0]
            merged = add_up(both)
            last = merged.num_rows - 1
            held = merged.slice(last, 1)
            if last:
                yield pa.RecordBatch.from_arrays(merged.columns[:-1], schema.names).slice(0, last)
        if held is not None:
            yield pa.RecordBatch.from_arrays(held.columns[:-1], schema.names)

    return packed.withColumn("__new", first).mapInArrow(run, schema)


def _runs_by_join(runs: DataFrame, terms: DataFrame, ks: list[str]) -> DataFrame:
    """The same by joins: for the distinct runs only, every substring whose length is a
    term's is matched against the vocabulary; the runs of each row are then joined on the
    run and summed."""
    per_doc = runs.select(*ks, F.explode("__runs").alias("run")).groupBy(*ks, "run").agg(F.count(F.lit(1)).alias("__m"))
    lens = F.broadcast(terms.agg(F.array_distinct(F.collect_list(F.length("term"))).alias("__lens")))
    subs = F.flatten(F.transform("__lens", lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("run") - n + 1, F.lit(0))), lambda i: F.substring("run", i, n))))
    cand = (per_doc.select("run").distinct().crossJoin(lens)
            .select("run", F.explode(subs).alias("term")).distinct())
    pairs = cand.join(terms, "term")
    run_tf = pairs.select("run", "term", occurrences("run", F.col("term")).alias("__c"))
    return (per_doc.join(run_tf, "run")
            .groupBy(*ks, "term").agg(F.sum(F.col("__m") * F.col("__c")).alias("tf")))


def letters_only(vocab: DataFrame) -> bool:
    """True when every term is a run of letters (one small action)."""
    return vocab.filter(~F.col("term").rlike(LETTERS_ONLY)).limit(1).count() == 0


def few_terms(terms: DataFrame) -> bool:
    """True for at most ``TASK_TERMS`` rows (one small action on a table by term)."""
    return terms.limit(TASK_TERMS + 1).count() <= TASK_TERMS


def inverse_document_frequency(tf: DataFrame, docs: DataFrame, vocab: DataFrame,
                               key: str = "doc_id") -> DataFrame:
    """E2-E4 (``tf`` is sparse: only non-zero counts): ``df`` = documents
    containing the term, ``n_docs`` = all documents
    (including those without any vocabulary word) and the smoothed
    ``idf = ln((n_docs + 1) / (df + 1)) + 1`` for every vocabulary term."""
    n = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (vocab.select("term").join(dfreq, "term", "left").crossJoin(F.broadcast(n))
            .withColumn("df", F.coalesce("df", F.lit(0)).cast("long"))
            .withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + F.lit(1.0)))


def tfidf(tf: DataFrame, idf: DataFrame, keys: str | Sequence[str] = "doc_id",
          normalize: bool = True) -> DataFrame:
    """``tf * idf`` (inner join on term: a term missing from the IDF table
    is dropped), then divided by the document's L2 norm (0 -> 1e-10).  Packed counts
    (``terms``, ``tf``) give packed weights (``terms``, ``tfidf``), row by row."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    if "terms" in tf.columns:
        weight = _term_numbers(idf, "idf")
        if weight is None:
            return pack(tfidf(unpack(tf, ks, "tf"), idf, ks, normalize), ks, "tfidf")
        return _weigh(tf, weight, ks, normalize)
    side = idf.select("term", "idf")
    if few_terms(side):  # the weights are joined where they are
        side = F.broadcast(side)
    w = tf.join(side, "term").withColumn("tfidf", F.col("tf") * F.col("idf"))
    if normalize:
        norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(*ks)))
        w = w.withColumn("tfidf", F.col("tfidf") / F.when(norm == 0, F.lit(1e-10)).otherwise(norm))
    return w.select(*ks, "term", "tfidf")


def _entries(batches, ks: list[str], value: str, numbers: dict):
    """Of parts of packed batches: the keys' columns, the rows and terms of the entries whose
    term is known, their values, and the terms' numbers."""
    words, number = pa.array(list(numbers), pa.string()), np.array(list(numbers.values()))
    step = max(1, DENSE_BATCH // max(len(numbers), 1))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            lists, values = (batch.column(batch.schema.get_field_index(c)) for c in ("terms", value))
            flat = lists.flatten()
            at = pa.compute.index_in(flat, value_set=words).fill_null(-1).to_numpy()
            known = np.flatnonzero(at >= 0)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[known]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in ks]
            yield kept, batch.num_rows, row, flat.take(pa.array(known)), values.flatten().to_numpy()[known], number[at[known]] if len(number) else number


def _weigh(tf: DataFrame, weight: dict, ks: list[str], normalize: bool) -> DataFrame:
    schema = T.StructType([*(tf.schema[k] for k in ks), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tfidf", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for kept, n, row, terms, count, idf in _entries(batches, ks, "tf", weight):
            x = count * idf
            if normalize:
                norm = np.sqrt(np.bincount(row, x * x, n))
                x = x / np.where(norm == 0, 1e-10, norm)[row]
            sizes = np.bincount(row, minlength=n)
            yield pa.RecordBatch.from_arrays([*kept, _lists(sizes, terms), _lists(sizes, x.astype(float))], schema.names)

    return tf.select(*ks, "terms", "tf").mapInArrow(run, schema)


def term_index(vocab: DataFrame) -> DataFrame:
    """K2: (term, index): the place of a term in vectors, from 0, by its rank in the vocabulary."""
    return vocab.select("term", (F.col("rank") - 1).cast("int").alias("index"))


def sparse_vectors(weights: DataFrame, index: DataFrame, rows: DataFrame, keys: str | Sequence[str] = "doc_id", value: str = "tfidf") -> DataFrame:
    """K2: (keys.., indices, values): the weights of every row of ``rows`` (unique keys) by the
    places of their terms, ascending; a row without terms has empty arrays, and terms that have
    no place are left out.  A vector holds at most as many entries as there are places.
    ``weights`` has a row for each term, or is packed (``terms`` and values)."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    if "terms" in weights.columns:
        places = _term_numbers(index, "index")
        if places is None:
            return sparse_vectors(unpack(weights, ks, value), index, rows, ks, value)
        return _every_row(rows, _placed(weights, places, ks, value), ks)
    entry = F.struct("index", F.col(value).cast("double").alias("value"))
    found = weights.join(index, "term").groupBy(*ks).agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    return _every_row(rows, found.select(*ks, F.col("__e.index").alias("indices"), F.col("__e.value").alias("values")), ks)


def _every_row(rows: DataFrame, found: DataFrame, ks: list[str]) -> DataFrame:
    every = blocked.join_null_safe(rows.select(*ks), found, ks, "left")
    return every.select(*ks, F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
                        F.coalesce("values", F.array().cast("array<double>")).alias("values"))


def _placed(weights: DataFrame, places: dict, ks: list[str], value: str) -> DataFrame:
    schema = T.StructType([*(weights.schema[k] for k in ks), T.StructField("indices", T.ArrayType(T.IntegerType())),
                           T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for kept, n, row, _, x, place in _entries(batches, ks, value, places):
            by = np.lexsort((place, row))
            sizes = np.bincount(row, minlength=n)
            yield pa.RecordBatch.from_arrays([*kept, _lists(sizes, place[by].astype(np.int32)), _lists(sizes, x[by].astype(float))], schema.names)

    return weights.select(*ks, "terms", value).mapInArrow(run, schema)


#: Numbers of a batch of dense vectors.
DENSE_BATCH = 1 << 20


def dense_vectors(df: DataFrame, size: int, indices: str = "indices", values: str = "values", out: str = "features") -> DataFrame:
    """K2: sparse arrays as one array of ``size`` numbers, the others being 0; places of ``size``
    or more are an error."""
    rest = [f for f in df.schema.fields if f.name not in (indices, values, out)]
    schema = T.StructType([*rest, T.StructField(out, T.ArrayType(T.DoubleType()))])
    step = max(1, DENSE_BATCH // max(size, 1))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                places, numbers = batch.column(batch.schema.get_field_index(indices)), batch.column(batch.schema.get_field_index(values))
                lengths = np.diff(places.offsets.to_numpy())
                flat = np.zeros((batch.num_rows, size))
                flat[np.repeat(np.arange(batch.num_rows), lengths), places.flatten().to_numpy()] = numbers.flatten().to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(flat.ravel()))
                kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
                yield pa.RecordBatch.from_arrays([*kept, lists], schema.names)

    return df.select(*[f.name for f in rest], indices, values).mapInArrow(run, schema)


def fit_tfidf(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
              regex: bool = False, materialize: bool = True, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bag of words -> IDF -> L2-normalised TF-IDF, every text read once.

    The vocabulary and the sparse counts each feed several branches; with
    ``materialize`` they are checkpointed into the session's shared checkpoint
    folder, so the texts are tokenised and counted exactly once and a lost executor
    does not send the job back to the raw texts.  The counts of letters-only terms are kept
    as arrays, a row for each document.  Returns ``(tfidf, idf)``; ``packed``: weights as
    arrays too."""
    keep = cut_lineage if materialize else (lambda df: df)
    vocab = keep(vocab)
    few = None if regex else _plain_terms(vocab)
    if few is None:
        counts = keep(bag_of_words(docs, vocab, key, text, regex))
        idf = keep(inverse_document_frequency(counts, docs, vocab, key))  # a row for each term
        weights = tfidf(counts, idf, key)
        return pack(weights, key, "tfidf") if packed else weights, idf
    arrays = keep(_packed(docs.select(key, F.lower(text).alias(text)), few, [key], text))
    found = arrays.select(F.explode("__t").alias("__t")).select(F.element_at(_literal(few), F.col("__t") + 1).alias("term"))
    idf = keep(inverse_document_frequency(found, docs, vocab, key))  # a row for each term
    weights = tfidf(_named(arrays, few, [key]), idf, key)
    return weights if packed else unpack(weights, key, "tfidf"), idf


def prefix_term_frequency(utt: DataFrame, vocab: DataFrame, id_col: str = "id", seq: str = "seq",
                          text: str = "tagged", materialize: bool = True) -> DataFrame:
    """Term counts of every call prefix 0..i, ``(id, seq, term, tf)`` with tf > 0,
    without building the quadratic prefix texts: count per utterance, then a
    running sum per ``(id, term)``.  Equal to counting on the space-joined
    prefix text for terms without whitespace (a match cannot cross the joining
    space); terms with whitespace are counted on the joined texts.  ``seq`` must be
    dense per call.  A count is carried on to the utterance before the next one of its call
    and term, so only counts that change are shuffled and summed, and nothing has to be
    written down (``materialize`` is accepted and has no effect)."""
    spaced = vocab.filter(F.col("term").rlike(r"\s"))
    if spaced.limit(1).count():
        joined = sequence.stack_prefixes(utt, id_col, seq, text, end_col=seq).select(id_col, seq, "text")
        rest = vocab.filter(~F.col("term").rlike(r"\s"))
        return (prefix_term_frequency(utt, rest, id_col, seq, text, materialize)
                .unionByName(bag_of_words(joined, spaced, [id_col, seq], "text")))
    per = bag_of_words(utt, vocab, [id_col, seq], text).where(F.col(seq).isNotNull())
    last = utt.groupBy(id_col).agg(F.max(seq).alias("__last"))
    w = Window.partitionBy(id_col, "term").orderBy(seq)
    steps = per.select(id_col, "term", seq, F.sum("tf").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tf"),
                       (F.lead(seq).over(w) - 1).alias("__stop"))
    steps = steps.join(last, id_col)
    return steps.select(id_col, F.explode(F.sequence(seq, F.coalesce("__stop", "__last"))).alias(seq), "term", "tf")
