"""Set similarity join of documents on word n-grams: a grouped prefix join.

Documents with equal sets form a class.  The n-grams have one order (by hash, those of
crowded hash buckets later, the more crowded the later), and the first n - ceil(t n) + 1
of a set are its prefix: two sets of similarity t share an n-gram of their prefixes.  Classes with one prefix and one
size form a group.

1. The lists of groups per prefix n-gram are made.  A group goes on only in lists where
   another's size, and what both have left behind that n-gram, allow a link.  Of lists (of
   one block) that are left with the same groups, one goes on: near copies share most of
   their n-grams, and need to meet once only.
2. Groups are expanded to their classes.  The classes of a list (and those of a group
   among themselves) are compared in blocks by size and by parity sketches: the bits in
   which two sketches differ cannot outnumber the n-grams in which the sets do.
3. In rounds, every class asks for a few partners that links have not yet brought
   together with it, and these pairs are verified on the sets.  The first round compares
   long lists within their blocks alone, which differ from list to list.  From the second,
   lists of one component are done, and in a long list the classes that are not of its
   largest component go to all its blocks.  Classes that had to leave partners out ask
   again, each round for more; the last is the one in which no class had to leave any out, so that every
   pair the sketches allow is verified or already connected.  n near copies of one
   another so cost about n pairs and n rows, not n * n / 2.

No pair is passed on before the sketches have been compared, long lists are split into
blocks, and copies are put together before every shuffle.  Broadcast are bitmaps of
fixed size: the crowded buckets, the classes to verify, and the texts that have them.

Defined results: a null text, or one without words, has the empty set and links with
nothing; one with fewer words than an n-gram has its whole sequence as its only member;
rows that repeat an id are documents of their own; a null id is smallest of none; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import _multipliers, as_long, column, components, id_filter, mix, shingle_hashes, small_batches, word_hashes
from callscope.session import cut_lineage

#: Buckets that n-grams are counted in.
BUCKETS = 1 << 18
#: A bucket is crowded from this count above the mean, or this many times the mean above it.
CROWDED, TIMES_MEAN = 64, 0.25
#: Groups of a list in one block, and pairs that are compared at a time.
BLOCK, PAIRS = 2048, 1 << 17
#: Long lists of a class that the first round compares.
FIRST_LONG = 2
#: Lists up to this length lose the groups that can link with no other of the list.
SHORT = 64
#: Bytes of text that are worked on together, and names that a task remembers.
BATCH, REMEMBERED = 1 << 18, 1 << 16
#: Partners that a class asks for in the first round, and how many times more in each further one.
PARTNERS, MORE = 4, 16


def shingle_sets(texts: list[str | None], k: int, lower: bool) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams."""
    hashes, at = word_hashes([(t or "").encode() for t in texts], lower)
    every = shingle_hashes(hashes, k)  # those across two texts are not used
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a:b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _multipliers(b - a, 1000 + b - a)).sum()], np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def class_id(s: np.ndarray) -> int:
    size = np.array([len(s)], np.uint64)
    return int(as_long(mix(size + mix(s + np.uint64(1)).sum()))[0])


class Measure:
    """Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def sizes(self, a, b):
        return (self.num * np.maximum(a, b)) <= (self.den * np.minimum(a, b))

    def common(self, a, b):
        """The fewest n-grams that linked sets of these sizes share."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def difference(self, a, b):
        """The most n-grams in which sets of these sizes may differ."""
        return (a + b) - 2 * self.common(a, b)

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)  # 18 bits


def _prefix(s: np.ndarray, measure: Measure, crowded: np.ndarray) -> np.ndarray:
    p = measure.prefix(len(s))
    late = crowded[_buckets(s)]
    if not late[:p].any():
        return s[:p]
    return s[np.argsort(late, kind="stable")[:p]]


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the n-grams by bit, of as many bits as n-grams, up to a power of two.
    Of sets with nothing in common about half the bits differ: with half as many bits that
    is near the most that linked sets may differ in, and more such pairs pass, the larger
    the table is; each would have both its sets shuffled."""
    bits = 1 << max(7, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


class _Sketches:
    """The sketches of a batch of classes, folded to any smaller width on demand."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(r) // 8 for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.full, self.folded = {}, {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.full[w] = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint64).reshape(len(own), w)

    def _at(self, own: int, width: int) -> np.ndarray:
        if (own, width) not in self.folded:
            self.folded[own, width] = _fold(self.full[own], width)
        return self.folded[own, width]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows, the bits in which their sketches (of one width) differ."""
        out = np.zeros(len(a), np.int64)
        kind = self.width[a] * (1 << 32) + self.width[b]
        for code in np.unique(kind).tolist():
            wa, wb = divmod(code, 1 << 32)
            w, own = min(wa, wb), np.flatnonzero(kind == code)
            x, y = self._at(wa, w)[self.place[a[own]]], self._at(wb, w)[self.place[b[own]]]
            out[own] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return out


def _pairs(first: np.ndarray, size: np.ndarray, home: np.ndarray):
    """Chunks of (list, a, b), a < b: the pairs of rows of each list (rows first .. first + size);
    in long lists only those with a row that is at ``home`` there."""
    for c in np.unique(size[size > 1]).tolist():
        lists = np.flatnonzero(size == c)
        if c * (c - 1) // 2 > PAIRS:  # some rows against the others at a time
            for i in lists.tolist():
                at = home[first[i]:first[i] + c]
                away, a, b, held = np.flatnonzero(~at), [], [], 0
                for x in np.flatnonzero(at).tolist():
                    other = np.concatenate([away[:np.searchsorted(away, x)], np.arange(x + 1, c)]) + first[i]
                    a.append(np.minimum(other, first[i] + x))
                    b.append(np.maximum(other, first[i] + x))
                    held += len(other)
                    if held >= PAIRS:
                        yield np.full(held, i), np.concatenate(a), np.concatenate(b)
                        a, b, held = [], [], 0
                if held:
                    yield np.full(held, i), np.concatenate(a), np.concatenate(b)
            continue
        x, y = np.triu_indices(c, 1)
        step = max(1, PAIRS // len(x))
        for at in range(0, len(lists), step):
            some = lists[at:at + step]
            yield np.repeat(some, len(x)), (first[some][:, None] + x).ravel(), (first[some][:, None] + y).ravel()


def _near(n: np.ndarray, sketches: _Sketches, a: np.ndarray, b: np.ndarray, measure: Measure) -> np.ndarray:
    """Which pairs the sizes and sketches allow."""
    ok = np.flatnonzero(measure.sizes(n[a], n[b]))
    differ = sketches.differ(a[ok], b[ok])
    return ok[differ <= measure.difference(n[a[ok]], n[b[ok]])]


def _sets(batches, text, k, lower):
    for batch in small_batches(batches, text, BATCH):
        sets = shingle_sets(column(batch, text).to_pylist(), k, lower)
        yield batch, sets, [class_id(s) if len(s) else None for s in sets]


class _Seen(set):
    """Names that a task has met, forgotten when there are many."""

    def new(self, name) -> bool:
        if name in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(name)
        return True


def _crowded(docs: DataFrame, text: str, k: int, lower: bool) -> np.ndarray:
    """How crowded each bucket of n-grams is: 0, or how often the limit was doubled.  All
    n-grams of the sets count: those behind a prefix move into it as crowded ones leave."""
    def run(batches):
        total, classes = np.zeros(BUCKETS, np.int64), _Seen()
        for _, sets, ids in _sets(batches, text, k, lower):
            once = [s for s, c in zip(sets, ids, strict=True) if c is not None and classes.new(c)]
            if once:
                np.add.at(total, _buckets(np.concatenate(once)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = cut_lineage(docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    above = max(CROWDED, TIMES_MEAN * mean)
    out = np.zeros(BUCKETS, np.int8)
    for r in counts.where(F.col("n") > mean + above).collect():  # of a fixed number
        out[r.bucket] = 1 + int(np.log2((r.n - mean) / above))
    return out


def _named(docs: DataFrame, key: str, text: str, k: int, lower: bool, measure: Measure, crowded: np.ndarray) -> DataFrame:
    """(key, n, cid) and the text's hash of every row.  The first row of a class (of those a
    task remembers) has its group g and sketch too, and the first row of a group the n-grams
    of its prefix."""
    def run(batches):
        classes, groups = _Seen(), _Seen()
        for batch, sets, ids in _sets(batches, text, k, lower):
            rows = []
            for s, c in zip(sets, ids, strict=True):
                if c is None or not classes.new(c):
                    rows.append((None, None, None))
                    continue
                p = _prefix(s, measure, crowded)
                g = _group(p, len(s))
                rows.append((g, _sketch(s), as_long(p) if groups.new(g) else None))
            g, sketch, prefix = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                column(batch, key), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
                pa.array(g, pa.int64()), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), column(batch, "__hash")], ["__key", "n", "cid", "g", "sketch", "prefix", "hash"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, "__hash").mapInArrow(run, f"__key {kind}, n long, cid long, g long, sketch binary, prefix array<long>, hash long")


def _group(prefix: np.ndarray, n: int) -> int:
    size = np.array([n], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(as_long(mix(size + mix(prefix).sum()))[0])


def _lists(entries: DataFrame, measure: Measure) -> DataFrame:
    """(token, g, blocks): the groups that may link with another one that has the n-gram,
    once for all n-grams that leave the same groups.
    Two sets whose first common n-gram this is share at most as many as each has from it on."""
    def run(batches):
        held = []  # of the last n-gram, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [column(batch, c).to_numpy() for c in ("token", "g", "n", "pos")]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last or (held and held[-1][0][-1] != rows[0][0]):
                yield done([*held, [x[:last] for x in rows]])
                held = []
            held.append([x[last:] for x in rows])
        if held:
            yield done(held)

    def done(pieces):
        token, g, n, pos = (np.concatenate(x) for x in zip(*pieces))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
        token, g, n, pos = (x[new] for x in (token, g, n, pos))
        _, first, size = np.unique(token, return_index=True, return_counts=True)
        live = np.repeat(size > SHORT, size)
        short = size <= SHORT
        for _, a, b in _pairs(first[short], size[short], np.ones(len(token), bool)):
            ok = measure.sizes(n[a], n[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= measure.common(n[a], n[b]))
            live[a[ok]] = live[b[ok]] = True
        token, g = token[live], g[live]
        _, first, size = np.unique(token, return_index=True, return_counts=True)
        same = as_long(mix(np.add.reduceat(mix(g.view(np.uint64)), first) + size.astype(np.uint64))) if len(g) else g
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(g), pa.array(np.repeat(-(-size // BLOCK), size).astype(np.int32)),
                                           pa.array(np.repeat(same, size))], ["token", "g", "blocks", "same"])

    lists = cut_lineage(entries.repartition("token").sortWithinPartitions("token", "g")
                        .mapInArrow(run, "token long, g long, blocks int, same long"))
    # lists of the same groups say the same: one of them stays
    one = lists.where("blocks = 1").groupBy("same").agg(F.min("token").alias("token"))
    return (lists.where("blocks = 1").join(one, ["same", "token"], "left_semi").unionByName(lists.where("blocks > 1"))
            .select("token", "g", "blocks"))


def _largest(rows: DataFrame, by: str) -> DataFrame:
    """(by, major): the component that most classes are of."""
    return (rows.groupBy(by, "component").agg(F.count("*").alias("n"))
            .groupBy(by).agg(F.max_by("component", F.struct("n", "component")).alias("major")))


def _candidates(lists: DataFrame, members: DataFrame, measure: Measure, most: int, first_round: bool) -> DataFrame:
    """(a, b, more): for every class b up to ``most`` smaller classes a of another
    component that the sketches allow; ``more`` says that b had to leave some out.  Only
    ``open`` classes ask, and only lists that hold one that has ``left`` partners out, and
    several components, are compared; in the first round, long lists only within their
    blocks, so that those are compared again (their classes being open) in the second."""
    spans = members.groupBy("g").agg(F.count("*").alias("classes"), F.min("component").alias("low"), F.max("component").alias("high"),
                                     F.max("open").alias("any"), F.max("left").alias("left"))
    asked = "low < high and (left or (any and blocks > 1))"
    own = spans.withColumn("blocks", F.ceil(F.col("classes") / BLOCK).cast("int")).where(f"classes > 1 and {asked}").select("g", "blocks")
    no_major = F.lit(None).cast("long").alias("major")
    if first_round:
        lists, own = lists.select("*", no_major), own.select("*", no_major)
    else:
        mixed = (lists.join(spans, "g").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                                               F.max("any").alias("any"), F.max("left").alias("left"), F.max("blocks").alias("blocks"))
                 .where(asked).select("token"))
        lists = lists.join(mixed, "token", "left_semi")
        at = members.select("g", "component")
        lists = lists.join(_largest(lists.where("blocks > 1").select("token", "g").join(at, "g"), "token"), "token", "left")
        own = own.join(_largest(own.where("blocks > 1").select("g").join(at, "g"), "g"), "g", "left")
    by_group = lists.groupBy("g").agg(F.collect_list(F.struct("token", "blocks", "major")).alias("tokens"))  # at most a prefix
    own = own.select("g", F.array(F.struct(F.col("g").alias("token"), "blocks", "major")).alias("own"))
    empty = F.array().cast("array<struct<token:bigint,blocks:int,major:bigint>>")
    full = (members.join(by_group, "g", "left").join(own, "g", "left")
            .withColumn("all", F.array_sort(F.concat(F.coalesce("tokens", empty), F.coalesce("own", empty)))).where(F.size("all") > 0))
    # a list that is not compared as a whole leaves its pairs to the others
    whole = F.col("all")
    if first_round:
        whole = F.filter("all", lambda x: x["blocks"] == 1)
        full = full.withColumn("all", F.concat(whole, F.slice(F.filter("all", lambda x: x["blocks"] > 1), 1, FIRST_LONG)))
    rows = (full.select("cid", "component", "open", "n", "sketch", F.transform(F.slice(whole, 1, 4), lambda x: x["token"]).alias("lead"), F.explode("all").alias("x"))
            .select("cid", "component", "open", "n", "sketch", "lead", F.col("x.token").alias("token"), F.col("x.blocks").alias("blocks"), F.col("x.major").alias("major"))
            .withColumn("home", F.pmod(F.xxhash64("cid", "token"), F.col("blocks")).cast("int")))
    if first_round:
        rows = rows.withColumn("block", F.col("home")).withColumn("stays", F.lit(False))
    else:
        rows = (rows.withColumn("stays", (F.col("blocks") == 1) | F.coalesce(F.col("component") == F.col("major"), F.lit(False)))
                .withColumn("block", F.explode(F.when(F.col("stays"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))))
    met = (rows.groupBy("token", "block")
           .agg(F.collect_list(F.struct("cid", "component", "open", "n", "sketch", "lead", "home", "stays")).alias("rows")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b, more = compare(batch.slice(at, 4096))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "more"])

    def compare(batch):
        lists = column(batch, "rows")
        size = lists.value_lengths().to_numpy()
        token, block = (column(batch, c).to_numpy() for c in ("token", "block"))
        them = lists.flatten()
        # the classes of a list by their ids, so that all ask for the smallest first
        order = np.lexsort((them.field("cid").to_numpy(), np.repeat(np.arange(len(size)), size)))
        them = them.take(pa.array(order))
        n, cid, component, home = (them.field(c).to_numpy() for c in ("n", "cid", "component", "home"))
        asks, stays = (them.field(c).to_numpy(zero_copy_only=False) for c in ("open", "stays"))
        at_home = home == np.repeat(block, size)
        sketches, first = _Sketches(them.field("sketch").to_pylist()), np.cumsum(size) - size
        # of the lists where a pair meets, that of the least n-gram passes it on (as far as the leads tell)
        leads = them.field("lead")
        held = leads.value_lengths().to_numpy()
        lead = np.full((len(n), 4), np.iinfo(np.int64).max)
        rows = np.repeat(np.arange(len(n)), held)
        lead[rows, np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)] = leads.flatten().to_numpy()
        taken, left_out, out = np.zeros(len(n), np.int64), np.zeros(len(n), bool), [np.empty((0, 2), np.int64)]
        for which, a, b in _pairs(first, size, at_home):
            # two that go to all blocks meet in each; that of the larger one counts
            across = (at_home[b] | stays[a]) & (component[a] != component[b]) & asks[b]
            which, a, b = which[across], a[across], b[across]
            ok = _near(n, sketches, a, b, measure)
            which, a, b = which[ok], a[ok], b[ok]
            for x in range(4):
                for y in range(4):
                    later = (lead[a, x] == lead[b, y]) & (lead[a, x] < token[which])
                    if later.any():
                        which, a, b = which[~later], a[~later], b[~later]
            by_b = np.lexsort((a, b))
            a, b = a[by_b], b[by_b]
            place = np.arange(len(b)) - np.searchsorted(b, b) + taken[b]
            left_out[b[place >= most]] = True
            a, b = a[place < most], b[place < most]
            np.add.at(taken, b, 1)
            out.append(np.column_stack([a, b]))
        rows = np.concatenate(out)
        return cid[rows[:, 0]], cid[rows[:, 1]], left_out[rows[:, 1]]

    found = (met.mapInArrow(run, "a long, b long, more boolean").where("a <> b")
             .groupBy("a", "b").agg(F.max("more").alias("more")))
    # what a class asks for in all its lists, of which there is one for an n-gram of its prefix
    place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    return (found.withColumn("place", place).where(F.col("place") <= most + 1)
            .withColumn("more", F.max(F.col("more") | (F.col("place") > most)).over(Window.partitionBy("b")))
            .where(F.col("place") <= most).select("a", "b", "more"))


def _links(pairs: DataFrame, members: DataFrame, docs: DataFrame, text: str, k: int, lower: bool, measure: Measure) -> DataFrame:
    """The pairs whose sets are similar enough.  Only texts that may be one of those the
    members have been made from are cut into n-grams again."""
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(members.select("cid", "hash"), "cid"))
    wanted, texts = id_filter(asked.select(F.col("cid").alias("id"))), id_filter(asked.select(F.col("hash").alias("id")))

    def some(batches):
        for batch in batches:
            batch = batch.filter(pa.array(texts[column(batch, "__hash").to_numpy() % len(texts)]))
            if batch.num_rows:
                yield batch

    def find(batches):
        classes = _Seen()
        for _, sets, ids in _sets(some(batches), text, k, lower):
            once = {c: s for c, s in zip(ids, sets, strict=True) if c is not None and wanted[c % len(wanted)] and classes.new(c)}
            yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.int64()), pa.array([s.tobytes() for s in once.values()], pa.binary())], ["cid", "s"])

    sets = docs.select(text, "__hash").mapInArrow(find, "cid long, s binary").groupBy("cid").agg(F.first("s").alias("s"))
    both = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b"))

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(bool(measure.linked(common, len(x), len(y))))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)], ["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def _components(lists: DataFrame, members: DataFrame, docs: DataFrame, text: str, k: int, lower: bool, measure: Measure) -> DataFrame:
    """(id, component) of the classes that links connect."""
    links, known, most = None, None, PARTNERS
    # classes of long lists have not met all partners in the first round
    long = lists.where("blocks > 1").select("g").unionByName(members.groupBy("g").count().where(F.col("count") > BLOCK).select("g")).distinct()
    long = cut_lineage(members.join(long, "g", "left_semi").select("cid"))
    any_long = not long.isEmpty()
    while True:
        first_round = known is None
        if first_round:
            at = members.withColumn("component", F.col("cid")).withColumn("open", F.lit(True)).withColumn("left", F.lit(True))
        else:
            asking = pairs.where("more").select(F.col("b").alias("cid"), F.lit(True).alias("left"))
            asking = (asking.unionByName(long.withColumn("left", F.lit(False))) if any_long else asking)
            asking = asking.groupBy("cid").agg(F.max("left").alias("left")).withColumn("open", F.lit(True))
            any_long = False
            no = F.lit(False)
            at = (members.join(known.select(F.col("id").alias("cid"), "component"), "cid", "left").join(asking, "cid", "left")
                  .withColumn("component", F.coalesce("component", "cid"))
                  .withColumn("open", F.coalesce("open", no)).withColumn("left", F.coalesce("left", no)))
        pairs = cut_lineage(_candidates(lists, at, measure, most, first_round))
        more = pairs.agg(F.count("*").alias("n"), F.max("more").alias("more")).first()
        if more.n or links is None:
            new = cut_lineage(_links(pairs.select("a", "b"), members, docs, text, k, lower, measure))
            links = new if links is None else links.unionByName(new)
            known = components(links)
        if not more.more and not any_long:
            return known
        most *= MORE


def similarity_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100,
                          lower: bool = True) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the size of its set of ``k``-word
    n-grams (of the text with A-Z in lower case), and the smallest key that links lead
    to; two rows link if their sets' Jaccard similarity is at least num / den."""
    measure = Measure(num, den)
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))

    crowded = _crowded(docs, "__text", k, lower)
    named = cut_lineage(_named(docs, "__key", "__text", k, lower, measure, crowded))
    lists = cut_lineage(_lists(named.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "g", "n"), measure))
    members = cut_lineage(named.where("g is not null").groupBy("cid")
                          .agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("hash").alias("hash")))
    groups = _components(lists, members, docs, "__text", k, lower, measure).withColumnRenamed("id", "cid")
    classes = named.where("cid is not null").groupBy("cid").agg(F.min("__key").alias("least"))
    whole = classes.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = whole.join(least, "component").select("cid", "component_id")
    return (named.join(by_class, "cid", "left")
            .select(F.col("__key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("cid").isNull(), F.col("__key")).otherwise(F.col("component_id")).alias("component_id")))
