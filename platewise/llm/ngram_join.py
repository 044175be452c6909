"""Exact n-gram Jaccard join as a blocked product of the document by n-gram incidence matrix.

Rows are distinct n-gram sets (documents of equal sets are one class), columns are n-grams. Only the columns that can
decide a pair are multiplied: with n-grams ordered from rare to frequent, two sets of Jaccard t or more share at least
k n-grams among their first a - ceil(t a) + k. k is a sixteenth of the size a of a set, well above what sets share by
chance, so pairs that meet in a few common n-grams never pass. The product sums the overlap of each pair over these columns, one block of columns in each task,
discards pairs that cannot reach the Jaccard by their sizes and places or whose overlap is below k, and verifies the
rest on the whole sets. Columns with the same rows are multiplied once, and a column of many rows in tiles of TILE x TILE
rows, so no task holds the square of a hot column.

What is asked for is each document's component, so links inside a known component need not be found again:
1. columns first link every row to the hub that it shares most of them with (a star, no more pairs than
   rows) and the verified links are closed to components; this goes on with other hubs, over columns of several
   components, for `rounds` rounds or until a round links nothing;
2. the product then runs over all columns for pairs of different components, each over the first n-grams that a link of
   its two sizes must share. A large group of near copies has become
   one component by then and costs no square of its size. No pair is dropped otherwise: every link between two
   components passes the exact bounds above.

The order of prefixes is any fixed one for right results. It puts a list of the most frequent n-grams (`frequent` at most,
found by counting all texts in blocks) last and sorts by hash otherwise. Within prefixes cells are ordered again, by the
number of their rows.

Defined results: words are split at ASCII white space with A-Z lowered; fewer words than n form one n-gram; null or
empty texts have the empty set and link with nothing; rows with a null id get a null component and link nothing;
repeated rows of one id belong to one document; an empty table gives an empty result. N-grams are told apart by 64-bit
hashes and equal sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import WordHashes, batch, discard, materialize, slices
from platewise.llm.components import components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ngrams_of(words: list[int], n: int) -> np.ndarray:
    """Hashes of all n-grams of word hashes, in order; shorter sequences are one n-gram."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.array(words, np.int64).view(np.uint64)
    size = min(n, len(w))
    h = mix(np.full(len(w) - size + 1, size, np.uint64) + _A)
    for j in range(size):
        h = mix(h * _A + w[j : len(w) - size + 1 + j])
    return h


class Sets:
    """text -> sorted distinct n-gram hashes."""

    def __init__(self, n: int):
        self.n, self.memo = n, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        memo = self.memo
        x = ngrams_of([memo[w] for w in (text or "").encode().lower().split()], self.n)
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def least_overlap(a, num: int, den: int):
    """ceil(t a): what a set of size a shares with any set of Jaccard t or more."""
    return -(-a * num // den)


def needed(a):
    """k: how many of the first n-grams two sets of size a must share."""
    return 1 + a // 16


def prefix(values: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of a set in the order: by hash, frequent ones last."""
    a = len(values)
    if not a:
        return values
    length = min(a, a - least_overlap(a, num, den) + needed(a))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        hot = frequent[at] == values
        return np.concatenate([values[~hot], values[hot]])[:length]
    return values[:length]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """Set size and signature of each document; rows without a signature carry an n-gram that is frequent in a block."""

    def run(batches):
        sets, held, size = Sets(n), [], 0

        def often():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            found, count = found[count >= 3], count[count >= 3]
            return batch(_PROFILE, (_signed(found), count, [None] * len(found)))

        for b in slices(batches):
            sizes, sigs = [], []
            for t in b.column(1):
                x = sets(t.as_py())
                sizes.append(len(x))
                sigs.append(xxhash.xxh3_128_digest(x.tobytes()))
                held.append(x)
                size += len(x)
            yield batch(_PROFILE, (b.column(0).to_pylist(), sizes, sigs))
            if size > 2_000_000:
                yield often()
                held, size = [], 0
        if size:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary")


def _prefixes(docs: DataFrame, n: int, shared, num: int, den: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        sets, frequent = Sets(n), shared.value
        for b in slices(batches):
            found = [sets(t.as_py()) for t in b.column(1)]
            yield batch(schema, (b.column(0).to_pylist(), [len(x) for x in found], [_signed(prefix(x, frequent, num, den)) for x in found]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, grams array<long>")


_SETS = pa.schema([("id", pa.int64()), ("grams", pa.binary()), *[(f"x{i}", pa.int64()) for i in range(4)]])


def parity(x: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: bit i tells whether an odd number of the n-grams fall to i.

    Two sets differ in at least as many n-grams as their bits do, which bounds their overlap.
    """
    return np.packbits((np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        sets = Sets(n)
        for b in slices(batches):
            found = [sets(t.as_py()) for t in b.column(1)]
            bits = np.array([parity(x) for x in found], np.int64).reshape(-1, 4)
            yield batch(_SETS, (b.column(0).to_pylist(), [x.tobytes() for x in found], *bits.T))

    return docs.select("doc_id", "text").mapInArrow(run, "id long, grams binary, x0 long, x1 long, x2 long, x3 long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose whole sets have Jaccard num / den or more."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                if den * common >= num * (len(z) - common):
                    us.append(u)
                    vs.append(v)
            yield batch(schema, (us, vs))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    return two.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "u long, v long")


def _possible(num: int, den: int) -> Column:
    """Whether a pair that meets in a cell can still have the Jaccard, by sizes n, places p and shared cells before q.

    Common n-grams before this one are shared cells of both, those after it lie behind both places in the prefixes. As
    prefixes begin the same order, those of the set whose prefix ends first are all in the other's prefix or behind it.
    """
    ma, mb = _m(F.col("na"), num, den), _m(F.col("nb"), num, den)
    most = F.least("qa", "qb") + F.least(ma - F.col("pa"), mb - F.col("pb")) + F.greatest(F.col("na") - ma, F.col("nb") - mb)
    return most * den >= (F.col("na") + F.col("nb") - most) * num


def _m(n: Column, num: int, den: int) -> Column:
    """Length of the prefix of a set of size n."""
    return F.least(n, n - F.floor((n * num + den - 1) / den) + _k(n))


def _early(num: int, den: int) -> Column:
    """Whether a cell lies among the first n-grams of both prefixes that a link of these two sizes must share _few of.

    The prefix that ends first misses n - o n-grams of a link of overlap o at most, so two prefixes share r = m - (n - o)
    for one of the sets, and in any order of a prefix few common ones lie among the first m - r + few. The order here is
    by the number of rows, so most of these are cells of one set alone.
    """
    both = F.col("na") + F.col("nb")
    overlap = F.floor((both * num + num + den - 1) / (num + den))
    few = _few(F.least("na", "nb"))
    ma, mb = _m(F.col("na"), num, den), _m(F.col("nb"), num, den)
    shared = F.least(ma - F.col("na"), mb - F.col("nb")) + overlap
    return (F.col("pa") < ma - shared + few) & (F.col("pb") < mb - shared + few)


def _few(n: Column) -> Column:
    """How many of their early n-grams a pair must share; below k, so that early cells are always prefix cells."""
    return (n / 128).cast("long") + 1


def _close(num: int, den: int) -> Column:
    """The same by the parity bits of both sets."""
    apart = sum((F.bit_count(F.col(f"x{i}a").bitwiseXOR(F.col(f"x{i}b"))) for i in range(4)), F.lit(0))
    twice = F.col("na") + F.col("nb") - apart
    return twice * den >= (2 * (F.col("na") + F.col("nb")) - twice) * num


def _k(n: Column) -> Column:
    return (n / 16).cast("long") + 1


TILE = 512


def _placed(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Cells with the component of their row."""
    return cells.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Cells of columns whose rows are in different components."""
    mixed = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gram")
    return placed.join(mixed, "gram", "left_semi")


def _merged(cells: DataFrame) -> DataFrame:
    """Columns with the same rows as one column: (x, y, rows, tiles, id, n, component, p, q, weight).

    Near copies share hundreds of n-grams, most of them with the same holders. Such columns are one with a weight. x, y:
    128 bits over the holders; p, q: of the first of the merged n-grams, which is the same n-gram for every row. What a
    pair must fulfil at each common n-gram it must fulfil at this one.
    """
    cells = cells.select("gram", "id", "n", "p", "q", "component")
    holders = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = cells.join(holders, "gram").groupBy("x", "y", "rows", "id").agg(F.min(F.struct("p", "q")).alias("first"), F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"), F.min("component").alias("component"))
    return one.select("x", "y", "rows", F.ceil(F.col("rows") / TILE).alias("tiles"), "id", "n", "component", "first.p", "first.q", "weight")


def ngram_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, frequent: int = 32_768, star_from: int = 2, rows_id: str = "doc_id", rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text); Jaccard num / den or more links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(rows_id).cast("long").alias("doc_id"), "text")
    seen = materialize(_profiles(docs, n))
    listed = seen.where("sig is null").groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc_id").limit(frequent)
    shared = spark.sparkContext.broadcast(np.sort(listed.toPandas()["doc_id"].to_numpy(np.int64).view(np.uint64)))
    profiles = seen.where("sig is not null")
    linkable = profiles.where("n > 0 and doc_id is not null")
    classes = materialize(linkable.groupBy("sig", "n").agg(F.min("doc_id").alias("rep")))

    # cells of the columns that more than one row has, in the order of these numbers; q: such cells before it, c: all of
    # them, p: place in the prefix when the cells of one row alone come first
    rows = _prefixes(docs, n, shared, num, den).join(classes.select(F.col("rep").alias("doc_id"), "n"), ["doc_id", "n"])
    cells = rows.select(F.col("doc_id").alias("id"), "n", F.explode("grams").alias("gram"))
    columns = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    own = Window.partitionBy("id")
    cells = cells.join(columns, "gram").withColumns({"q": F.row_number().over(own.orderBy("rows", "gram")) - 1, "c": F.count(F.lit(1)).over(own)})
    cells = cells.withColumn("p", _m(F.col("n"), num, den) - F.col("c") + F.col("q"))
    # a set that shares fewer columns with others than k has no partner
    cells = materialize(cells.where(F.col("c") >= _k(F.col("n"))))
    able = cells.where("q = 0").select("id")
    sets = materialize(_sets(docs.join(able.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), n))

    # 1. stars: of each column the first hub is the set with most shared cells (the least edited of its kind), later
    # ones are any; rounds go on while they link components
    links, known = None, None
    for turn in range(rounds):
        many = cells.where(F.col("rows") >= star_from).withColumn("component", F.col("id")) if known is None else _mixed(_placed(cells, known))
        least = F.struct("c", -F.col("id")) if known is None else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        hubs = many.groupBy("gram").agg(F.max_by(F.struct(*[F.col(x).alias(y) for x, y in (("id", "a"), ("n", "na"), ("p", "pa"), ("q", "qa"), ("component", "ca"))]), least).alias("h")).select("gram", "h.*")
        spokes = many.select("gram", *[F.col(x).alias(y) for x, y in (("id", "b"), ("n", "nb"), ("p", "pb"), ("q", "qb"), ("component", "cb"))])
        star = spokes.join(hubs, "gram").where((F.col("ca") != F.col("cb")) & _possible(num, den))
        star = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("na", "nb")).alias("n")).where(F.col("c") * 2 >= _k(F.col("n")))
        star = star.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
        found = materialize(_verified(star.select("a", "b"), sets, num, den))
        if known is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        known = materialize(components(links))

    # 2. the product over pairs of different components
    bits = [f"x{i}" for i in range(4)]
    placed = materialize(_merged(_mixed(_placed(cells, known))).join(sets.select("id", *bits), "id"))
    left, right = (
        placed.select("x", "y", "rows", "tiles", "weight", *[F.col(x).alias(y + s) for x, y in (("id", ""), ("n", "n"), ("p", "p"), ("q", "q"), ("component", "c"))], *[F.col(x).alias(x + s) for x in bits]) for s in "ab"
    )
    # a column of many rows is multiplied in tiles, each its own key
    own = lambda s: F.pmod(F.xxhash64(s), "tiles")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    left, right = left.select("*", own("a").alias("ta"), every.alias("tb")), right.drop("weight").select("*", every.alias("ta"), own("b").alias("tb"))
    product = left.join(right, ["x", "y", "rows", "ta", "tb"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _early(num, den) & _possible(num, den) & _close(num, den))
    pairs = product.groupBy("a", "b").agg(F.sum("weight").alias("overlap"), F.min(F.least("na", "nb")).alias("n"))
    pairs = pairs.where(F.col("overlap") >= _few(F.col("n")))
    more = materialize(_verified(pairs.select("a", "b"), sets, num, den))
    whole = components(more.unionByName(known.select(F.col("id").alias("u"), F.col("component").alias("v"))))

    named = classes.join(whole, classes["rep"] == whole["id"], "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    out = profiles.join(named, "sig", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_component(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, with all columns of docs; a null id counts as the largest.

    Rows, not ids, are joined, so rows of one id with different texts are compared like any others. docs should be a
    table as it was read: its rows are numbered by their place in the files, which is the same in every scan.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    found = ngram_components(rows, n, num, den, rows_id="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component"))
    ids = rows.select("__row", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("order"))
    stays = found.join(ids, "__row").groupBy("component").agg(F.min("order").alias("order")).select(F.col("order.row").alias("__row"))
    return rows.join(stays, "__row", "left_semi").select(docs.columns)
