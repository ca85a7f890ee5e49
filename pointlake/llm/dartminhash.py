"""Near-duplicate texts by DartMinHash signatures, banded joins and an exact check.

A text is the weighted set of its five-word shingles; a shingle weighs as often as it
occurs (``weighting="set"``: 1). Darts are thrown by hash into each shingle's weight
region, one Poisson field over (shingle, weight, rank) that all texts share; a dart that
falls below the shingle's weight hits. Each dart belongs to one of K coordinates, and the
hit of the lowest rank in a coordinate is the signature there: two texts agree in a
coordinate with their weighted Jaccard similarity as probability, and a text costs its
weight plus about K log K darts, not their product.

Texts with equal weighted sets are one *representative* from the start, so that exact
copies never meet in a join. Signatures are cut into bands; texts that share a band are
candidates (at similarity 0.8 all bands miss with probability 3e-6). Pairs are not
expanded within a band: its members are tested against its leader, the text that shares
bands with most others, and what is verified is merged. Bands that still hold several
components are compared in blocks, band by band: a band's members are dealt into blocks
of bounded weight (a component that fills blocks has its own, which are not held against
each other), and two blocks at a time meet in a task. A pair is looked at in the first
band that it shares. A first pass compares signatures alone and names the texts that
have a possible partner; only their sets are sent to a second pass, which tests pairs of
*different* components and returns only links that join components. Nothing is capped:
large clouds of copies are settled by their leaders, and what is left is tested in full.

A candidate pair must pass three tests: weights allow the similarity, the signatures
(one byte a coordinate) agree within six standard deviations of it, and the weighted
sets themselves reach it. A shingle's n-th occurrence has a 64-bit hash of its own there,
so that the weighted similarity is that of plain sets. Sets are made again, in a second
pass over the texts, for candidates only; a bitmap of fixed size tells the scan which
rows to send. ``classes`` and ``links`` never shuffle a text; ``deduplicated`` does once at
most, to meet the rows that stay. All tables between rounds are kept in the shared folder.

Defined cases: fewer than five words are one shingle; texts without a word (null, empty,
blank) are copies of each other; null ids stay null and form classes like any other;
repeated rows are copies, and of rows with one id and text ``deduplicated`` keeps the
first by a hash of all their columns; an empty table gives an empty table; input columns
that clash with an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.common import chunks, cut, fresh, in_parts, map_column, quoted, read_table, spent

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Darts expected per text; all coordinates are then hit but for 2 texts in 100, which get more.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 4))
#: Standard deviations below what a threshold gives that signatures may agree less: about 1 pair in 100 million at the threshold.
SLACK = 6.0
#: Bits of the map of candidate rows at most, 16 MB; more candidates than bits only let more rows through.
MAP_BITS = 27
#: Shingles of a block, on average, and what a text counts for at least: two blocks are compared at a time.
BLOCK, LEAST_TEXT = 1 << 20, 1 << 11

U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)
#: Darts of a cell by the first 16 bits of its hash: Poisson, mean 1.
_POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 20)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included."""
    words = WORDS.findall(text)
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_HASHES.__getitem__, words), U, len(words))
    with np.errstate(over="ignore"):
        if len(h) < SHINGLE:
            return mix(np.array([sum(int(x) * int(c) for x, c in zip(h, _ODD)) + len(h) & 0xFFFFFFFFFFFFFFFF], U))
        n = len(h) - SHINGLE + 1
        out = h[:n] * _ODD[0]
        for i in range(1, SHINGLE):
            out += h[i : i + n] * _ODD[i]
    return mix(out)


def weighted(text: str, weighting: str = "count") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights: how often each occurs, or 1 each."""
    found, counts = np.unique(shingles(text), return_counts=True)
    return found, counts.astype(np.float64) if weighting == "count" else np.ones(len(found))


def occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hashes of (element, 1) to (element, weight), sorted: sets whose similarity is the weighted one."""
    if (weights == 1).all():
        return elements
    times = weights.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth == 0, np.repeat(elements, times), mix(np.repeat(elements, times) + nth.astype(U) * _ODD[4])))


def throw(elements: np.ndarray, weights: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ranks of the darts that hit below the weights, of ranks in [first, last).

    The field is cut into cells of one unit of weight and one of rank; a cell's
    hash gives its number of darts (Poisson, mean 1) and their places.
    """
    whole = bool((weights == 1).all())
    span = np.arange(first + 1, last + 1, dtype=U)
    with np.errstate(over="ignore"):
        if whole:
            base, unit, top = mix(elements), None, None
        else:
            units = np.ceil(weights).astype(np.int64)
            unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
            top = np.repeat(weights, units)
            base = mix(np.repeat(elements, units) + unit.astype(U) * _ODD[1])
        cells = mix((base[:, None] + span * _ODD[2]).ravel())
        many = _POISSON[(cells >> U(48)).astype(np.int64)]
        of = np.repeat(np.arange(len(cells)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        darts = mix(cells[of] + (nth + 1).astype(U) * _ODD[3])
        if top is not None and (top % 1 > 0).any():  # regions that end within a cell
            at = of // len(span)
            hit = unit[at] + uniform(mix(darts + _ODD[4])) < top[at]
            darts, of = darts[hit], of[hit]
        return darts, of % len(span) + first + uniform(mix(darts + _ODD[0]))


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES, darts: int = DARTS) -> np.ndarray:
    """The id of the lowest dart in each of ``k`` coordinates; none for an empty set."""
    out, lowest = np.zeros(k, U), np.full(k, np.inf)
    total = weights.sum()
    if total <= 0:
        return out
    first, last = 0, max(1, int(np.ceil(darts / total)))
    while True:
        ids, ranks = throw(elements, weights, first, last)
        at = (ids % U(k)).astype(np.int64)
        before = lowest.copy()
        np.minimum.at(lowest, at, ranks)
        won = (ranks == lowest[at]) & (ranks < before[at])
        out[at[won]] = ids[won]
        if np.isfinite(lowest).all():
            return out
        first, last = last, 2 * last


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sig.reshape(BANDS, ROWS)
        sums = (mix(parts) * _ODD[:ROWS]).sum(axis=1, dtype=U)
        return mix(sums + np.arange(1, BANDS + 1, dtype=U) * _ODD[2]).view(np.int64)


def set_key(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def with_signatures(df: DataFrame, text_col: str, weighting: str, out: str) -> DataFrame:
    """``df`` with a struct: key of the weighted set, its weight, hashes of the bands, bytes of the signature."""
    kind = pa.struct([("key", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in in_parts(batches):
            rows = []
            for texts in chunks(batch):
                for text in texts:
                    elements, weights = weighted(text, weighting)
                    sig = signature(elements, weights)
                    rows.append((set_key(occurrences(elements, weights)), int(weights.sum()), bands(sig) if len(elements) else [], (sig & U(255)).astype(np.uint8).view(np.int8)))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind)) if rows else pa.array([], kind)

    return map_column(df, text_col, run, "key binary, n int, bands array<long>, sketch array<tinyint>", out)


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A map of the hashes ``h`` as 64-bit words, and its bits: 32 or so a hash, but MAP_BITS at most."""
    bits = min(MAP_BITS, max(10, ids.count().bit_length() + 5))
    word = F.shiftrightunsigned(F.col("h"), 64 - bits)
    cells = ids.select(F.shiftright(word, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - bits}) & 63))").alias("b"))
    got = cells.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.view(U), bits


def _sets(docs: DataFrame, text_col: str, id_hash: str, wanted: DataFrame, weighting: str) -> DataFrame:
    """(key, set) of the rows whose ``id_hash`` is in the map of ``wanted``; one row a key."""
    words, bits = _bitmap(wanted)
    bitmap = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("key", pa.binary()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U) >> U(64 - bits)
            found = (words[(h >> U(6)).astype(np.int64)] >> (h & U(63))) & U(1)
            rows = []
            for texts in chunks(batch.column(1).filter(pa.array(found.astype(bool)))):
                for text in texts:
                    members = occurrences(*weighted(text, weighting))
                    rows.append((set_key(members), members.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col(id_hash).alias("h"), F.col(text_col).alias("t")).mapInArrow(run, "key binary, set array<long>")
    return rows.groupBy("key").agg(F.first("set").alias("set"))


def agree_least(threshold: float) -> int:
    """Coordinates in which signatures of texts at ``threshold`` agree but for chance."""
    mean = COORDINATES * threshold
    return int(mean - SLACK * (mean * (1 - threshold)) ** 0.5)


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach ``threshold``."""
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    both = F.size(F.array_intersect("ta", "tb"))
    similarity = both / (F.size("ta") + F.size("tb") - both)
    side = lambda df, k, v, name: df.select(F.col("key").alias(k), F.col(v).alias(name))
    near = pairs.join(side(sketches, "b", "sketch", "sb"), "b").join(side(sketches, "a", "sketch", "sa"), "a").where(same >= agree_least(threshold)).select("a", "b")
    exact = near.join(side(sets, "b", "set", "tb"), "b").join(side(sets, "a", "set", "ta"), "a")
    return exact.where(similarity >= threshold).select("a", "b")


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str], fn: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``fn`` of each run of rows with equal ``keys``, which come together; what it gives for many runs goes on in one batch."""
    held: list[pa.RecordBatch] = []
    out: list[pa.Table] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out, rows
        if rows:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
        out, rows = [], 0

    def put(parts: list[pa.RecordBatch]) -> None:
        nonlocal rows
        made = fn(pa.Table.from_batches(parts).combine_chunks())
        if made.num_rows:
            out.append(made)
            rows += made.num_rows

    def name(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False), bool)
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            if held and name(held[-1], 0) != name(batch, lo):
                put(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        if rows > 1 << 12:
            yield from flush()
    if held:
        put(held)
    yield from flush()


def candidates(table: pa.Table, threshold: float) -> np.ndarray:
    """(agreement, x, y) of the rows of two blocks (or one) of a band that may be linked.

    They are of different components, this band is the first that they share, their
    weights allow the similarity and their signatures agree by enough.
    """
    side, n, bucket = (table.column(c).to_numpy() for c in ("side", "n", "bucket"))
    comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    matrix = lambda name, width: table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width)
    band, sketch = matrix("bands", BANDS), matrix("sketch", COORDINATES)
    one = bool((side == 2).all())
    left, right = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    place = int(np.argmax(band[0] == bucket[0])) if len(n) else 0
    found = [np.empty((0, 3), np.int64)]
    for i in range(0, len(left), 64):
        rows = left[i : i + 64]
        may = (comp[rows][:, None] != comp[right][None, :]) & (np.minimum(n[rows][:, None], n[right][None, :]) >= threshold * np.maximum(n[rows][:, None], n[right][None, :]))
        if one:
            may &= rows[:, None] < right[None, :]
        x, y = np.nonzero(may)
        x, y = rows[x], right[y]
        for j in range(0, len(x), 1 << 16):
            p, q = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            first = ~(band[p, :place] == band[q, :place]).any(axis=1)
            p, q = p[first], q[first]
            same = (sketch[p] == sketch[q]).sum(axis=1)
            near = same >= agree_least(threshold)
            found.append(np.stack([same[near], p[near], q[near]], axis=1))
    return np.concatenate(found)


def screened(table: pa.Table, threshold: float) -> pa.Table:
    """The rows that have a possible partner."""
    return table.take(pa.array(np.unique(candidates(table, threshold)[:, 1:])))


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links (a, b) between different components among the texts of two blocks (or within one).

    Pairs are taken by how much their signatures agree, and tested exactly unless
    links found before have made them one component: as many links come out as
    components were joined, never all pairs.
    """
    comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sets = table.column("set").combine_chunks()
    ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(U)
    root = list(range(int(comp.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    pairs, taken = candidates(table, threshold), []
    for _, x, y in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], -pairs[:, 0]))].tolist():
        p, q = find(int(comp[x])), find(int(comp[y]))
        if p != q:
            u, v = values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]
            at = np.searchsorted(u, v)
            both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
            if both >= threshold * (len(u) + len(v) - both):
                root[p] = q
                taken.append((x, y))
    keys = table.column("key")
    a, b = zip(*taken) if taken else ((), ())
    return pa.Table.from_arrays([keys.take(pa.array(x, pa.int64())).cast(pa.binary()) for x in (a, b)], schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))


def block_links(rest: DataFrame, known: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among ``rest`` (bucket, key, n, comp), all bands that hold several components: each band in blocks."""
    rest = rest.withColumn("w", F.greatest("n", F.lit(LEAST_TEXT)).cast("long"))
    sizes = rest.groupBy("bucket", "comp").agg(F.sum("w").alias("w"))
    large = F.col("w") >= BLOCK
    own = cut(sizes.where(large).select("bucket", "comp", F.ceil(F.col("w") / BLOCK).cast("int").alias("parts")))
    small = sizes.where(~large).groupBy("bucket").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("parts"))
    # only bands with more than one block need to be told which blocks meet
    kinds = cut(own.select("bucket", F.col("comp").alias("own"), "parts").unionByName(small.select("bucket", F.lit(b"").alias("own"), "parts")))
    many = kinds.groupBy("bucket").agg(F.sum("parts").alias("parts")).where("parts > 1").select("bucket")
    blocks = kinds.join(many, "bucket", "left_semi").select("bucket", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct("own", i.alias("part")))).alias("block"))
    none = F.lit(b"")
    met = blocks.join(blocks.select("bucket", F.col("block").alias("with")), "bucket").where((F.col("block") <= F.col("with")) & ((F.col("block.own") == none) | (F.col("block.own") != F.col("with.own"))))
    met = met.withColumn("meeting", F.xxhash64("block", "with"))
    sent = met.select("bucket", "block", "meeting", F.when(F.col("block") == F.col("with"), 2).otherwise(0).alias("side"))
    sent = sent.unionByName(met.where(F.col("block") < F.col("with")).select("bucket", F.col("with").alias("block"), "meeting", F.lit(1).alias("side")))
    placed = rest.join(own.withColumnRenamed("parts", "mine"), ["bucket", "comp"], "left").join(small, "bucket", "left")
    block = F.struct(F.when(F.col("mine").isNotNull(), F.col("comp")).otherwise(none).alias("own"), F.pmod(F.xxhash64("key"), F.coalesce("mine", "parts")).cast("int").alias("part"))
    placed = placed.select("bucket", "key", "n", "comp", block.alias("block"))
    alone = placed.join(many, "bucket", "left_anti").select("bucket", F.lit(0).cast("long").alias("meeting"), F.lit(2).alias("side"), "key", "n", "comp")
    rows = alone.unionByName(placed.join(sent, ["bucket", "block"]).select("bucket", "meeting", "side", "key", "n", "comp"))

    def meet(df: DataFrame, fn: Callable[[pa.Table, float], pa.Table], ddl: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from grouped(batches, ("bucket", "meeting"), lambda t: fn(t, threshold))

        return df.repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting").mapInArrow(run, ddl)

    near = rows.join(known.select("key", "bands", "sketch"), "key").select("bucket", "meeting", "side", "key", "n", "comp", "bands", "sketch")
    near = meet(near, screened, "bucket long, meeting long, side int, key binary, n int, comp binary, bands array<long>, sketch array<tinyint>")
    return meet(cut(near).join(sets, "key"), compared, "a binary, b binary")


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (key, comp) after joining what ``edges`` (a, b) link; both are kept tables.

    Components hook onto their smallest neighbour, pointers jump four steps on,
    links are rewritten, and those within a component drop out. A pointer that
    has not reached its end still has its link there, which the next pass takes.
    """
    def between(e: DataFrame, c: DataFrame) -> DataFrame:
        e = e.join(c.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a", "left").join(c.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b", "left")
        e = e.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links, given = cut(between(edges, comps)), comps
    while not links.isEmpty():
        first = hook = cut(links.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("comp"), "to"))
        for _ in range(2):
            on = hook.select(F.col("comp").alias("to"), F.col("to").alias("end"))
            hook = hook.join(on, "to", "left").select("comp", F.coalesce("end", "to").alias("to"))
        hook = cut(hook)
        now = cut(comps.join(hook, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp")))
        left = cut(between(links, hook.select(F.col("comp").alias("key"), F.col("to").alias("comp"))))
        spent(links, first, hook, *([] if comps is given else [comps]))
        comps, links = now, left
    spent(links)
    return comps


def _linked(docs: DataFrame, text_col: str, id_col: str, threshold: float, weighting: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Rows with keys, representatives, their components, and the links (a, b) that were found between representatives."""
    h, s = fresh(docs, "h"), fresh(docs, "s")
    own = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.xxhash64(quoted(id_col)).alias(h), F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))).alias("text_hash"))
    signed = cut(with_signatures(own, "text", weighting, s).select("id", h, "text_hash", f"{s}.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", F.col(h).alias("h"))).alias("first")
    texts = cut(signed.groupBy("key").agg(first, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    members = texts.select(F.explode("bands").alias("bucket"), "key", "n")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(members.join(shared, "bucket"))
    comps = cut(members.select("key").distinct().select("key", F.col("key").alias("comp")))
    known = cut(texts.select("key", "sketch", "bands", F.col("first.h").alias("h")).join(comps.select("key"), "key"))
    sets = cut(_sets(own, "text", h, known, weighting))

    # every text of a band against its leader, the one that shares most with others: the middle of a cloud of copies
    degree = members.groupBy("key").agg(F.sum("m").alias("degree"))
    lead = members.join(degree, "key").groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), "key", "n")).alias("lead"))
    met = members.join(lead, "bucket").where(F.col("key") != F.col("lead.key"))
    fits = F.least("n", "lead.n") >= threshold * F.greatest("n", "lead.n")
    pairs = met.where(fits).select(F.col("lead.key").alias("a"), F.col("key").alias("b")).distinct()
    led = cut(verified(pairs, known, sets, threshold))
    comps = merged(comps, led)

    # bands that still hold several components are compared in blocks
    now = cut(members.join(comps, "key").select("bucket", "key", "n", "comp"))
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = cut(now.join(several, "bucket", "left_semi"))
    if rest.isEmpty():
        return signed, texts, comps, [led]
    blocks = cut(block_links(rest, known, sets, threshold))
    return signed, texts, merged(comps, blocks), [led, blocks]


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, weighting: str = "count") -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash``, ``rep_id``, ``class_id``, ``class_size`` (rows), ``is_first``.

    ``rep_id`` is the smallest id of the texts with the same weighted set, and
    ``class_id`` the class's smallest id (null if there is none). ``is_first``
    marks rows with the smallest (id, text_hash) of their class; there are several
    only if rows repeat. Similarity is that of the shingles weighted by
    ``weighting``, in signatures and in the exact test alike.
    """
    signed, texts, comps, _ = _linked(docs, text_col, id_col, threshold, weighting)
    of = texts.join(comps, "key", "left").select("key", "first", "rows", F.coalesce("comp", "key").alias("comp"))
    heads = of.groupBy("comp").agg(F.min("first").alias("head"), F.sum("rows").alias("class_size"))
    of = of.join(heads, "comp").select("key", F.col("first.id").alias("rep_id"), "head", "class_size")
    out = signed.select("id", "text_hash", "key").join(of, "key")
    is_first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return out.select(F.col("id").alias(id_col), "text_hash", "rep_id", F.col("head.id").alias("class_id"), F.col("class_size").cast("long").alias("class_size"), is_first.alias("is_first"))


def links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, weighting: str = "count") -> DataFrame:
    """(a, b): ids of representatives whose texts reach the threshold; together they join each class."""
    _, texts, _, found = _linked(docs, text_col, id_col, threshold, weighting)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    side = lambda k: texts.select(F.col("key").alias(k), F.col("first.id").alias(f"{k}_id"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    return out.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the first by id: the rows of ``docs`` unchanged.

    Rows meet the list of those that stay by one key. Only those of repeated rows
    are ranked; where the list is small enough to be broadcast, no other text moves.
    """
    found = classes(docs, text_col, id_col, threshold)
    k, rows, order = (fresh(docs, x) for x in ("k", "rows", "order"))
    name = lambda i, t: F.concat(F.when(i.isNull(), "n").otherwise("i"), F.coalesce(i.cast("string"), F.lit("")), F.lit(" "), t.cast("string"))
    keep = cut(found.where("is_first").groupBy(name(F.col(id_col), F.col("text_hash")).alias(k)).agg(F.count(F.lit(1)).alias(rows)))
    marked = docs.withColumn(k, name(quoted(id_col), F.xxhash64(F.coalesce(quoted(text_col), F.lit("")))))
    columns = [quoted(c) for c in docs.columns]
    out = marked.join(keep.where(F.col(rows) == 1), k).select(*columns)
    again = keep.where(F.col(rows) > 1)
    if again.isEmpty():
        return out
    ranked = marked.join(again, k).withColumn(order, F.to_json(F.struct(*columns)))
    first = ranked.withColumn(rows, F.row_number().over(Window.partitionBy(k).orderBy(order))).where(F.col(rows) == 1)
    return out.unionByName(first.select(*columns))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "class_size", "rep_id")
