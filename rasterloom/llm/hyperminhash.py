"""Near-duplicates by HyperMinHash.

A document's shingle hashes fall into buckets by their leading bits; a bucket's register keeps the leading
zeros of its smallest hash and a few mantissa bits. Bands of registers give candidate buckets of documents.
Candidates pass a collision-corrected Jaccard estimate and are then confirmed on their full shingle sets.

Registers of small sets are too few to tell. Their candidates are exact: of two linked sets, each has one of
the other's first shingles among its own first ones, in an order that all sets share (rarer ones first, by
counts over all documents). Their pairs are passed over only where more buckets
differ than linked sets can have shingles apart.

No bucket is expanded into all its pairs. Copies with one shingle set are one class from the start. First
every class is compared with the smallest leader of its buckets; what that links becomes components. Then
only buckets that hold several components are looked at again: the members outside the bucket's main component
and those inside it are cut into blocks, and each pair of blocks that can hold a link is a task of its own.
Registers are compared there, the rows of passing pairs meet again with their full sets, and links leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, staged
from .components import connected, relabel
from .text import hashed_words, mix, ngram_hashes, unused

#: 2 ** P buckets; bits of a register: 6 for leading zeros, R for the mantissa.
P, R = 7, 10
#: Bands and rows of a band: at a similarity of 0.8 all bands differ with a chance of 5e-5.
BANDS, ROWS = 25, 5
#: Sets of fewer shingles find their candidates by prefixes, not by bands.
SMALL = 256
#: log2 of the counters that order shingles, and of those in a slice; slices are added up apart.
COUNTERS, SLICE = 20, 14
#: Register of an empty bucket; no filled one has it.
EMPTY = np.uint16(0xFFFF)
#: Standard errors that an estimate may lie below the threshold and still be confirmed exactly.
SLACK = 4.0
#: log2 of the bits of the filter that picks the candidates' texts.
FILTER = 24
#: Members of an oversize bucket that make a block; a task compares two blocks.
BLOCK = 512


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word shingles; one for a shorter text."""
    for i in range(0, len(texts), 256):
        h, at = hashed_words(texts[i : i + 256])
        grams = ngram_hashes(h, size)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            # runs that reach into the next text are passed over
            yield np.unique(grams[lo : hi - size + 1] if hi - lo >= size else ngram_hashes(h[lo:hi], size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), size))


def registers(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set; an empty bucket borrows from the next one that is filled."""
    return borrowed(own_registers(s)[None])[0]


def borrowed(regs: np.ndarray) -> np.ndarray:
    """Rows of registers in which empty buckets hold the register of the next filled one, the last ones that
    of the first."""
    m = regs.shape[1]
    twice = np.concatenate((regs, regs), 1)
    at = np.where(twice != EMPTY, np.arange(2 * m), 2 * m - 1)
    at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :m]
    return np.take_along_axis(twice, at, 1)


def own_registers(s: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; EMPTY where a bucket has no hash."""
    bucket = (s >> np.uint64(64 - P)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = s[first] << np.uint64(P)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 63 - P)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - R)
    filled = (zeros.astype(np.uint64) << np.uint64(R) | mantissa).astype(np.uint16)
    out = np.full(1 << P, EMPTY)
    out[bucket[first]] = filled
    return out


def most_apart(n_a, n_b, threshold: int):
    """Shingles that two linked sets can have in one of them only: union less common, from
    100 * common >= threshold * union."""
    return (100 - threshold) * (n_a + n_b) // (100 + threshold)


def prefix(s: np.ndarray, threshold: int, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the common order, so many that no linked set lacks them all."""
    many = len(s) - -(-threshold * len(s) // 100) + 1
    return s[np.lexsort((s, counts[s & np.uint64(len(counts) - 1)]))[:many]].view(np.int64)


def candidate_keys(s: np.ndarray, regs: np.ndarray, threshold: int, counts: np.ndarray) -> np.ndarray:
    """Prefix keys of every set that a small one can be linked with, band keys of every set that isn't small."""
    keys = []
    if threshold * len(s) < 100 * SMALL:
        keys.append(prefix(s, threshold, counts))
    if len(s) >= SMALL:
        keys.append(band_keys(borrowed(regs[None])[0]))
    return np.concatenate(keys)


def _slices(counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["slice", "counts"])


def _frequencies(size: int):
    """Counts of shingles by their low bits, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                found = np.concatenate([np.empty(0, np.uint64), *shingle_sets(batch["text"], size)])
                np.add.at(counts, (found & np.uint64((1 << COUNTERS) - 1)).view(np.int64), 1)
        yield _slices(counts.reshape(-1, 1 << SLICE))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices of a partition, which holds all parts of one slice or of several."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, part in zip(batch["slice"].to_pylist(), batch["counts"]):
            part = np.frombuffer(part.as_buffer(), np.int64)
            total[at] = total[at] + part if at in total else part.copy()
    for at, counts in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many of all documents' sets hold a shingle of each counter. What a task passes on, and what comes
    here, is of fixed size."""
    parts = arrow_map(docs.select("text"), _frequencies(size), _COUNTS).repartition(1 << (COUNTERS - SLICE), "slice")
    counts = np.zeros((1 << (COUNTERS - SLICE), 1 << SLICE), np.int64)
    got = arrow_map(parts, _added, _COUNTS).toArrow()
    for at, c in zip(got["slice"].to_pylist(), got["counts"]):
        counts[at] = np.frombuffer(c.as_buffer(), np.int64)
    return counts.ravel()


_COUNTS = "slice int, counts binary"


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; a band takes registers far apart, so borrowed ones seldom meet."""
    rows = regs[: BANDS * ROWS].reshape(ROWS, BANDS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in rows:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r)
    return key.view(np.int64)


def collision_rate(n_a, n_b) -> np.ndarray:
    """Chance that registers of different minima agree: equal leading zeros, then equal mantissas."""
    k = np.arange(64 - P)
    share = lambda n: np.exp(-np.multiply.outer(np.maximum(n, 1) / (1 << P), 2.0 ** -(k + 1))) - np.exp(-np.multiply.outer(np.maximum(n, 1) / (1 << P), 2.0**-k))
    return (share(np.asarray(n_a, float)) * share(np.asarray(n_b, float))).sum(-1) * 2.0**-R


def estimate(agree, n_a, n_b) -> np.ndarray:
    """Jaccard estimate from the number of agreeing registers, without the expected chance agreements."""
    c = collision_rate(n_a, n_b)
    return np.clip((np.asarray(agree) / (1 << P) - c) / (1 - c), 0, 1)


def least_estimate(threshold: float) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (1 << P))


def _sketches(size: int, threshold: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, counts = TaskContext.get().partitionId(), {}, shared.value
        for batch in batches:
            n, dig, local, regs, bands = [], [], [], [], []
            for s in shingle_sets(batch["text"], size):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                known = seen.get(digest)
                if known is None:
                    known = seen[digest] = (part << 33) + len(seen)
                    r = own_registers(s) if len(s) else None
                    regs.append(r.tobytes() if len(s) else b"")
                    bands.append(candidate_keys(s, r, threshold, counts) if len(s) else [])
                else:
                    regs.append(None)
                    bands.append(None)
                n.append(len(s))
                dig.append(digest)
                local.append(known)
            text = pa.array([t if r is not None else None for t, r in zip(batch["text"], regs)], pa.string()) if None in regs else batch["text"].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(local, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), text],
                names=["doc_id", "n", "dig", "local", "regs", "bands", "text"],
            )

    return run, "doc_id long, n long, dig binary, local long, regs binary, bands array<long>, text string"


def _confirm(threshold: int):
    """Keeps pairs whose estimate passes and whose full sets have 100 * common >= threshold * union."""
    least = least_estimate(threshold / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            for i in range(batch.num_rows):
                lo, hi = sorted((int(n_a[i]), int(n_b[i])))
                if 100 * lo < threshold * hi:
                    continue
                a, b = (np.frombuffer(batch[r][i].as_buffer(), np.uint16) for r in ("r_a", "r_b"))
                if lo < SMALL:
                    if np.count_nonzero(a != b) > most_apart(lo, hi, threshold):
                        continue
                elif estimate(np.count_nonzero(np.equal(*borrowed(np.stack((a, b))))), lo, hi) < least:
                    continue
                both = len(np.intersect1d(np.frombuffer(batch["s_a"][i].as_buffer(), np.uint64), np.frombuffer(batch["s_b"][i].as_buffer(), np.uint64), assume_unique=True))
                if 100 * both >= threshold * (lo + hi - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (key, block) of sorted batches."""
    now, rows = None, []
    for batch in batches:
        key, block = batch["key"].to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        for at, to in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))):
            if to > at:
                if now != (key[at], block[at]):
                    if rows:
                        yield pa.Table.from_batches(rows)
                    now, rows = (key[at], block[at]), []
                rows.append(batch.slice(at, to - at))
    if rows:
        yield pa.Table.from_batches(rows)


def _passing(t: pa.Table, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows i that are odd with the rows of other components whose registers pass; ``part`` numbers the blocks
    of odd rows and is -1 for the others. A pair without a small set is looked at in one bucket only: in that
    of the first band that it shares."""
    least = least_estimate(threshold / 100)
    cid, label, n, part = (t[c].to_numpy() for c in ("cid", "label", "n", "part"))
    odd, lone = part >= 0, len(set(part.tolist())) == 1
    regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, 1 << P)
    key = t["key"][0].as_py()
    full = borrowed(regs)
    bands = full[:, : BANDS * ROWS].reshape(-1, ROWS, BANDS)
    for i in np.flatnonzero(odd):
        other = (label != label[i]) & (~odd | (cid < cid[i] if lone else part < part[i])) & (100 * np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]))
        at = np.flatnonzero(other)
        small = np.minimum(n[at], n[i]) < SMALL
        exact, at = at[small], at[~small]
        if len(exact):
            exact = exact[(regs[exact] != regs[i]).sum(1) <= most_apart(n[exact], n[i], threshold)]
        if len(at):
            at = at[estimate((full[at] == full[i]).sum(1), n[at], n[i]) >= least]
        if len(at):
            first = (bands[at] == bands[i]).all(1).argmax(1)
            at = at[band_keys(full[i])[first] == key]
        at = np.sort(np.concatenate((exact, at)))
        if len(at):
            yield int(i), at


def _involved(threshold: int):
    """First look at a block, by registers: rows that have a passing partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            hit = np.zeros(t.num_rows, bool)
            for i, at in _passing(t, threshold):
                hit[i] = True
                hit[at] = True
            if hit.any():
                yield from t.select(["key", "block", "cid", "label", "part"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _linked(threshold: int):
    """Second look, with full sets: links between components of a block, as many as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cid, label, n = (t[c].to_numpy() for c in ("cid", "label", "n"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"]]
            top: dict[int, int] = {}

            def root(x: int, top=top) -> int:
                while x in top:
                    x = top[x]
                return x

            found = []
            for i, at in _passing(t, threshold):
                for j in at:
                    one, other = root(int(label[i])), root(int(label[j]))
                    if one != other:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= threshold * (n[i] + n[j] - both):
                            top[one] = other
                            found.append((int(cid[i]), int(cid[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _filter_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A filter of 2 ** FILTER bits that holds the hashes of ``column``; its size doesn't depend on the data."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << FILTER))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def near_duplicates(docs: DataFrame, size: int = 4, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...).

    Shingles are ``size`` lower-cased (A-Z) words; a shorter text is one shingle. Documents are linked when
    100 * common >= threshold * union. Texts without words (null, empty, white space) are linked with
    nothing and stay. component_id is the smallest doc_id that links reach; null ids count as larger than
    all others and reach only each other if nothing else is there. Repeated rows of one doc_id share their
    component. Other columns are ignored and an empty table gives no rows.
    """
    spark = docs.sparkSession
    # orders shingles only: any order that all sets share gives the same links
    run, schema = _sketches(size, threshold, spark.sparkContext.broadcast(shingle_counts(docs, size)))
    seen = staged(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema), "sketches")
    firsts = seen.where("regs is not null and n > 0")
    classes = staged(seen.where("n > 0").groupBy("dig").agg(F.min("local").alias("cid"), F.min("doc_id").alias("id")), "classes")
    reps = firsts.select("local", "n", "regs", "bands").join(classes.select(F.col("cid").alias("local")), "local", "left_semi").withColumnRenamed("local", "cid")
    bands = reps.select("cid", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(shared, "key"), "members")

    wanted = members.select("cid").distinct()
    # texts of candidates are picked where they lie, by a filter of fixed size; its few false hits go after
    bits = spark.sparkContext.broadcast(_filter_bits(wanted, "cid"))
    texts = firsts.select(F.col("local").alias("cid"), "n", "regs", "text", F.pmod(F.xxhash64("local"), F.lit(1 << FILTER)).alias("at"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["at"].to_numpy()
            b = b.filter(pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            found = pa.array([s.tobytes() for s in shingle_sets(b["text"], size)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["cid"], b["n"], b["regs"], found], names=["cid", "n", "regs", "set"])

    sets = staged(arrow_map(texts, full_sets, "cid long, n long, regs binary, set binary").join(wanted, "cid", "left_semi"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"), F.col("set").alias(f"s_{x}"))
        return staged(arrow_map(pairs.join(side("a"), "a").join(side("b"), "b"), _confirm(threshold), "b long, a long").select("a", "b"), "links")

    links = confirmed(members.groupBy(F.col("cid").alias("a")).agg(F.min("leader").alias("b")).where("a <> b"))
    labels = connected(links)
    # other leaders of a class that is still elsewhere
    leads = members.select(F.col("cid").alias("a"), F.col("leader").alias("b")).where("a <> b").distinct()
    links = links.union(confirmed(_apart(leads, labels)))
    labels = connected(links)

    # buckets of several components, in blocks
    here = members.select("key", "cid", F.col("cid").alias("label"), "size")
    here = staged(relabel(here, labels, "label"), "labelled")
    held = here.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = held.groupBy("key").agg(F.max(F.struct("n", F.col("label").alias("main"))).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    here = here.join(mixed.select("key", "top.main", F.col("top.n").alias("many")), "key").withColumn("odd", F.col("label") != F.col("main"))
    # tasks (odd block, other odd block) and (odd block, block of the main component)
    odds, mains = (F.ceil(c / BLOCK).cast("long") for c in (F.col("size") - F.col("many"), F.col("many")))
    one = F.pmod(F.xxhash64("cid"), F.when(F.col("odd"), odds).otherwise(mains))
    here = here.withColumns({"odds": odds, "mains": mains, "one": one, "part": F.when(F.col("odd"), one).otherwise(F.lit(-1).cast("long"))})
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    with_odd = F.transform(upto("odds"), lambda x: F.least(x, F.col("one")) * F.col("odds") + F.greatest(x, F.col("one")))
    with_main = F.transform(upto("mains"), lambda x: F.col("odds") * F.col("odds") + F.col("one") * F.col("mains") + x)
    from_main = F.transform(upto("odds"), lambda x: F.col("odds") * F.col("odds") + x * F.col("mains") + F.col("one"))
    dealt = here.select("key", "cid", "label", "part", F.explode(F.when(F.col("odd"), F.concat(with_odd, with_main)).otherwise(from_main)).alias("block"))
    dealt = dealt.join(sets.select("cid", "n", "regs"), "cid")
    dealt = dealt.select("key", "block", "cid", "label", "n", "part", "regs").repartition("key", "block").sortWithinPartitions("key", "block")
    near = arrow_map(dealt, _involved(threshold), "key long, block long, cid long, label long, part long")
    near = near.join(sets, "cid").select("key", "block", "cid", "label", "n", "part", "regs", "set")
    near = near.repartition("key", "block").sortWithinPartitions("key", "block")
    links = links.union(staged(arrow_map(near, _linked(threshold), "a long, b long"), "residual"))
    labels = connected(links)

    named = relabel(classes.select("dig", "cid", "id"), labels, "cid")
    least = named.groupBy("cid").agg(F.min("id").alias("component"))
    by_class = named.select("dig", "cid").join(least, "cid").select("dig", "component")
    by_local = firsts.select("dig", "local").join(by_class, "dig").select("local", "component")
    out = seen.select("doc_id", "n", "local").join(by_local, "local", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends have different labels."""
    both = pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    return relabel(relabel(both, labels, "la"), labels, "lb").where("la <> lb").select("a", "b")


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``dropped`` (doc_id); rows without a doc_id stay.

    A filter of fixed size lets most rows pass where they lie; only those that it can't clear are joined."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_bits(dropped, "doc_id"))

    def may_be(at):
        import pandas as pd

        at = at.to_numpy()
        return pd.Series((bits.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    mark, own = unused(docs.columns, "held"), [F.col(f"`{c}`") for c in docs.columns]
    flagged = docs.withColumn(mark, F.pandas_udf(may_be, "boolean")(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER))))
    kept = flagged.where(F.col(mark)).join(dropped, "doc_id", "left_anti")
    return flagged.where(~F.col(mark)).select(own).union(kept.select(own))


def representatives(docs: DataFrame, size: int = 4, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: of each component the document of
    the smallest doc_id. Of rows that repeat a doc_id or have none, one of each distinct text stays; rows
    without doc_id aren't dropped for a link. Texts without words all stay, but for such repeats."""
    found = near_duplicates(docs, size, threshold).where("doc_id is not null")
    dropped = found.where("not kept").select("doc_id").distinct()
    again = staged(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).where("n > 1"), "repeated")
    single = without_ids(docs.where("doc_id is not null"), dropped.union(again.select("doc_id")).distinct())
    several = docs.where("doc_id is null")
    if again.limit(1).count():
        several = several.unionByName(docs.join(again.where("kept").select("doc_id"), "doc_id", "left_semi"))
    # equal texts meet by their hashes; the rows of each are cut down inside input partitions first
    mark = unused(docs.columns, "text_hash")
    several = several.withColumn(mark, F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", mark])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(own).union(several.select(own))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT x AS doc_id, x AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, w.doc_id) AS component_id, coalesce(least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
