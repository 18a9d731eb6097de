"""Similarity join of documents on word shingles by PartEnum signatures.

Sets at a Jaccard similarity of at least 4/5 differ in at most a quarter of the smaller set's elements. The domain of
shingle hashes is cut into first-level partitions, each into two halves, of which one may differ (n2 = 2, k2 = 1): the
enumerated subsets are the single halves, and there are more halves that hold an element of the smaller set than two
similar sets can differ in, so at least one half, with all it holds, is the same in both: the pair shares that signature.
Sets meet in schemes by bands of size; a set takes part in its own band and, if a smaller partner may lie in the band
below, in that one too.

The same count gives a filter without loss: similar sets share at least as many signatures as the halves exceed the
differences, so a document with fewer repeated signatures has no partner. What is left forms families, in which the exact
sets are compared. Of its repeated signatures a document needs only the rarest ones to meet all its partners: similar sets
share ``need`` of them, so the first one they share, in any order common to all, stands among the first
``repeated - need + 1`` of both. What many documents share, such as a common passage, then links nothing.

Signatures travel in packed arrays by hash range, as 32 bits inside a range (two that agree by chance only make one more
comparison), with 64 bits for the set that has them. A family beyond a bounded number of elements is compared block by block.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursuit.llm.components import components
from pursuit.llm.registry import query, table
from pursuit.llm.words import distinct_runs, mix, pieces, run_hashes, word_hashes, words
from pursuit.staging import staged, sweep

SHINGLE = 5
PER_HALF = 2.5          # elements of the largest set of a band in one half, on average
BANDS = [1]
while BANDS[-1] < 2 ** 40:
    BANDS.append(max(BANDS[-1] + 1, int(BANDS[-1] * 1.5)))
BANDS = np.array(BANDS)
BUCKET_BYTES = 8 << 20  # bytes of text for each bucket of signatures
FAMILY_ELEMENTS = 500_000

META = "kind int, doc_id long, n long, fa long, fb long, scheme int, sig long, need1 long, need2 long"


def halves(scheme):
    """Number of halves in a scheme: at least 64, so that sets of a few elements fall apart as well."""
    return np.maximum(64, np.ceil(BANDS[scheme + 1] / PER_HALF)).astype(np.uint64)


def sets_of(data, offsets):
    """Shingle sets of a piece: ``(hashes, doc, sizes, fa, fb)``, hashes ascending in a document; fa and fb are two
    64-bit sums that identify a set."""
    start, end, doc = words(data, offsets)
    el, owner = distinct_runs(*run_hashes(word_hashes(data, start, end), doc, SHINGLE))
    n = np.bincount(owner, minlength=len(offsets) - 1)
    fa, fb = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = np.cumsum(n[some]) - n[some]
        fa[some] = np.add.reduceat(mix(el + np.uint64(1)), at)
        fb[some] = np.add.reduceat(mix(el + np.uint64(2)), at)
    return el, owner, n, fa, fb


def signatures(el, owner, n, scheme, seed: int = 0):
    """Signatures of sets in one scheme each: ``(signature, doc, halves with an element by doc)``. Hashes ascend in a
    document and a half is a range of hashes, so the elements of a half stand together."""
    count = halves(scheme)
    code = el
    if seed:
        code = mix(el + np.uint64(seed))
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
    part = ((code >> np.uint64(32)) * count[owner]) >> np.uint64(32)
    new = np.ones(len(el), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    total = np.add.reduceat(mix(code + np.uint64(3)), at)
    who = owner[at]
    sig = mix(mix(total + np.uint64(seed)) ^ mix(part[at] + (scheme[who].astype(np.uint64) << np.uint64(40))))
    return sig, who, np.bincount(who, minlength=len(n))


def schemes_of(n):
    """Own band, and the band below where a smaller partner may lie in it, else -1. Sets without elements have none."""
    own = np.searchsorted(BANDS, n, "right") - 1
    low = np.where((own > 0) & (4 * n <= 5 * (BANDS[np.maximum(own, 0)] - 1)), own - 1, -1)
    return own, low


def _emit(buckets: int, seed: int = 0, least: int = 0, most_n: int = 2 ** 62):
    def emit(batches):
        for rows, data, offsets in pieces(batches):
            ids = np.array(rows.column("doc_id").to_pylist(), object)
            el, owner, n, fa, fb = sets_of(data, offsets)
            own, low = schemes_of(n)
            ranged = (n >= least) & (n <= most_n)
            need = np.zeros((2, len(n)), np.int64)
            once = np.zeros(len(n), bool)
            once[np.unique(np.stack([fa, fb]), axis=1, return_index=True)[1]] = True
            parts = []
            for role, scheme in enumerate((own, low)):
                take = (scheme >= 0) & (n > 0) & ranged
                pick = take[owner]
                sig, who, full = signatures(el[pick], owner[pick], n, scheme, seed)
                # differences of a pair: at most a quarter of the smaller set, two ninths of the larger
                most = n // 4 if role == 0 else 2 * n // 9
                need[role] = np.where(take, full - most, 0)
                keep = once[who]
                parts.append((sig[keep], who[keep], np.full(keep.sum(), role)))
            sig, who, role = (np.concatenate(x) for x in zip(*parts))
            bucket = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((role, who, bucket))
            sig, who, role, bucket = sig[order], who[order], role[order], bucket[order]
            meta = np.rec.fromarrays([np.array([x is None for x in ids]), np.array([x or 0 for x in ids], np.int64),
                                      n, fa, fb, need[0], need[1], own, low])[ranged]
            out = [(-1 - int(mix(fa[:1])[0] % np.uint64(buckets)), pickled(meta), b"", b"", b"")]
            for b in np.unique(bucket):
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                run = 2 * who[lo:hi] + role[lo:hi]
                first = np.flatnonzero(np.diff(run, prepend=-1))
                times = np.diff(np.append(first, hi - lo)) * 2 + run[first] % 2
                out.append((int(b), b"", fa[run[first] // 2].tobytes(), times.astype(np.uint32).tobytes(), sig[lo:hi].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))],
                names=["bucket", "meta", "labels", "times", "sigs"])
    return emit


META_TYPE = np.dtype([("none", "?"), ("id", "i8"), ("n", "i8"), ("fa", "u8"), ("fb", "u8"), ("need1", "i8"), ("need2", "i8"),
                      ("own", "i8"), ("low", "i8")])


def pickled(meta) -> bytes:
    return np.array(meta.tolist(), META_TYPE).tobytes()


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: documents as they are, and the signatures that two different sets have."""
    signed = lambda x: x.astype(np.uint64).view(np.int64)
    if key[0] < 0:
        m = np.concatenate([np.frombuffer(x, META_TYPE) for x in rows["meta"]])
        ids = pd.array(m["id"], "Int64")
        ids[m["none"]] = pd.NA
        return pd.DataFrame({"kind": 0, "doc_id": ids, "n": m["n"], "fa": signed(m["fa"]), "fb": signed(m["fb"]),
                             "scheme": 0, "sig": 0, "need1": m["need1"], "need2": m["need2"]})
    sigs = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["sigs"]])
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["times"]])
    labels = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["labels"]])
    head = np.repeat(np.arange(len(times), dtype=np.int32), times // 2)
    order = np.lexsort((labels[head], sigs))
    sigs, head = sigs[order], head[order]
    labels = labels[head]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (labels[1:] != labels[:-1])
    sigs, labels, role = sigs[new], labels[new], (times[head[new]] % 2).astype(np.int32)
    same = np.zeros(len(sigs), bool)
    same[1:] = sigs[1:] == sigs[:-1]
    same[:-1] |= same[1:]
    return pd.DataFrame({"kind": 1, "doc_id": pd.array([pd.NA] * int(same.sum()), "Int64"), "n": 0, "fa": signed(labels[same]), "fb": 0,
                         "scheme": role[same], "sig": sigs[same].astype(np.int64) + (np.int64(key[0]) << 32), "need1": 0, "need2": 0})


def linked(codes, at, n) -> list[tuple[int, int]]:
    """Links that connect the similar sets of a block: positions of sets, which come by rising size. ``codes`` are dense
    element numbers, a set i has ``codes[at[i]:at[i + 1]]``. Sets already connected are not compared again, nor are sets
    of which one is more than a quarter larger."""
    group = np.arange(len(n))
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    out = []
    ends = np.searchsorted(n, 5 * n // 4, "right")
    for i in range(len(n) - 1):
        end = ends[i]
        if (group[i + 1:end] == group[i]).all():
            continue
        seen[codes[at[i]:at[i + 1]]] = True
        common = np.add.reduceat(seen[codes[at[i + 1]:at[end]]], at[i + 1:end] - at[i + 1], dtype=np.int64)
        seen[codes[at[i]:at[i + 1]]] = False
        union = n[i] + n[i + 1:end] - common
        for j in np.flatnonzero((100 * common >= 80 * union) & (group[i + 1:end] != group[i])) + i + 1:
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n", "rep"])
    sets = [np.frombuffer(s, np.uint64) for s in rows["el"]]
    n = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    rep = rows["rep"].to_numpy()
    pairs = linked(codes, np.append(0, np.cumsum(n)), n)
    return pd.DataFrame([(rep[i], rep[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")


def _sets(batches):
    for rows, data, offsets in pieces(batches):
        el, _, n, _, _ = sets_of(data, offsets)
        ends = np.append(0, np.cumsum(n))
        yield pa.RecordBatch.from_arrays(
            [rows.column("rep"), rows.column("family"), pa.array(n, pa.int64()),
             pa.array([el[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["rep", "family", "n", "el"])


def _meetings(texts: DataFrame, buckets: int, seed: int = 0, least: int = 0, most: int = 2 ** 62) -> DataFrame:
    emitted = texts.mapInArrow(_emit(buckets, seed, least, most), "bucket int, meta binary, labels binary, times binary, sigs binary")
    return emitted.groupBy("bucket").applyInPandas(_meet, META)


def _alive(met: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, rep`` of the classes that share as many signatures as a similar pair must, by their rarest signatures."""
    need = met.where("kind = 0").groupBy("fa").agg(F.min("need1").alias("need1"), F.min("need2").alias("need2"))
    shared = met.where("kind = 1").select("fa", F.col("scheme").alias("role"), "sig")
    enough = shared.groupBy("fa", "role").agg(F.count("*").alias("shared")).join(need, "fa").select(
        "fa", "role", "shared", F.when(F.col("role") == 0, F.col("need1")).otherwise(F.col("need2")).alias("need")).where("shared >= need")
    rows = shared.join(enough.select("fa", "role", "need"), ["fa", "role"])
    several = rows.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("fa", "role")
    ranked = rows.join(several, "sig").withColumn("at", F.row_number().over(own.orderBy("often", "sig"))).withColumn("left", F.count("*").over(own))
    return ranked.where("left >= need and at <= left - need + 1").join(classes.select("fa", "rep"), "fa").select("sig", "rep")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Documents link when 100 * intersection >= 80 * union of their sets of distinct 5-word shingles; a text of fewer words
    is one shingle, an empty or null one has none and links with nothing. The component is named by its smallest id. Equal
    sets are one class before anything is compared. A row without an id has a null component and links nothing. Rows of
    one id are one document for links, each with its own count. An empty table gives an empty one. Runs its stages when
    called."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    met = staged(_meetings(texts, buckets), "signatures")
    meta = met.where("kind = 0").select("doc_id", "n", "fa", "fb", "need1")
    classes = staged(meta.where("doc_id is not null and n > 0").groupBy("n", "fa", "fb").agg(
        F.min("doc_id").alias("rep"), F.min("need1").alias("need1")), "classes")
    ids = staged(meta.join(classes.select("n", "fa", "fb", "rep"), ["n", "fa", "fb"], "left").select("doc_id", "n", "rep"), "ids")
    several = ids.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")

    alive, seed = staged(_alive(met, classes), "alive"), 0
    sweep(docs.sparkSession)
    weak = classes.where("need1 <= 0").select("n", "fa", "fb")
    while not weak.isEmpty():   # sets whose elements fall into too few halves meet again under other hashes
        seed += 1
        least, most = weak.agg(F.min("n"), F.max("n")).first()
        again = staged(_meetings(texts, buckets, seed, 4 * least // 5, 5 * most // 4 + 1), "signatures")
        alive = alive.union(staged(_alive(again, classes), "alive"))
        weak = staged(weak.join(again.where("kind = 0 and need1 <= 0").select("n", "fa", "fb").distinct(), ["n", "fa", "fb"], "left_semi"), "weak")
    star = alive.groupBy("sig").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1")
    candidate = alive.join(star, "sig").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    families = staged(components(candidate).withColumnsRenamed({"node": "rep", "component": "family"}), "families")

    chosen = texts.join(families.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    sets = staged(chosen.select("rep", "family", "text").mapInArrow(_sets, "rep long, family long, n long, el binary"), "sets")
    size = sets.groupBy("family").agg(F.sum("n").alias("elements"))
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("elements") / FAMILY_ELEMENTS)).cast("int")
    placed = sets.join(size.withColumn("blocks", F.when(F.col("elements") <= FAMILY_ELEMENTS, 1).otherwise(blocks)), "family")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # elements, not bytes, are what a comparison takes: dealt over a fixed number of tasks for so many elements
    elements = sets.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, 8 * elements // FAMILY_ELEMENTS))
    placed = placed.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "n", "el")
    links = placed.repartition(tasks, "family", "lo", "hi").groupBy("family", "lo", "hi").applyInPandas(_compare, "a long, b long")

    edges = links.select("a", "b").union(several.select("a", "b"))
    found = components(edges).withColumnsRenamed({"node": "rep"})
    result = ids.join(found, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return result


@query()
def op7_ngram_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of linked documents the one with the smallest id; rows of one id all stay."""
    others = join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
