"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct shingles of ``SHINGLE`` words (the whole
sequence when it has fewer), as 64-bit hashes. SuperMinHash (Ertl, 2017) gives
each shingle a pseudorandom permutation of the ``M`` components: the shingle
meets one component a round, with a value between the round's number and the
next. A component keeps its least value. Rounds end as soon as all components
of a document are filled, as later rounds can only bring larger values.

``BANDS`` bands of ``M / BANDS`` components make bucket keys. With 32 bands of 4
a pair of similarity 0.85 shares no bucket with probability 6e-11.

Equal sets fold into one node first. In each bucket every member is compared
with one centre, then, where a bucket still holds several components, with
another. What can be left are links between components of one bucket, as in
families of texts that resemble each other, but mostly less than the threshold.
Pairing all their members would be quadratic, so exact prefix filtering
(Bayardo et al., 2007) finds every possible pair among the documents of such buckets: ordered from the rarest shingle, two sets
similar enough share one of their first few. Pairs pass a signature estimate
(far below the threshold, so that nothing is lost to noise) and are confirmed
on full sets computed from whole texts. Confirmed links go to
``connected_components``; links are never collected.

Rows without a doc_id link with nothing: their component_id is null and they are
kept. Rows that share a doc_id count as one document, linked through it. Null and
empty texts have empty sets and link with nothing. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import lean, materialize, own_columns, packed, row_hash

SHINGLE = 5
M, BANDS = 128, 32
#: A pair whose signatures agree in a share of components this much below the threshold is not verified: more than 4 standard errors.
MARGIN = 0.14
CHUNK = 1 << 19

_U = np.uint64
_GOLD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASK = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
SIGNED = "doc_id long, n long, fp1 long, fp2 long, bands array<long>, sig binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 4096, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        if size > CHUNK + 4096:
            return tuple(found)
        _POWERS[size] = tuple(found)
    return _POWERS[size]


def _word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array: a polynomial over its bytes, by differences of one running sum."""
    space = _SPACE[flat]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=total[1:])
    return start, mixed((total[end] - total[start]) * down[start])


def _words(text: bytes) -> np.ndarray:
    """Word hashes of one text of any length, cut at white space into pieces of bounded size."""
    found, a = [], 0
    while a < len(text):
        b = min(len(text), a + CHUNK)
        while b < len(text) and not _SPACE[text[b]]:
            b += 1
        found.append(_word_hashes(np.frombuffer(text[a:b], dtype=np.uint8))[1])
        a = b
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _short(words: np.ndarray, size: int) -> np.ndarray:
    h = len(words)
    for w in words.tolist():
        h = ((h ^ w) * int(_GOLD) + int(_MIX1)) & _MASK
    return mixed(np.array([h ^ size], dtype=np.uint64))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within each text, and the offsets of the texts."""
    groups, now, n = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK or n + len(t) > CHUNK:
            groups.append(now)
            now, n = [], 0
        now.append(i)
        n += len(t) + 1
    groups.append(now)
    flats, counts = [], np.zeros(len(texts), dtype=np.int64)
    for group in filter(None, groups):
        if len(group) == 1:
            words = _words(texts[group[0]].lower())
            sizes = np.array([len(words)])
        else:
            lengths = np.array([len(texts[i]) + 1 for i in group])
            start, words = _word_hashes(np.frombuffer(b" ".join(texts[i] for i in group).lower(), dtype=np.uint8))
            sizes = np.bincount(np.searchsorted(np.cumsum(lengths), start, side="right"), minlength=len(group))
        ends = np.cumsum(sizes)
        made = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        scale = _U(1)
        for k in range(size):
            made += words[k : len(words) - size + 1 + k] * scale if len(made) else made
            scale = _U(int(scale) * int(_GOLD) & _MASK)
        made = mixed(made)
        for i, s, e in zip(group, sizes.tolist(), ends.tolist()):
            own = made[e - s : e - size + 1].copy() if s >= size else _short(words[e - s : e], size) if s else made[:0]
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            counts[i] = len(own)
            flats.append(own)
    return np.concatenate(flats) if flats else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(counts)])


def super_minhash(hashes: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures (texts x m) of sets laid end to end; a component's value is its round in the upper and a fraction in the lower 32 bits."""
    docs = len(offsets) - 1
    least = np.full(docs * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    order = None
    for j in range(m):
        rand = mixed(hashes + _U((j + 1) * int(_GOLD) & _MASK))
        at = (j + ((rand >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)).astype(np.int64)
        if order is None:
            component = at
        else:
            rows = np.arange(len(hashes))
            component = order[rows, at].astype(np.int64)
            order[rows, at] = order[rows, j]
        np.minimum.at(least, doc * m + component, _U(j) << _U(32) | rand & _U(0xFFFFFFFF))
        full = least.reshape(docs, m).max(axis=1) != np.iinfo(np.uint64).max
        live = ~full[doc]
        if not live.any():
            break
        if order is None:
            hashes, doc, at = hashes[live], doc[live], at[live]
            order = np.tile(np.arange(m, dtype=np.uint8), (len(hashes), 1))
            order[np.arange(len(hashes)), at] = 0  # the swap of round 0; position 0 is not read again
        elif not live.all():
            hashes, doc, order = hashes[live], doc[live], order[live]
    return least.reshape(docs, m)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, two fingerprints of the set, band keys and a 16-bit digest of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch["doc_id"], batch["text"]
            a = 0
            while a < len(ids):
                texts, size = [], 0
                while a + len(texts) < len(ids) and (not texts or size < CHUNK):
                    texts.append((column[a + len(texts)].as_py() or "").encode())
                    size += len(texts[-1])
                flat, offsets = shingle_sets(texts)
                n = np.diff(offsets)
                yield _signed(ids.slice(a, len(texts)), n, flat, offsets)
                a += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), SIGNED)


def _signed(ids: pa.Array, n: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(n)
    prints = np.zeros((2, len(n)), dtype=np.uint64)
    for k in range(2):
        if len(some):
            prints[k, some] = np.add.reduceat(mixed(flat ^ _U((k + 1) * int(_MIX2) & _MASK)), offsets[:-1][some])
    sig = super_minhash(flat, offsets) if len(some) else np.zeros((len(n), M), dtype=np.uint64)
    rows = M // BANDS
    keys = np.zeros((len(n), BANDS), dtype=np.uint64)
    for r in range(rows):
        keys = mixed((keys ^ sig[:, r::rows][:, :BANDS]) * _GOLD + np.arange(1, BANDS + 1, dtype=np.uint64))
    digest = (mixed(sig) & _U(0xFFFF)).astype("<u2")
    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), listed, pa.array([d.tobytes() for d in digest], pa.binary())], names=["doc_id", "n", "fp1", "fp2", "bands", "sig"])


# --- links ---------------------------------------------------------------------------------------


def _signature_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, M)


def _similar_signatures(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = pa.array((_signature_matrix(batch["sig_a"]) == _signature_matrix(batch["sig_b"])).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch["a"].filter(good), batch["b"].filter(good)], names=["a", "b"])

    return run


def _least(percent: int) -> float:
    return (percent / 100 - MARGIN) * M


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            good = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                a, b = batch["text_a"][i].as_py() or "", batch["text_b"][i].as_py() or ""
                if a != last:
                    last, mine = a, shingle_sets([a.encode()])[0]
                theirs = shingle_sets([b.encode()])[0]
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                good[i] = shared > 0 and 100 * shared >= percent * (len(mine) + len(theirs) - shared)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar enough."""
    for side in "ab":
        own = nodes.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        pairs = pairs.join(own, side)
    near = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_similar_signatures(_least(percent))), "a long, b long")
    near = materialize(near.distinct(), "similar-pairs")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    texts = materialize(texts, "similar-texts")
    for side in "ba":
        near = near.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return materialize(near.select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirm(percent)), "a long, b long").distinct(), "links")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            own = shingle_sets([(batch["text"][i].as_py() or "").encode()])[0]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), pa.array([len(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "n", "hashes"])


def prefix_pairs(docs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components among ``wanted`` (doc_id, component) that can reach the threshold; none that reaches it is missing.

    Of sets with n shingles in one common order, two that are similar enough share one of their first n - ceil(n * threshold) + 1.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(lean(_shingles), "doc_id long, n long, hashes array<long>"), "shingles")
    each = sets.select("doc_id", "n", F.explode("hashes").alias("hash"))
    shared = each.groupBy("hash").agg(F.count("*").alias("f")).where("f > 1")
    # shingles of one document only come first and lead to no pair
    ranked = each.join(shared.hint("merge"), "hash").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "hash"))).alias("s"))
    length = F.expr(f"n - ((n * {percent} + 99) div 100) + 1 - (n - size(s))").cast("int")
    # a pair's first common shingle leaves no more overlap than either set has from there on (positional filter)
    first = ranked.withColumn("p", length).where("p > 0").select("doc_id", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.col("p"))).alias("i", "s"))
    prefix = first.select("doc_id", "n", F.col("s.hash").alias("hash"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest"))
    # sizes of a pair differ by less than one step of this ladder, so a frequent shingle's documents only meet those of their own or the next rung
    prefix = prefix.withColumn("rung", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    prefix = materialize(prefix.join(wanted, "doc_id"), "prefixes")
    # a component alone on its rungs of a shingle has no partner there
    several = prefix.select("hash", F.explode(F.array("rung", F.col("rung") + 1)).alias("rung"), "component").groupBy("hash", "rung").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hash", "rung")
    one = prefix.join(several.hint("merge"), ["hash", "rung"], "left_semi")
    other = prefix.select("hash", F.explode(F.array("rung", F.col("rung") + 1)).alias("rung"), F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("component").alias("k2"))
    pairs = one.join(other.hint("merge"), ["hash", "rung"]).where(f"component <> k2 and {100 + percent} * least(rest, rest2) >= {percent} * (n + n2)")
    return pairs.select(F.least("doc_id", "d2").alias("a"), F.greatest("doc_id", "d2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    signed = materialize(signatures(docs), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    sets = materialize(named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "sets")
    r = sets.select("fp1", "fp2", F.col("rep").alias("doc_id"))
    nodes = materialize(named.join(r, ["fp1", "fp2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"]).select("doc_id", "n", "sig", "bands"), "nodes")

    # members of buckets with more than one node
    members = nodes.select("doc_id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("centre")).where("c > 1").drop("c")
    members = materialize(members.join(shared.hint("merge"), "key"), "bucket-members")
    # an id that rows of different texts share links their sets
    alike = named.select("doc_id", "fp1", "fp2").join(sets, ["fp1", "fp2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = materialize(alike, "shared-ids")
    centred = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = links.union(confirmed(centred, nodes, docs, percent))

    def open_members() -> tuple[DataFrame, DataFrame]:
        """The components so far, and the members of buckets that hold several."""
        groups = materialize(connected_components(links), "components")
        placed = members.drop("centre").join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        placed = materialize(placed, "placed-members")
        spread = F.xxhash64(F.lit(1), "doc_id")
        keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("doc_id", "component", "n"), spread).alias("c")).where("lo < hi").select("key", "c")
        return groups, materialize(placed.join(keys.hint("merge"), "key"), "open-members")

    groups, left = open_members()
    if not left.isEmpty():
        again = left.where(f"component <> c.component and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
        again = again.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
        links = links.union(confirmed(again, nodes, docs, percent))
        groups, left = open_members()
    if not left.isEmpty():
        wanted = materialize(left.select("doc_id", "component").distinct(), "open-documents")
        links = links.union(confirmed(prefix_pairs(docs, wanted, percent), nodes, docs, percent))
        groups = materialize(connected_components(links), "components")
    found = sets.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp1")).alias("fp1"), "fp2")
    rows = rows.join(found, ["fp1", "fp2"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group, with its own columns; rows that only repeat a kept id go."""
    found = near_duplicates(docs, percent).where("kept")
    kept = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    rows = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(own_columns(docs))
    if not kept.where("n > 1").isEmpty():
        one = rows.select("doc_id", packed(rows).alias("row"), F.struct(F.xxhash64("text").alias("t"), row_hash(rows).alias("r")).alias("by"))
        rows = one.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*")
    return rows.union(docs.where("doc_id is null"))
