"""Language identification by prediction by partial matching (PPM).

Training counts every byte with the three bytes before it, per language, over a
bounded sample of labelled rows. From the counts a tree of contexts of zero to
three bytes is built once and frozen. A byte's cost in a language is its exact
PPM code length there: method C's escape probability (distinct followers over
occurrences plus distinct followers) at each step to a shorter context, symbols
of longer contexts excluded, and at the root an equal share for what is left.
Every context of the sample is kept, sparsely: sorted contexts and grams of each
language with their counts. A text's distinct grams are looked up once a chunk.

A text is given to the language with the shortest code, the first by code point
on a tie. A null text, or one without any letter, is ``und`` with score 0. The
score is the posterior of the chosen language under equal priors, where a text
counts for at most ``EVIDENCE_BYTES`` bytes (average code length times that
many), so that it doesn't saturate with length. Rows with a null language don't
train; repeated rows train and are predicted each. Without any training row every text is
``und``; an empty table gives an empty result. Texts are read whole, however long;
columns other than doc_id, text and (in training) lang are not read.

There may be any number of languages: models of up to ``MODEL_GRAMS`` contexts and followers are
broadcast at a time, and where all languages together have more, texts pass
through one group of languages after the other, with the best so far beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import lean, materialize

ORDER = 3
PAD = b"\n" * ORDER
#: Rows of training text a language (an expected number: rows are taken by the hash of their id).
ROWS_A_LANGUAGE = 2000
EVIDENCE_BYTES = 64
#: Four-byte grams whose trees a broadcast model may hold (about 25 bytes each); a language alone is bounded by its sample.
MODEL_GRAMS = 10_000_000
UNDETERMINED = "und"
CHUNK, ROWS_AT_ONCE = 1 << 19, 256
SCORED = StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")


def count_contexts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): four-byte strings, the last one being what follows the other three."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                flat = np.frombuffer(b"".join(PAD + t.encode() for t in part["text"]), dtype=np.uint8).astype(np.uint32)
                if len(flat) <= ORDER:
                    continue
                gram, n = np.unique(flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One language's contexts of zero to three bytes: for each order the sorted contexts with their occurrences, distinct
    followers and the followers' occurrences one order below, and the sorted pairs of context and follower with their counts.
    Followers of a context also follow its shorter ones, so exclusion only needs these sums."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.grams, self.logs, self.contexts, self.total, self.kinds, self.covered = [], [], [], [], [], []
        below, order0 = None, np.argsort(gram)
        gram, n = gram[order0], n[order0]
        for order in range(ORDER + 1):
            keys, back = np.unique(gram & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            count = np.bincount(back, weights=n)
            context, first = np.unique(keys >> 8, return_index=True)
            self.grams.append(keys.astype(np.uint32))
            self.logs.append(np.log2(count))
            self.contexts.append(context.astype(np.uint32))
            self.total.append(np.add.reduceat(count, first))
            self.kinds.append(np.diff(np.append(first, len(keys))))
            if order:
                shorter = below[1][np.searchsorted(below[0], keys & (1 << 8 * order) - 1)]
                self.covered.append(np.add.reduceat(shorter, first))
            else:
                self.covered.append(None)
            below = keys, count

    def lengths(self, gram: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """The code length of each four-byte gram's last byte after the ``longest`` bytes before it."""
        out, spent, taken = (np.zeros(len(gram)) for _ in range(3))
        kinds, todo = np.zeros(len(gram), dtype=np.int64), np.arange(len(gram))
        for order in range(longest, -1, -1):
            own = gram[todo]
            found, at = _find(self.grams[order], own & (1 << 8 * (order + 1)) - 1)
            known, node = _find(self.contexts[order], own >> 8 & (1 << 8 * order) - 1)
            # without the followers of the longer context, which have been tried
            total, left = np.where(known, self.total[order][node] - taken[todo], 0), 256 - kinds[todo]
            new = np.where(known, self.kinds[order][node] - kinds[todo], 0)
            escapes = np.where(new < left, new, 0)  # nothing to escape to when all that is left was seen here
            whole = np.log2(np.maximum(total + escapes, 1))
            out[todo[found]] = (spent[todo] + whole - self.logs[order][at])[found]
            spent[todo] += np.where(escapes > 0, whole - np.log2(np.maximum(escapes, 1)), 0)
            kinds[todo] = np.where(known, self.kinds[order][node], 0)
            if order:
                taken[todo] = np.where(known, self.covered[order][node], 0)
            todo = todo[~found]
        out[todo] = spent[todo] + np.log2(np.maximum(256 - kinds[todo], 1))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is among the sorted keys, and where."""
    wanted = wanted.astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Model:
    """Frozen context trees of all languages, with all contexts that the training sample holds."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique().tolist())
        self.trees = []
        for lang in self.langs:
            own = counts[counts["lang"] == lang]
            self.trees.append(Tree(own["gram"].to_numpy(dtype=np.int64), own["n"].to_numpy(dtype=np.float64)))

    def lengths(self, gram: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """(grams, languages): code lengths of the last bytes."""
        return np.stack([t.lengths(gram, longest) for t in self.trees], axis=1)

    # Dense tables, to look at small models; scoring doesn't use them. Rows of the cost table are the contexts of order 1,
    # then 2, then 3; each byte pair leads to its row, or to that of its last byte.

    @cached_property
    def _nodes(self) -> list[np.ndarray]:
        held = [np.unique(np.concatenate([t.contexts[k] for t in self.trees])).astype(np.int64) for k in (2, 3)]
        return [np.arange(256), *held]

    @cached_property
    def pair(self) -> np.ndarray:
        out = np.tile(np.arange(256, dtype=np.int32), 256)
        out[self._nodes[1]] = 256 + np.arange(len(self._nodes[1]), dtype=np.int32)
        return out

    @cached_property
    def triple(self) -> np.ndarray:
        """[row of the pair, byte before it]"""
        first3, deep = 256 + len(self._nodes[1]), self._nodes[2]
        out = np.repeat(np.arange(first3, dtype=np.int32)[:, None], 256, axis=1)
        out[self.pair[deep & 0xFFFF], deep >> 16] = first3 + np.arange(len(deep), dtype=np.int32)
        return out

    @cached_property
    def cost(self) -> np.ndarray:
        """[context, byte, language]"""
        grams = [(nodes[:, None] << 8 | np.arange(256)).ravel() for nodes in self._nodes]
        return np.concatenate([self.lengths(g, order) for order, g in enumerate(grams, 1)]).reshape(-1, 256, len(self.langs)).astype(np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language; each byte sees the three before it in its own text."""
        flat = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), dtype=np.uint8)
        sizes = np.fromiter((len(t) + ORDER for t in texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(flat), CHUNK):
            piece = flat[max(0, a - ORDER) : a + CHUNK].astype(np.uint32)
            if a == 0:
                piece = np.concatenate([np.full(ORDER, PAD[0], dtype=np.uint32), piece])
            gram, back = np.unique(piece[:-3] << 24 | piece[1:-2] << 16 | piece[2:-1] << 8 | piece[3:], return_inverse=True)
            cost = self.lengths(gram.astype(np.int64)).astype(np.float32)[back]
            inside = starts[(starts >= a) & (starts < a + CHUNK)] - a
            for k in range(ORDER):  # the padding costs nothing
                cost[inside[inside + k < len(cost)] + k] = 0
            if a and len(back := starts[(starts < a) & (starts > a - ORDER)]):
                cost[: max(0, int(back[-1]) + ORDER - a)] = 0
            cuts = np.concatenate([[0], inside[inside > 0]]) if len(inside) else np.array([0])
            who = np.searchsorted(starts, a + cuts, side="right") - 1
            np.add.at(out, who, np.add.reduceat(cost, cuts, axis=0, dtype=np.float64))
        return out


class Languages:
    """Gram counts of all languages in a written table, and the groups of languages that make a model each, in order."""

    def __init__(self, counts: DataFrame, most: int = MODEL_GRAMS):
        self.counts, self.groups, size = counts, [], most
        for r in counts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect():  # a row a language
            if size + r["n"] > most:
                self.groups.append([])
                size = 0
            self.groups[-1].append(r["lang"])
            size += r["n"]

    def models(self) -> Iterator[Model]:
        for group in self.groups:
            yield Model((self.counts if len(self.groups) == 1 else self.counts.where(F.col("lang").isin(group))).toPandas())


def train(rows: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> Languages | None:
    """Counts from (doc_id, text, lang), or None without usable rows."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a share of each language's rows by the hash of their id: no language is sorted or gathered
    shares = materialize(usable.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(rows_a_language)) / F.count("*")).alias("_share")), "language-shares")
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.join(shares, F.col("lang") == F.col("_lang")).where(place < F.col("_share")).select("lang", "text")
    counts = materialize(count_contexts(sample), "language-grams")
    return None if counts.isEmpty() else Languages(counts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score(docs: DataFrame, languages: Languages | None, keep: list[str], within: str | None = None) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred, score and bits_per_byte of the chosen language.

    The text is the column text or, so that it doesn't travel twice, the string field text of the kept struct ``within``, which must not be null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), *([] if within else [F.col("text").cast("string").alias("text")]))
    out = StructType([rows.schema["kept"], *SCORED.fields])
    models = list(languages.models()) if languages and len(languages.groups) == 1 else languages.models() if languages else [None]
    last = len(languages.groups) if languages else 1
    for turn, model in enumerate(models, 1):
        rows = rows.mapInArrow(lean(_scorer(docs.sparkSession.sparkContext.broadcast(model), turn == 1, turn < last, within)), out.add(rows.schema["text"]) if turn < last and not within else out)
        out = StructType([rows.schema["kept"], *SCORED.fields])
        if turn < last:  # or the workers of all groups would hold their models at once
            rows = materialize(rows, "language-scores")
    return rows.select("kept.*", "lang_pred", "score", "bits_per_byte")


def _scorer(shared, first: bool, more: bool, within: str | None):
    """One group of languages: the best of it and of those before; ``score`` is, until the last, the sum of all languages' odds against the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, len(b), ROWS_AT_ONCE)):
            texts = (batch["kept"].field(within).field("text") if within else batch["text"]).to_pylist()
            pred = [UNDETERMINED] * len(texts) if first else batch["lang_pred"].to_pylist()
            odds, rate = np.zeros(len(texts)), np.full(len(texts), np.inf)
            if not first:
                odds, rate = batch["score"].to_numpy().copy(), batch["bits_per_byte"].fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
            known = [i for i, t in enumerate(texts) if model is not None and t is not None and has_letter(t)]
            if known:
                raw = [texts[i].encode() for i in known]
                sizes = np.array([len(t) for t in raw])
                mean = model.bits(raw) / sizes[:, None]
                weigh = np.minimum(sizes, EVIDENCE_BYTES)
                best = np.minimum(mean.min(1), rate[known])
                before = np.where(np.isinf(rate[known]), 0, np.exp2((best - np.where(np.isinf(rate[known]), best, rate[known])) * weigh))
                odds[known] = odds[known] * before + np.exp2((best[:, None] - mean) * weigh[:, None]).sum(1)
                for i, b, m, old in zip(known, mean.argmin(1).tolist(), mean.min(1).tolist(), rate[known].tolist()):
                    if m < old:
                        pred[i] = model.langs[b]
                rate[known] = best
            sure = odds if more else np.where(odds > 0, 1 / np.maximum(odds, 1e-300), 0.0)
            columns = {"kept": batch["kept"], "lang_pred": pa.array(pred, pa.string()), "score": pa.array(sure), "bits_per_byte": pa.array([None if np.isinf(x) else x for x in rate.tolist()], pa.float64())}
            if more and not within:
                columns["text"] = batch["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def remainder(doc_id: str, divisor: int):
    """CRC-32 of the id as text, modulo the divisor; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor, F.lit(0))


def identify(docs: DataFrame, held_out_remainder: int = 2, folds: int = 4) -> DataFrame:
    """Train on all folds but one, predict every row: doc_id, held_out, lang_pred, score."""
    held = remainder("doc_id", folds) == held_out_remainder
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id"), F.col("text"), held.alias("held_out"))
    return score(rows, model, ["doc_id", "held_out"])
