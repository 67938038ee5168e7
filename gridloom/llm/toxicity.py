"""Toxicity by weak supervision.

1. Lexicons. Fixed lists of insults, one a language, and signs learned from labelled
   rows: word beginnings (``PREFIXES`` letters) and whole words that stand mostly in
   documents labelled toxic, more often than chance gives the best of all candidates.
2. Voters, each of which says toxic or nothing. Lexicon voters: every fixed list; the learned words
   and the learned beginnings, each dealt by precision into ``TIERS`` lists. Pattern voters: several
   different signs, a sign repeated, signs dense among the words, a sign in capitals, a
   sign with an exclamation mark behind it, a sign beside a word of address, and shouting without regard to signs.
3. Label model. A generative model of the true label: the class prior, and for each class
   the voters' joint distribution as a tree, in which a voter's rate depends on the true label and on
   one other voter, so accuracies and correlations are estimated together. The tree links the pairs with most mutual
   information within the classes (Chow and Liu, 1968) and is fitted again as posteriors move
   (expectation maximisation). The given label is one more voter with rates of its own, as labels are wrong at times.
4. Classifier. Logistic regression (ridge, Newton steps by conjugate gradients on sparse rows) of the
   posterior labels on the signs' counts and the votes; its probability is the score.

Labels are learned from at most about ``LABELLED_ROWS`` rows, taken by the hash of
their id; signs are learned from texts that differ by more than case and white space, and all that pass stay.
Several labels of one doc_id count as the highest. Null labels and ids aren't learned from. Without a toxic or a
clean row, as with an empty table of labels, the fixed lists alone score, with fixed weights. Null and empty texts
have no sign and get the score of such texts; an empty table of documents gives an empty result. Texts are scored
whole, however long; columns other than doc_id, text and toxic are not read. Repeated rows are scored each. Ties of
signs go by their spelling, so that a rerun learns the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .langid import remainder
from .shared import materialize

# Common insults by language, as word beginnings, and words of address.
INSULTS = {
    "en": ("idiot", "moron", "stupid", "dumb", "imbecile", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "jerk", "bastard"),
    "de": ("dummkopf", "blöd", "arschloch", "trottel", "abschaum", "widerlich", "wertlos"),
    "fr": ("crétin", "imbécile", "connard", "salaud", "ordure", "abruti", "pathétique"),
    "es": ("estúpid", "imbécil", "cabrón", "basura", "patétic", "asqueros", "inútil"),
}
ADDRESS = ("you", "your", "u", "du", "dich", "dein", "tu", "toi", "ton", "eres", "usted")
LABELLED_ROWS = 12_000
PREFIXES = (3, 8)
TIERS = 4
PATTERNS = ("several", "repeated", "dense", "capitals", "exclaimed", "addressed", "shouting")
PRECISION, LEAST_ROWS = 0.5, 3
#: The share of capitals among the letters that makes a text shouting, and its least length.
SHOUTING, SHOUTED_LETTERS = 0.5, 20
THRESHOLD = 0.7


class Signs:
    """Finds word beginnings (``abc``) and whole words (``abc$``) in a text with one automaton."""

    def __init__(self, signs: list[str]):
        import ahocorasick

        self.signs, self.whole = signs, [s.endswith("$") for s in signs]
        self.machine = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, s in enumerate(signs):
            by.setdefault(s.rstrip("$"), []).append(i)
        for s, found in by.items():
            self.machine.add_word(s, (len(s), found))
        if by:
            self.machine.make_automaton()
        self.empty = not by

    def counts(self, text: str) -> tuple[dict[int, int], list[bool]]:
        """How often each sign stands in a text, and the pattern voters' votes."""
        out: dict[int, int] = {}
        low = text.lower()
        same = len(low) == len(text)  # or places differ
        capitals = exclaimed = addressed = False
        for end, (size, found) in self.machine.iter(low) if not self.empty else ():
            before = end - size
            if before >= 0 and (low[before].isalnum() or low[before] == "_"):
                continue
            hit = False
            for i in found:
                if self.whole[i] and end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_"):
                    continue
                out[i] = out.get(i, 0) + 1
                hit = True
            if hit:
                capitals = capitals or (same and text[before + 1 : end + 1].isupper())
                behind = low[end + 1 : end + 24].split()[:2]
                exclaimed = exclaimed or any("!" in w for w in behind[:1])
                near = low[max(0, before - 24) : before + 1].split()[-2:] + behind[1:]
                addressed = addressed or any(w.strip(".,;:!?") in ADDRESS for w in near)
        letters = sum(map(str.isalpha, text))
        shouting = letters >= SHOUTED_LETTERS and sum(map(str.isupper, text)) >= SHOUTING * letters
        total = sum(out.values())
        return out, [len(out) > 1, max(out.values(), default=0) > 1, total > 0 and total * 100 > len(low.split()), capitals, exclaimed, addressed, shouting]


def learned_signs(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(sign, toxic rows, clean rows) of signs that stand mostly in toxic rows of (text, toxic), best first.

    A sign needs more toxic rows than chance gives one of all candidates. Of a
    beginning and extensions found in as many rows only the longest stays.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    if not total.n or not total.pos or total.pos == total.n:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    low, high = PREFIXES
    ends = F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(w) >= n, F.substr(w, F.lit(1), n)))))
    signs = rows.select("toxic", F.explode(F.array_distinct(F.flatten(ends))).alias("sign")).where("sign is not null")
    counts = signs.groupBy("sign").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where((F.col("pos") >= LEAST_ROWS) & (F.col("pos") >= PRECISION * F.col("n")))
    base = total.pos / total.n
    # the chance of so many toxic rows among n at the base rate, by Chernoff's bound, over a million candidates
    p, share = F.lit(base), F.least(F.col("pos") / F.col("n"), F.lit(1 - 1e-9))
    bound = F.col("n") * (share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p)))
    kept: list[tuple[str, int, int]] = []
    alike: dict[tuple[int, int], list[str]] = {}
    for r in counts.where(bound >= np.log(2e4)).orderBy(F.desc(F.round(bound, 6)), F.desc(F.length("sign")), "sign").collect():  # no more than the bounded sample's words
        stem, found = r.sign.rstrip("$"), (int(r.pos), int(r.n - r.pos))
        others = alike.setdefault(found, [])
        if not any(y.startswith(stem) or stem.startswith(y) for y in others):
            kept.append((r.sign, *found))
            others.append(stem)
    return kept


def spanning_tree(votes: np.ndarray, q: np.ndarray) -> list[int]:
    """Each voter's parent (-1 at the root) in the tree of most mutual information within the classes."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    for weight in (q, 1 - q):
        total = weight.sum() + 1.0
        on = (votes.T @ weight + 0.25) / total
        both = (votes.T @ (votes * weight[:, None]) + 0.0625) / total
        for joint, a, b in ((both, on[:, None], on[None, :]), (on[:, None] - both, on[:, None], 1 - on[None, :]), (on[None, :] - both, 1 - on[:, None], on[None, :]), (1 - on[:, None] - on[None, :] + both, 1 - on[:, None], 1 - on[None, :])):
            joint = np.clip(joint, 1e-9, 1)
            gain += total / (len(q) + 2) * joint * np.log(joint / np.clip(a * b, 1e-12, 1))
    parent, best, far = [-1] * n, gain[0].copy(), np.ones(n, dtype=bool)
    link = np.zeros(n, dtype=int)
    far[0] = False
    while far.any():
        j = int(np.argmax(np.where(far, best, -np.inf)))
        parent[j], far[j] = int(link[j]), False
        closer = far & (gain[j] > best)
        best[closer], link[closer] = gain[j][closer], j
    return parent


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of toxic for rows of 0/1 votes and given labels; see the module's text.

    Clean rows' votes are held to be rarer than toxic rows', and a given label to be right more often than wrong: that
    names the two classes. Rates are smoothed as by one row of each class.
    """
    rows, voters = votes.shape
    q = 0.05 + 0.9 * given.astype(np.float64)
    parent: list[int] = []
    for turn in range(rounds):
        if turn % 10 == 0:
            parent = spanning_tree(votes, q)
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        odds = np.full(rows, np.log(prior / (1 - prior)))
        for j, p in enumerate(parent):
            for state in (0, 1) if p >= 0 else (None,):
                at = np.ones(rows, dtype=bool) if state is None else votes[:, p] == state
                v = votes[at, j]
                on = np.clip((v @ q[at] + 0.5) / (q[at].sum() + 1), 1e-3, 0.999)
                off = np.clip((v @ (1 - q[at]) + 0.05) / ((1 - q[at]).sum() + 1), 1e-4, 0.999)
                off = min(off, on) if state is None or state == 0 else off
                odds[at] += np.where(v > 0, np.log(on / off), np.log((1 - on) / (1 - off)))
        said_on = np.clip((given @ q + 1) / (q.sum() + 2), 0.5, 0.995)
        said_off = np.clip((given @ (1 - q) + 1) / ((1 - q).sum() + 2), 0.005, 0.5)
        odds += np.where(given > 0, np.log(said_on / said_off), np.log((1 - said_on) / (1 - said_off)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if turn % 10 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


class Features:
    """Sparse rows of features: log counts of signs, votes, and a constant at the end."""

    def __init__(self, found: list[tuple[dict[int, int], list[bool]]], lists: np.ndarray, voters: int):
        signs = len(lists)
        self.rows, self.columns = len(found), signs + voters + 1
        at, of, value = [], [], []
        for r, (counts, patterns) in enumerate(found):
            votes = {signs + int(lists[i]) for i in counts} | {signs + voters - len(PATTERNS) + k for k, v in enumerate(patterns) if v}
            for i, n in counts.items():
                at.append(r), of.append(i), value.append(np.log1p(n))
            for k in [*votes, signs + voters]:
                at.append(r), of.append(k), value.append(1.0)
        self.at, self.of, self.value = np.array(at, dtype=np.int64), np.array(of, dtype=np.int64), np.array(value)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * w[self.of], minlength=self.rows)

    def sums(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=self.value * u[self.at], minlength=self.columns)

    def votes(self, signs: int) -> np.ndarray:
        out = np.zeros((self.rows, self.columns - signs - 1))
        own = (self.of >= signs) & (self.of < self.columns - 1)
        out[self.at[own], self.of[own] - signs] = 1
        return out


class Classifier:
    """signs: spellings, with $ behind whole words; lists: the lexicon voter of each sign; then come the pattern voters."""

    def __init__(self, signs: list[str], lists: np.ndarray, voters: int, coefficients: np.ndarray):
        self.signs, self.lists, self.voters, self.coefficients = signs, lists, voters, coefficients
        self.finder: Signs | None = None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        self.finder = self.finder or Signs(self.signs)
        x = Features([self.finder.counts(t) for t in texts], self.lists, self.voters)
        return 1 / (1 + np.exp(-np.clip(x.times(self.coefficients), -30, 30)))


def logistic(x: Features, target: np.ndarray, ridge: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton steps, each solved by conjugate gradients."""
    w = np.zeros(x.columns)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        left = x.sums(target - p) - ridge * w
        move, way, size = np.zeros(x.columns), left.copy(), left @ left
        for _ in range(200):
            if size < 1e-16:
                break
            image = x.sums(curve * x.times(way)) + ridge * way
            step = size / (way @ image)
            move += step * way
            left -= step * image
            size, old = left @ left, size
            way = left + size / old * way
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def sign_counts(rows: DataFrame, signs: list[str]) -> list[tuple[int, dict[int, int], list[bool]]]:
    """(toxic, counts of signs, patterns) of labelled rows; their number is bounded by ``LABELLED_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Signs(signs)
        for batch in batches:
            found = [finder.counts(t or "") for t in batch["text"].to_pylist()]
            columns = [batch["toxic"].cast(pa.int32()), pa.array([list(f) for f, _ in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in found], pa.list_(pa.int32())), pa.array([p for _, p in found], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "sign", "n", "patterns"])

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, sign array<int>, n array<int>, patterns array<boolean>").collect()
    # in one order, whatever the partitions, so that sums of doubles and with them scores repeat
    return sorted(((r.toxic, dict(sorted(zip(r.sign, r.n))), list(r.patterns)) for r in got), key=lambda x: (x[0], list(x[1].items()), x[2]))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Classifier:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = own.count()
    place = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    own = own.where(place < min(1.0, labelled_rows / max(n, 1)))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("_id"))  # bounded by labelled_rows
    rows = rows.withColumn("alike", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary"), 256)).select("toxic", "text", "alike")
    rows = materialize(rows, "labelled")
    apart = rows.groupBy("alike", "toxic").agg(F.min("text").alias("text"))
    learned = learned_signs(apart)
    known = [x for x, _, _ in learned]
    fixed = [(s, k) for k, group in enumerate(INSULTS.values()) for s in group if not any(s.startswith(x) for x in known)]
    signs = known + [s for s, _ in fixed]
    # learned words and learned beginnings go to lists of their own, by precision
    tier = lambda pos, neg: min(TIERS - 1, int((1 - pos / (pos + neg)) / (1 - PRECISION) * TIERS))
    lists = np.array([len(INSULTS) + TIERS * x.endswith("$") + tier(pos, neg) for x, pos, neg in learned] + [k for _, k in fixed], dtype=np.int64)
    voters = len(INSULTS) + 2 * TIERS + len(PATTERNS)
    ridge = np.full(len(signs) + voters + 1, 0.3)
    ridge[len(signs) :] = 0.03
    ridge[-1] = 1e-3
    data = sign_counts(rows, signs)
    given = np.array([t for t, _, _ in data], dtype=np.float64)
    if not len(given) or given.min() == given.max():
        w = np.zeros(len(ridge))
        w[len(signs) : len(signs) + len(INSULTS)] = 4.0
        w[len(signs) + voters - len(PATTERNS)] = 1.0
        w[-1] = -3.0
        return Classifier(signs, lists, voters, w)
    x = Features([(c, p) for _, c, p in data], lists, voters)
    return Classifier(signs, lists, voters, logistic(x, label_model(x.votes(len(signs)), given), ridge))


def score(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with score and predicted."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))
    kept = StructType([inner.schema["kept"]]).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # signs of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 256) for b in batches for a in range(0, len(b), 256)):
            p = shared.value.scores([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["kept"], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["kept", "score", "predicted"])

    return inner.mapInArrow(run, kept).select("kept.*", "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 1, folds: int = 3) -> DataFrame:
    """Train on all folds but one, score every row: doc_id, held_out, score, predicted."""
    model = train(docs, labels.where(remainder("doc_id", folds) != held_out_remainder))
    rows = docs.select("doc_id", "text", (remainder("doc_id", folds) == held_out_remainder).alias("held_out"))
    return score(rows, model, ["doc_id", "held_out"])
