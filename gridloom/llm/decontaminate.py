"""Benchmark decontamination with a distributed positional inverted index.

Words are maximal runs of digits, ASCII letters (lower-cased) and all signs
beyond ASCII. A window is ``WINDOW`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one window. Equal windows are one, in
whatever items and however often they stand.

1. Count the corpus occurrences of every benchmark term.
2. Of each window take its two rarest terms (by that count, then position), the
   anchors, and of each item its two rarest different words (by count, then word).
   Store the postings (term, document, position) of all of them: the index.
3. Intersect the anchors' lists, one shifted by their distance in the window. Where
   they meet, every window with these anchors is a candidate at one place.
4. Compare each candidate with the document's words at that place, by hash and
   then as text. A place has at most one exact window of a length, so work and
   memory grow with the words and the postings, however repetitive a text is.

``phrase_matches`` gives maximal stretches that follow an item word for word;
``proximity_matches`` tells from the same index where an item's two rarest words
stand within ``SLOP`` words of each other: neighbours in one sorted list of both.

Documents are keyed by (doc_id, hash of the text), so repeated rows get equal
results, and a null id or item id is allowed: a null item's words count as hits,
but its id is not listed. Null and empty texts have no words and no hits; very long
ones are read whole. Of equally rare terms the first counts. With an empty
benchmark nothing is hit, an empty corpus gives an empty result. Only doc_id, text
and item_id are read; a caller's other columns pass through ``clean_documents`` in one
struct, so their names can't clash. All steps are DataFrame expressions; no step emits
pairs within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, packed

TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW = 13
#: Words between an item's two rarest words, at most, that still make a proximity match.
SLOP = 5
#: Terms and windows up to this many are broadcast to the scan; beyond it the scan's rows are shuffled to them.
BROADCAST_TERMS = 1_000_000
KEY = ["doc_id", "text_hash"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): item is a key of the row, equal for equal rows."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), terms(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("item", F.sha2(F.concat_ws("\x00", F.coalesce("item_id", F.lit("\x01")), F.array_join("words", " ")), 256))
    return rows.dropDuplicates(["item"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))


def bounded(small: DataFrame, n: int) -> DataFrame:
    """Broadcast terms only after their number was checked."""
    return F.broadcast(small) if n <= BROADCAST_TERMS else small


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one document; b's key columns are _d and _t, and a null id equals a null id."""
    return a["doc_id"].eqNullSafe(b["_d"]) & (a["text_hash"] == b["_t"])


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n) for every term of ``vocabulary``, 0 included."""
    n = vocabulary.count()
    words = keyed(docs).select(F.explode(terms(F.col("text"))).alias("term"))
    found = words.join(bounded(vocabulary, n), "term").groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def item_windows(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, pos, text, len, a, b) of every window: its place in the item, and the places in the window of its two rarest terms (b = a in windows of one word)."""
    placed = items.select("item", F.posexplode("words").alias("pos", "term")).join(counts, "term")
    ranked = placed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("p"))
    rarest = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("p") - window, F.lit(0))),
        lambda i: F.struct(i.alias("pos"), F.slice(F.transform(F.array_sort(F.transform(F.slice("p", i + 1, window), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos")))), lambda x: x["pos"] - i), 1, 2).alias("two")),
    )
    rows = items.join(ranked.select("item", rarest.alias("r")), "item").select("item", "item_id", "words", F.explode("r").alias("r"))
    words = F.slice("words", F.col("r.pos") + 1, window)
    a = F.get("r.two", F.lit(0))
    return rows.select("item", "item_id", F.col("r.pos").alias("pos"), F.array_join(words, " ").alias("text"), F.size(words).alias("len"), a.alias("a"), F.coalesce(F.get("r.two", F.lit(1)), a).alias("b"))


def item_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, item_id, one, two): the two rarest different words of each item that has two."""
    words = items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    best = words.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("s")).where(F.size("s") > 1)
    return best.select("item", "item_id", F.get("s", F.lit(0))["term"].alias("one"), F.get("s", F.lit(1))["term"].alias("two"))


class Index:
    """windows: win, text, len, a, b, t_a, t_b, one row a different window; members: win, text, item, item_id, pos (its first place in the item);
    pairs: as ``item_pairs``; postings: term, doc_id, text_hash, pos. All are tables in the shared folder."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        items = materialize(benchmark_items(benchmark), "bench-items")
        counts = materialize(term_counts(docs, items.select(F.explode("words").alias("term")).distinct()), "bench-terms")
        every = materialize(item_windows(items, counts, window).withColumn("win", F.xxhash64("text")), "bench-windows")
        self.members = every.groupBy("win", "text", "item", "item_id").agg(F.min("pos").alias("pos"))
        own = F.split("text", " ")
        self.windows = every.dropDuplicates(["win", "text"]).select("win", "text", "len", "a", "b", F.get(own, F.col("a")).alias("t_a"), F.get(own, F.col("b")).alias("t_b"))
        self.pairs = item_pairs(items, counts)
        wanted = self.windows.select(F.explode(F.array("t_a", "t_b")).alias("term")).union(self.pairs.select(F.explode(F.array("one", "two")).alias("term"))).distinct()
        self.n = every.count()
        words = keyed(docs).select(*KEY, F.posexplode(terms(F.col("text"))).alias("pos", "term"))
        self.postings = materialize(words.join(bounded(wanted, wanted.count()), "term").select("term", *KEY, "pos"), "postings")

    def small(self, table: DataFrame) -> DataFrame:
        """A table of windows or of items, of which there are no more."""
        return bounded(table, self.n)


def candidates(index: Index) -> DataFrame:
    """(doc_id, text_hash, start, len, win) where both anchors of a window stand as far apart as in it."""
    anchors = index.windows.select("t_a", "t_b", (F.col("b") - F.col("a")).alias("apart")).distinct()
    key = F.xxhash64("t_a", "t_b", "apart")
    first = anchors.select(F.col("t_a").alias("term"), key.alias("pair"), F.lit(0).alias("shift"), F.lit(1).alias("side"))
    second = anchors.where("apart <> 0").select(F.col("t_b").alias("term"), key.alias("pair"), F.col("apart").alias("shift"), F.lit(2).alias("side"))
    lists = index.postings.join(index.small(first.union(second)), "term").select(*KEY, "pair", (F.col("pos") - F.col("shift")).alias("at"), "side")
    met = lists.groupBy(*KEY, "pair", "at").agg(F.bit_or("side").alias("sides"))
    windows = index.windows.withColumn("apart", F.col("b") - F.col("a")).select(key.alias("pair"), F.when(F.col("apart") == 0, 1).otherwise(3).alias("both"), "a", "len", "win")
    found = met.join(index.small(windows), "pair").where("sides = both").select(*KEY, (F.col("at") - F.col("a")).alias("start"), "len", "win")
    return found.where("start >= 0")


def window_hits(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, text_hash, start, len, win, text) of every window that stands in a document, each place once."""
    found = candidates(index).groupBy(*KEY).agg(F.collect_set(F.struct("start", "len", "win")).alias("c"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "c")
    rows = keyed(docs)
    rows = rows.join(found, same_key(rows, found)).select(*KEY, terms(F.col("text")).alias("w"), "c")
    cut = lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ")
    equal = F.filter("c", lambda x: (x["start"] + x["len"] <= F.size("w")) & (F.xxhash64(cut(x)) == x["win"]))
    rows = rows.select(*KEY, F.explode(F.transform(equal, lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), x["win"].alias("win"), cut(x).alias("text")))).alias("h")).select(*KEY, "h.*")
    return rows.join(index.small(index.windows.select("win", "text")), ["win", "text"]).select(*KEY, "start", "len", "win", "text").distinct()


def phrase_matches(hits: DataFrame, index: Index) -> DataFrame:
    """Exact matches (doc_id, text_hash, item_id, start, end, item_start): words [start, end) of the document are those of the item from item_start, as far as whole windows go.

    A window that an item holds several times counts from its first place there.
    """
    rows = hits.join(index.small(index.members), ["win", "text"]).withColumn("shift", F.col("start") - F.col("pos"))
    run = Window.partitionBy(*KEY, "item", "shift").orderBy("pos")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(run))  # windows that follow each other share it
    rows = rows.groupBy(*KEY, "item", "item_id", "shift", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.min("pos").alias("item_start"))
    return rows.select(*KEY, "item_id", "start", "end", "item_start")


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """(doc_id, text_hash, item_id, start, end): neighbouring places of an item's two rarest words, at most ``slop`` words apart."""
    sides = index.pairs.select("item", "item_id", F.explode(F.array(*(F.struct(F.col(c).alias("term"), F.lit(c).alias("side")) for c in ("one", "two")))).alias("x")).select("item", "item_id", "x.*")
    lists = index.postings.join(index.small(sides), "term").select(*KEY, "item", "item_id", "side", "pos").distinct()
    line = Window.partitionBy(*KEY, "item").orderBy("pos")
    lists = lists.withColumn("before", F.lag(F.struct("pos", "side")).over(line))
    return lists.where((F.col("before.side") != F.col("side")) & (F.col("pos") - F.col("before.pos") <= slop)).select(*KEY, "item_id", F.col("before.pos").alias("start"), (F.col("pos") + 1).alias("end"))


def covered_words(hits: DataFrame) -> DataFrame:
    """(_d, _t, n_hit): words of each document inside windows, each counted once; one sort, no array of places."""
    line = Window.partitionBy(*KEY).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    rows = hits.select(*KEY, "start", "len").distinct().withColumn("to", F.coalesce(F.max(end).over(line), F.lit(0)))
    rows = rows.groupBy(*KEY).agg(F.sum(F.greatest(end - F.greatest("start", "to"), F.lit(0))).cast("long").alias("n_hit"))
    return rows.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "n_hit")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit, and in at least a twentieth of the words."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_phrases (exact phrase matches, as items and stretches) and n_near (items with a proximity match)."""
    index = Index(docs, benchmark, window)
    hits = materialize(window_hits(docs, index), "window-hits")
    per_doc = covered_words(hits)

    def of_key(rows: DataFrame, *found: Column) -> DataFrame:
        got = rows.groupBy(*KEY).agg(*found)
        return got.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), *[c for c in got.columns if c not in KEY])

    phrases = of_key(phrase_matches(hits, index).where("item_id is not null"), F.sort_array(F.collect_set("item_id")).alias("items"), F.count("*").alias("phrases"))
    near = of_key(proximity_matches(index, slop).where("item_id is not null").select(*KEY, "item_id").distinct(), F.count("*").alias("near"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text").cast("string")).alias("n_words"))
    for part in (per_doc, phrases, near):
        rows = rows.join(part, same_key(rows, part), "left").drop("_d", "_t")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"), F.coalesce("phrases", F.lit(0)).cast("long").alias("n_phrases"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    per_doc = covered_words(materialize(window_hits(docs, Index(docs, benchmark)), "window-hits"))
    rows = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = rows.join(per_doc, same_key(rows, per_doc), "left")
    dirty = F.coalesce(is_contaminated(F.col("n_hit"), word_count(F.col("text"))), F.lit(False))
    return rows.where(~dirty).select("row.*")
