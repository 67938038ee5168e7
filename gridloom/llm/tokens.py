"""Token ids in canonical, length-limited Huffman code.

A written corpus is a folder with two Parquet tables:

* ``codebook``: one row per id that occurs, with its code length (at most
  ``MAX_BITS``); codes follow from the lengths by the canonical rule (shorter
  codes first, ids ascending within a length), so nothing else is stored;
* ``blocks``: one row per block of whole documents in ascending ``doc_id``
  order. ``first`` counts all ids before the block, ``doc_ids`` and ``doc_sizes``
  say where documents lie, ``payload`` holds the bits (big endian, 32-bit words)
  and ``segments`` the bit length of every run of ``SEGMENT`` ids. Their running
  sum is the list of bit-offset checkpoints at which decoding can start, and
  the decoder walks all segments of a block at once.

Rows may repeat a ``doc_id``; repeats are ordered by the text's hash, then the
text. A null ``doc_id`` sorts first. A null text is an empty document: its only
id is the end id. An empty table gives a corpus without blocks and without
codes. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, lean, materialize, new_path, partitions, release

MAX_BITS = 16
SEGMENT = 64
BLOCK_IDS = 1 << 17
#: Words that a worker's table holds (about 25 MB) and the signs of the longest one, so memory is bounded at any vocabulary of words.
PARTS_KEPT, LONGEST = 500_000, 64
#: Signs of the texts that are looked up together (one text may have more).
SIGNS_AT_ONCE = 1 << 22
# First and last code points of the blocks whose letters go to the model directly (Latin, Greek, Cyrillic, kana, common ideographs).
DIRECT = ((0x61, 0x7A), (0xDF, 0x24F), (0x390, 0x3CE), (0x430, 0x45F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5))

RAW = "shard int, block int, ids_before long, doc_ids array<long>, doc_sizes array<int>, ids binary"
BLOCKS = "shard int, block int, first long, n_ids int, doc_ids array<long>, doc_sizes array<int>, segments binary, payload binary"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- ids -----------------------------------------------------------------------------------------


class Table:
    """Ids of the strings last asked for, in arrays of Arrow and numpy, in as few bytes a string as they take; strings of over ``LONGEST`` signs aren't kept."""

    def __init__(self, make: Callable[[list[str]], tuple[list[int], list[int]]], kind: np.dtype, limit: int):
        self.make, self.kind, self.limit, self.recent = make, kind, limit, 0
        self.known = pa.array([], pa.large_string())
        self.start, self.size, self.values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)

    def __len__(self) -> int:
        """Strings of the last look-up that are kept."""
        return self.recent

    @property
    def older(self) -> pa.Array:
        """Strings kept from those before."""
        return self.known[self.recent :]

    def look_up(self, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different strings: values, and where in them each one's ids start and how many they are. What isn't known is made."""
        found = pc.index_in(asked, value_set=self.known).fill_null(-1).to_numpy()
        old, new = found >= 0, found < 0
        ids, sizes = self.make(asked.filter(pa.array(new)).to_pylist())
        start, size = np.empty(len(found), dtype=np.int64), np.empty(len(found), dtype=np.int64)
        start[old], size[old] = self.start[found[old]], self.size[found[old]]
        size[new] = sizes
        start[new] = len(self.values) + np.cumsum(size[new]) - size[new]
        values = np.concatenate([self.values, np.array(ids, dtype=self.kind)])
        # what was asked for now comes first, so that what wasn't in a long time drops out
        short, others = pc.less_equal(pc.utf8_length(asked), LONGEST), np.ones(len(self.known), dtype=bool)
        others[found[old]] = False
        first = asked.filter(short)
        self.known, self.recent = pa.concat_arrays([first, self.known.filter(pa.array(others))])[: self.limit], min(len(first), self.limit)
        short = short.to_numpy(zero_copy_only=False)
        begin, self.size = (np.concatenate([now[short], was[others]])[: self.limit] for now, was in ((start, self.start), (size, self.size)))
        self.values, self.start = runs(values, begin, self.size), np.cumsum(self.size) - self.size
        return values, start, size


def runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all runs, one after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return values[at]


class Encoder:
    """The library's tokenizer behind a table of parts that it has encoded before, which are looked up for many texts at once.

    The tokenizer splits at white space and between letters and other signs, so
    a text's ids are those of its parts in order. Texts for which that could fail
    (added tokens' strings, text that is not in NFC before or after lower-casing, a
    capital sigma, whose lower case depends on its neighbours) go through the library whole. Words of letters
    of the ``DIRECT`` blocks go to the library's model as the byte-level alphabet
    spells them; other parts go through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.model = self.whole.model
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.parts = Table(self._make, self.kind, PARTS_KEPT)
        #: Strings that send a text through the library whole; the separators are white space to str.split() only.
        self.odd = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()] + ["\x1c", "\x1d", "\x1e", "\x1f"]
        letters = (chr(c) for a, b in DIRECT for c in range(a, b + 1))
        letters = "[" + "".join(c for c in letters if c.isalpha() and c.lower() == c) + "]+"
        self.letters, self.only_letters = re.compile(letters), f"^{letters}$"
        self.spelled = byte_alphabet()
        self.split = normal_splits(self.whole)

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _make(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all parts (of lower-cased texts), and how many each has."""
        ids, ends, model = [], [0], self.model.tokenize
        for part in parts:
            if part.isascii() and part.isalpha():
                ids += [t.id for t in model(part)]
            elif self.letters.fullmatch(part):
                ids += [t.id for t in model(part.encode().decode("latin-1").translate(self.spelled))]
            else:
                ids += self._whole(part)
            ends.append(len(ids))
        return ids, np.diff(ends)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has; every different word is looked up once."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        asked, which = coded.dictionary, coded.indices.to_numpy()
        # a run of letters, then signs without apostrophe: the tokenizer never joins the two
        run = pc.utf8_rtrim(asked, characters=".,;:!?*$%&#|()")
        ended = np.flatnonzero(pc.less(pc.binary_length(run), pc.binary_length(asked)))
        ended = ended[pc.match_substring_regex(run.take(pa.array(ended)), self.only_letters).to_numpy(zero_copy_only=False)]
        at = pa.array(ended)
        signs = [w[len(x) :] for w, x in zip(asked.take(at).to_pylist(), run.take(at).to_pylist())]
        both = np.zeros(len(asked), dtype=bool)
        both[ended] = True
        units = pa.concat_arrays([pc.if_else(pa.array(both), run, asked), pa.array(signs, pa.large_string())]).dictionary_encode()
        values, start, size = self.parts.look_up(units.dictionary)
        unit = units.indices.to_numpy()
        # of each word the unit that it is or begins with, and the one that it ends with, if any
        begin, many = np.zeros((len(asked), 2), dtype=np.int64), np.zeros((len(asked), 2), dtype=np.int64)
        begin[:, 0], many[:, 0] = start[unit[: len(asked)]], size[unit[: len(asked)]]
        begin[ended, 1], many[ended, 1] = start[unit[len(asked) :]], size[unit[len(asked) :]]
        values, size = runs(values, begin.ravel(), many.ravel()), many.sum(1)
        return runs(values, (np.cumsum(size) - size)[which], size[which]), size[which]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        at, words, ends = [], [], [0]
        for i, text in enumerate(texts):
            low = text.lower()
            composed = text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) and "Σ" not in text)
            if not self.split or not composed or any(x in low for x in self.odd):
                out[i] = np.array(self._whole(text), dtype=self.kind).tobytes()
                continue
            words += low.split()
            at.append(i)
            ends.append(len(words))
        if words:
            ids, sizes = self._words(words)
            cuts = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
            for i, a, b in zip(at, cuts, cuts[1:]):
                out[i] = ids[a:b].tobytes()
        return out


def by_size(rows: Iterable[tuple[int | None, str]], most: int) -> Iterator[list[tuple[int | None, str]]]:
    """Rows in order, as many together as have ``most`` signs (one more row may go over it)."""
    found, n = [], 0
    for row in rows:
        found.append(row)
        n += len(row[1])
        if n >= most:
            yield found
            found, n = [], 0
    if found:
        yield found


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


def normal_splits(tokenizer) -> bool:
    """Whether this tokenizer treats parts on their own, ignores case and white space and spells bytes as ``byte_alphabet`` does, told by trial."""
    whole = tokenizer.encode("One,two  THREE\nfour-five ok. Über 東京", add_special_tokens=False).ids
    parts = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("one", ",", "two", "three", "four-five", "ok", ".", "über", "東京")]
    direct = [[t.id for t in tokenizer.model.tokenize(x.encode().decode("latin-1").translate(byte_alphabet()))] for x in ("three", "über", "東京")]
    return whole == sum(parts, []) and direct == [parts[3], *parts[7:]]


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One per worker process and tokenizer, so that its tables outlive a task."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Workers outlive the stage that encodes; its tables would stay beside those of all later stages."""
    _ENCODERS.clear()


def tokenize(docs: DataFrame, definition: str, end_id: int = 1) -> DataFrame:
    """Blocks of raw ids, in ascending doc_id order by (shard, block)."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, where, block = encoder(definition), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], dtype=enc.kind).tobytes(), enc.kind.itemsize
        names, sizes, parts, n, before = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([where], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())],
                names=["shard", "block", "ids_before", "doc_ids", "doc_sizes", "ids"],
            )

        texts = ((name.as_py(), text.as_py() or "") for batch in batches for name, text in zip(batch["doc_id"], batch["text"]))
        for some in by_size(texts, SIGNS_AT_ONCE):
            for (name, _), ids in zip(some, enc.encode_all([text for _, text in some])):
                ids += end
                names.append(name)
                sizes.append(len(ids) // width)
                parts.append(ids)
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    yield row()
                    block, before = block + 1, before + n
                    names, sizes, parts, n = [], [], [], 0
        if names:
            yield row()

    spread = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), spread.alias("h"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return rows.select("doc_id", "text").mapInArrow(lean(shard), RAW)


# --- the code ------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    rows, is_leaf = leaves, np.ones(n, dtype=bool)
    levels = [is_leaf]
    for _ in range(limit - 1):
        packages = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        rows = merged[by]
        levels.append(by < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ids and lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        spans = np.left_shift(1, MAX_BITS - self.lengths)
        starts = np.cumsum(spans) - spans
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.bits, self.codes = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint64)
        self.bits[self.ids] = self.lengths
        self.codes[self.ids] = starts >> (MAX_BITS - self.lengths)
        #: Of each run of MAX_BITS bits: the id it starts with and that id's length.
        self.table = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        filled = np.repeat((self.ids << 8 | self.lengths).astype(np.uint32), spans)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Segments and payload."""
        if not len(ids):
            return b"", b""
        bits = self.bits[ids].astype(np.int64)
        ends = np.cumsum(bits)
        starts = ends - bits
        value = self.codes[ids] << (64 - bits - (starts & 31)).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] >> 5) + 2, dtype=np.uint64)
        at = word[first]
        out[at] += np.add.reduceat(value >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return np.add.reduceat(bits, np.arange(0, len(ids), SEGMENT)).astype("<u2").tobytes(), out[: int(ends[-1] + 31 >> 5)].astype(">u4").tobytes()

    def unpack(self, segments: bytes, payload: bytes, n: int) -> np.ndarray:
        """All segments advance together, one table look-up an id."""
        runs = np.frombuffer(segments, dtype="<u2").astype(np.int64)
        at = np.cumsum(runs) - runs
        words = np.concatenate([np.frombuffer(payload, dtype=">u4").astype(np.uint64), np.zeros(SEGMENT * MAX_BITS // 32 + 2, dtype=np.uint64)])
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.empty((SEGMENT, len(runs)), dtype=np.uint32)
        for k in range(SEGMENT):
            window = pairs[at >> 5] >> (48 - (at & 31)).astype(np.uint64)
            hit = self.table[(window & np.uint64(0xFFFF)).astype(np.int64)]
            out[k] = hit >> 8
            at += hit & 0xFF
        return out.T.reshape(-1)[:n]


# --- files ---------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int = 1) -> None:
    """Encode every document and write the corpus to ``path``.

    The ids are made once, kept in the shared folder while their counts are
    summed, and deleted when the coded blocks stand. What reaches the driver is one
    count an id (at most the vocabulary) and one sum a shard.
    """
    spark = docs.sparkSession
    raw = materialize(tokenize(docs, definition, end_id), "token-ids", "zstd")
    release(spark)  # the shuffled texts are no longer needed
    width = 2 if encoder(definition).kind.itemsize == 2 else 4

    def count(batches):
        forget_encoders()
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                got = np.bincount(np.frombuffer(ids.as_buffer(), dtype=f"<u{width}"))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = raw.select("ids").mapInArrow(lean(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    ids, lengths = counts["id"].to_numpy(), code_lengths(counts["n"].to_numpy())
    code = Code(ids, lengths)
    book = spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, lengths)], "id int, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    n_ids = F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = raw.groupBy("shard").agg(F.sum(n_ids).alias("n")).toPandas().sort_values("shard")
    before = dict(zip(sums["shard"].tolist(), (sums["n"].cumsum() - sums["n"]).tolist()))

    def pack(batches):
        forget_encoders()
        for batch in batches:
            for r in batch.to_pylist():
                got = np.frombuffer(r["ids"], dtype=f"<u{width}")
                segments, payload = code.pack(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([before[r["shard"]] + r["ids_before"]], pa.int64()), pa.array([len(got)], pa.int32()), pa.array([r["doc_ids"]], pa.list_(pa.int64())), pa.array([r["doc_sizes"]], pa.list_(pa.int32())), pa.array([segments], pa.binary()), pa.array([payload], pa.binary())],
                    names=["shard", "block", "first", "n_ids", "doc_ids", "doc_sizes", "segments", "payload"],
                )

    raw.mapInArrow(lean(pack), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(raw)


def read_code(spark: SparkSession, path: str) -> Code:
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").toPandas()
    return Code(book["id"].to_numpy(), book["bits"].to_numpy())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written corpus: doc_id, start, ids (array of int)."""
    code = read_code(spark, path)

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = code.unpack(r["segments"], r["payload"], r["n_ids"])
                cuts = np.concatenate([[0], np.cumsum(r["doc_sizes"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + cuts[:-1].astype(np.int64), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "start", "ids"],
                )

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(lean(decode), "doc_id long, start long, ids array<int>")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written corpus: doc_id, start, n_tokens and the CRC-32 of its ids, decoded from the file."""
    code = read_code(spark, path)

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = code.unpack(r["segments"], r["payload"], r["n_ids"]).astype("<u4")
                sizes = np.array(r["doc_sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(lean(decode), DIGEST)


def tokenizer_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_output(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a coded corpus (to ``path``, or to the shared folder) and read its digest back."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = path or new_path(docs.sparkSession, "corpus")
    write_tokens(docs, path, tokenizer_definition(vocabulary), end_id)
    return read_digest(docs.sparkSession, path)
