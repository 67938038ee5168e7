"""The operators on texts against brute force, and on odd and empty tables."""

import collections
import datetime
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import decontaminate, langid, mixing, neardup, pii, secrets, tokens, toxicity
from tests.llm.conftest import SCHEMA, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0, "", "") for i, t in enumerate(texts)], SCHEMA)


# --- 1


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, total = {}, set(names), float(sum(sizes.values()))
    while free:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    return out


def test_mixing(spark, odd, empty):
    got = mixing.mix(odd).taken().toPandas()
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in odd_rows()}
    by = collections.Counter()
    for i, t, _, s, *_ in odd_rows():
        by[s] += size[i, t]
    want = targets(by)
    assert len(got) == len(odd_rows()) and (got.taken <= 3 * got["size"]).all()
    assert sorted(got["size"]) == sorted(size[i, t] for i, t, *_ in odd_rows())
    for s, t in want.items():
        own = got[np.isclose(got.target, t) & (got.source_size == by[s])]
        assert own.taken.sum() == int(t + 1e-6), s
    again = mixing.mix(odd.repartition(7)).taken().toPandas()
    key = lambda d: sorted(map(tuple, d.fillna(-1).values.tolist()))
    assert key(got) == key(again)
    assert mixing.mix(empty).taken().count() == 0
    mixed = mixing.mix(odd).documents(odd)
    assert mixed.columns == odd.columns
    texts = collections.Counter()
    for r in mixed.collect():
        texts[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(texts[s] == int(t + 1e-6) for s, t in want.items())
    assert mixing.mix(empty).documents(empty).count() == 0


def test_many_sources(spark):
    """Targets of 700 sources against plain repetition, and draws that meet them."""
    rng = random.Random(13)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), "en", None if i % 701 == 700 else f"d{i % 701:04}", 0, 0, "", "") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).taken().toPandas()
    by, of = collections.Counter(), {}
    for i, t, _, s, *_ in rows:
        by[s] += len(t.split())
        of[i] = s
    want = targets(by)
    assert len(got) == len(rows) and np.allclose(got.target, [want[of[i]] for i in got.doc_id]) and (got.taken <= 3 * got["size"]).all()
    taken = got.groupby(got.doc_id.map(lambda i: of[i] or "")).taken.sum()
    assert all(taken[s or ""] == int(t + 1e-6) for s, t in want.items())


def test_rows_alike_but_for_other_columns(spark):
    rows = [(1, "a b c", "en", "s", 1, 10, "x", "y"), (1, "a b c", "de", "s", 2, 20, "x", "y"), (2, "d e f g", "en", "t", 3, 30, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = [sorted(map(tuple, mixing.mix(d).documents(d).collect())) for d in (docs, docs.repartition(5))]
    assert texts[0] == texts[1] and {r[2] for r in texts[0] if r[0] == 1} == {"en", "de"}


def test_permutation(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import permutation

    rows = spark.range(1000).select(permutation.permuted(F.col("id"), F.lit(1000), F.lit(3)).alias("p"), "id").withColumn("back", permutation.permuted(F.col("p"), F.lit(1000), F.lit(3), inverse=True)).toPandas()
    assert sorted(rows.p) == list(range(1000)) and (rows.back == rows.id).all() and abs(np.corrcoef(rows.p, rows.id)[0, 1]) < 0.15


# --- 2


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([r for r in sets if r[0] is not None], 2):
        if x & y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    return {i: find(i) for i in up}


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(1)
    base = [words(rng, 60).split() for _ in range(4)]
    texts = []
    for b in base:  # families around and below the threshold
        for k in range(14):
            t = list(b)
            for _ in range(k % 5):
                t[rng.randrange(len(t))] = "new" + str(rng.randrange(10**6))
            texts.append(" ".join(t))
    texts += ["", "a b", "A  b", "a b c d e f"]
    for percent in (85, 80):
        found = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts), percent).collect()}
        want = groups(enumerate(texts), percent)
        assert {i: r.component_id for i, r in found.items()} == want
        assert all(r.n_shingles == len(shingles(texts[i])) and r.kept == (want[i] == i) for i, r in found.items())
    got = neardup.near_duplicates(odd).collect()
    want = groups([(r[0], r[1]) for r in odd_rows()], 85)
    assert len(got) == len(odd_rows())
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id) for r in got)
    one = neardup.one_of_each(odd)
    assert one.columns == odd.columns and collections.Counter(r.doc_id for r in one.collect()) == collections.Counter([*{v for v in want.values()}, None])
    assert neardup.near_duplicates(empty).count() == 0 and neardup.one_of_each(empty).count() == 0


def test_super_minhash():
    rng = np.random.default_rng(0)
    err = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 260, dtype=np.uint64)
        a, b = x[:200], x[60:]
        s = neardup.super_minhash(np.concatenate([a, b]), np.array([0, 200, 400]))
        err.append((s[0] == s[1]).mean() - 140 / 260)
    assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.05
    assert (neardup.super_minhash(np.array([5], dtype=np.uint64), np.array([0, 1])) < 2**63).all()


# --- 3


def test_tokens(spark, odd, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    path = str(tmp_path / "corpus")
    got = tokens.token_output(odd, path).toPandas().sort_values("start")
    ids = [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in rows]
    assert got.n_tokens.sum() == sum(map(len, ids)) and got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    assert got.doc_id.fillna(-1).tolist() == [-1 if r[0] is None else r[0] for r in rows]
    assert sorted(zip(got.doc_id.fillna(-1), got.n_tokens, got.ids_crc32)) == sorted((-1 if r[0] is None else r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    back = {(r.doc_id, r.start): r.ids for r in tokens.read_tokens(spark, path).collect()}
    assert sum(map(len, back.values())) == sum(map(len, ids))
    assert tokens.token_output(empty).count() == 0


def test_encoder_agrees_with_the_library():
    public = pytest.importorskip("public_tokenizers")
    definition = tokens.tokenizer_definition(public.path("word_bpe_49k.json"))
    enc = tokens.Encoder(definition)
    cases = ["it's can't'll x's", "a<|endoftext|>b", "...,x..y", "é é K İ ß", "a_b 12a3 ½ ²", "tab\tnl x y\x1cz", "ΑΣ ΣΑΣ", "don''t *** $$$ rent%%% 'quoted'", "ᾳ ǅ ﬁ", "中文字 日本"]
    for text in cases:
        assert np.frombuffer(enc.encode(text), dtype="<u2").tolist() == enc.whole.encode(text, add_special_tokens=False).ids, text
    rng = random.Random(11)
    letters = [chr(c) for a, b in tokens.DIRECT for c in range(a, b + 1) if chr(c).isalpha()]
    odd = [chr(c) for c in [*range(0x600), 0xA0, 0x130, 0x149, 0x1C5, 0x1E9E, 0x200D, 0x2028, 0x3000, 0x1F600]]
    enc.parts.limit = 500  # the older half takes part
    for k in range(30_000):
        pick = (lambda: rng.choice(letters)) if k % 3 == 0 else (lambda: rng.choice(odd if rng.random() < 0.3 else "abc dE'st,.$| \n"))
        text = "".join(pick() for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(enc.encode(text), dtype="<u2").tolist() == enc.whole.encode(text, add_special_tokens=False).ids, text
    assert len(enc.parts) + len(enc.parts.older) <= 1000


def test_different_words_are_encoded_once_for_many_texts():
    public = pytest.importorskip("public_tokenizers")
    enc = tokens.Encoder(tokens.tokenizer_definition(public.path("word_bpe_49k.json")))
    made, make = [], enc.parts.make
    enc.parts.make = lambda parts: made.extend(parts) or make(parts)
    enc.parts.limit = 10  # far fewer than there are words
    rng = random.Random(3)
    words = [f"{x}é" if k % 5 == 0 else x for k, x in enumerate({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)})]
    texts = [" ".join(rng.choice(words).title() + rng.choice(["", "", ",", "...", "'s"]) for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["", "Σ two", " \n", "x" * 300 + "."]
    for some in (texts, texts[:7]):
        made.clear()
        for text, ids in zip(some, enc.encode_all(some), strict=True):
            assert np.frombuffer(ids, dtype="<u2").tolist() == enc.whole.encode(text, add_special_tokens=False).ids, text
        assert len(made) == len(set(made)) and not any(x[:-1] in words and x[-1] in ",." for x in made)
    assert len(enc.parts) + len(enc.parts.older) <= 10


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (7, 4), (300, 12), (5000, 16)])
def test_code(n, limit):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 2).astype(np.int64))
    lengths = tokens.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0**-x for x in lengths) <= 1 + 1e-12
    entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
    assert (counts * lengths).sum() / counts.sum() <= entropy + 1.1 or n <= 2
    code = tokens.Code(rng.permutation(n), lengths)
    for size in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, n, size)
        assert np.array_equal(code.unpack(*code.pack(x), size), x)


# --- 4


def test_pseudonyms(spark, odd, empty):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112", "on 2024-02-29 and 29/02/2024 but 2023-02-30", "mail Ann.Lee@Example.org or ann.lee@example.org", "ip 10.1.2.255, not 10.1.2.256", "ssn 123-45-6789 not 666-12-1234", "+1 (017) 555-7713", "GB82WEST12345698765432 GB82WEST12345698765433", "nothing 12 34"]
    rows = {r.doc_id: r for r in pii.pseudonymize(docs_of(spark, texts), "k").collect()}
    luhn = lambda s: sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0
    spaced, plain, bad = re.findall(r"\d[\d ]{14,}\d", rows[0].text)
    assert spaced.replace(" ", "") == plain and plain != "4111111111111111" and luhn(plain) and bad == "4111111111111112" and re.fullmatch(r"(\d{4} ){3}\d{4}", spaced)
    iso, slashed = re.search(r"on (\S+) and (\S+) but 2023-02-30", rows[1].text).groups()
    assert iso == "-".join(reversed(slashed.split("/"))) != "2024-02-29"
    a, b = re.findall(r"\S+@\S+", rows[2].text)
    assert a == b and re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{3}@[a-z0-9]{7}\.org", a) and a != "ann.lee@example.org"
    assert rows[3].n_ip == 1 and rows[3].text.endswith("not 10.1.2.256")
    assert rows[4].n_ssn == 1 and "666-12-1234" in rows[4].text and "123-45-6789" not in rows[4].text
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", rows[5].text) and rows[5].text != texts[5]
    ok, no = rows[6].text.split()
    assert no == "GB82WEST12345698765433" and ok != "GB82WEST12345698765432" and int("".join(str(int(c, 36)) for c in ok[4:] + ok[:4])) % 97 == 1
    assert rows[7].text == texts[7]
    got = pii.pseudonymize(odd, "k")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter((r[0], r[1]) for r in odd_rows()) and pii.pseudonymize(empty, "k").count() == 0


def pseudonymized(text, key):
    """The same rules in plain Python: one pass of the pattern, and Feistel networks on integers and strings."""
    sha = lambda n, *parts: hashlib.new(f"sha{n}", "|".join(map(str, parts)).encode()).hexdigest()

    def pairs(left, right, ranges, tweak):
        for r in range(8):
            other = right if r % 2 == 0 else left
            move = int(sha(256, key, tweak, r, other)[:15], 16)
            left, right = ((left + move) % ranges[0], right) if r % 2 == 0 else (left, (right + move) % ranges[1])
        return left, right

    def numerals(number, kind):
        n, a = len(number), len(number) // 2
        left, right = pairs(int(number[:a] or 0), int(number[a:]), (10**a, 10 ** (n - a)), f"{kind}|{n}")
        return f"{left:0{a}}"[:a] + f"{right:0{n - a}}"

    def letters(shape, tweak):
        own = "".join(c for c in shape if c in pii.BASE36)
        left, right = own[: len(own) // 2], own[len(own) // 2 :]
        for r in range(8):
            to, other = (left, right) if r % 2 == 0 else (right, left)
            stream = "".join(sha(512, key, tweak, len(own), r, b, other) for b in range(max(len(to) - 1, 0) // 32 + 1))
            to = "".join(pii.BASE36[(pii.BASE36.index(c) + int(stream[4 * i : 4 * i + 4], 16)) % 36] for i, c in enumerate(to))
            left, right = (to, right) if r % 2 == 0 else (left, to)
        new = iter(left + right)
        return "".join(next(new) if c in pii.BASE36 else c for c in shape)

    check = lambda p: -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(p)))) % 10
    mod97 = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
    refill = lambda shape, new: (lambda it: "".join(next(it) if c.isdigit() else c for c in shape))(iter(new))

    def made(m):
        kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m))
        own = re.sub("[^0-9]", "", m)
        if kind == "email":
            name, domain = m.lower().split("@")
            labels, last = domain.rsplit(".", 1)
            return letters(name, f"email|{domain}") + "@" + letters(labels, "domain") + "." + last
        if kind == "ip":
            a, b, c, d = map(int, m.split("."))
            left, right = pairs(a * 256 + b, c * 256 + d, (65536, 65536), "ip")
            return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
        if kind == "iban":
            if mod97(m[4:] + m[:4]) != 1:
                return m
            inner = re.sub("[^0-9]", "", m[4:])
            body = refill(m[4:], numerals(inner, "iban")) if len(inner) > 1 else m[4:]
            return m[:2] + f"{98 - mod97(body + m[:2] + '00'):02}" + body
        if kind == "ssn":
            area, group, serial = map(int, m.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return m
            left, right = pairs((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999), "ssn")
            area = left // 99 + 1
            return f"{area + (area >= 666):03}-{left % 99 + 1:02}-{right + 1:04}"
        if kind == "date":
            form = "%Y-%m-%d" if "-" in m else "%d/%m/%Y"
            try:
                day = datetime.datetime.strptime(m, form).date() - datetime.date(1700, 1, 1)
            except ValueError:
                return m
            if not 0 <= day.days < 146_097:
                return m
            left, right = pairs(*divmod(day.days, 189), (773, 189), "date")
            to = datetime.date(1700, 1, 1) + datetime.timedelta(left * 189 + right)
            return f"{to.year:04}-{to.month:02}-{to.day:02}" if "-" in m else f"{to.day:02}/{to.month:02}/{to.year:04}"
        if kind == "phone":
            keep = max(len(own) - 10, 1 if m[0] == "+" else 0)
            return refill(m, own[:keep] + numerals(own[keep:], "phone"))
        if check(own[:-1]) != int(own[-1]):
            return m
        payload = numerals(own[:-1], "card")
        return refill(m, payload + str(check(payload)))

    return re.sub("|".join(f"(?:{p})" for p in pii.PATTERNS.values()), lambda m: made(m.group()), text)


def test_pseudonyms_against_plain_python(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcXYZ019._-") for _ in range(n))
    card = lambda n: next(x for x in iter(lambda: digits(n), None) if sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0)
    make = [
        lambda: card(rng.randint(13, 19)), lambda: digits(rng.randint(11, 21)), lambda: " ".join(re.findall("....", card(16))), lambda: f"{letters(rng.randint(1, 70))}@{letters(rng.randint(1, 9))}.{rng.choice(['org', 'Co.uk'])}",
        lambda: f"{rng.randint(1600, 2200)}-{rng.randint(0, 13):02}-{rng.randint(0, 32):02}", lambda: f"{rng.randint(0, 32):02}/{rng.randint(0, 13):02}/{rng.randint(1600, 2200)}", lambda: ".".join(str(rng.randint(0, 270)) for _ in range(4)),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"GB{digits(2)}WEST{digits(14)}", lambda: "GB82WEST12345698765432", lambda: "plain words", lambda: "é" + digits(4),
    ]
    texts = ["".join(rng.choice(make)() + rng.choice([" ", ", ", "", "\n", "-"]) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["x@" + "a1" * 60 + ".example.com"]
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, texts), "secret").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pseudonymized(t, "secret"), t
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, texts[:20]), "another").collect()}
    assert any(other[i] != got[i] for i in other)
    with pytest.raises(ValueError):
        pii.pseudonymize(docs_of(spark, texts), "")


def test_long_ibans(spark):
    """All digits of a valid number are permuted, those behind the twentieth, too."""
    def iban(country, body):
        return country + f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}" + body

    given = [iban("PL", f"1090101400000712198{k:05}") for k in range(40)] + [iban("BR", "00360305000010009795493C1"), iban("MT", "0" * 30), iban("XX", "9" * 30), iban("XX", "9" * 21)]
    got = {r.doc_id: r for r in pii.pseudonymize(docs_of(spark, given), "k").collect()}
    made = [got[i].text for i in range(len(given))]
    assert all(got[i].n_iban == 1 for i in got) and len(set(made)) == len(given)
    assert all(int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 and re.sub("[0-9]", "9", x) == re.sub("[0-9]", "9", y) for x, y in zip(made, given))
    assert sum(x[-4:] == y[-4:] for x, y in zip(made[:40], given)) <= 2 and made[42][-10:] != given[42][-10:] and made[43][-1:] + made[43][4:8] != given[43][-1:] + given[43][4:8]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    got = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "card", F.lit("k")).alias("p")).toPandas().p
    assert sorted(got) == [f"{i:03}" for i in range(1000)]


# --- 5


def test_language(spark, odd, empty):
    rng = random.Random(2)
    text = {"xx": lambda: " ".join(rng.choice(["the", "thing", "and", "other"]) for _ in range(40)), "yy": lambda: " ".join(rng.choice(["der", "und", "über", "nicht"]) for _ in range(40))}
    rows = [(i, text[lang](), lang, "s", 0, 0, "", "") for i, lang in enumerate(["xx", "yy"] * 40)] + [(900, "12 34 --", "xx", "s", 0, 0, "", ""), (901, None, "yy", "s", 0, 0, "", ""), (902, "über", None, "s", 0, 0, "", "")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows[:80])) and got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "yy"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(odd).count() == len(odd_rows()) and langid.identify(empty).count() == 0
    none = langid.identify(odd.where("lang is null"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_groups_of_languages_agree_with_one_model(spark, monkeypatch):
    """Scores don't depend on how many models the languages are dealt to, and ties go to the first."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    rows = [(i, words(rng, 30) if lang < "ld" else " ".join(rng.choice([lang * 2, "und", "zwei"]) for _ in range(30)), lang, "s", 0, 0, "", "") for i, lang in enumerate(["la", "lb", "lc", "ld", "le"] * 12)]
    rows += [(100, "12", "la", "s", 0, 0, "", ""), (101, None, "la", "s", 0, 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    assert len(model.groups) == 1
    one = sorted(map(tuple, langid.score(docs, model, ["doc_id"]).collect()))
    parts = langid.Languages(model.counts, 1)
    assert parts.groups == [["la"], ["lb"], ["lc"], ["ld"], ["le"]]
    for a, b in zip(one, sorted(map(tuple, langid.score(docs, parts, ["doc_id"]).collect()))):
        assert a[:2] == b[:2] and np.allclose(a[2], b[2]) and (a[3] is b[3] is None or np.allclose(a[3], b[3]))
    nested = docs.select(F.struct(*docs.columns).alias("row"))
    for models, flat in ((model, one), (parts, sorted(map(tuple, langid.score(docs, parts, ["doc_id"]).collect())))):
        got = langid.score(nested, models, ["row"], "row").select("row.doc_id", "lang_pred", "score", "bits_per_byte")
        assert sorted(map(tuple, got.collect())) == flat


def test_code_lengths_are_those_of_a_code():
    import pandas as pd

    rng = random.Random(3)
    grams = collections.Counter()
    for lang in ("a", "b"):
        t = (b"\n\n\n" + words(rng, 400).encode())
        grams.update((lang, int.from_bytes(t[i : i + 4], "big")) for i in range(len(t) - 3))
    model = langid.Model(pd.DataFrame([(x, g, n) for (x, g), n in grams.items()], columns=["lang", "gram", "n"]))
    assert np.allclose(np.exp2(-model.cost.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    texts = [b"abc abc", b"z", b"dead beef " * 90_000]
    for t, bits in zip(texts, model.bits(texts)):
        t3 = b"\n\n\n" + t
        want = [sum(model.cost[model.triple[model.pair[t3[i + 1] << 8 | t3[i + 2]], t3[i]], t3[i + 3], j] for i in range(min(len(t), 2000))) for j in range(2)]
        if len(t) <= 2000:
            assert np.allclose(bits, want, rtol=1e-5)
    assert np.allclose(model.bits([texts[2], b"abc abc"])[1], model.bits([b"abc abc"])[0])


def test_every_context_of_the_sample_counts():
    """Code lengths of a small language beside one with more contexts than any cap, against PPM by dictionaries."""
    import pandas as pd

    rng = np.random.default_rng(4)
    texts = {"big": rng.integers(97, 123, 60_000).astype(np.uint8).tobytes(), "small": "東京は日本の首都である。京都は古い都である。".encode() * 2}
    held = {x: collections.Counter(int.from_bytes((b"\n\n\n" + t)[i : i + 4], "big") for i in range(len(t))) for x, t in texts.items()}
    model = langid.Model(pd.DataFrame([(x, g, n) for x, c in held.items() for g, n in c.items()], columns=["lang", "gram", "n"]))

    def bits(text, grams):
        follow = collections.defaultdict(collections.Counter)
        for g, n in grams.items():
            b = g.to_bytes(4, "big")
            for k in range(4):
                follow[b[3 - k : 3]][b[3]] += n
        total, text = 0.0, b"\n\n\n" + text
        for i in range(3, len(text)):
            seen = set()
            for k in (3, 2, 1, 0):
                here = {s: n for s, n in follow.get(text[i - k : i], {}).items() if s not in seen}
                escapes = len(here) if len(here) < 256 - len(seen) else 0
                if text[i] in here:
                    total -= np.log2(here[text[i]] / (sum(here.values()) + escapes))
                    break
                if escapes:
                    total -= np.log2(escapes / (sum(here.values()) + escapes))
                seen |= set(here)
            else:
                total += np.log2(256 - len(seen))
        return total

    asked = ["京都は日本の都である。".encode(), b"abcabcxyz", "東 z\x00é".encode()]
    assert np.allclose(model.bits(asked), [[bits(t, held[x]) for x in ("big", "small")] for t in asked], rtol=1e-5)


# --- 8


def entropy_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s = m.group()
        if any(re.fullmatch(p, s) for p in secrets.ALLOWED):
            continue
        least = secrets.MIN_HEX_BITS if re.fullmatch("[0-9a-fA-F]*", s) else secrets.MIN_BITS
        h = lambda x: -sum(n / len(x) * np.log2(n / len(x)) for n in collections.Counter(x).values())
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            classes = [[c for c in w if c in k] for k in secrets.CLASSES]
            if h(w) >= least - 1e-12 and sum(len(c) > 1 and h(c) >= secrets.MIN_CLASS_BITS - 1e-12 for c in classes) >= secrets.MIN_CLASSES:
                out.append((m.start(), 3, "entropy", m.end()))
                break
    return out


def test_secrets(spark, odd, empty):
    rng = random.Random(4)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(rng.choice(a) for _ in range(n))
    texts = [f"é😀 PassWord='{key(14)}' x", "secret: token: abcdefghijklmnop", f"AKIA{key(16, 'ABCDEFGH0123')} AKIA12", f"{key(40, '0123456789abcdef')} deadbeef", f"blob {key(48)} {key(24)}", "api-key=aaaaaaaaaaaaaaaa apikey = zzzzzzzzzzzz", "path/to/some/long/directory/name_of_words some-very-long-name-here-too", "123e4567-e89b-12d3-a456-426614174000 aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 30 + key(30), "token=" + key(11) + "\nToKeN = \"" + key(12) + '"', None, ""]
    texts += [" ".join(key(rng.randint(1, 45), rng.choice(["abcdef0123456789", "abcXYZ019_-", "ab"])) for _ in range(12)) for _ in range(30)]
    kinds = [("assign", secrets.ASSIGN, lambda m: len(m.group(2)) >= 12), ("access", secrets.ACCESS, lambda m: len(m.group()) >= 18), ("hex", secrets.HEX, lambda m: len(m.group()) >= 16)]

    def check(rows, got):
        for r in got:
            text = rows[r.doc_id] or ""
            base = sorted((m.start(), k, name, m.end()) for k, (name, p, f) in enumerate(kinds) for m in re.finditer(p, text, re.A) if f(m))
            line = lambda s: ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted(s))
            assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
            assert r.spans == line(base + entropy_spans(text)), text

    check(dict(enumerate(texts)), secrets.secret_digest(docs_of(spark, texts)).collect())
    got = secrets.secret_digest(odd).collect()
    assert len(got) == len(odd_rows())
    check({r[0]: r[1] for r in odd_rows()}, got)
    assert secrets.secret_digest(empty).count() == 0


def test_secrets_of_texts_with_many_matches(spark):
    """Work in proportion to the matches: 50,000 of them in one text."""
    many = " ".join(f"{k:016x}" for k in range(50_000)) + " password=abcdefghijklmnop"
    r = secrets.secret_digest(docs_of(spark, [many])).collect()[0]
    want = [f"hex:{17 * k}:{17 * k + 16}" for k in range(50_000)]
    assert (r.n_hex, r.n_assign) == (50_000, 1)
    assert r.base_sha256 == hashlib.sha256(",".join([*want, f"assign:{17 * 50_000}:{len(many)}"]).encode()).hexdigest()


# --- 9


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice(["a", "b", "the", "thé", "x9"]) if rng.random() < 0.6 else f"w{rng.randrange(40)}" for _ in range(n))
    items = [(i, some(rng.choice([1, 5, 13, 14, 40]))) for i in range(12)] + [(3, "unique words"), (None, some(20)), (50, None), (51, "...")]
    texts = []
    for _ in range(60):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [", ".join(w[a : a + rng.randint(12, 30)]).upper(), some(rng.randint(0, 9))]
        texts.append("-".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    def want(text):
        w, hit, found = cut(text), set(), set()
        for i, t in items:
            x = cut(t)
            n = min(13, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[k : k + n]:
                        hit |= set(range(j, j + n))
                        found.add(i)
        names = sorted(str(i) for i in found if i is not None)
        return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    assert rows == {i: want(t) for i, t in enumerate(texts)} and any(r[4] for r in rows.values())
    clean = decontaminate.clean_documents(docs_of(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in rows.items() if not r[4]}
    assert decontaminate.contamination(odd, bench).count() == len(odd_rows()) and decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(odd, bench.where("false")).collect()
    assert len(none) == len(odd_rows()) and not any(r.n_hit for r in none)


def test_phrases_and_proximity(spark):
    rng = random.Random(12)
    items = [(1, "zebra of quokka"), (2, " ".join(f"w{k}" for k in range(40))), (3, "only only only"), (4, "the zebra and the lynx"), (None, "zebra quokka")]
    w = items[1][1].split()
    texts = ["zebra x x quokka", "zebra quokka", "zebra x x x x x x x x x quokka", "quokka zebra", "only " * 9, " ".join(["x", *w[3:30], "y", *w[20:40]]), " ".join([*w[0:13], *w[0:12], "lynx zebra"])]
    texts += [" ".join(rng.choice(["zebra", "quokka", "lynx", "x", "the", "of"]) for _ in range(rng.randint(2, 25))) for _ in range(25)]
    index = decontaminate.Index(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    hits = decontaminate.window_hits(docs_of(spark, texts), index)
    got = {(r.doc_id, r.item_id, r.start, r.end, r.item_start) for r in decontaminate.phrase_matches(hits, index).collect()}
    want = set()
    for d, t in enumerate(texts):
        x = t.split()
        for i, item in items:
            y = item.split()
            n = min(13, len(y))
            first = {}
            for k in range(len(y) - n + 1):
                first.setdefault(tuple(y[k : k + n]), k)
            places = {(first[tuple(x[p : p + n])], p) for p in range(len(x) - n + 1) if tuple(x[p : p + n]) in first}
            for k, p in places:
                if (k - 1, p - 1) not in places:
                    m = next(m for m in range(1, len(x) + 2) if (k + m, p + m) not in places)
                    want.add((d, None if i is None else str(i), p, p + m - 1 + n, k))
    assert got == want and any(e - s > 13 for _, _, s, e, _ in got)
    count = collections.Counter(x for t in texts for x in t.split())
    pairs = {i: sorted(set(t.split()), key=lambda x: (count[x], x))[:2] for i, t in items}
    near = {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(index, 5).collect()}
    at = lambda t, x: [k for k, y in enumerate(t.split()) if y == x]
    assert near == {(d, None if i is None else str(i)) for d, t in enumerate(texts) for i, p in pairs.items() if len(p) == 2 and any(abs(a - b) <= 5 for a in at(t, p[0]) for b in at(t, p[1]))}


def test_decontamination_of_repetitive_texts(spark):
    docs = docs_of(spark, ["a " * 200_000, "a b " * 3000 + "c", "a b c"])
    bench = spark.createDataFrame([(1, "a " * 40), (2, "a b " * 20), (3, "b")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {0: (200_000, 200_000, 1), 1: (6001, 6000, 2), 2: (3, 1, 1)}


# --- 10


def test_toxicity(spark, odd, empty):
    rng = random.Random(8)
    texts, rows = [], []
    for i in range(240):
        bad = i % 4 == 0
        w = [words(rng, 1) for _ in range(25)]
        for k in range(3 if bad else 0):
            w[rng.randrange(25)] = rng.choice(["zorkish", "zorkly", "blarg", "idiot"])
        texts.append(" ".join(w))
        rows.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*rows, (None, 0, 1), (5, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*texts, None, ""])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(240)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held) and got[240].predicted == got[241].predicted == 0
    assert toxicity.toxicity(odd, labels.where("false")).count() == len(odd_rows()) and toxicity.toxicity(empty, labels).count() == 0


def test_label_model_against_all_patterns():
    """The posterior of a tree of voters, against its joint distribution summed over both labels by brute force; correlated voters count once."""
    rng = np.random.default_rng(15)
    truth = rng.random(6000) < 0.3
    votes = np.stack([np.where(truth, rng.random(6000) < a, rng.random(6000) < b) for a, b in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02))], axis=1).astype(float)
    copies = np.repeat(votes[:, 1:2], 4, axis=1)  # four voters that repeat the second one
    given = np.where(rng.random(6000) < 0.1, ~truth, truth).astype(float)
    alone, crowd = toxicity.label_model(votes, given), toxicity.label_model(np.concatenate([votes, copies], axis=1), given)
    assert np.abs(alone - crowd).max() < 0.1 and ((crowd > 0.5) == truth).mean() > 0.95 > ((given > 0.5) == truth).mean()
    prior, rates = truth.mean(), [(votes[truth, j].mean(), votes[~truth, j].mean()) for j in range(3)]
    said = given[truth].mean(), given[~truth].mean()
    for v in itertools.product((0, 1), repeat=4):
        both = [p * np.prod([r[k] if x else 1 - r[k] for x, r in zip(v, [*rates, said])]) for k, p in ((0, prior), (1, 1 - prior))]
        rows = (votes == v[:3]).all(1) & (given == v[3])
        if rows.sum() > 60:
            assert abs(alone[rows].mean() - both[0] / sum(both)) < 0.12


def test_toxic_texts_with_a_common_beginning(spark):
    """Signs behind 60 and more common characters are learned, and repeats of a text count once."""
    rng, header = random.Random(9), "Licensed under terms that stand at the head of every text of this place. "
    texts, rows = [], []
    for i in range(240):
        w = [words(rng, 1) for _ in range(25)]
        if i % 4 == 0:
            w[3], w[9] = "zorkish", "blarg"
        texts.append(header + " ".join(w))
        rows.append((i, int(i % 4 == 0)))
    texts += ["qqqrare toxic once"] * 12 + ["QQQrare  toxic once\n"] * 12
    rows += [(i, 1) for i in range(240, 264)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    again = toxicity.train(docs_of(spark, texts).repartition(7), labels.repartition(5))
    assert model.signs == again.signs and np.allclose(model.coefficients, again.coefficients, atol=1e-9)
    scores = model.scores(texts[:240])
    assert ((scores >= 0.7) == [i % 4 == 0 for i in range(240)]).all()
    assert any(s.startswith("zor") for s in model.signs) and any(s.startswith("bla") for s in model.signs) and not any(s.startswith("qqq") for s in model.signs)
