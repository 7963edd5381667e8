"""Whitening, byte-level BPE and spelling variants against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import bytebpe, variants, whitening

DOCS = "doc_id bigint, text string, id string, key string, word string, n bigint, ids binary, part string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "k", "w", 1, b"i", "p") for i, t in rows], DOCS).repartition(parts)


# --- whitening ---------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 200), st.integers(1, 5), st.sampled_from([1, 8, 20, 45, 62]))
def test_bit_planes_give_exact_products(seed, n, dims, bits):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(1 << bits), 1 << bits, (n, dims), dtype=np.int64)
    sums, products = whitening.scatter(x)
    rows = x.tolist()
    for i in range(dims):
        assert sums[i] == sum(r[i] for r in rows)
        for j in range(i, dims):
            assert products[i, j] == sum(r[i] * r[j] for r in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-2 ** 63, 2 ** 63 - 1) | st.integers(-200, 200), min_size=3, max_size=3), min_size=1, max_size=20))
def test_packed_rows_come_back(rows):
    x = np.array(rows, dtype=np.int64)
    packed = whitening.pack_rows(x)
    assert (whitening.unpack_rows(packed, 3) == x).all()
    assert len(set(packed)) == len({tuple(r) for r in rows})
    y = x >> 2
    assert whitening.deviations(y) == [sum(v * v for v in r) for r in y.tolist()]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (150, 6)) @ rng.normal(0, 1, (6, 6))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)]
    rows += [(900 + i, rows[7][1]) for i in range(60)]  # one vector many times
    rows += [(5, rows[5][1]), (None, rows[1][1]), (960, None), (961, []), (962, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (963, [math.nan] * 6), (964, [math.inf] + [0.0] * 5), (965, [1.0, 2.0]), (966, [-0.0] * 6), (967, [0.0] * 6)]
    return rows


def test_whitening_matches_plain_algebra(spark, vectors):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors],
                                  "vec_id bigint, embedding array<double>, n string, component int").repartition(4)
    got = collections.defaultdict(list)
    for r in whitening.whiten(table, components=4).collect():
        got[r["vec_id"]].append(r)
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=float) / n
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1][:4], vec[:, ::-1][:, :4]
    assert sum(map(len, got.values())) == 4 * len(good)
    assert collections.Counter(i for i, _ in good) == {i: len(rows) // 4 for i, rows in got.items()}
    signs = {}
    for i, x in good:
        for r in got[i]:
            k = r["component"] - 1
            want = float((np.array([n * a - s for a, s in zip(x, sums)], dtype=float) / n) @ vec[:, k] / math.sqrt(e[k]))
            sign = signs.setdefault(k, 1 if r["whitened"] * want >= 0 else -1)
            assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r["whitened"] - sign * want) < 1e-9 and abs(r["explained"] - e[k] / np.trace(cov)) < 1e-9
            assert r["identity_error"] < 1e-9
    same = {(r["component"], r["whitened"]) for i in range(900, 960) for r in got[i]}
    assert len(same) == 4


def test_whitening_without_directions(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(9)], kind)  # one direction only
    found = whitening.whiten(line).collect()
    assert len(found) == 9 and {r["component"] for r in found} == {1} and abs(found[0]["explained"] - 1) < 1e-9


# --- byte-level BPE ----------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    ranks = bytebpe.read_ranks(bytebpe.vocabulary_path())
    return tiktoken.Encoding("plain", pat_str=bytebpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    marks = ["'s", "'re", "''ll", " ", "  ", "\n", "\n\n  ", "\t", " ", "　", "é", "ß", "字", "。", "12", "٣", "x", "Word", "!?", "'", "\x1c", "́", "😀", "՘"]
    out = ["", " ", "it's they're", "a" * 300, " " * 300 + "x", "字" * 200, "'s" * 90, "\n" * 99, "x" + "\n" * 99 + " y", "1" * 100 + "a" * 100]
    for size in (5, 40, 200, 900):
        out += ["".join(rng.choice(marks) for _ in range(size)) for _ in range(6)]
    return out


def test_ids_are_those_of_the_whole_text(spark, plain):
    rows = list(enumerate(odd_texts())) + [(7, None), (7, "a" * 300), (None, "they're " * 50), (None, None)]
    docs = docs_of(spark, rows)
    want = collections.Counter((i, np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t in rows)
    for chunk, overlap in ((1, 1), (16, 5), (64, 64), (1 << 16, 1 << 10)):
        found = bytebpe.encode(docs, chunk=chunk, overlap=overlap)
        got = found.collect()
        assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    back = collections.Counter((r["doc_id"], bytes(r["raw"])) for r in bytebpe.decode(found).collect())
    assert back == collections.Counter((i, (t or "").encode()) for i, t in rows)
    assert bytebpe.encode(docs.limit(0)).count() == 0


def test_chunks_are_cut_where_neighbours_meet(spark):
    text = "plain words, and more of them " * 40
    found = bytebpe.pieces(spark.createDataFrame([("k", text), ("k", text), ("r", "a" * 500)], "key string, text string"),
                           bytebpe.default_pattern(), 100, 20).collect()
    pieces = [r["text"] for r in sorted((r for r in found if r["key"] == "k"), key=lambda r: r["piece"])]
    assert "".join(pieces) == text and len(pieces) == 12
    assert [r["text"] for r in found if r["key"] == "r"] == ["a" * 500]  # a run without borders stays whole


def test_long_blanks_and_long_runs(plain):
    encoder = bytebpe.Encoder(bytebpe.vocabulary_path(), bytebpe.default_pattern())
    decoder = bytebpe.Decoder(bytebpe.vocabulary_path())
    for text in ("x" + " " * 5000 + "y", " " * 5000, "\n" * 6000 + "\n z", "a b" + "\t" * 4097 + "'s" + " " * 4096 + "\x1cq"):
        assert encoder.ids(text) == np.array(plain.encode_ordinary(text), dtype="<u4").tobytes()
    for text in (" " * 1_500_000 + "x", "x" * 200_000):
        assert decoder.raw([encoder.ids(text), None, b""]) == [text.encode(), None, b""]
    with pytest.raises(ValueError):
        decoder.raw([np.array([60_000], dtype="<u4").tobytes()])


def test_decoding_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, b"\x01\x00\x00\x00", "old"), (2, None, "old"), (3, b"", None)], "a int, tokens binary, raw string")
    got = {r["a"]: r["raw"] for r in bytebpe.decode(rows, "tokens").collect()}
    assert got[2] is None and bytes(got[3]) == b"" and len(got[1]) == 1


# --- spelling variants -------------------------------------------------------

def plain_variants(rows, every=None, shortest=5, least=3, ratio=2):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every and i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    letters = sorted(set("".join(words)))
    near = {w: set() for w in words}
    for w in words:
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = {x for x in edits if x in words and x != w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    out = [(0, None), (1, ""), (2, " 12 . "), (None, "abcde abcde abcdf abcdf abcdf"), (3, "x" * 700 + " " + ("y" + "x" * 699 + " ") * 8 + "x" * 700 + " " + "x" * 700)]
    for i in range(4, 90):
        text = []
        for _ in range(rng.randint(1, 60)):
            w = list(rng.choice(base))
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = rng.choice("abÀé")
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        out.append((i, rng.choice([" ", "-", "7", "×"]).join(text)))
    return out + [out[-1], (5, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa aaaaa aaaaa aaaaa aaaaaaa aaaaaaa aaaaaaa " * 4)]


@pytest.mark.parametrize("slab,every", [(variants.SLAB, None), (40, 3), (variants.SLAB, 97)])
def test_variants_match_all_edits(spark, spelled, slab, every):
    got = variants.group_variants(docs_of(spark, spelled), every=every, slab=slab).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == plain_variants(spelled, every)


def test_variants_of_nothing(spark):
    assert variants.group_variants(docs_of(spark, [(1, None)]).limit(0)).count() == 0
    assert variants.group_variants(docs_of(spark, [(1, None), (2, "short words but none of them often")])).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(21)] + [("21", None), ("z", None), ("y", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.roots(forms).collect()}
    assert got == {**{str(i): "21" for i in range(21)}, "y": "z"}


def test_index_ranges_agree_in_both_orders():
    rng = np.random.default_rng(5)
    index = variants.BidirectionalIndex([rng.integers(1, 4, rng.integers(2, 9)) for _ in range(50)], 4)
    low, other, size = index.start(1)
    text = "".join(map(str, index.text))
    match = ""
    for step, symbol in enumerate([1, 2, 3, 1]):
        if step % 2:
            other, low, size = index.extend(index.back, other, low, size, np.array([symbol]))
            match += str(symbol)
        else:
            low, other, size = index.extend(index.ahead, low, other, size, np.array([symbol]))
            match = str(symbol) + match
        places = [m.start() for m in re.finditer(f"(?={match})", text)]
        assert size[0] == len(places)
        assert sorted(index.ahead.suffixes[low[0]:low[0] + size[0]].tolist()) == places
        assert sorted((len(text) - index.back.suffixes[other[0]:other[0] + size[0]] - len(match)).tolist()) == places


# --- packing: blocks of words ------------------------------------------------

def test_long_texts_are_tokenized_in_parts(spark, monkeypatch):
    from quillwork.llm import packing
    text = "\n".join(f"word{i} and, more. Ünï {i * i}" for i in range(900)) + "x" * 300
    assert " ".join(packing.parts_of(text, 50)).split() == text.split() and len(packing.parts_of(text, 50)) > 100
    monkeypatch.setattr(packing, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(packing, "OUT_IDS", 700)
    batch = spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, text)], "doc_id bigint, text string").toArrow().to_batches()
    got = collections.defaultdict(list)
    for out in packing._task(packing.vocabulary_path(), 512, 1)(iter(batch)):
        for r in out.to_pylist():
            got[r["id"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist(), r["tokens"]))
    tokenizer = packing.WordCache(packing.vocabulary_path()).tokenizer
    for i, t in ((1, text), (2, ""), (3, "short"), (4, text)):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert [x for *_, part, _ in got[i] for x in part] == ids and {n for *_, n in got[i]} == {len(ids)}
        assert [(s, n) for s, n, *_ in got[i]] == packing.pieces(len(ids), 512)


# --- near duplicates: drifting copies ----------------------------------------

def drifting(members, words=120, edits=7, seed=11):
    """Copies of copies, each with some words replaced, so that most pairs of the group are far apart."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [base]
    while len(out) < members:
        copy = list(out[rng.randrange(len(out))] if rng.random() < 0.5 else base)
        for _ in range(rng.randint(1, edits)):
            copy[rng.randrange(words)] = f"n{rng.randrange(10 ** 6)}"
        out.append(copy)
    return [" ".join(w) for w in out]


def jaccard_classes(texts, least=0.8):
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_drifting_copies_keep_every_link(spark, monkeypatch):
    from quillwork.llm import jaccard
    asked = []
    plain_confirmed = jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda pairs, sets, least: asked.append(pairs.count()) or plain_confirmed(pairs, sets, least))
    texts = drifting(1000) + drifting(60, 40, 4, 5) + [" ".join(f"w{random.Random(i).randrange(60)}" for _ in range(40)) for i in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2000, texts[3]), (None, texts[4]), (2001, None), (2002, " \n "), (2002, " \n ")]
    docs = spark.createDataFrame([(i, t, "g", 1.0) for i, t in rows], "doc_id bigint, text string, `group` string, f double").repartition(4)
    got = collections.Counter(map(tuple, jaccard.near_duplicates(docs).collect()))
    want = jaccard_classes(texts)
    assert got == collections.Counter([*enumerate(want), (2000, want[3]), (None, want[4]), (2001, 2001), (2002, 2001), (2002, 2001)])
    assert sum(asked) < 25 * len(texts), asked


# --- bounded samples ---------------------------------------------------------

def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    from quillwork.llm import langid, toxicity
    rows = [(7, f"same id {i} text")  for i in range(3000)] + [(100 + i, f"alpha beta gamma {i}") for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in rows], "doc_id bigint, text string, lang string").repartition(4)
    seen = []
    plain_fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda bits, labels: seen.append(len(labels)) or plain_fit(bits, labels))
    langid.train(docs, sample_rows=200)
    assert 0 < seen[0] <= 250
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, i % 2) for i in range(3000)], "doc_id bigint, toxic int")
    net = toxicity.train(docs.withColumn("text", F.when(F.col("doc_id") == 101, F.repeat("text", 20000)).otherwise(F.col("text"))),
                         labels, sample_rows=100)
    assert len(net.words) < 200
