"""Corpus operators against plain versions on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import (components, contamination, langid, licences, linededup, packing, quality, simhash, substring, toxicity,
                           warc)
from quillwork.llm.textkit import Rolling, new_folder, sliding_min

DOCS = "doc_id bigint, text string, fp string, id string, key string, row string, rest string, n_words string"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Ids and texts: null and blank texts, copies, near copies, shared passages, a long text, repeated rows, a null id."""
    base = prose(1, 300)
    passage = " ".join(prose(2, 70))
    out = [(0, None), (1, ""), (2, " \t\n "), (3, " ".join(base)), (4, " ".join(base).upper()), (5, " ".join(base)),
           (6, " ".join(base[:150] + ["changed"] + base[151:])), (7, "one"), (8, "one two three"), (9, "One  two\tthree"),
           (10, " ".join(prose(3, 60)) + "\n" + passage + "\n" + " ".join(prose(4, 60))),
           (11, passage + " " + " ".join(prose(5, 30))), (12, "x\x0by\x0cz é ü ß　q"), (13, " ".join(prose(6, 6000))),
           (14, "again and again " * 90), (14, "again and again " * 90), (15, passage), (None, passage), (16, "é" * 40)]
    out += [(20 + i, " ".join(prose(100 + i, 120)[:80] + base[40:100] + [str(i)])) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "k", "r", "s", "w") for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def words_of(text):
    return (text or "").encode().split()


def fingerprint(text, width):
    words = [w.lower() for w in words_of(text)]
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a in range(len(values)):
            for b in range(a):
                if label[a] != label[b] and linked(values[a], values[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_matches_brute_force(docs, rows, empty):
    got = bag(simhash.near_duplicates(docs, width=4, max_bits=4, slab=4), "doc_id", "fp", "component_id")
    prints = [fingerprint(t, 4) for _, t in rows]
    label = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert got == collections.Counter((rows[i][0], signed[i], least[label[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(empty).count() == 0


def test_spark_hash_is_the_contract_hash(spark):
    texts = ["", "a", "four words in here", "é" * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 200), st.integers(0, 6))
def test_gray_index_keeps_every_class(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (n, spread)).astype(np.uint64)) if spread else np.zeros((n, 1), dtype=np.uint64)
    index = simhash.GrayIndex(np.unique(rng.choice(centres, n) ^ np.bitwise_xor.reduce(flips, axis=1)))
    fps = index.fps.tolist()
    assert index.classes(4).tolist() == classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = bag(components.components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "root")
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == collections.Counter(want.items())
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_archives_round_trip(spark):
    big, nested = "<p>" + "body " * 400, gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n").decode("latin-1")
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "v", "small"),
             (7, "w", big), (7, "w", big), (8, "n", nested * 20), (9, "l", "".join(prose(9, 60000, 20000))), (None, "z", big), (10, "é", "é" * 600)]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, refers_to string").repartition(3)
    archives = warc.write_archives(table, new_folder(spark, "warc"), archive_bytes=20000)
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    last = {}
    for p, body in payloads:
        if p is not None:
            last[body] = max(p, last.get(body, p))
    want = collections.Counter()
    for p, body in payloads:
        revisit = p is not None and len(body) >= 1000 and last[body] > p
        want[(p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[body] if revisit else None)] += 1
    for size in (777, 16 << 20):  # every record belongs to one range, however ranges fall
        read = warc.digests(warc.read_archives(archives, range_bytes=size))
        assert bag(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.read_archives(warc.write_archives(table.limit(0), new_folder(spark, "warc"))).count() == 0
    with gzip.open(archives.first().path.removeprefix("file:"), "rb") as whole:
        assert whole.read().startswith(b"WARC/1.1\r\n")


def test_stored_gzip_inside_a_record_is_no_record():
    inner = warc.gzip_member(b"WARC/1.1\r\nContent-Length: 5\r\n\r\n12", 9)
    outer = warc.gzip_member(warc.record(1, "u", inner * 3, b"\0" * 20, None), 0)  # stored, so the magic shows
    data = warc.gzip_member(warc.record(0, "u", b"first", b"\0" * 20, None), 6) + outer + b"junk\x1f\x8b\x08"
    for cut in range(0, len(data), 13):
        found = [*warc.members(io.BytesIO(data), 0, cut), *warc.members(io.BytesIO(data), cut, len(data))]
        assert [warc.parse(x)[0] for x in found] == [0, 1]


def test_packing_covers_every_id_once(docs, rows, empty):
    tokenizer = packing.WordCache(packing.vocabulary_path()).tokenizer
    got = packing.pack(docs, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in got)
    seen = collections.defaultdict(list)
    for r in got:
        assert 4 * r.length == len(r.ids)
        seen[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i, text in rows:
        if i == 14:  # a row that is there twice
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(seen[i])
        assert [x for _, part, _ in parts for x in part] == ids and {t for *_, t in parts} == {len(ids)}
        assert [s for s, *_ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts])[:-1].tolist()
    assert len(seen[14]) == 2 * len(packing.pieces(seen[14][0][2], 64))
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aéÉßİſǅ ,.'0１\n\t\x0b 　|<>"), st.characters(exclude_categories=["Cs"])), max_size=30)))
def test_word_cache_gives_the_tokenizers_ids(texts):
    cache = test_word_cache_gives_the_tokenizers_ids.cache
    want = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert cache.ids(texts) == want


test_word_cache_gives_the_tokenizers_ids.cache = packing.WordCache(packing.vocabulary_path(), limit=50)


def test_substring_matches_brute_force(docs, rows, empty):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k:k + 50])
            first[key] = min(i, first.get(key, i))
    want = collections.Counter()
    for i, t in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    out = substring.remove_repeats(docs).withColumn("sha", F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))))
    assert bag(out, "doc_id", "n_words", "n_removed", "sha") == want
    assert sum(n for (_, _, r, _), n in want.items() if r) > 20
    assert substring.remove_repeats(empty).count() == 0


def test_substring_takes_every_place_of_a_stretch(spark):
    """A passage of an earlier document that a later id has several times between the same words, in one text or two."""
    x, p, y = prose(70, 60), prose(71, 80), prose(72, 60)
    again = x + p + y + prose(73, 30) + x + p + y
    rows = [(3, prose(74, 60) + p + prose(75, 60)), (5, again), (6, prose(76, 60) + p + prose(77, 60)), (7, again[:200]),
            (8, prose(78, 55) + x + p + y), (8, prose(79, 55) + x + p + y), (8, prose(79, 20) + again)]
    first, want = {}, collections.Counter()
    for i, w in rows:
        for k in range(len(w) - 49):
            first[tuple(w[k:k + 50])] = min(i, first.get(tuple(w[k:k + 50]), i))
    for i, w in rows:
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for j in range(k, k + 50)}
        kept = None if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), kept)] += 1
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(3)
    assert (5, len(again), 160) in {k[:3] for k in want}
    assert bag(substring.remove_repeats(table), "doc_id", "n_words", "n_removed", "kept") == want


def test_rolling_hashes_and_minima():
    values = np.random.default_rng(0).integers(0, 2 ** 63, 500, dtype=np.uint64)
    values[300:350] = values[100:150]
    roll = Rolling(substring.FIRST)
    assert (roll(values, 20)[300:331] == roll(values, 20)[100:131]).all() and len(set(roll(values, 20).tolist())) == 481 - 31
    assert sliding_min(values, 35).tolist() == [values[i:i + 35].min() for i in range(466)]
    assert roll.stretches(values, np.array([100]), np.array([150])) == roll.stretches(values, np.array([300]), np.array([350]))


def test_licences(spark, empty):
    apache = licences.TEMPLATES["Apache-2.0"][1]
    texts = {0: None, 1: "", 2: "words\nReleased under the MIT License.\nmore", 3: "Licensed under CC BY-NC 4.0.",
             4: "intro\n\n" + apache.replace(" you may", "\nyou may") + "\n\noutro", 5: apache.upper(), 6: "the MIT way of life", 7: "x " * 5000,
             8: "This work is licensed under the GNU General Public License, version 3."}
    got = licences.find_licences(spark.createDataFrame([(i, t, "e") for i, t in texts.items()], "doc_id bigint, text string, hits string"))
    names = {r.doc_id: sorted({h.licence for h in r.hits}) for r in got.collect()}
    assert names == {0: [], 1: [], 2: ["MIT"], 3: ["CC-BY-NC-4.0"], 4: ["Apache-2.0"], 5: ["Apache-2.0"], 6: [], 7: [], 8: ["GPL-3.0"]}
    assert licences.find_licences(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("licensed under the mit license apache version 2 0 cc by nc a b".split()), max_size=14))
def test_size_bounds_lose_no_licence(words):
    text, t = " ".join(words), 0.8
    every = [(-licences.dice(licences.bigrams(text), licences.bigrams(x)), n) for n, xs in licences.TEMPLATES.items() for x in xs]
    score, name = min(every)
    assert licences.Templates(licences.TEMPLATES, t).best(text) == ((name, -score) if -score >= t else None)


def test_quality_counts_and_verdict(docs, rows, empty):
    got = quality.weak_quality(docs)
    want = collections.Counter()
    for i, t in rows:
        text, w = t or "", words_of(t)
        grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        inside = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        want[(i, len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed)] += 1
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not got.filter("base_failed AND kept").count() and quality.weak_quality(empty).count() == 0


def test_expectation_maximisation_matches_numpy(spark):
    rng = np.random.default_rng(4)
    good = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, 3)) < 0.2, 0, np.where(good[:, None] ^ (rng.random((4000, 3)) < [0.1, 0.2, 0.3]), 1, -1))
    counted = collections.Counter(map(tuple, votes.tolist()))
    model = quality.fit(spark.createDataFrame([(list(k), n) for k, n in counted.items()], "votes array<int>, n bigint"), rules=3, rounds=30).first()
    p, n = np.array(list(counted)), np.array(list(counted.values()))
    share, hit, miss = 0.8, np.full(3, 0.9), np.full(3, 0.6)
    for _ in range(30):
        odds = np.log(share / (1 - share)) + ((p == 1) * np.log(hit / (1 - miss)) + (p == -1) * np.log((1 - hit) / miss)).sum(axis=1)
        r = 1 / (1 + np.exp(-odds))
        share = ((n * r).sum() + 0.8) / (n.sum() + 1)
        hit = (((p == 1) * (n * r)[:, None]).sum(axis=0) + 0.9) / (((p != 0) * (n * r)[:, None]).sum(axis=0) + 1)
        miss = (((p == -1) * (n * (1 - r))[:, None]).sum(axis=0) + 0.6) / (((p != 0) * (n * (1 - r))[:, None]).sum(axis=0) + 1)
    assert np.allclose([model["share"], *model["good"], *model["bad"]], [share, *hit, *miss])
    assert abs(model["share"] - 0.7) < 0.05 and np.allclose(model["good"], [0.9, 0.8, 0.7], atol=0.06)


def test_language_kernel_and_edges(spark, empty):
    rng = random.Random(3)
    syllables = {"aa": ["the", "ing", "er"], "bb": ["sch", "ung", "ä"], "cc": ["ção", "os", "mente"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang, 5 + i % 40), lang, "e") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa", "e"), (901, "123 !?", "bb", "e"), (902, "", None, "e"), (903, text("cc", 3000), None, "e"), (None, text("aa", 9), "aa", "e")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, bits string")
    model = langid.train(table.filter("doc_id < 90"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows[:120]) and got[903][0] == "cc" and got[None][0] == "aa"
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(table, nothing).collect()} == {"und"} and langid.predict(empty, model).count() == 0
    # the folded matrix is the kernel machine: K(x, marks) K(marks, marks)^-1/2 w
    a, b = langid.presence("abc"), langid.presence("abd")
    assert np.isclose((langid.normed(a[None]) @ langid.normed(b[None]).T).item(), (a & b).sum() / np.sqrt(a.sum() * b.sum()))


def test_network_derivatives():
    net = toxicity.Network.start({"word": 9, "gram": 40, "head": 30}, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.read_words([b"ab cd efg hello world foo, bar baz" * 3, b"xx yy"])
    words.word, words.grams, words.heads = words.word % 9, words.grams % 40, words.heads % 30
    ids = np.concatenate([toxicity.windows_of(r) for r in words.texts])
    target, weight = np.array([1.0, 0.0]), np.array([0.3, 0.7])

    def loss():
        logit = net.forward(net.projected(net.inputs(words)), ids)
        return float((weight * (np.logaddexp(0, logit) - target * logit)).sum())

    _, grad = net.gradients(words, ids, target, weight)
    for name, value in net.p.items():
        flat, slope = value.reshape(-1), grad[name].ravel()
        for i in np.argsort(-np.abs(slope))[:3]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert np.isclose(slope[i], (up - down) / 2e-2, rtol=2e-2, atol=1e-5), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        row = np.arange(1, n + 1, dtype=np.int32)
        assert set(toxicity.windows_of(row).ravel().tolist()) - {0} == set(range(1, n + 1))


def test_toxicity_learns_and_handles_edges(spark, empty):
    bad = ["grubwort", "fiesling", "schuft"]
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = prose(1000 + i, rng.randint(20, 150), 300)
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "en", ","]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame([(i, t, "e") for i, t, _ in rows] + [(900, None, "e"), (901, " ", "e"), (902, " ".join(prose(8, 9000)), "e"),
                                  (903, " ".join(prose(9, 4000) + bad), "e"), (904, "grubwort", "e"), (None, "x", "e")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(900, None), (None, 1)], "doc_id bigint, toxic int")
    net = toxicity.train(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, net).collect()}
    right = [(got[i] >= 0.5) == y for i, _, y in rows if i % 5 == 0]
    assert np.mean(right) > 0.95 and got[903] >= 0.5 and got[902] < 0.5 and got[900] < 0.5 and got[901] < 0.5
    kept = {r.doc_id for r in toxicity.filter_clean(table, net).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert toxicity.score(empty, net).count() == 0
    unlabelled = toxicity.train(table, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(table, unlabelled).collect())


LONG, LONGER = " ".join(prose(70, 60)), " ".join(prose(71, 200))
LINES = [(0, None), (1, ""), (2, "a\nb\nc\nd"), (3, "x\na\nb\n c \ny"), (4, "b\nc\nd\ne"), (5, "a\nb"), (6, "r\n" * 9), (7, "q\na\nb\nc\nd\nz\na\nb\nc"),
         (8, "a\nb\nc\nd"), (8, "a\nb\nc\nd"), (9, "\n\n\n"), (None, "a\nb\nc"), (10, "\n".join(str(i) for i in range(500)) + "\nb\nc\nd"),
         (11, LONGER), (12, "top\n" + LONGER + "\nend"), (13, LONG + "\nshort\nown"), (14, "w\n" + LONG + "\nshort\nother\n" + LONG), (15, LONGER + "\nend"),
         (16, "one two three\n" + LONG[:130]), (17, "p\none two three\n" + LONG[:130] + "\nq"), (18, LONG[:130] + "\nsix"), (None, LONG)]


def without_repeats(rows, least_lines, least_words):
    """Texts, lines and removed lines by trying every run of lines."""
    split = lambda t: [] if t is None else t.split("\n")
    first, out = {}, []

    def runs(i, t):
        lines = [x.strip() for x in split(t)]
        for a in range(len(lines) if i is not None else 0):
            for b in range(a + 1, min(len(lines), a + 6) + 1):
                if b - a >= least_lines or sum(len(x.split()) for x in lines[a:b]) >= least_words:
                    yield a, b, tuple(lines[a:b])

    for i, t in rows:
        for a, _, run in runs(i, t):
            first[run] = min((i, a), first.get(run, (i, a)))
    for i, t in rows:
        gone = {k for a, b, run in runs(i, t) if first[run] < (i, a) for k in range(a, b)}
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(split(t)) if k not in gone), len(split(t)), len(gone)))
    return out


def test_repeated_lines_match_brute_force(spark, empty):
    schema = "doc_id bigint, text string, rest string, n_chars bigint"
    table = spark.createDataFrame([(i, t, "e", len(t or "")) for i, t in LINES], schema).repartition(3)
    for least_lines, least_words in ((3, 50), (2, 60), (1, 1000), (4, 5), (5, 10 ** 6)):
        got = bag(linededup.drop_repeated_lines(table, least_lines=least_lines, least_words=least_words), "doc_id", "text", "n_lines", "n_removed")
        assert got == collections.Counter(without_repeats(LINES, least_lines, least_words))
    texts = {r.doc_id: r.text for r in linededup.drop_repeated_lines(table).collect()}
    assert texts[12] == "top\nend" and texts[14] == "w\nother" and texts[15] == "" and texts[18] == LONG[:130] + "\nsix"
    kept = linededup.rewrite(table)
    assert kept.columns == table.columns and bag(kept, "n_chars") == collections.Counter((len(r.text or ""),) for r in kept.collect())
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_repeated_lines_of_random_texts(spark):
    rng = random.Random(5)
    pool = ["", " ", "a", "b b", "c c c c", "d " * 9, "e " * 12, "f " * 20]
    rows = [(rng.randrange(40), "\n".join(rng.choice(pool) + rng.choice(["", "", "", str(k)]) for _ in range(rng.randrange(9)))) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for least_lines, least_words in ((3, 10), (4, 18)):
        got = bag(linededup.drop_repeated_lines(table, least_lines=least_lines, least_words=least_words), "doc_id", "text", "n_lines", "n_removed")
        assert got == collections.Counter(without_repeats(rows, least_lines, least_words))


def test_contamination_matches_brute_force(spark, docs, rows, empty):
    norm = lambda t: [w for w in bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in (t or "").encode()).split()]
    text = dict(rows)
    items = [(1, " ".join(text[3].split()[20:45])), (2, "One, two! THREE"), (3, None), (4, " ... "), (5, text[15]), (6, text[15]), (1, "again and again"),
             (None, " ".join(text[13].split()[100:140])), (7, "never seen words here at all")]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id bigint, text string, id string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add(i)
    want = collections.Counter()
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        want[(i, len(w), len(hit), tuple(sorted(found - {None})))] += 1
    for block in (8 << 20, 200):  # one block of phrases and several
        got = contamination.contaminated_spans(docs, bench, block_bytes=block).withColumn("n", F.expr("aggregate(spans, 0L, (s, x) -> s + x.stop - x.start)"))
        assert collections.Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got.collect()) == want
    # many equal items are one phrase with all their ids, of any type
    many = bench.filter("item_id = 5").crossJoin(spark.range(300).withColumnRenamed("id", "n")).select(
        F.col("n").cast("decimal(10,1)").alias("item_id"), "text").repartition(5)
    got = contamination.contaminated_spans(docs, many.union(many), block_bytes=5000).filter("n_hit > 0").collect()
    assert got and all(list(map(int, r["items"])) == list(range(300)) for r in got)
    assert contamination.contaminated_spans(empty, bench).count() == 0
    assert contamination.contaminated_spans(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    clean = contamination.filter_clean(docs, bench)
    assert clean.columns == docs.columns
    assert collections.Counter(r.doc_id for r in clean.collect()) == sum((collections.Counter({i: n}) for (i, w, h, _), n in want.items() if not (h and 20 * h >= w)), collections.Counter())


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(7)
    text = np.append(rng.integers(0, 5, 600), 0)
    index = contamination.FmIndex(text, 4)
    patterns = [p for n in (1, 2, 3) for p in np.ndindex(*([4] * n))]
    rows = np.zeros((len(patterns), 3), dtype=np.int64)
    for k, p in enumerate(patterns):
        rows[k, 3 - len(p):] = np.array(p) + 1
    lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == np.array(p) + 1).all()]
        assert sorted(index.locate(np.arange(lo[k], max(lo[k], hi[k]))).tolist()) == want



def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    """10,000 whole texts at a time once took some 50 MB a task, twice: in the executor and in its worker."""
    from quillwork.llm.textkit import BATCH_BYTES_KEY, bound_batches
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 1000) as text")
    before = spark.conf.get(BATCH_BYTES_KEY, None)
    try:
        bound_batches(spark)
        sizes = [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()]
        assert sum(sizes) > 30 << 20 and max(sizes) < 9 << 20
        spark.conf.set(BATCH_BYTES_KEY, "1m")
        bound_batches(spark)
        assert spark.conf.get(BATCH_BYTES_KEY) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES_KEY) if before is None else spark.conf.set(BATCH_BYTES_KEY, before)


def test_stored_tables_leave_no_shuffle_files(spark):
    """Shuffle files of finished steps once stayed until the driver collected its garbage, and filled the disk of op4."""
    import time

    from quillwork.llm.textkit import store
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = manager.getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    query = spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.collect_set("id").alias("ids"))
    held = store(query, "held")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, None) is None
    assert held.count() == 7 and query.count() == 7
