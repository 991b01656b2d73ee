"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from purchaseflow.llm import bpe, chat, components, exact_dedup, html_text, minhash, packing, quality_rules, queries, suffix_dedup, warc, weak_labels
from purchaseflow.llm.common import new_folder
from purchaseflow.llm.suffix_sort import suffix_array

DOCS = "doc_id long, text string, n_words string, label string"  # the last two clash with names that operators use inside
ODD = [
    (5, "same  text here", "x", "y"), (3, "same text\there", "x", "y"), (3, "same text\there", "x", "y"), (9, None, None, None), (8, "", "x", "y"), (7, " \n ", "x", "y"),
    (None, "same text here", "x", "y"), (10, "é" * 300, "x", "y"), (11, "word " * 20_000, "x", "y"), (12, "\x1c odd \x85 space", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# --- exact dedup ---------------------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[squeeze(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_on_odd_rows(odd, empty):
    got = sorted(map(tuple, exact_dedup.exact_dedup(odd).collect()), key=repr)
    assert got == brute_exact([(r[0], r[1]) for r in ODD])
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    assert sorted((r.doc_id or -1) for r in exact_dedup.drop_copies(odd).collect()) == [3, 3, 7, 8, 10, 11, 12]


def test_exact_dedup_spills_by_subtree(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted(map(tuple, exact_dedup.exact_dedup(small, limit=4000).collect()), key=repr) == brute_exact(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 50)), max_size=60), st.sampled_from([150, 1 << 20]))
def test_trie_holds_what_was_put_in(rows, limit):
    trie, want = exact_dedup.Trie(limit), {}
    for k, i in rows:
        trie.add(k, i, 1)
        least, n = want.get(k, (i, 0))
        want[k] = (min(least, i), n + 1)
    assert {k: (i, n) for k, i, n in trie.items()} == want


def test_long_single_strings_keep_the_limit():
    trie, keys = exact_dedup.Trie(2000), [bytes([c]) * 3000 for c in range(65, 91)] + [b"Z" * k for k in range(1, 400)]
    for k in keys * 2:
        trie.add(k, 1, 1)
    assert trie.limit == 2000
    assert {k: n for k, _, n in trie.items()} == {k: 2 for k in keys}


# --- suffix sorting and passages -----------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 200), max_size=60), st.lists(st.integers(1, 2), max_size=7).map(lambda x: x * 8)))
def test_suffix_array(items):
    text = [*items, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_spans(rows, length):
    first = {}
    data = [(suffix_dedup.order_of(i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((i, b, list(zip(edge[::2].tolist(), edge[1::2].tolist()))))
    return sorted(out, key=repr)


def spans_of(df):
    return sorted(((suffix_dedup.order_of(r[0]), bytes(r.data), [(s.begin, s.end) for s in r.spans]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length,hot", [(50, suffix_dedup.HOT), (50, 1), (7, suffix_dedup.HOT), (7, 2)])
def test_passages_against_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "SLICE", 2000)
    rng = random.Random(length)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    shared = [" ".join(rng.choices(words, k=30)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(shared)[rng.randint(0, 40) :], " ".join(rng.choices(words, k=rng.randint(0, 25))), "ab" * rng.randint(0, 90), "x" * rng.randint(0, 200)]) for _ in range(4)]
        rows.append((rng.choice([i, i, None, rng.randint(0, 60)]), rng.choice([" ".join(parts), shared[0], None, ""])))
    rows += rows[:3]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    assert spans_of(suffix_dedup.repeated_spans(df, length=length, hot=hot)) == brute_spans(rows, length)


@pytest.mark.parametrize("parts", [8, 51, 480, 5000, 50_000])
def test_first_step_of_passages_stays_small(small, parts):
    """What step 1 sends is bounded by the bytes of the texts, into however many parts it is dealt."""
    texts = [(k, (r.text or "").encode()) for k, r in enumerate(small.collect())] * 8
    batch = pa.RecordBatch.from_arrays([pa.array([k * 7919 + n for n, (k, _) in enumerate(texts)], pa.int64()), pa.array([t for _, t in texts], pa.binary())], names=["key", "data"])
    sent = sum(b.nbytes for b in suffix_dedup._scan(50, parts)(iter([batch])))
    assert sent <= 1.2 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("parts", [7, 70_000])
def test_homes_hear_only_of_their_own_hot_classes(small, parts):
    """What is told of hot classes goes to the homes of rows that have them, each once, however many parts there are."""
    texts = [(k, (r.text or "").encode()) for k, r in enumerate(small.collect())]
    batches = [pa.RecordBatch.from_arrays([pa.array([k * 7919 for k, _ in some], pa.int64()), pa.array([t for _, t in some], pa.binary())], names=["key", "data"]) for some in (texts[::2], texts[1::2], texts)]
    sent = [b for batch in batches for b in suffix_dedup._scan(50, parts)(iter([batch]))]
    told, hot = set(), []
    for b in suffix_dedup._meet(parts, 1)(iter(sent)):
        for home, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
            if kind == suffix_dedup.TOLD:
                tag, n, gram = suffix_dedup.unpacked(blob, "<u4", "<u2", "<u4")
                assert set((tag % parts).tolist()) == {home}
                told |= {(home, g) for g in gram.tolist()}
            elif kind == suffix_dedup.HOTS:
                low, _ = suffix_dedup.unpacked(blob, "<u4", "<u2")
                hot += [(home, g) for g in low.tolist()]
    assert hot and set(hot) == told  # with a limit of one context every shared class is hot


def test_packed_arrays_come_back():
    arrays = [np.arange(n, dtype="<u4") for n in (0, 1, 254, 255, 256, 70_000)]
    back = suffix_dedup.unpacked(suffix_dedup.packed(*arrays), *["<u4"] * len(arrays))
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, back))


def test_passages_on_odd_rows(odd, empty):
    assert spans_of(suffix_dedup.repeated_spans(odd)) == brute_spans([(r[0], r[1]) for r in ODD], 50)
    assert suffix_dedup.repeated_spans(empty).count() == 0


CLASHES = ["_gone", "_sha", "_name", "_code", "_text", "my-col", "a.b", "row", "data", "key", "gone", "sha", "spans", "n", "`x`"]


def test_stages_take_columns_of_any_name(spark):
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    rows = [(1, text), (2, text), (3, text + " x"), (4, "other " + text[::-1])]
    df = spark.createDataFrame([(i, t, *range(len(CLASHES))) for i, t in rows], ["doc_id", "text", *CLASHES])
    assert sorted(r.doc_id for r in quality_rules.keep_good(df).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in minhash.drop_near(df).collect()) == [1, 4]
    cut = suffix_dedup.cut_repeats(df)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: text, 2: "", 3: " x", 4: "other " + text[::-1]}
    for stage in (quality_rules.keep_good, exact_dedup.drop_copies, minhash.drop_near, suffix_dedup.cut_repeats):
        out = stage(df)
        assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(CLASHES)))}
    assert packing.best_fit(df, packing.word_count()).count() == 4
    named = df.withColumnRenamed("doc_id", "my-id").withColumnRenamed("text", "the.text")
    assert quality_rules.keep_good(named, id_col="my-id", text_col="the.text").count() == 4
    assert exact_dedup.drop_copies(named, "my-id", "the.text").count() == 3 and minhash.drop_near(named, "my-id", "the.text").count() == 2
    assert suffix_dedup.cut_repeats(named, "my-id", "the.text").columns == named.columns


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    for stage in (exact_dedup.drop_copies, minhash.drop_near, suffix_dedup.cut_repeats, suffix_dedup.repeated_spans):
        with pytest.raises(TypeError):
            stage(df)


def test_cut_text_keeps_whole_characters(spark):
    rows = [(1, "é" * 60, "x", "y"), (2, "a" + "é" * 60 + "b", "x", "y")]
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "é" * 60, 2: "ab"}


# --- near duplicates -----------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = (text or "").encode().translate(minhash.LOWER_ASCII).split()
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_near(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or i == find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width,percent,bucket,block", [(3, 85, 20_000, 4_000_000), (5, 80, 20_000, 4_000_000), (3, 85, 2, 400)])
def test_near_duplicates_against_brute_force(spark, width, percent, bucket, block):
    rng = random.Random(width)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(80)}" for _ in range(rng.choice([40, 150]))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 8))) for k in range(25)]
    rows += [(500, "One two"), (501, "one TWO"), (502, "one"), (503, None), (504, " "), (None, "one two"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = minhash.near_dedup(df, width=width, percent=percent, bucket=bucket, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(rows, width, percent)


def test_near_duplicates_on_odd_rows(odd, empty):
    got = sorted(map(tuple, minhash.near_dedup(odd).collect()), key=repr)
    assert got == brute_near([(r[0], r[1]) for r in ODD], 3, 85)
    assert minhash.near_dedup(empty).count() == 0
    assert minhash.drop_near(odd).columns == odd.columns


def test_pigeonhole_keys():
    """Signatures that differ in up to 2 * chunks - 1 symbols share a key."""
    rng = np.random.default_rng(1)
    chunks = minhash.chunks_for(85)
    assert minhash.beyond(chunks * minhash.WIDTH, 0.15, minhash.far_for(chunks)) <= minhash.MISS
    for _ in range(300):
        a = rng.integers(0, 65536, chunks * minhash.WIDTH, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(len(a), 2 * chunks - 1, replace=False)
        b[at] ^= 1
        assert minhash.far_for(chunks) == len(at)
        ka, kb = minhash.keys_of(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame([*links, (5, 5)], "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- rules ---------------------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, small, odd, empty):
    for df in (small, odd):
        want = Counter((r.doc_id, *brute_measures(r.text)) for r in df.collect())
        assert Counter(tuple(r)[:6] for r in quality_rules.measure(df).collect()) == want
    assert quality_rules.ledger(empty).count() == 0


def test_query_of_rules(spark, sf_dir, small):
    for r, q in zip(small.orderBy("doc_id").collect(), queries.op7_quality_rules(spark, sf_dir).orderBy("doc_id").collect()):
        n, chars, symbols, dup, rep = brute_measures(r.text)
        assert tuple(q)[:6] == (r.doc_id, n, chars, symbols, dup, rep)
        assert q.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (q.kept and q.base_failed)


def test_ledger_policies_and_ablations(small):
    book = quality_rules.ledger(small).cache()
    rows = book.collect()
    for p in quality_rules.POLICIES:
        bad = {r.bit for r in quality_rules.RULES if r.name in p.rules}
        kept = sum(not any(r.failed_bits >> b & 1 for b in bad) for r in rows)
        assert quality_rules.apply_policies(book).where(f"kept_{p.version}").count() == kept
        for a in quality_rules.ablations(book, (p,)).collect():
            own = next(r.bit for r in quality_rules.RULES if r.name == a.rule)
            without = sum(not any(r.failed_bits >> b & 1 for b in bad - {own}) for r in rows)
            assert (a.n_docs, a.kept_with, a.kept_without, a.only_this) == (len(rows), kept, without, without - kept)


def test_rules_keep_good_documents(spark, sf_dir, small):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    labelled = small.join(good, "doc_id")
    long_ones = labelled.where("size(split(text, ' ')) >= 60")
    assert quality_rules.keep_good(long_ones.select(*small.columns)).count() >= 0.98 * long_ones.count()


def test_keep_good_returns_columns_as_they_came(odd):
    kept = quality_rules.keep_good(odd, quality_rules.Policy("any", ()))
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))


# --- weak labels ---------------------------------------------------------------------------------------------------


def test_weak_labels_agree_with_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_weak_labels(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.9


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    right = np.linspace(0.65, 0.95, len(weak_labels.LABELLERS))
    truth = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, len(right))) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = weak_labels.NONE
    code = votes @ (3 ** np.arange(len(right))[::-1])
    patterns, counts = np.unique(code, return_counts=True)
    found = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(found.prior - 0.8) < 0.02
    for (_, bad, good), r in zip(found.accuracies(), right):
        assert abs(bad - r) < 0.04 and abs(good - r) < 0.03


def test_fitting_sample_counts_texts_not_copies(spark, monkeypatch):
    good = [(k, f"{k} the man of the house was in the garden and it is said that he had not been there for {k} days or more") for k in range(300)]
    bad = [(1000 + k, f"$$$ ### %%% WIN {k if k < 60 else 60 + k % 3} NOW !!! *** $$$ BUY !!! ### &&& FREE !!!") for k in range(3000)]
    fitted, fit = [], weak_labels.fit
    monkeypatch.setattr(weak_labels, "fit", lambda rows: fitted.extend(rows) or fit(rows))
    for sample, n_good, n_bad in ((40, 20, 20), (200, 100, 63)):
        fitted.clear()
        got = weak_labels.classify(spark.createDataFrame(good + bad, "doc_id long, text string").repartition(8), sample=sample).collect()
        assert (sum(y > 0.5 for *_, y in fitted), sum(y <= 0.5 for *_, y in fitted)) == (n_good, n_bad)
        assert all(r.kept == (r.doc_id < 1000) for r in got)


def plain_weak_labels(rows, sample):
    """Posterior and score by plain means: EM over every row's votes, features word by word, the fit over the same texts."""
    labels = len(weak_labels.LABELLERS)
    votes = [[f(weak_labels.facts(d)) for _, f in weak_labels.LABELLERS] for _, d in rows]
    q = []
    for v in votes:
        good, bad = v.count(weak_labels.GOOD), v.count(weak_labels.BAD)
        q.append(0.5 * good / (good + 2 * bad) if bad else 0.95)
    before = None
    for _ in range(weak_labels.ROUNDS):
        prior = (sum(q) + 1) / (len(q) + 2)
        shares = []
        for j in range(labels):
            both = []
            for weight in ([1 - x for x in q], q):
                got = [1 + sum(w for w, v in zip(weight, votes) if v[j] == k) for k in range(3)]
                both.append([g / sum(got) for g in got])
            shares.append(both)
        odds = [math.log(prior / (1 - prior)) + sum(math.log(shares[j][1][v[j]] / shares[j][0][v[j]]) for j in range(labels)) for v in votes]
        q = [1 / (1 + math.exp(-o)) for o in odds]
        now = [x for a in shares for b in a for x in b]
        if before and max(abs(a - b) for a, b in zip(now, before)) < 1e-7:
            break
        before = now

    def vector(data):
        words, x = data.split(), defaultdict(float)
        for w in words:
            x[weak_labels._slot(b"w", w.lower())] += 1 / len(words)
            x[weak_labels._slot(b"s", weak_labels.shape(w))] += 1 / len(words)
        for s in weak_labels.ratio_slots(weak_labels.facts(data)):
            x[s] += 1
        return x

    first = {}
    for (_, d), y in zip(rows, q):
        first.setdefault(xxhash.xxh3_64_intdigest(d) >> 1, (d, y))
    chosen = []
    for label, most in ((True, sample - sample // 2), (False, sample // 2)):
        chosen += sorted(c for c, (_, y) in first.items() if (y > 0.5) == label)[:most]
    fitted = []
    for c in sorted(chosen):
        x = vector(first[c][0])
        fitted.append((np.array(list(x), np.int64), np.array(list(x.values())), first[c][1]))
    w, bias = weak_labels.fit(fitted)
    return [(i, y, 1 / (1 + math.exp(-(bias + sum(w[s] * v for s, v in vector(d).items()))))) for (i, d), y in zip(rows, q)]


@pytest.mark.parametrize("sample", [60, 4096])
def test_weak_labels_against_a_plain_version(small, sample):
    want = plain_weak_labels([(r.doc_id, (r.text or "").encode()) for r in small.collect()], sample)
    got = {r.doc_id: r for r in weak_labels.classify(small, sample=sample).collect()}
    assert len(got) == len(want)
    for i, label, score in want:
        assert abs(got[i].weak_label - label) < 1e-6 and abs(got[i].score - score) < 1e-5, i
        assert got[i].kept == (got[i].score >= weak_labels.THRESHOLD)


def test_columns_with_dots_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "some words here", 5, "x"), (2, None, 6, "y")], ["my.id", "the.text", "id", "ids"])
    path = queries.word_vocabulary()
    assert weak_labels.classify(df, "my.id", "the.text").columns[0] == "my.id"
    ids = bpe.encode(df, path, "my.id", "the.text")
    assert ids.columns == ["my.id", "ids"]
    assert sorted(map(tuple, bpe.decode(ids, path, "my.id").collect()), key=str) == sorted(map(tuple, bpe.encode_decode(df, path, "my.id", "the.text").collect()), key=str)
    pages = df.withColumnRenamed("ids", "a.url")
    assert {(r.page_id, r.payload_bytes) for r in warc.page_ids(warc.round_trip(pages, "my.id", "a.url", "the.text")).collect()} == {(1, 15), (2, 0)}


def test_weak_labels_on_odd_rows(odd, empty):
    assert Counter(r.doc_id for r in weak_labels.classify(odd).collect()) == Counter(r[0] for r in ODD)
    assert weak_labels.classify(empty).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def plain_pack(lengths, capacities):
    """The same rule without indexes: best fit over all open bins, expected fill by scanning what is left."""
    bins = []
    out = []
    for at, n in enumerate(lengths):
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= n]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b))
        else:
            best = None
            for c in capacities:
                if c < n:
                    continue
                room, used = c - n, n
                for m in lengths[at + 1 :]:
                    if m <= room:
                        room, used = room - m, used + m
                if best is None or packing.cost(c) / used < best[0]:
                    best = (packing.cost(c) / used, c)
            b = len(bins)
            bins.append([best[1], 0])
        out.append((b, bins[b][1]))
        bins[b][1] += n
    return [(b, min(c for c in capacities if c >= bins[b][1]), p) for b, p in out]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_against_plain_version(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.pack(lengths, (16, 32, 64)) == plain_pack(lengths, (16, 32, 64))


def test_packing_holds_every_word_once(spark, small, odd, empty):
    for df in (small, odd):
        rows = packing.best_fit(df, packing.word_count(), capacities=(64, 256, 1024), shard=50).collect()
        words = Counter()
        for r in df.collect():
            words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        found, bins = Counter({k: 0 for k in words}), defaultdict(list)
        for r in rows:
            found[r.doc_id] += r.n_words
            if r.bin is not None:
                bins[r.bin].append(r)
        assert found == words
        for held in bins.values():
            held.sort(key=lambda r: r.place)
            used = sum(r.n_words for r in held)
            assert [r.place for r in held] == np.cumsum([0, *(r.n_words for r in held)])[:-1].tolist()
            assert {r.capacity for r in held} == {min(c for c in (64, 256, 1024) if c >= used)}
    assert packing.best_fit(empty, packing.word_count()).count() == 0


def test_long_documents_take_many_shards(spark):
    rows = packing.best_fit(spark.createDataFrame([(1, "w " * 2000), (2, "w " * 1000)], "doc_id long, text string"), packing.word_count(), capacities=(8, 16), shard=10).collect()
    assert len({r.bin >> 32 for r in rows}) >= 10 and sum(r.n_words for r in rows) == 3000


# --- tokens --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.word_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    with open(queries.word_vocabulary()) as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cn", "Cs"]), max_size=40), st.text("abcdehinorst' .!A1é", max_size=60), st.sampled_from(["", "  ", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "ΑΣ ΟΔΟΣ", "don't we'll", "x" * 500, "İ"])))
def test_encoding_is_the_library_s(library, encoder, text):
    assert encoder.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_tables(spark, library, small, odd, empty):
    path = queries.word_vocabulary()
    for df in (small, odd):
        want = Counter()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
        for got in (bpe.decode(bpe.encode(df, path), path), bpe.encode_decode(df, path)):
            assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got.collect()) == want
    assert bpe.encode(empty, path).count() == bpe.encode_decode(empty, path).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------

TROUBLE = ["</s>", "<s>", "[INST]", "[/INST]", "[ANS]", "[ROLE x]", "[/ROLE]", "<\\/s>", "\\", "[", "<", " ", "\n", "ok", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]x", "", "a\nb"]), st.lists(st.sampled_from(TROUBLE), max_size=12).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    whole = ""
    for role, text in turns:
        segment, begin, end = chat.render_turn(role, text)
        assert chat.unescape(segment[begin:end]) == text
        whole += segment
    assert [x[:2] for x in chat.parse(whole)] == turns
    for _, _, begin, end in chat.parse(whole):
        assert chat.clean("", whole[begin:end])


def test_chat_tables(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 1, None, None), (2, 1, "assistant", None), (None, 1, "user", "x"), (2, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256("\n\nuser\n</s>[INST] ok [/INST]\nassistant\nb\n".encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_turns == 1
    assert chat.digests(chat.render(df.limit(0))).count() == 0


# --- archives ------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 1000
    rows = [(1, "http://a/x", big, 1), (2, "http://a/y%0A\n", big, 1), (3, None, None, 1), (None, "u", big, 1), (5, "u", "short", 1), (6, "u", "short", 1), (2, "http://b", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    folder = new_folder(spark, "warc-test")
    assert warc.write_archives(warc.captures_of(df), folder, roll=200).count() >= 1
    got = warc.assemble(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.requests) == len(r.metadata) == 1
    kinds = Counter((r.type, bytes(r.payload).decode() if r.payload is not None else None) for r in got)
    assert kinds == Counter({("response", big): 2, ("revisit", None): 2, ("response", "short"): 2, ("response", ""): 1})
    assert all(r.digest_ok for r in got if r.type == "response")
    assert Counter(r.target_uri for r in got) == Counter(r[1] for r in rows)
    ids = warc.page_ids(warc.assemble(spark, folder, payloads=False)).collect()
    assert Counter((r.page_id, r.type, r.to_page) for r in ids) == Counter([(1, "revisit", 2), (None, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (5, "response", None), (6, "response", None)])


def test_cut_off_archives_raise():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    assert len(list(warc.parse(io.BytesIO(whole * 2)))) == 2
    with pytest.raises(EOFError):
        list(warc.parse(io.BytesIO(whole + whole[:-8])))


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_ids(warc.round_trip(df)).count() == 0


def test_links_of_any_direction(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m2", "metadata", ["q2"]), ("x", "metadata", ["y"])]
    got = warc.membership(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")).collect()
    assert sorted(map(tuple, got)) == [("m1", "r1"), ("m2", "r2"), ("q1", "r1"), ("q2", "r2")]


# --- pages ---------------------------------------------------------------------------------------------------------


def test_main_text():
    prose = "The story of the fox and the hill is one that was told by the people of the town for many years and it is good. "
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body><div id="header"><a href="/">Home</a></div><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice"><p>{prose}</p></div><main><article><h1>Fox &amp; Hill</h1><p>{prose * 2}<p>Short&nbsp;one.</p><aside>{prose}</aside>
    <form><p>{prose}</p></form><script>var x = "<p>no</p>";</script><div class="ad">{prose}</div><p>{prose}</p></article></main>
    <section id="comments"><p>{prose * 3}</p></section><footer>&copy; us</footer></body></html>"""
    one = re.sub(r"\s+", " ", prose).strip()
    assert html_text.main_text(page) == f"Fox & Hill {one} {one} Short one. {one}"


@pytest.mark.parametrize("html", [None, "", "<p", "<", "&am", "<script>never closed", "<!-- open", "</div></div>", "<div " * 1000])
def test_broken_pages(html):
    assert html_text.main_text(html) == ""


PROSE = "The fox that was in the garden of the old house had come from the hills, and it is said that he was not alone there. "


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article><p>{}</p></article></body></html>",
        "<html><head><meta charset=utf-8><title>x</title><article><p>{}</p></article>",
        "<html><head><title>a < b</title><link rel=x href=y><style>p{{}}</style></head><body><article><p>{}</p></article>",
        "<html><head><title>x<body><article><p>{}</p></article>",
        "<article><svg width='5' viewBox=\"0 0 1 1\"/><p>{}</p></article>",
        "<article><math/><p>{}</p></article><svg><text>no</text></svg>",
        "<article><svg><svg><text>no</text></svg><title>no</title></svg><p>{}</p></article>",
        "<body><button><article><p>{}</p></article><button>no</button>",
        "<div><video></div><article><p>{}</p></article><video>no</video>",
        "<article><textarea><p>no</textarea><script>'<article>'</script><iframe>no</iframe><p>{}</p></article>",
        "<article><select><option>no<option>no</select><object><p>no</p></object><p>{}</p></article>",
    ],
)
def test_silent_elements_end(page):
    assert html_text.main_text(page.format(PROSE * 3)) == (PROSE * 3).strip()


FOREIGN = {
    "it": "Questa mattina abbiamo visto molte persone camminare lungo quel fiume, mentre alcuni bambini giocavano vicino alle vecchie case. ",
    "pl": "Wczoraj wieczorem pojechaliśmy nad jezioro, gdzie czekali nasi przyjaciele oraz ich rodzice z małymi dziećmi. ",
    "ru": "Вчера вечером мы поехали на озеро, где нас ждали друзья и их родители с маленькими детьми. ",
    "zh": "昨天晚上我们开车去了湖边，朋友们和他们的父母带着孩子在那里等着我们，大家一起吃了晚饭。",
}
FOOT = "<footer>us</footer>"


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post category-legal tag-ads'><p>{}</p></article>" + FOOT,
        "<article class='post legal'><p>{}</p></article>" + FOOT,
        "<div id='content' class='with-sidebar'><p>{}</p></div>" + FOOT,
        "<div class='post has-social comments-open'><p>{}</p></div>" + FOOT,
        "<body class='header-fixed nav-left'><p>{}</p></body>",
        "<div class='sidebar-right'><div class=menu><a href=/>Home</a></div><h1></h1><p>{}</p></div>" + FOOT,
        "<form action=x><div class='sidebar'><p>no</div><div><p>{}</p></div></form><div class='cookie-notice'><p>no</div>",
        "<form><div class='widget wide'><article><p>{}</p></article></div><section class=comments><p>" + PROSE + "</p></section></form>",
        "<div class='site-footer'><p>" + PROSE * 2 + "</p></div><div><p>{}</p></div>",
        "<div class=ad>" + PROSE * 9 + "</div><article><p>{}</p></article>",
        "<article><p>{}</p></article><section id=comments><article class=comment><p>" + PROSE * 20 + "</p></article></section>",
    ],
)
def test_place_words_mark_places_only(page):
    assert html_text.main_text(page.format(PROSE * 3)) == (PROSE * 3).strip()


@pytest.mark.parametrize("text", [PROSE, *FOREIGN.values()])
@pytest.mark.parametrize("times", [1, 4])
def test_pages_without_good_blocks(text, times):
    page = f"<div><a href=/>Home</a></div><div><p>{text * times}</p><p>{text * times}</p></div><footer>{text * 3}</footer>"
    assert html_text.main_text(page) == f"{(text * times).strip()} {(text * times).strip()}"


def plain_labels(page):
    """Both passes by the rules as they are told, each undecided block looking through all others."""
    T = html_text
    linky = [b.linked > T.LINKS * len(b.text) for b in page]
    prose = [b for b, k in zip(page, linky) if not b.outside and not k and b.size >= T.SHORT]
    weight = lambda some: sum(len(b.text) - b.linked for b in some)
    readable = 2 * weight([b for b in prose if b.stops >= T.STOPS_LOW]) >= weight(prose)
    first = []
    for b, k in zip(page, linky):
        wordy = b.size >= T.SHORT and (b.stops >= T.STOPS_LOW or not readable)
        dense = b.stops >= T.STOPS_HIGH or not readable and b.stops < T.STOPS_LOW
        if b.outside or k and not b.article:
            first.append("bad")
        elif k:
            first.append("near" if wordy else "unsure")
        elif b.size < T.SHORT:
            first.append("unsure")
        elif not wordy:
            first.append("unsure" if b.article else "bad")
        else:
            first.append("good" if b.article or dense and b.size > T.LONG else "near")
    menu = [f == "unsure" and k for f, k in zip(first, linky)]
    for i in range(len(page)):
        a, z = i, i
        while a > 0 and menu[a - 1]:
            a -= 1
        while z < len(page) and menu[z]:
            z += 1
        if menu[i] and z - a >= T.MENU:
            first[i] = "bad"
    if "good" not in first:
        first = ["good" if f == "near" and 2 * b.linked <= T.LINKS * len(b.text) else f for f, b in zip(first, page)]
    out = []
    for i, b in enumerate(page):
        if first[i] in ("good", "bad"):
            out.append(first[i] == "good")
            continue
        known = [(j, first[j]) for j in range(len(page)) if first[j] in ("good", "bad") and (not b.article or page[j].article == b.article and not page[j].outside)]
        if not b.article:
            known = [(-1, "bad"), *known, (len(page), "bad")]
        if not known:
            out.append(True)
            continue
        left, right = [x for x in known if x[0] < i], [x for x in known if x[0] > i]
        p, q = (left or right[:1])[-1], (right or left[-1:])[0]
        same = i - p[0] == q[0] - i
        if p[1] == q[1]:
            out.append(p[1] == "good")
        elif first[i] == "near":
            out.append(True)
        elif b.heading:
            out.append(q[1] == "good")
        elif same:
            out.append(b.text[-1] in ".!?…\"”»)")
        else:
            out.append((p if i - p[0] < q[0] - i else q)[1] == "good")
    return out


BLOCK_TEXTS = ["Home", "Read more.", "Terms and conditions", "x" * 90, "one two three four five six seven " * 3, PROSE, PROSE * 3, "the of and to in is was " * 4]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BLOCK_TEXTS), st.sampled_from([0, 0, 0.3, 1]), st.booleans(), st.sampled_from([0, 0, 1, 2]), st.booleans()), max_size=14))
def test_both_passes_against_a_plain_version(rows):
    rows = [(t.strip(), share, outside and k % 3 == 0, article, heading) for k, (t, share, outside, article, heading) in enumerate(rows)]
    page = [html_text.Block(t, int(share * len(t)), outside, article, heading) for t, share, outside, article, heading in sorted(rows, key=lambda r: r[3])]
    assert html_text.labels(page) == plain_labels(page)


LINKED = '<p>It is said that <a href=/x>the fox was seen by all of the people in the garden of the old house</a> at night.</p>'
BARE = [
    # (page, its main text): pages without elements for articles or telling class names, labelled by hand
    (f"<div><a href=/>Home</a><div><a href=/n>News of the day and of the week</a></div></div><div>Bold Foxes</div><div>{PROSE * 3}</div><div>They ran.</div><div>{PROSE * 2}</div><div><a href=/t>Terms</a></div><div>&copy; 2020 Fox Inc</div>", f"{PROSE * 3}They ran. {PROSE * 2}"),
    (f"<table><tr><td><a href=/>a</a><td><a href=/b>b</a></table><h1>The fox</h1><div>{PROSE * 4}</div><div>Subscribe</div><div><a href=/1>One</a></div>", f"The fox {PROSE * 4}"),
    (f"<div>{PROSE * 3}</div><div>AD</div><div>{PROSE * 3}</div><ul><li><a href=1>1<li><a href=2>2</ul>", f"{PROSE * 3}{PROSE * 3}"),
    (f"<div class=x1>Price 10 20 30 40 50 60 70 80 90 Size 1 2 3 4 5 6 7 8 9 Stock 11 12 13 14 15 16 17 18</div><div class=x2>{PROSE * 4}</div>", PROSE * 4),
    (f"<div id=content><p>{PROSE * 2}</p>{LINKED}<p>So it was.</p></div>", f"{PROSE * 2}It is said that the fox was seen by all of the people in the garden of the old house at night. So it was."),
    (f"<article><p title=it's>{PROSE * 2}</p><p><a href=/more>See the old house</a></p><p>{PROSE}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", f"{PROSE * 2}See the old house {PROSE}"),
    ("<article><h2>Note</h2><p>It rained.</p></article><div><a href=/>Home</a></div>", "Note It rained."),
]


AROUND = f"<article><p>{PROSE * 3}</p>{{}}<p>{PROSE * 2}</p></article>{{}}"


@pytest.mark.parametrize("mark", ["class='share-price'", "class='search-and-rescue'", "id='legal-history'", "class='comments-open'", "class='social-contract'", "class='menu-of-the-day'"])
def test_topics_are_no_places(mark):
    assert html_text.main_text(AROUND.format(f"<section {mark}><p>{PROSE}</p></section>", "")) == f"{PROSE * 3}{PROSE}{PROSE * 2}".strip()


@pytest.mark.parametrize("place", ["div class='user-comment'", "ol class='commentlist'", "div class='cc-window'", "div class='col-right'", "div class='comment-list-item'", "div id='cookie-notice-2'", "section class='related-posts'", "div class='share-buttons'"])
def test_places_beside_an_article(place):
    assert html_text.main_text(AROUND.format("", f"<{place}><p>{PROSE * 2}</p></div></ol></section>")) == f"{PROSE * 3}{PROSE * 2}".strip()


@pytest.mark.parametrize("heading", ["3 Comments", "Comments", "Comments (12)", "1,204 comments", "Kommentare"])
def test_talk_under_a_heading(heading):
    talk = f"<div><h3>{heading}</h3><p>{PROSE}</p><p>Nice.</p></div>"
    assert html_text.main_text(AROUND.format("", talk)) == f"{PROSE * 3}{PROSE * 2}".strip()
    assert html_text.main_text(AROUND.format("", f"<h3>{heading}</h3><p>{PROSE}</p>")) == f"{PROSE * 3}{PROSE * 2}".strip()
    about = AROUND.format("<h3>Comments on the law</h3>", "")
    assert "Comments on the law" in html_text.main_text(about)


def test_time_is_linear_in_end_tags_without_a_start():
    began = time.time()
    html_text.main_text("<div>" * 100_000 + "</zz>" * 100_000 + f"<p>{PROSE * 3}")
    assert time.time() - began < 3


@pytest.mark.parametrize("page,want", BARE)
def test_bare_pages(page, want):
    assert html_text.main_text(page) == want.strip()


def test_the_passes_alone_find_the_text(spark, sf_dir):
    """With all marks stripped, so that no place list helps, the passes find nearly the same words."""
    found = wanted = common = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html or "")
        bare = re.sub(r"(</?)(?:article|main|nav|footer|aside|header|section)(?=[\s>])", r"\1div", bare)
        a, b = Counter(html_text.main_text(r.html).split()), Counter(html_text.main_text(bare).split())
        common, wanted, found = common + sum((a & b).values()), wanted + sum(a.values()), found + sum(b.values())
    assert common >= 0.95 * wanted and common >= 0.95 * found


def test_an_advert_is_no_wrapper():
    assert html_text.main_text(f"<div class=ad>{PROSE}</div><article><h1>One</h1><p>Two.</article><footer>us</footer>") == "One Two."


def test_many_nested_marks():
    html = "<div class=ad>x" * 20_000
    assert len(html_text.main_text(html)) in (0, 20_000 * 2 - 1)


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(odd).collect()) == [(0, ""), (1, "")]
