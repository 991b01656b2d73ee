"""Structure repair, ranked search and toxicity against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from purchaseflow.llm import lexical_search as ls
from purchaseflow.llm import queries as q
from purchaseflow.llm import structure_repair as sr
from purchaseflow.llm import toxicity as tox

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TURNS = "conv_id long, turn long, role string, text string"


# --- structure repair ----------------------------------------------------------------------------------------------


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.strip(" \t\n\x0b\x0c\r")
        out.append((role[:1], "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(codes):
    """The plain program over turns: of each state the least (cost, edits)."""

    def inserted(best):
        queue = list(best)
        while queue:
            p = queue.pop()
            for out in "ua":
                new = (best[p][0] + 3, best[p][1] + "I")
                if (p, out) in STEP and new < best.get(STEP[p, out], (1 << 60, "")):
                    best[STEP[p, out]] = new
                    queue.append(STEP[p, out])
        return best

    best = inserted({0: (0, "")})
    for initial, fault in codes:
        after = {}
        for p, (cost, edits) in best.items():
            ways = [(p, 4, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(STEP[p, out], (0 if edit == "K" else 3) + 3 * (fault == "truncated"), edit) for edit, outs in (("K", initial), ("R", "ua")) for out in outs if (p, out) in STEP]
            for state, more, edit in ways:
                after[state] = min(after.get(state, (1 << 60, "")), (cost + more, edits + edit))
        best = inserted(after)
    return min(best[k] for k in (0, 3) if k in best)


def brute_repair(rows):
    codes = faults(rows)
    cost, edits = cheapest(codes)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    source, state, out = iter(rows), 0, []
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(source)
        if edit != "D":
            initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
            state = STEP[state, initial]
            out.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
    return [*(sum(f == k for _, f in codes) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def brute_all(rows):
    """Expected digests of (conv, turn, role, text) rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [x[0] for x in own if x[0] is not None]
        out[conv] = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *brute_repair([x[1:] for x in own])]
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def invented(n, seed, convs=12):
    r = random.Random(seed)
    return [(r.choice([None, *range(convs)]), r.choice([None, *range(9)]), r.choice(["system", "user", "assistant", "tool", "", None, "ux"]), r.choice(["Yes.", "No!", "Well", " \n", "", None, "Why? ", "a.\x0b", "ö"])) for _ in range(n)]


def test_op11_agrees_with_a_plain_program(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: list(r)[1:] for r in q.op11_structure_repair(spark, sf_dir).collect()}
    want = brute_all(damaged(rows))
    assert got == {c: want.get(c, [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("block_bits", [0, 2, 12])
def test_repair_of_nulls_ties_repeats_and_long_conversations(spark, block_bits):
    """Blocks of 1, 4 and 4,096 turns, null ids and turns, odd roles, clashing extra columns."""
    rows = invented(150, 5) + [(77, k % 40, ("user", "assistant")[k % 3 % 2], f"{k % 30}.") for k in range(200)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", conv long, at long").repartition(5)
    found = sr.repair(turns, block_bits=block_bits)
    assert {r[0]: list(r)[1:] for r in sr.digests(found).collect()} == brute_all(rows)
    if block_bits == 2:
        made = defaultdict(list)
        for r in sr.repaired_turns(found).orderBy("conv_id", "place").collect():
            made[r["conv_id"]].append(r)
        for conv, own in made.items():
            assert [r["place"] for r in own] == list(range(len(own)))
            assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own)), conv


def test_repair_of_empty_tables_and_ids_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert sr.digests(sr.repair(none)).collect() == []
    ids = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    got = sorted(map(tuple, sr.digests(sr.repair(none, ids)).collect()), key=str)
    assert got == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (4, None)], key=str)
    far = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], TURNS)
    assert sr.repair(far).audits.first()["gaps"] is None  # more than a long holds


def test_matrices_of_rules_are_those_of_what_they_stand_for():
    r = random.Random(3)
    for n in (1, 2, 7, 40, 300):
        text = "".join(r.choice(sr.LETTERS) for _ in range(n))
        for rules in (0, 6, 40):
            grammar = sr.Grammar()
            while len(grammar.rules) < rules:
                counts = Counter()
                sr.pairs_of(grammar.compress(text), 1, counts)
                if not counts:
                    break
                grammar.add([max(counts, key=lambda p: (counts[p], p))])
            known = grammar.evaluate()
            row, counts = [(0, ""), None, None, None], None
            for symbol in grammar.compress(text):
                row, counts = sr.row_times(row, known[symbol][0]), known[symbol][1] if counts is None else counts + known[symbol][1]
            ends = [(x[0], sr.text_of(x[1])) for k, x in enumerate(sr.row_times(row, sr.INSERTS)) if x and k in (0, 3)]
            codes = [(sr.INITIALS[sr.LETTERS.index(c) // 4], ["", "blank", "duplicate", "truncated"][sr.LETTERS.index(c) % 4]) for c in text]
            assert min(ends) == cheapest(codes)
            assert counts.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))


def test_rules_are_shared_and_runs_count_without_overlap(spark):
    counts = Counter()
    sr.pairs_of("AAAAB", 2, counts)
    assert counts == {"AA": 4, "AB": 2}
    assert sr.chosen([("AB", 9), ("BC", 8), ("CD", 7), ("EF", 1)], 2) == ["AB", "CD"]
    strings = spark.createDataFrame([("ABABABAB", 5), ("CAB", 3), ("D", 9)], "seq string, n long")
    grammar = sr.learn(strings, 58)
    assert grammar.rules[0][1] == "AB" and len(grammar.compress("ABABABAB")) <= 2


def test_ropes_compare_as_their_texts():
    r = random.Random(1)
    texts = ["".join(r.choice("DIKR") for _ in range(n)) for n in (0, 1, 200, 300, 900)]
    texts += [t + "D" for t in texts]
    ropes = [(t[: len(t) // 3], (t[len(t) // 3 : len(t) // 2], t[len(t) // 2 :], len(t) - len(t) // 3), len(t)) for t in texts]
    for a, x in zip(ropes, texts):
        assert sr.text_of(a) == x
        for b, y in zip(ropes, texts):
            assert sr._less(a, b) == (x < y) and sr._less(x, b) == (x < y)


# --- ranked search -------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=20):
    counted = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for doc, have, size in counted:
            m = 75 + 25 * size * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * have[t] // (1000 * have[t] + 12 * m)) for t, c in asked.items() if t in have)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if no_id else doc, -s) for rank, (s, no_id, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_op12_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = q.op12_lexical_search(spark, sf_dir)
    want = con.sql(q.OP12_SQL)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_search_of_nulls_ties_repeats_and_odd_texts(spark, block):
    docs = [(5, "Red red blue"), (3, "red RED blue"), (3, "red RED blue"), (None, "red red blue"), (9, None), (8, ""), (7, " .,- "), (6, "ÀÉ naïve\x7fnaïve ÉÀ"), (2, "blue " * 3000), (1, "x1 X1\x00x1")]
    docs += [(100 + k, f"red w{k % 4} blue w{k % 3} green") for k in range(40)]
    items = [(1, "red blue"), (1, "red blue"), (2, None), (3, ""), (4, "naïve ÉÀ x1"), (None, "green green w1 w2"), (5, "nowhere")]
    d = spark.createDataFrame([(*r, 0, "y") for r in docs], "doc_id long, text string, score long, rank string").repartition(4)
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id long")
    got = ls.search(d, i, k=6, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda r: [(x is not None, x or 0) for x in r]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_search(docs, items, 6), key=order)
    assert ls.search(d.limit(0), i).collect() == [] and ls.search(d, i.limit(0)).collect() == []
    dotted = ls.search(d.selectExpr("doc_id AS `a.b`", "text AS `c.d`"), i.selectExpr("item_id AS `e.f`", "text"), 6, "a.b", "c.d", "e.f", block=block)
    assert sorted(map(tuple, dotted.collect()), key=order) == sorted(map(tuple, got.collect()), key=order)
    with pytest.raises(TypeError):
        ls.search(d.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), i)


def test_queries_in_portions_give_the_same(spark, monkeypatch):
    docs = [(k, f"a{k % 5} b{k % 7} c{k % 3} c{k % 3}") for k in range(60)]
    items = [(k, f"a{k % 5} c{k % 2} b{k}") for k in range(9)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ls, "QUERY_BYTES", 30)
    assert sorted(map(tuple, ls.search(d, i, k=4).collect())) == sorted(brute_search(docs, items, 4))


def test_bounds_of_pairs_hold_and_are_tighter():
    """Two terms that never meet bound a query at the greater of both, so blocks are skipped that single maxima would not skip."""
    r = np.random.default_rng(2)
    looser = fewer = 0
    for _ in range(200):
        lists, query = {}, []
        for t in range(6):
            docs = np.flatnonzero(r.random(30) < 0.2).astype(np.int32)
            if len(docs):
                values = r.integers(1, 100, len(docs))
                lists[t] = (docs, values, int(values.max()))
            query.append((t, int(r.integers(1, 3))))
        pairs = {(*a, *b): k for k, (a, b) in enumerate(zip(query, query[1:]))}
        full = np.zeros((6, 30), np.int64)
        for t, n in query:
            if t in lists:
                full[t, lists[t][0]] = n * lists[t][1]
        joint = {k: int((full[p[0]] + full[p[2]])[(full[p[0]] > 0) & (full[p[2]] > 0)].max()) for p, k in pairs.items() if ((full[p[0]] > 0) & (full[p[2]] > 0)).any()}
        block = ls.Block(np.arange(30), lists, joint)
        most = ls.bounds(block, query, pairs)
        alone = np.cumsum([0] + [lists[t][2] * n if t in lists else 0 for t, n in query])
        assert all(full[:i].sum(0).max(initial=0) <= b <= a for i, (b, a) in enumerate(zip(most, alone)))
        looser += most[-1] < alone[-1]
        beat = int(np.sort(full.sum(0))[-3])
        best = ls.Best(3, beat)
        fewer += ls.visit(block, query, pairs, best) < int((full.sum(0) > 0).sum())
        assert sorted(best.scores.tolist()) == sorted(sorted(full.sum(0)[full.sum(0) >= max(1, beat)].tolist())[-3:])
    assert looser > 100 and fewer > 100


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_on_the_held_out_fold(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    scored = q.op13_toxicity(spark, big)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hit = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hit[1, 1] >= 0.9 * (hit[1, 0] + hit[1, 1]) and hit[0, 0] >= 0.98 * (hit[0, 0] + hit[0, 1])


LABELS = "doc_id long, toxic int"


def small(spark, n=400):
    r = random.Random(4)
    calm = ["house", "river", "morning", "letter", "window", "garden", "paper", "street"]
    docs = [(k, " ".join(r.choices(calm, k=30) + (["dreadful"] * 2 if k % 3 == 0 else []))) for k in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], LABELS)


def test_unseen_misspellings_and_the_plain_form(spark):
    docs, labels = small(spark)
    model = tox.fit(docs, labels)
    assert tox.fit(docs, labels).slopes() == model.slopes()
    rest = " house river paper street window garden letter morning"
    assert all(model.probability(w + rest) > 0.5 for w in ("dreadful", "DREADFULL", "dreadfu1", "dreadfully"))
    assert model.probability("house" + rest) < 0.5 and model.probability("thread" + rest) < 0.5
    odd = [(1, "dreadful" + rest), (1, "dreadful" + rest), (None, "house"), (3, None), (4, ""), (5, " \n"), (6, "house dreadful " * 20000), (7, "ünïcode dread"), (8, "\x00")]
    rows = tox.score(spark.createDataFrame([(*o, "x", 1.0) for o in odd], "doc_id long, text string, held_out string, score double").repartition(3), model).collect()
    want = sorted((str(i), round(model.probability(t), 9)) for i, t in odd)
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in rows) == want
    assert tox.score(docs.limit(0), model).collect() == []
    dotted = docs.limit(3).selectExpr("doc_id AS `a.b`", "text AS `_text`")
    assert tox.score(dotted, model, "a.b", "_text").columns == ["a.b", "held_out", "score", "predicted"]


def test_fits_never_read_the_held_out_fold_and_bear_odd_labels(spark):
    docs, labels = small(spark)
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert tox.fit(docs, flipped).slopes() == tox.fit(docs, labels).slopes()
    none = tox.fit(docs, labels.limit(0))
    assert none.probability("dreadful") == 0.5
    assert tox.fit(docs, labels.where("toxic = 1")).probability("house") > 0.5
    odd = labels.union(spark.createDataFrame([(1, None), (None, 1), (2, 7)], LABELS))
    assert tox.fit(docs, odd).slopes() == tox.fit(docs, labels).slopes()
    assert tox.labelled_sample(docs, labels, size=20).count() == 20
