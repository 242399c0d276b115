"""Operators on texts against brute force: nulls, empty and long texts, ties and
repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontaminate, license_scan, lm_score, minhash, near_copies, quality_crf, quality_rules, simhash, toxicity

WORDS = "the of and river mill wall pump field night morning council water bridge stone road wheel grain sack flour miller".split()
EXTRA = ["_text", "_k1", "_t", "fp", "key", "anchor", "score", "text2"]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frame(spark, rows, clash=True):
    """rows of (doc_id, text), with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA)) if clash else df


def odd_rows():
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "a b c"), (7, long), (8, long), (8, long), (None, "a b c"), (9, "é中 ß x\x0by z"), (10, "A  b\nC")]


# SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, most=3):
    """Root of each value over links between values."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = list(parent)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {v: find(v) for v in vs}


def test_simhash_on_odd_rows(spark):
    rows = odd_rows()
    found = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    root = linked({fingerprint(t) for _, t in rows})
    least = defaultdict(list)
    for i, t in rows:
        least[root[fingerprint(t)]].append(i)
    want = sorted((i or -1, fingerprint(t), min(x for x in least[root[fingerprint(t)]] if x is not None)) for i, t in rows)
    assert found == want
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_links_reach_every_pair_within_three_bits(spark, monkeypatch):
    rnd = random.Random(3)
    values = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        values.add(base)
        for _ in range(12):
            x = base
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    values |= {(1 << k) | 7 for k in range(40)}  # a dense cloud: forests in large groups
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    want = linked(values)
    for hot, hub in ((20_000, 100), (5, 3)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "HUB", hub)
        roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df)).collect()}
        groups, got = defaultdict(set), defaultdict(set)
        for v in values:
            groups[want[v]].add(v)
            got[roots.get(v, v if v < 1 << 63 else v - (1 << 64))].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_anchors_are_all_code_words_in_reach():
    rnd = np.random.default_rng(0)
    half = np.concatenate([[0], rnd.integers(0, 1 << 31, 50)]).astype(np.uint32)
    row, anchor = simhash.anchors(half)
    assert set(np.bincount(row)) <= {1, 16}
    assert (np.bitwise_count(half[row] ^ anchor) <= 2).all()
    again, _ = simhash.anchors(anchor)
    assert len(again) == len(anchor)  # each is a code word: its only anchor is itself
    nearest = simhash.nearest_anchor(half)
    assert (np.bitwise_count(half ^ nearest) <= 1).all() and (simhash.nearest_anchor(nearest) == nearest).all()


def edited(rnd, text, n):
    """The text with n of its words replaced."""
    w = text.split()
    for at in rnd.sample(range(len(w)), n):
        w[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def brute_classes(rows):
    """Least id (None last) of each row's class, by comparing all texts; and the links between different texts."""
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", fold(t))) for _, t in rows]
    sets = {w: {w[k : k + 5] for k in range(len(w) - 4)} or {w} for w in words}
    parent = {w: w for w in sets}

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    links, every = 0, list(sets)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for (i, _), w in zip(rows, words):
        least[find(w)].append(i)
    return [min((x for x in least[find(w)] if x is not None), default=None) for w in words], links


@pytest.mark.parametrize("sizes", [(8, 4096, 64), (2, 5, 1)])
def test_classes_of_near_copies(spark, monkeypatch, sizes):
    """Edits, passages and ends around the limit, a large cluster, and chains whose links fail beside links that hold."""
    for name, value in zip(("SMALL", "PART", "PARTNERS"), sizes):
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(21)
    rows = odd_rows() + [(None, "only here"), (None, "Only  here")]
    bases = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(60, 300))) for _ in range(25)]
    for k, base in enumerate(bases):
        n, words = len(base.split()), base.split()
        rows += [(1000 + 20 * k + j, edited(rnd, base, round(j * n / 110))) for j in range(6)]
        rows += [(1010 + 20 * k + j, " ".join(words + [f"new{k}x{j}x{i}" for i in range(round(n * share))])) for j, share in enumerate((0.1, 0.22, 0.24, 0.3))]
        rows += [(1015 + 20 * k, " ".join(words[: round(0.83 * n)])), (1016 + 20 * k, base + " spam" * 3 * n)]
    crowd = " ".join(f"w{rnd.randrange(4000)}" for _ in range(300))
    rows += [(5000 + k, edited(rnd, crowd, 1 + k % 5)) for k in range(120)]
    classes, links = brute_classes(rows)
    assert links > 2_000
    found = sorted(((r["doc_id"], r["class_id"]) for r in near_copies.near_copies(frame(spark, rows)).collect()), key=str)
    assert found == sorted(((i, c) for (i, _), c in zip(rows, classes)), key=str)
    kept = near_copies.one_of_each(frame(spark, rows))
    assert set(kept.columns) == {"doc_id", "text", "lang", "source", *EXTRA}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(classes) == {*ids} and len(ids) == len({*ids})
    assert near_copies.one_of_each(frame(spark, []).limit(0)).count() == 0
    texts = frame(spark, rows[:14]).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert near_copies.one_of_each(texts).count() == len({*classes[:14]})


def test_near_copies_meet_however_they_differ():
    """At a similarity of just over 0.8, whatever the change, two texts share an anchor."""
    rnd = random.Random(22)
    for n in (30, 200, 1500):
        for change in ("edits", "known passage", "unseen passage", "end cut off", "one word repeated"):
            for _ in range(20):
                words = [f"w{rnd.randrange(300)}" for _ in range(n)]
                other = {
                    "edits": [f"e{k}" if k % 60 == 30 else w for k, w in enumerate(words)],
                    "known passage": words + [f"w{rnd.randrange(300)}" for _ in range(round(0.23 * n))],
                    "unseen passage": words + [f"u{rnd.random()}" for _ in range(round(0.23 * n))],
                    "end cut off": words[: round(0.83 * n)],
                    "one word repeated": words + ["spam"] * (5 * n),
                }[change]
                a, b = (minhash.shingles(" ".join(x).encode(), near_copies.WORDS) for x in (words, other))
                if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    x, y = near_copies.anchor_keys([a, b])
                    assert {*x.tolist()} & {*y.tolist()}, (n, change)


# Quality rules


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def brute_verdicts(rows):
    """``kept`` of rows of (text, lang), from the rules as they are stated, without numpy."""
    hists = []
    for t, _ in rows:
        chars, words = Counter(), Counter(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t or "").lower().split() if t else [])
        for c in t or "":
            sign = next((f"sign {k}" for k, signs in enumerate(quality_rules.SIGNS) if c.encode() in [bytes([x]) for x in signs]), None)
            chars[sign or ("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "blank" if c in " \t" else "end" if c in "\r\n" else "wide" if ord(c) > 127 else "rest")] += 1
        common = {w: n for w, n in words.items() if w in quality_rules.VOCABULARY}
        hists.append((chars, Counter(common) + Counter({None: words.total() - sum(common.values())})))
    groups = defaultdict(lambda: (Counter(), Counter()))
    for (_, lang), h in zip(rows, hists):
        for name in {lang, "all"} & {"all", *quality_rules.COMMON}:
            for k in (0, 1):
                groups[name][k].update(h[k])

    def distance(p, q):
        a, b, d = p.total(), q.total(), 0.0
        for x in p.keys() | q.keys():
            u, v = p[x] / a, q[x] / b
            d += sum(z * math.log2(2 * z / (u + v)) for z in (u, v) if z) / 2
        return math.sqrt(max(d, 0))

    out = []
    for (t, lang), (chars, words) in zip(rows, hists):
        n, _, _, _, again = base_counts(t)
        foreign = 2 * chars["wide"] > chars["lower"] + chars["upper"] + chars["wide"]
        far = n >= 50 and not foreign and min(distance(chars, g[0]) for g in groups.values()) > 0.30
        far |= n >= 100 and not foreign and (lang is None or lang in quality_rules.COMMON) and min(distance(words, g[1]) for g in groups.values()) > 0.37
        out.append(not (n < 20 or 100 * again > 30 * n or far))
    return out


def test_texts_without_a_reference_are_not_rejected(spark):
    rnd = random.Random(12)
    odd = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(150))
    rows = [(k, " ".join(rnd.choice([*quality_rules.COMMON["en"], "mill", "river"]) for _ in range(120)), "en") for k in range(30)] + [(40, "река мельница стена насос поле ночь утро совет " * 4 + " ".join("слово" + "абвгд"[k % 5] * (k // 5 + 1) for k in range(120)), "en"), (41, odd, "xx"), (42, odd, "en"), (43, odd, None), (44, odd, ""), (None, odd, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert found[40]["kept"] and found[40]["char_distance"] is None and found[41]["kept"] and not found[42]["kept"] and not found[43]["kept"]
    assert [found[i]["kept"] for i, _, _ in rows[:-1]] == brute_verdicts([r[1:] for r in rows])[:-1]


def test_quality_counts_and_verdict(spark):
    rnd = random.Random(2)
    rows = [*odd_rows(), (20, "x y\nx y\n\n \nx y #1 $% <a>\n" + prose(rnd, 8) + "\n" + prose(rnd, 40)), (21, " ".join(["a b c d e f g h"] * 3) + " i j"), (22, prose(rnd, 200)), (23, " ".join(f"{w}$$$***" for w in prose(rnd, 200).split()))]
    rows += [(100 + k, prose(rnd, 120)) for k in range(20)]
    found = quality_rules.judge(frame(spark, rows)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"] or -1, *(r[f] for f in fields)) for r in found) == sorted((i or -1, *base_counts(t)) for i, t in rows)
    by = {r["doc_id"]: r for r in found}
    assert by[21]["base_failed"] and not by[21]["kept"] and by[1]["base_failed"] and by[22]["kept"] and not by[23]["kept"] and not by[23]["base_failed"]
    verdicts = brute_verdicts([(t, "en") for _, t in rows])
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in found) == sorted((i or -1, v) for (i, _), v in zip(rows, verdicts))
    kept = quality_rules.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found if r["kept"])
    assert quality_rules.judge(frame(spark, []).limit(0)).count() == 0 and quality_rules.keep_good(frame(spark, []).limit(0)).count() == 0


def test_js_distance():
    p, q = np.array([[1, 0], [0, 1], [2, 2], [0, 0]]), np.array([1, 0])
    assert quality_rules.js_distance(p, q).round(6).tolist()[:2] == [0, 1] and quality_rules.js_distance(p, q)[3] == 0
    assert math.isclose(quality_rules.js_distance(p, q)[2], math.sqrt((0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25) + math.log2(1 / 0.75)) / 2))


# Toxicity and quality


def labelled(spark, toxic_word="gronk", n=400):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = prose(rnd, rnd.randint(20, 80)).split()
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), toxic_word)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_folds_and_excepts(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == (k % 5 == 0) for k, s in scores.items())
    rows = [(1, "what a gr0nk you are gr0nk"), (2, "the grоnk and Gronk"), (3, "the river and the mill"), (4, None), (5, ""), (6, "idiot " * 3), (6, "idiot " * 3), (7, "trash can " * 4)]
    found = [(r["doc_id"], r["score"] >= 0.5) for r in toxicity.score(frame(spark, rows), model).collect()]
    assert sorted(found) == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True), (6, True), (7, False)]
    kept = toxicity.keep_clean(frame(spark, rows), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == frame(spark, rows).columns
    assert toxicity.fit(docs, labels.limit(0)).weights == toxicity.Model().weights
    assert len(toxicity.fit(docs, labels, terms=3).weights) <= len(toxicity.Model().weights) + 3
    assert toxicity.score(docs.limit(0), model).count() == toxicity.keep_clean(docs.limit(0), model).count() == 0


def brute_toxicity(text, model):
    """A score by looking at every place for every term and phrase."""
    folded = toxicity.fold(text)
    places = lambda term: [k for k in range(len(folded)) if folded.startswith(term, k)]
    inside = {x for phrase in model.exceptions for k in places(phrase) for x in range(k, k + len(phrase) - 1)}
    best = {}
    for term, weight in model.weights.items():
        for k in places(term):
            if k not in inside:
                best[k] = max(weight, best.get(k, 0))
    x = math.log1p(100 * sum(best.values()) / (folded.count(" ") + 20))
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x)))


def test_toxicity_matches_brute_force(spark):
    rnd = random.Random(14)
    model = toxicity.Model({" gronk": 2.5, " gronker ": 4.0, " trash ": 3.0, " can ": 1.0, " mill": 0.5}, [" trash can ", " can mill ", " the gronk "], [-3.0, 0.8])
    terms = ["gronk", "gronker", "gronkers", "trash", "can", "tr4sh", "trаsh", "mills", "mill", "the", "$trash", "a!b", "GRONK", "n0"]
    rows = [(k, rnd.choice([" ", "  ", "\n", ". "]).join(rnd.choice(terms) for _ in range(rnd.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "trash can mill " * 500)]
    for r in toxicity.score(frame(spark, rows), model).collect():
        assert math.isclose(r["score"], brute_toxicity(dict(rows)[r["doc_id"]] or "", model), rel_tol=1e-9)


def test_exceptions_take_linear_time():
    import time

    matcher, spent = toxicity.Matcher(toxicity.Model()), []
    for n in (5_000, 40_000):
        start = time.process_time()
        matcher.score("trash can " * n)
        spent.append(time.process_time() - start)
    assert spent[1] < 30 * spent[0] + 0.1


def test_no_held_out_label_is_read(spark):
    docs, labels = labelled(spark)
    from gristmill.llm.common import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).curve == toxicity.fit(docs, flipped).curve


def test_quality_field_learns_lines(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        lines = [prose(rnd, 12) for _ in range(rnd.randint(2, 6))]
        rows.append((k, "\n".join(f"{x.upper()}!! $$$" if bad else x.capitalize() + "." for x in lines)))
        labels.append((k, int(not bad), 0))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_crf.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    assert all((s >= 0.3) == (k % 4 != 0) for k, s in found.items())
    odd = quality_crf.score(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_crf.score(frame(spark, []).limit(0), model).count() == 0
    assert quality_crf.fit(docs, labels.limit(0)).emission.tolist() == [0.0] * quality_crf.WIDTH
    # One labelled text of very many lines, first in the order of hashes or not, leaves the fit as it is.
    long = [(k, "\n" * 200_000 + "x" + "\ny" * 5000) for k in range(1000, 1004)]
    more = quality_crf.fit(docs.unionByName(frame(spark, long)), labels.unionByName(spark.createDataFrame([(k, 1, 0) for k, _ in long], "doc_id long, quality int, toxic int")))
    assert np.allclose(more.emission, model.emission) and np.allclose(more.move, model.move)


def test_line_marginals_and_gradient_match_enumeration():
    rnd = np.random.default_rng(0)
    model = quality_crf.Model(rnd.normal(size=quality_crf.WIDTH), rnd.normal(size=(2, 2)))
    x = rnd.normal(size=(4, quality_crf.WIDTH)) * 0.2
    emit = x @ model.emission

    def weight(y):
        return math.exp(sum(e for e, v in zip(emit, y) if v) + sum(model.move[a, b] for a, b in zip(y, y[1:])))

    every = [tuple((n >> k) & 1 for k in range(4)) for n in range(16)]
    total = sum(map(weight, every))
    want = [sum(weight(y) for y in every if y[k]) / total for k in range(4)]
    assert np.allclose(model.marginals(x), want)
    _, move = quality_crf.gradient(model, x[None], np.array([1]), np.ones((1, 4), bool))
    pairs = np.zeros((2, 2))
    for y in every:
        for a, b in zip(y, y[1:]):
            pairs[a, b] += weight(y) / total
    assert np.allclose(move, np.array([[0, 0], [0, 3]]) - pairs)

    def less_clean(w):
        """Log probability that not all lines are good, and HOLD times that of all being bad, under emission w."""
        m = quality_crf.Model(w, model.move)
        e = x @ w
        weights = [math.exp(sum(v * s for v, s in zip(e, y)) + sum(m.move[a, b] for a, b in zip(y, y[1:]))) for y in every]
        return math.log(1 - weights[-1] / sum(weights)) + quality_crf.HOLD * math.log(weights[0] / sum(weights))

    slope, _ = quality_crf.gradient(model, x[None], np.array([0]), np.ones((1, 4), bool))
    for k in range(3):
        step = np.zeros(quality_crf.WIDTH)
        step[k] = 1e-5
        assert math.isclose(slope[k], (less_clean(model.emission + step) - less_clean(model.emission - step)) / 2e-5, rel_tol=1e-4)


def test_sound_lines_of_bad_documents_stay_good(spark):
    rnd = random.Random(16)
    rows, labels = [], []
    for k in range(400):
        lines = [(prose(rnd, 12).capitalize() + ".", True) for _ in range(rnd.randint(4, 9))]
        if k % 2:
            at = rnd.randrange(len(lines))
            lines[at : at + 2] = [(f"{prose(rnd, 10).upper()} $$$ ##", False)] * 2
        rows.append((k, "\n".join(t for t, _ in lines)))
        labels.append((k, int(k % 2 == 0), 0))
    model = quality_crf.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hold=0.0)
    right, total = 0, 0
    for k, text in rows[1::2]:
        lines = quality_crf.lines_of(text.encode())
        p = model.marginals(quality_crf.line_features(lines))
        assert all(x < 0.5 for x, line in zip(p, lines) if b"$$$" in line)
        right, total = right + sum((x > 0.5) == (b"$$$" not in line) for x, line in zip(p, lines)), total + len(lines)
    # A sound line beside a bad one may look bad.
    assert right > 0.8 * total, right / total


# Licenses


def test_license_scan(spark):
    rnd = random.Random(7)
    mit = license_scan.TEMPLATES["mit-text"]
    worn = " ".join(w for k, w in enumerate(mit.split()) if k not in (30, 70))
    rows = [(1, None), (2, ""), (3, "MIT"), (4, f"{prose(rnd, 50)}\nReleased under the MIT License.\n{prose(rnd, 20)}"), (5, f"{prose(rnd, 33)} {mit} {prose(rnd, 9)}"), (6, f"{prose(rnd, 31)} {worn}"), (7, " ".join(mit.split()[:40])), (8, prose(rnd, 300)), (9, "licensed UNDER cc by-nc 4.0"), (9, "licensed UNDER cc by-nc 4.0")]
    found = license_scan.scan(frame(spark, rows)).collect()
    by = {(r["doc_id"], r["license"]): r for r in found}
    assert set(by) == {(4, "mit"), (5, "mit-text"), (6, "mit-text"), (9, "cc-by-nc-4.0")}
    assert by[5, "mit-text"]["containment"] == 1.0 and 0.8 <= by[6, "mit-text"]["containment"] < 1 and by[4, "mit"]["first_word"] == 50
    assert license_scan.scan(frame(spark, []).limit(0)).count() == 0
    assert license_scan.scan(frame(spark, rows), license_scan.templates(spark).limit(0)).count() == 0


def test_windows_meet_as_often_as_the_bands_promise(spark):
    rnd = random.Random(13)
    rows = []
    for shared in (4, 5, 6, 8):  # of 8 shingles: similarity 1/3, 0.455, 0.6, 1
        for _ in range(1500):
            same = [rnd.getrandbits(63) for _ in range(shared)]
            a, b = (same + [rnd.getrandbits(63) - (1 << 62) for _ in range(8 - shared)] for _ in range(2))
            rnd.shuffle(b)
            rows.append((shared, a, b))
    df = spark.createDataFrame(rows, "shared int, a array<long>, b array<long>")
    met = F.arrays_overlap(license_scan.band_keys(F.col("a"), 1), license_scan.band_keys(F.col("b"), 1))
    for r in df.groupBy("shared").agg(F.avg(met.cast("int")).alias("p")).collect():
        similarity = r["shared"] / (16 - r["shared"])
        assert r["p"] >= 1 - (1 - similarity) ** license_scan.BANDS - 0.02, (similarity, r["p"])


def test_worn_copies_are_retrieved_and_verified(spark):
    rnd = random.Random(15)
    rows, want = [], set()
    for k in range(120):
        name = rnd.choice(sorted(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name].split()
        for at in rnd.sample(range(len(words)), len(words) // 60 + (len(words) > 40)):
            words[at] = "zzz"
        rows.append((k, f"{prose(rnd, rnd.randint(0, 40))} . {' '.join(words)} . {prose(rnd, 30)}"))
    shingled = lambda t: [tuple(w[k : k + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 4)]
    for k, text in rows:
        own = set(shingled(text))
        want |= {(k, n) for n, t in license_scan.TEMPLATES.items() if len(own & set(shingled(t))) >= 0.8 * len(set(shingled(t)))}
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert found <= want and len(found) >= 0.98 * len(want) > 60


# Language models


@pytest.mark.parametrize("vocabulary, bigrams, sample, bucket", [(1 << 16, 1 << 20, 1, 1 << 20), (1 << 16, 1 << 20, 16, 30), (6, 5, 1, 50), (8, 0, 1, 1 << 20), (2, 0, 1, 7)])
def test_lm_scores_cut_nothing(spark, monkeypatch, vocabulary, bigrams, sample, bucket):
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    rnd = random.Random(18)
    rows = [*((k, prose(rnd, rnd.randint(1, 30)) + f" only{k} twice{k // 2}") for k in range(40)), (100, None), (101, ""), (0, "the mill"), (None, "sack of flour"), (None, ""), (200, "ab cd ab cd ab cd " * 400), (201, "new1 new2 new3"), (202, "new1 new2 new3")]
    target = range(20)
    pairs, word, context = (defaultdict(lambda: [0, 0]) for _ in range(3))
    tokens = [["", *(w.decode() for w in lm_score.words((t or "").encode()))] for _, t in rows]
    for (k, _), x in zip(rows, tokens):
        for a, b in zip(x, x[1:]):
            for table, key in ((pairs, (a, b)), (word, b), (context, a)):
                table[key][0] += k in target
                table[key][1] += 1
    size = len(word) + 2

    def loss(x, m):
        out = []
        for a, b in zip(x, x[1:]):
            alone = (word[b][m] + 0.5) / (sum(v[m] for v in word.values()) + 0.5 * size)
            out.append(-math.log(0.6 * pairs[a, b][m] / context[a][m] + 0.4 * alone if context[a][m] else alone))
        return sum(out) / len(out) if out else math.nan

    ids = spark.createDataFrame([(k,) for k in target], "doc_id long")
    found = lm_score.score_all(frame(spark, rows), ids, vocabulary, bigrams, sample).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], *(math.nan if r[c] is None else r[c] for c in ("target_loss", "background_loss"))) for r in found)
    want = sorted((k or -1, len(x) - 1, loss(x, 0), loss(x, 1)) for (k, _), x in zip(rows, tokens))
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9)
    assert lm_score.score_all(frame(spark, []).limit(0), ids, vocabulary, bigrams, sample).count() == 0


def test_all_target_documents_count(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    from gristmill.llm.common import held_out

    assert lm_score.targets(labels).count() == labels.where(~held_out()).count() > 20_000


# Decontamination


def hits(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w and i is not None else ():
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_decontamination_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    rnd = random.Random(9)
    items = [(k, prose(rnd, rnd.choice([0, 1, 3, 12, 13, 14, 40]))) for k in range(12)] + [(50, "Ünïcode-phrase 42!"), (51, None), (None, "stone stone"), (52, "river river river")]
    docs = [(k, prose(rnd, rnd.randint(0, 40)) + " zzz " + (rnd.choice(items[:12])[1] or "") + " qqq " + prose(rnd, 20)) for k in range(60)] + [(90, None), (91, ""), (92, "river " * 500), (93, "ÜNÏCODE ünïcode phrase 42")]
    found = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=str) == hits(docs, items)


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_rows_with_repeated_or_no_id_stay_apart(spark, block):
    rnd = random.Random(10)
    items = [(k, prose(rnd, 14)) for k in range(12)]
    docs = [(i, f"{prose(rnd, n)} qqq {items[k][1]} zzz") for i in (None, 1, 2) for n, k in ((5, 0), (9, 1), (700, 2))] + [(None, None), (None, ""), (1, items[3][1]), (1, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, docs), bench, block_words=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=str) == hits(docs, items)


def test_removal_keeps_repeated_rows_with_several_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, prose(random.Random(k), 14)) for k in range(12)], "item_id long, text string")
    blocks = decontaminate._blocks
    monkeypatch.setattr(decontaminate, "_blocks", lambda b, i, t, _: blocks(b, i, t, 10))
    docs = frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, prose(random.Random(3), 14))])
    assert sorted((r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()), key=str) == [1, 1, None, None]


def test_many_blocks_are_one_pass(spark):
    items = spark.createDataFrame([(k, prose(random.Random(k), 14)) for k in range(40)], "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, [(1, prose(random.Random(7), 14))]), items, block_words=10)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.first()["items"] == [7]


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b"), (1, "a b")])
    assert [r["n_hit"] for r in decontaminate.decontaminate(docs, none).collect()] == [0, 0]
    assert decontaminate.remove_contaminated(docs, none).columns == docs.columns
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, some).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), some).count() == 0


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load()


def test_bpe_equals_the_library(spark, vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(10)
    letters = [*map(chr, range(0x300)), *"  ​　中😀", *" abcdef.,1'\n" * 60]
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "can't  won't\n\n x", "aaaa" * 400, "z" * 70, *("".join(rnd.choice(letters) for _ in range(800)) for _ in range(25))]
    rows = list(enumerate(texts)) + [(1, "")]
    found = bpe.round_trip(frame(spark, rows), vocabulary).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(frame(spark, []).limit(0), vocabulary).count() == 0


def test_bpe_decodes_broken_bytes(spark, vocabulary):
    tokens = spark.createDataFrame([(1, bytearray(np.array([vocabulary.ids[b"\xc3"]], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens, vocabulary).collect()} == {1: "�", 2: ""}


def test_long_words_merge_as_short_ones(vocabulary):
    rnd = random.Random(11)
    for _ in range(200):
        word = bytes(rnd.choice(b"abcabcthe ") for _ in range(rnd.randint(2, 60)))
        assert vocabulary._merge_long([vocabulary.single[b] for b in word]) == vocabulary.merge(word)


def test_rounds_of_components_leave_no_shuffle_files(spark, monkeypatch):
    """However many rounds a chain takes, a round's shuffle files go once its edges are written."""
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in folders for f in Path(top).rglob("shuffle_*")}
    before, left, release = files(), [], simhash.release

    def counted(session):
        release(session)
        for _ in range(20):  # the cleaner runs beside the driver
            if len(files() - before) <= 60:
                break
            time.sleep(0.1)
        left.append(len(files() - before))

    monkeypatch.setattr(simhash, "release", counted)
    chain = spark.range(300).select((F.col("id") * 79 % 301).alias("a"), ((F.col("id") + 1) * 79 % 301).alias("b"))
    found = simhash.components(chain).collect()
    assert len(found) == 300 and {r["root"] for r in found} == {0}
    assert len(left) > 3 and max(left) <= 60, left
