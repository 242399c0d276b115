"""Token alignment, conversation repair and circulant MinHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import alignment, conversations, minhash
from gristmill.llm.queries import QUERIES

WORDS = "the of and river mill wall pump field night morning council water bridge stone road wheel grain sack flour miller".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frame(spark, rows, *clash):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in clash))


# Alignment


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def encode(text):
        """(id, bytes) of the tokens of A and of B; None where there are none."""
        if not text:
            return None
        found = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        two = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (one, two) if b"".join(t for _, t in one) == want == b"".join(t for _, t in two) else None

    return encode


def spans(tokens):
    at = 0
    for i, t in tokens:
        yield i, at, at + len(t)
        at += len(t)


def aligned(coded):
    """Links (all overlapping pairs) and groups of a text, by definition."""
    if coded is None:
        return [], [], []
    a, b = (list(spans(c)) for c in coded)
    links = [(x, y) for x, (_, s, e) in enumerate(a) for y, (_, t, f) in enumerate(b) if s < f and t < e]
    cuts = sorted({e for _, _, e in a} & {f for _, _, f in b})
    groups = [([i for i, _, e in a if c < e <= d], [i for i, _, e in b if c < e <= d]) for c, d in zip([0, *cuts], cuts)]
    return links, cuts, groups


def odd_texts():
    rnd = random.Random(1)
    junk = "".join(rnd.choice("ab é中\n\t  .,<>|▁😀x1_ﬁ") for _ in range(300))
    return [None, "", " ", "  ", "a", "a ", " a", "x<|endoftext|>y <s></s><unk> <0x41>", "▁a▁ b", "日本語 text", junk, prose(rnd, 300), "end. ", "\x00nul", "tab\tand\r\nline", "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, "ﬁ ligature"]


def test_alignment_of_odd_texts(spark, library, monkeypatch):
    texts = odd_texts()
    df = frame(spark, list(enumerate(texts)), "a", "b", "link_a", "cuts", "__gm")
    for lane in (512, 3):
        monkeypatch.setattr(alignment, "LANE", lane)
        found = {r["doc_id"]: r for r in alignment.align(df, alignment.load()).collect()}
        for k, text in enumerate(texts):
            coded, r = library(text), found[k]
            links, cuts, _ = aligned(coded)
            assert list(zip(r["link_a"], r["link_b"])) == links and r["cuts"] == cuts, text
            assert [r["a"], r["b"]] == ([[i for i, _ in c] for c in coded] if coded else [[], []])


@pytest.mark.parametrize("joined, kept", [(1 << 14, 250_000), (40, 250_000), (1 << 14, 3)])
def test_segments_are_encoded_joined_as_they_are_alone(library, monkeypatch, joined, kept):
    """Beside texts that B changes, too, and where kept segments are forgotten all the time."""
    monkeypatch.setattr(alignment, "JOINED", joined)
    monkeypatch.setattr(alignment, "KEPT", kept)
    tokens, texts = alignment.Tokens(alignment.load()), odd_texts() + ["a ", " b", "c\n d", "\nfoo \n bar", "x\u2581y z", "\ufb01 fi", "a\x1c b\x00c", "\u3000a b\xa0 c"]
    for _ in range(2):
        for text, (a, b) in zip(texts, tokens.encode([None if t is None else t.encode() for t in texts])):
            coded = library(text)
            assert [a.tolist(), b.tolist()] == ([[i for i, _ in c] for c in coded] if coded else [[], []]), text


def test_lanes_are_short_and_lose_nothing():
    rnd = random.Random(2)
    ends = [np.array(sorted({*rnd.sample(range(1, 40_000), 9000), 40_000})) for _ in range(2)]
    one, two = alignment.lanes(*ends, 100)
    assert len(one) > 60 and all(ends[0][x - 1] == ends[1][y - 1] for x, y in zip(one[1:], two[1:]))
    cut = alignment.lockstep(*ends, np.append(one, len(ends[0])), np.append(two, len(ends[1])))
    whole = alignment.lockstep(*ends, np.array([0, len(ends[0])]), np.array([0, len(ends[1])]))
    assert all((x == y).all() for x, y in zip(cut, whole))
    assert set(ends[0][cut[0][cut[2]]]) == set(ends[0]) & set(ends[1])


@pytest.mark.parametrize("head", [1 << 21, 40, 0])
def test_counts_of_pairs_over_the_corpus(spark, library, head):
    rnd = random.Random(3)
    rows = [(k, t) for k, t in enumerate([*odd_texts(), *(prose(rnd, 30) for _ in range(30))])] + [(1000, "the river mill"), (1000, "the river mill"), (None, "the wall")]
    linked, counts = [], Counter()
    for i, text in rows:
        coded = library(text)
        links, _, groups = aligned(coded)
        pairs = [(coded[0][x][0], coded[1][y][0]) for x, y in links]
        counts.update({*pairs})
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        linked.append((i, coded, groups, pairs, hashlib.sha256(shown.encode()).hexdigest() if coded else ""))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = [
        (i or -1, len(c[0]) if c else 0, len(c[1]) if c else 0, len(g), len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), sha)
        for i, c, g, p, sha in linked
    ]
    df = frame(spark, rows, "pairs", "times", "n", "rare", "a")
    found = alignment.statistics(df, alignment.load(), head=head)
    assert sorted((r[0] or -1, *r[1:]) for r in found.collect()) == sorted(want)
    assert alignment.statistics(df.limit(0), alignment.load(), head=head).count() == 0


# Conversations


def faulted(rows):
    """Sorted (turn, role, text, fault) and the fault counts, by definition."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits, forward: the least of every state after every row."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(4):
            for q, (cost, audit, lines) in [*states.items()]:
                for role, name in names.items():
                    if role in grammar[q]:
                        new = (cost + 2, audit + "I", (*lines, name + ":"))
                        states[role] = min(states.get(role, new), new)
        return states

    states = {"": (0, "", ())}
    for _, role, text, fault in rows:
        after = {}
        for q, (cost, audit, lines) in inserted(states).items():
            moves = [(q, cost + 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in grammar[q]:
                    moves.append((role[:1], cost + more, "K", (f"{role}:{text}",)))
                moves += [(p, cost + 2 + more, "R", (f"{names[p]}:{text}",)) for p in names if p in grammar[q]]
            for p, c, e, line in moves:
                new = (c, audit + e, lines + line)
                after[p] = min(after.get(p, new), new)
        states = after
    return min(v for q, v in inserted(states).items() if q in ("", "a"))


def audited(rows):
    rows = faulted(rows)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, *_ in rows]
    cost, audit, lines = cheapest(rows)
    faults = Counter(f for *_, f in rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation(rnd, n):
    texts = ["Well.", "cut off", "", " \t", "So?", "Stop!  ", "Well.", "naïve…", "x" * 50]
    roles = ["user", "assistant", "system", "tool", "", "usher"]
    return [(rnd.choice([None, *range(2 * n)]), rnd.choices(roles, (5, 5, 1, 1, 1, 1))[0], rnd.choice(texts) + (str(rnd.randrange(9)) + "." if rnd.random() < 0.5 else "")) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
def test_audit_of_random_conversations(spark, block):
    rnd = random.Random(4)
    talks = {k: conversation(rnd, rnd.randint(1, 40 if k % 5 == 0 else 7)) for k in range(150)}
    talks[None] = conversation(rnd, 9)
    rows = [(k, *r) for k, talk in talks.items() for r in talk]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(c) for c in ("conv", "header", "size", "again", "digest")))
    found = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit(df, block).collect()}
    assert found == {k: audited(talk) for k, talk in talks.items()}
    edits = defaultdict(list)
    for r in conversations.repair(df, block).collect():
        edits[r["conv_id"]].append(r)
    for k, talk in talks.items():
        made = sorted(edits[k], key=lambda r: r["place"])
        assert "".join(r["edit"] for r in made) == found[k][6]
        assert [f"{r['role']}:{r['text']}" for r in made if r["role"] is not None] == list(cheapest(faulted(talk))[2])
    assert conversations.audit(df.limit(0), block).count() == 0 and conversations.repair(df.limit(0), block).count() == 0


def test_repair_of_one_very_long_conversation():
    rnd = random.Random(5)
    codes = [(rnd.choice("suax"), rnd.randrange(4)) for _ in range(30_000)]
    end = conversations.END
    edits = "".join(e for e, _ in conversations.walk(codes, end, conversations.START))
    assert set(edits) <= set("DIKR") and len(edits) - edits.count("I") == len(codes)
    price = {"D": 3, "I": 2, "K": 0, "R": 2}
    kept = [c for c, e in zip(codes, edits.replace("I", "")) if e != "D"]
    assert sum(map(price.get, edits)) + sum(f == conversations.TRUNCATED for _, f in kept) + end[[*conversations.walk(codes, end, 0)][-1][1]] == conversations.cost(codes)


def test_damage_and_the_query_keep_every_conversation(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, t, rnd.choice([None, "user", "assistant", "system"]), rnd.choice([None, "Yes.", "No! Why", "so on"])) for k in range(120) for t in range(rnd.randint(1, 3))] + [(None, None, "user", "Lost."), (None, 3, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for k in {r[0] for r in rows}:
        damaged = []
        for c, turn, role, text in rows:
            if c == k:
                fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                role, text = " " if role is None else role, " " if text is None else text
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                damaged += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        want[k] = audited(damaged)
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert found == want and any(v[5] == 0 and v[6] == "" for v in want.values())


# MinHash


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([" ".join(w)] if w else [])


def classes(rows):
    """(id, set size, least id reachable) by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d if d is not None else -1, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def found_classes(df):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in minhash.near_duplicates(df).collect())


def edited(rnd, words, share):
    return " ".join(rnd.choice(WORDS) + "x" if rnd.random() < share else w for w in words)


def test_minhash_on_odd_rows(spark):
    rnd = random.Random(7)
    long = prose(rnd, 20_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, long), (8, long + " a few more"), (8, long), (None, "a b c"), (None, None), (9, "é中 ß x\x0by z"), (10, "only here and without id"), (11, "a b c d"), (12, "a b c d a b c d")]
    assert found_classes(frame(spark, rows, "digest", "keys", "node", "root", "id", "size")) == classes(rows)
    assert minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(8, 4096, 8), (2, 5, 1)])
def test_minhash_links_of_large_groups(spark, monkeypatch, sizes):
    """Near copies around the limit, in groups larger than a block; chains that only members at their rim close."""
    for name, value in zip(("SMALL", "PART", "PARTNERS"), sizes):
        monkeypatch.setattr(minhash, name, value)
    rnd, rows = random.Random(8), []
    for share in (0.005, 0.02, 0.027, 0.03, 0.04):
        base = prose(rnd, 250).split()
        rows += [(len(rows) + k, edited(rnd, base, share)) for k in range(24)]
    words = prose(rnd, 200).split()
    for k in range(40):  # each is linked with its neighbours alone
        words = words[6:] + prose(rnd, 6).split()
        rows.append((len(rows), " ".join(words)))
    rnd.shuffle(rows)
    assert found_classes(frame(spark, rows)) == classes(rows)


def test_sketches_never_part_what_is_linked():
    rnd = np.random.default_rng(9)
    for n in (3, 40, 256, 257, 300, 511, 514, 2000):
        base = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in (0, n // 20, n // 10, n // 9):
            for cut in (0, k):
                other = np.unique(np.concatenate([base[k:], rnd.integers(0, 1 << 63, k - cut, dtype=np.uint64)]))
                one = np.unique(base)
                both = len(np.intersect1d(one, other))
                x, y = minhash.sketch(one), minhash.sketch(other)
                linked = 100 * both >= 80 * (len(one) + len(other) - both)
                may = minhash._may_link(len(one), int.from_bytes(x, "little"), len(other), int.from_bytes(y, "little"))
                near = minhash.Nodes(np.array([len(other)]), [y]).near(len(one), np.frombuffer(x, "<u8"))[0]
                assert may >= linked and bool(len(near)) == may


def test_circulant_signatures_agree_as_often_as_sets():
    rnd = np.random.default_rng(10)
    for share in (0.5, 0.8):
        agree = []
        for _ in range(60):
            both, one, two = (rnd.integers(0, 1 << 63, k, dtype=np.uint64) for k in (int(600 * share), *(int(300 * (1 - share)),) * 2))
            agree.append((minhash.signature(np.concatenate([both, one])) == minhash.signature(np.concatenate([both, two]))).mean())
        assert abs(np.mean(agree) - share) < 0.02
