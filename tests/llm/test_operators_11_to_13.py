"""Spelling variants, the divergence audit and circulant MinHash against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import circulant, divergence, minhash, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, parts=3):
    """rows of (doc_id, text, lang, source), with columns of clashing names."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(parts)
    for name in ("word", "n", "term", "count", "node", "set", "value", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- spelling variants


def variants_by_hand(rows, damage):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
        return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]

    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = [n[w], len(close)]
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, *out[w], n.get(form[w]))
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    base = ["colour", "harbour", "neighbour", "réserve", "Übergang", "aaaaaa", "abcdefg", "internationalisation", "x" * 300]
    words = []
    for w in base:
        words += [w] * 150
        for c in (30, 6, 5, 1):
            for _ in range(6):
                i = rng.randrange(len(w))
                words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aouéx") + w[i:], w[:i] + rng.choice("aouéx") + w[i + 1 :]])] * c
    words += ["aaaaab"] * 30 + ["aaaabb"] * 6 + ["short", "word12word", "a×b÷cdefgh"] * 9
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::60]), "en", "a") for i in range(60)]
    return [*rows, (None, "colour, colour; COLOUR\ncolour-colour", "en", "a"), (None, None, None, None), (7, "", "en", "a"), rows[3], rows[3]]


@pytest.mark.parametrize(("damage", "shared", "letters"), [(0, 768, 60_000), (3, 768, 60_000), (3, 1, 60), (0, 4, 400)])
def test_spelling(spark, monkeypatch, misspelt, damage, shared, letters):
    monkeypatch.setattr(spelling, "SHARED", shared)
    monkeypatch.setattr(spelling, "PART_LETTERS", letters)
    monkeypatch.setattr(spelling, "STEP_BITS", 1 << 10)
    want = variants_by_hand(misspelt, damage)
    got = spelling.variants(table(spark, misspelt), damage).collect()
    assert len(got) == len(want) > 40
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    if not damage:
        assert any(r["root"] not in (r["word"], r["form"]) for r in got), "no chain of forms"


def test_spelling_of_nothing(spark, misspelt):
    assert spelling.variants(table(spark, misspelt).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None, "en", "a"), (2, "few words here", "en", "a")])).count() == 0


def test_position_index_finds_each_edit():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(150)})
    index = spelling.PositionIndex(words)

    def edits(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "ab"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "ab"}

    for w in ["abab", "bbbbb", "aaaaaa", "abbaab", "cccc", "abacab"]:
        hit = np.unpackbits(index.near(spelling.letters_of([w])[0], len(w)).view(np.uint8), bitorder="little")[: len(words)]
        assert {x for x, there in zip(words, hit, strict=True) if there} == (edits(w) & set(words)) - {w}


# --- divergence audit


def audit_by_hand(rows, least=10, top=10):
    docs = [[x or "" for x in r[1:4]] for r in rows]
    split = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    within, total, where = {}, {}, {}
    for text, lang, source in docs:
        own = Counter(split(text))
        within.setdefault((lang, source), Counter()).update(own)
        total.setdefault(lang, Counter()).update(own)
        where.setdefault(lang, Counter()).update(set(own))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), count in within.items():
        kept = [t for t, n in where[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = share(count), share(total[lang])
        pairs = [(-sum(f(p[t], o[t]) for t in kept), other.encode(), other) for (x, other), c in within.items() if x == lang and other != source for o in [share(c)]]
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if count[t] and p[t] > q[t]]
        for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    vocabulary = ["ab", "Ab", "éa", "zoo", "𝒳y", "ﬁn", "word", "Term", "oak", "elm", "ash", "yew", "fir", "bay", "fig", "ivy", "rue", "box"]
    rows = []
    for i in range(260):
        source = rng.choice(["s1", "s2", "s3", None, "ß", "￿", "𝒳"])
        lean = vocabulary[: 4 + len(source or "") * 5] if rng.random() < 0.6 else vocabulary
        rows.append((i, rng.choice([" ", "\n", "1", "-"]).join(rng.choice(lean) for _ in range(rng.randint(1, 40))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, None, "en", "silent"), (1, "", "de", "silent"), (2, "123 -- @", "xx", "one"), (3, "few terms", "xx", "two"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 2), (1000, 10)])
def test_divergence(spark, monkeypatch, spoken, least, top):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(table(spark, spoken), least, top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == audit_by_hand(spoken, least, top)


def test_divergence_of_nothing(spark, spoken):
    assert divergence.audit(table(spark, spoken).limit(0)).count() == 0


def test_skyband_against_all_pairs():
    made = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 1), (700, 1), (900, 4)):
        high, low, word = made.integers(0, 12, n), made.integers(0, 12, n), made.permutation(n)
        over = [(int(((high >= high[i]) & (low <= low[i]) & (word < word[i])).sum())) for i in range(n)]
        assert (divergence.in_skyband(high, low, word, k) == (np.array(over) < k)).all()


def test_shares_of_very_large_counts(spark):
    rows = [(0, 1, 1), (10**12, 3 * 10**12, 10**6), (10**17, 10**17, 5), (999, 10**18, 10**9)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["v"]) for r in got)


# --- circulant MinHash


def near_by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids.setdefault(root(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min(ids[root(i)], default=None) if root(i) in ids else None) for i, r in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def alike():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for n in (1, 2, 3, 6, 12, 60, 400):
        for _ in range(3):
            base = text(n)
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 12))):
                    copy[rng.randrange(n)] = rng.choice(words)
                rows.append(" ".join(copy))
    one = text(200)
    # each a few words from the one before
    for i in range(40):
        one[i * 4] = f"new{i}"
        rows.append(" ".join(one))
    rows += [None, "", " \n", "w1", "W1", "w1 w1 w1 w1", "x" * 5000, "é É", "é é"]
    rng.shuffle(rows)
    rows = [(i, t, "en", "a") for i, t in enumerate(rows)]
    return [*rows, (None, rows[5][1], "en", "a"), (None, "only without id", "en", "a"), rows[9], rows[9], (3, "another text of this id", "en", "a")]


@pytest.mark.parametrize("crowd", [256, 6])
def test_circulant(spark, monkeypatch, alike, crowd):
    monkeypatch.setattr(circulant, "CROWD", crowd)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    got = circulant.deduplicated(table(spark, alike)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_by_hand(alike)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_circulant_of_nothing(spark, alike):
    assert circulant.deduplicated(table(spark, alike).limit(0)).count() == 0
    got = circulant.deduplicated(table(spark, [(2, "", "en", "a"), (1, None, "en", "a")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_coordinates_are_those_of_permutations():
    made = np.random.default_rng(6)
    x = made.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    for step in (circulant.scattered, circulant.rank_at):
        assert len(np.unique(step(x))) == len(np.unique(x))
    # coordinates agree as often as sets are similar, also for sets of neighbouring numbers
    for base in (x, np.arange(100_000, dtype=np.uint64)):
        for share in (0.5, 0.8):
            agreed = []
            for t in range(40):
                own = base[t * 1000 : t * 1000 + 1000]
                both = round(2 * share / (1 + share) * 500)
                a, b = own[:500], np.concatenate([own[:both], own[500 : 1000 - both]])
                agreed.append((circulant.signature(a) == circulant.signature(b)).mean())
            assert abs(np.mean(agreed) - share) < 0.02
