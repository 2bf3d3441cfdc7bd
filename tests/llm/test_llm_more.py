"""Source audit, SimHash trees and whitening against brute force; exact counts where hashes collide."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import DOCS, WORD, clashing, rows_of

from weftgraph.llm import lpf_dedup, quality, simhash_tree, source_audit, url_lm, whitening

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


# --- source audit ------------------------------------------------------------------


def brute_audit(rows, least, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add(g)
        counts[g].update(terms)
        held[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        own = [g for g in groups if g[0] == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {g: shares(counts[g]) for g in own}
        q = shares(sum((counts[g] for g in own), Counter()))
        for g in own:
            pairs = [(h[1], sum(abs(p[g][t] - p[h][t]) for t in kept)) for h in own if h != g]
            terms = [(t, p[g][t] - q[t]) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(*g, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def audited():
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "éту", "don't", "x1y", "\U0001f600z", "q"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "\n"
    rows = [(i, text(r.randrange(1, 60)), r.choice(["en", "en", "de", None]), r.choice(["s0", "s0", "s0", "S1", "s2", None, "é", "zz"]), 0) for i in range(220)]
    rows += [(900, None, "en", "null text", None), (901, "", "fr", "only", 0), (902, "1 2 3", "fr", "digits", 0), (903, "word " * 9000, "en", "s2", 0), rows[0], rows[0]]
    return [(*x[:4], len(x[1] or "")) for x in rows]


def test_audit_equals_brute_force(spark, audited, monkeypatch):
    monkeypatch.setattr(source_audit, "CHUNK", 5)
    monkeypatch.setattr(source_audit, "SLAB", 2)
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    monkeypatch.setattr(source_audit, "ENTRIES", 300)
    monkeypatch.setattr(source_audit, "PIECE", 1000)
    docs = spark.createDataFrame(audited, DOCS).repartition(3)
    want = brute_audit(audited, 30, 50)
    assert rows_of(source_audit.audit(docs)) == want and {x[2] for x in want} == {"pair", "term"}


def test_audit_limits_and_tables(spark, audited):
    docs = spark.createDataFrame(audited, DOCS)
    assert rows_of(source_audit.audit(clashing(docs), 3, 2)) == brute_audit(audited, 3, 2)
    assert source_audit.audit(docs.filter("false")).count() == 0


def test_shares_are_exact_at_any_size():
    r = random.Random(1)
    for size in (10, 10**9, 10**12, 10**15, 4 * 10**17):
        counts = [r.randrange(size) for _ in range(50)]
        total, v = sum(counts), 50
        want = [1 + 1_000_000_000 * (c + 5) // (total + 5 * v) for c in counts]
        assert source_audit.shares(np.array(counts, np.int64), total, v).tolist() == want


def test_packed_vectors_return():
    for counts in ([], [3], [1, 255], [256, 70000], [2**40, 1]):
        places = np.arange(len(counts)) * 7
        a, b = source_audit.unpack(source_audit.pack(places, np.array(counts, np.int64)))
        assert a.tolist() == places.tolist() and b.tolist() == counts


# --- SimHash -----------------------------------------------------------------------


def brute_print(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    shown = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shown]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_reach(prints, radius):
    """The root of each fingerprint, by all pairs."""
    x = np.array(prints, np.uint64)
    root = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root.tolist()


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(9)
    prose = lambda n: [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n\t\x0b "), (3, "One two"), (4, "oNE\ttwo"), (5, "one two three"), (6, "É é straße ΣΑΣ x y"), (7, "a a a a a a"), (8, "w " * 70_000)]
    for base in range(12):
        words = prose(r.choice([5, 40, 300]))
        for k in range(r.randrange(1, 6)):
            some = list(words)
            for _ in range(k):
                some[r.randrange(len(some))] = "new"
            rows.append((100 + base * 10 + k, " ".join(some)))
    return [*rows, (None, rows[12][1]), (None, "alone it stands here and now"), rows[11], rows[11]]


def test_simhash_equals_brute_force(spark, near_rows):
    rows = [(i, t, "en", "s", 0) for i, t in near_rows]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    prints = [brute_print(t) for _, t in near_rows]
    root = brute_reach(prints, 4)
    least = {}
    for (i, _), k in zip(near_rows, root, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = sorted(((i, format(p, "016x"), least[k]) for (i, _), p, k in zip(near_rows, prints, root, strict=True)), key=repr)
    assert rows_of(simhash_tree.near_duplicates(docs)) == want == rows_of(simhash_tree.near_duplicates(clashing(docs)))
    assert len({k for k in root}) < len(rows) - 5
    assert simhash_tree.near_duplicates(docs.filter("false")).count() == 0


def some_prints(seed, n, clusters):
    """Fingerprints at random and in clusters, some at the very radius."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(clusters):
        at = r.getrandbits(64)
        for _ in range(n // clusters):
            at ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4, 5, 6])))
            out.append(at)
    return sorted(set(out))


@pytest.mark.parametrize("radius,depth,block", [(4, 1, 10_000), (4, 3, 40), (1, 2, 50), (7, 2, 10_000)])
def test_shards_lose_no_link(spark, radius, depth, block):
    prints = some_prints(radius + depth, 150, 5)
    df = spark.createDataFrame([(simhash_tree._long(p),) for p in prints], "print long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash_tree.print_links(df, radius, block, depth).collect()]
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    root = brute_reach(prints, radius)
    ours = defaultdict(set)
    for p, k in zip(prints, root, strict=True):
        ours[find(p)].add(k)
    assert all(len(k) == 1 for k in ours.values()) and len(ours) == len(set(root))


def test_trees_go_down_to_leaves():
    """A task's tree with small leaves, guests and a second block finds what all pairs find."""
    mask = simhash_tree.bands(4)[0]
    r = random.Random(2)
    own = [p & ~mask | r.getrandbits(9) for p in some_prints(8, 200, 4)]
    guests = [own[r.randrange(len(own))] ^ (1 << r.randrange(21)) ^ (1 << r.randrange(30, 64)) for _ in range(150)]
    met = [own[r.randrange(len(own))] ^ (1 << r.randrange(30, 64)) for _ in range(100)]
    as_array = lambda x: np.array(x, np.uint64)
    a, b = simhash_tree.tree_links(as_array(own), as_array(guests), as_array([]), mask, 4, leaf=8)
    every = sorted({*own, *guests})
    root = dict(zip(every, brute_reach(every, 4), strict=True))
    assert all(root[int(x)] == root[int(y)] for x, y in zip(a, b, strict=True))
    linked = {int(y) for y in b}
    for g in guests:
        near = [o for o in own if (o ^ g).bit_count() <= 4 and ((o ^ g) & mask).bit_count() == 1]
        assert not near or g in linked
    a, b = simhash_tree.tree_links(as_array(own), as_array([]), as_array(met), mask, 4, leaf=8)
    assert {int(x) for x in b} >= {m for m in met if any((o ^ m).bit_count() <= 4 and not (o ^ m) & mask for o in own)} - set(own)


# --- whitening ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def exact_fit(vectors):
    """Fit list, and the covariance in fractions."""
    xs = sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[j] for x in xs), n) for j in range(d)]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(d)] for i in range(d)]
    return xs, mean, cov


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 5)) * [1, 30, 0.2, 500, 3] + [0, 1e4, -3, 0, 9]
    return [*base.tolist(), base[3].tolist(), (base[4] + 1e-5).tolist(), [-0.001, 0.0, 0.015, 1.0, 2.0]]


def test_whitening_equals_exact_fractions(spark, vectors):
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [1.0, None, 2.0, 3.0, 4.0], 0), (902, [float("nan")] * 5, 0), (903, [1.0, float("-inf"), 0.0, 0.0, 0.0], 0), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(3)
    xs, mean, cov = exact_fit(vectors)
    n = len(xs)
    e, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    e, axes = e[::-1], axes[:, ::-1]
    got = whitening.whitened(df).collect()
    assert len(got) == (len(vectors) + 1) * 5 and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    for r in got:
        x = [int(np.floor(64 * c)) + 1_000_000 for c in vectors[r["vec_id"] or 0]]
        assert r["deviation"] == sum((n * a - n * m) ** 2 for a, m in zip(x, mean, strict=True)) == int(r["deviation_exact"])
        k = r["component"] - 1
        want = float(np.dot([float(a - m) for a, m in zip(x, mean, strict=True)], axes[:, k]) / e[k] ** 0.5)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-5
        assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-6
    same = {(r["component"], r["whitened"]) for r in got if r["vec_id"] in (3, len(vectors) - 3)}
    assert len(same) == 5  # equal vectors, equal values
    wide = df.withColumns({c: F.lit("x") for c in ("key", "n", "component", "i", "part")})
    assert rows_of(whitening.whitened(wide)) == rows_of(whitening.whitened(df))


def test_whitening_of_odd_tables(spark):
    make = lambda *v: spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], VECTORS)
    assert whitening.whitened(make([1.0, 2.0]).filter("false")).count() == 0
    assert whitening.whitened(make([1.0, 2.0], [1.0, 2.0])).count() == 0  # one distinct vector
    assert whitening.whitened(make([], [])).count() == 0
    line = whitening.whitened(make([1.0, 5.0], [2.0, 5.0], [4.0, 5.0])).collect()
    assert len(line) == 3 and all(r["explained"] == 1 and r["identity_error"] < 1e-12 for r in line)
    # shorter vectors are filled up with 0.0
    filled, ragged = whitening.whitened(make([1.0, 0.0], [2.0, 3.0], [4.0, 0.0])), whitening.whitened(make([1.0], [2.0, 3.0], [4.0]))
    assert rows_of(filled.select("vec_id", "component", "deviation", "explained")) == rows_of(ragged.select("vec_id", "component", "deviation", "explained"))
    huge = whitening.whitened(make([1e300, 0.0], [-1e300, 1.0], [3e17, 2.0])).collect()
    assert huge and all(r["deviation"] is None and len(r["deviation_exact"]) > 30 for r in huge if r["vec_id"] == 0)


@pytest.mark.parametrize("most", [3, 10**7, 10**9, 2**62])
def test_scatter_is_exact_at_any_size(most):
    r = random.Random(most)
    rows = np.array([[r.randrange(-most, most + 1) for _ in range(3)] for _ in range(40)], np.int64)
    sums, products = whitening.scatter(rows)
    exact = rows.astype(object)
    assert sums.tolist() == exact.sum(0).tolist() and products.tolist() == (exact.T @ exact).tolist()
    assert whitening.from_keys(whitening.as_keys(rows), 4)[:, :3].tolist() == rows.tolist()
    for v in (0, 1, -1, most**5, -(most**3)):
        assert sum(part << (32 * k) for k, part in whitening.limbs(v)) == v


# --- exact counts and keys of earlier operators ----------------------------------------


def test_repeats_are_exact_whatever_the_hash(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 400, 3000)] + ["x " * 50, "a b c d a b c", " ".join(str(i) for i in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def brute(t):
        w = t.split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})

    for bits in (64, 5, 1):
        got = {x["text"]: x["_quality_n_repeat_words"] for x in quality.with_metrics(df, bits).collect()}
        assert got == {t: brute(t) for t in texts}


def test_each_page_comes_out_once(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.net/x", "http://a.net/x", None, "", "http://b.com/" + "y" * 5000, "http://é.org/fr/z"] * 3)], "page_id long, url string")
    got = url_lm.url_filter(pages).collect()
    assert sorted(x["page_id"] for x in got) == list(range(18)) and all(x["verdict"] in ("allow", "block") for x in got)


# --- longest previous factors ------------------------------------------------------


def shared_start(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(12))
def test_longest_previous_factor(seed):
    r = random.Random(seed)
    full = lpf_dedup.LENGTH
    starts = ["".join(r.choice("ab") for _ in range(r.choice([3, 60, full]))) for _ in range(4)]
    texts = [(s + "".join(r.choice("ab") for _ in range(2 * full)))[: r.choice([full, full + 8])].encode() for s in r.choices(starts, k=300)]
    rows = np.array([list(t.ljust(full + 8, b"\0")) for t in texts], np.uint8)
    position = np.array([r.randrange(200) for _ in texts], np.int32)  # some are equal: neither is earlier
    order, shared = lpf_dedup.suffix_order(rows)
    assert [texts[i] for i in order] == sorted(texts)
    got = lpf_dedup.longest_previous_factor(position[order], np.minimum(shared, full))
    for i, factor in zip(order, got, strict=True):
        brute = max((min(shared_start(texts[i], t), full) for t, p in zip(texts, position, strict=True) if p < position[i]), default=0)
        assert factor <= brute and (factor >= full) == (brute >= full)


def test_suffix_order_one_byte_earlier():
    r = random.Random(5)
    full = lpf_dedup.LENGTH
    data = np.array([r.choice(b"ab") for _ in range(900)] * 2 + [r.choice(b"abc") for _ in range(300)], np.uint8)
    starts = np.arange(40, len(data) - full)
    tail = lambda s: data[s : s + full].tobytes()
    order, shared = lpf_dedup.suffix_order(np.stack([data[s : s + full] for s in starts]))
    for d in range(1, 41):
        order, shared = lpf_dedup._one_earlier(order, shared, data[starts[order] - d])
        got = [tail(starts[i] - d) for i in order]
        assert got == sorted(got)
        assert list(shared[1:]) == [min(shared_start(a, b), full) for a, b in zip(got, got[1:], strict=False)]


def test_chunks_that_recur_outlive_a_full_memory():
    import public_tokenizers

    from weftgraph.llm.bpe_ids import ChunkEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = ChunkEncoder(path, max_chunks=40), ChunkEncoder(path)
    made, make = [], small.known.make
    small.known.make = lambda chunk: made.append(chunk) or make(chunk)
    texts = [f"often here {chr(97 + i % 26) * 3}{chr(97 + i // 26)} often, once" for i in range(300)]
    assert [small.encode([x]) for x in texts] == [large.encode([x]) for x in texts]
    assert made.count("here") == made.count("often,") == 1 and len(small.known) + len(small.known.older) < 100
