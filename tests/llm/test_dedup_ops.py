"""Exact, near and substring dedup, and components, against brute force."""

import hashlib
import random
import re

import xxhash

from ledgerlink.llm.components import connected_components
from ledgerlink.llm.exact_dedup import exact_dedup
from ledgerlink.llm.near_copies import first_pairs, near_copies, other_pairs
from ledgerlink.llm.repeats import remove_repeats
from ledgerlink.llm.simhash import fingerprint, fingerprint_links, simhash_components


def closure(nodes, edges):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    return best


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.u: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = {n: m for n, m in closure({x for e in real for x in e}, real).items() if n != m}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_exact_dedup(spark):
    rows = [(5, "a b"), (3, "a  b\n"), (9, "ab"), (1, None), (2, ""), (4, " \t"), (7, "x"), (8, "x"), (8, "x"), (6, "É b"), (10, "y" * 100000)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string"), slots=5, fan_in=2).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {
        5: (3, 3, False), 3: (3, 3, True), 9: (3, 3, False), 1: (4, 3, False), 2: (4, 3, False), 4: (4, 3, True), 7: (7, 3, True), 8: (7, 3, False), 6: (6, 1, True), 10: (10, 1, True)
    }
    twice = exact_dedup(spark.createDataFrame([(8, "x"), (8, "x"), (8, "y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in twice) == [(8, 1, True), (8, 2, True), (8, 2, True)]
    assert got[6].text_sha256 == hashlib.sha256("Éb".encode()).hexdigest()
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_fingerprint(t, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_and_components(spark):
    rng = random.Random(4)
    words = [f"W{i}é" for i in range(40)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        for j in range(3):
            copy = list(base)
            if copy and j:
                copy[rng.randrange(len(copy))] = "new"
            docs.append((i * 3 + j, " ".join(copy)))
    docs += [(1000, None), (1001, "　a"), (1002, "x " * 70000)]
    for _, t in docs:
        assert fingerprint((t or "").encode(), 3) == brute_fingerprint(t, 3)
    fps = {i: brute_fingerprint(t, 3) for i, t in docs}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = closure(fps, links)
    got = simhash_components(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, fp int")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_join_all_within_two_bits(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(12)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    rows = fingerprint_links(spark.createDataFrame(signed, "node long, fp long"), "node", "fp", 2).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 2 for r in rows)
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert closure(range(len(fps)), [(r.a, r.b) for r in rows]) == closure(range(len(fps)), want)


def test_near_copies_are_verified_and_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        docs.append((i * 10, " ".join(base)))
        for j in (1, 2):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(300)] = "changed"
            docs.append((i * 10 + j, " ".join(copy)))
    docs += [(9000, None), (9001, ""), (9002, "short"), (9003, "one two three four five six")]
    got = {r.doc_id: r.keep_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(k // 10 == i // 10 and k < i for i, k in got.items())  # only true copies are linked
    assert len(got) >= 40  # of 80: a change of one of 300 equally common words moves about two bits
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_find_every_pair(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    docs, at = [], 0
    for n in (60, 100, 150, 300, 700):
        for _ in range(12):
            base = some(n)
            scattered = list(base)
            for k in range(max(1, n // 60)):
                scattered[rng.randrange(n)] = f"new{k}"
            block = list(base)
            block[n // 3 : n // 3 + n // 15] = some(n // 15)
            for copy in (base, base + some(n // 5 - 2), block, scattered, [*base, "one", "two"]):
                docs.append((at, " ".join(copy)))
                at += 1
    sets = {}
    for i, t in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i: c for i, c in closure(sets, links).items() if c != i}
    got = {r.doc_id: r.keep_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 200 and got == want


def test_near_copies_beside_a_stranger_are_linked(spark):
    # ids 1 and 3 are copies; 2 lies between them in every bucket of shingles that all three share
    rows = [(key, i, n, 0) for key in (7, 8) for i, n in ((1, 20), (2, 100), (3, 21))] + [(9, i, 20, 0) for i in range(10, 700, 3)]
    prefix = spark.createDataFrame(rows, "key long, id long, n int, i int")
    assert {(r.a, r.b) for r in first_pairs(prefix, 0.8).collect() if r.a < 10} == {(1, 3)}
    comps = spark.createDataFrame([(i, 10) for i in range(13, 700, 3) if i != 400], "u long, component long")
    other = {(r.a, r.b) for r in other_pairs(prefix, comps, 0.8).collect()}
    assert other == {(1, 3)} | {(min(i, 400), max(i, 400)) for i in range(10, 700, 3) if i != 400}  # one group: only the one outside it is compared
    rng = random.Random(13)
    some = lambda n: [str(rng.randrange(9000)) for _ in range(n)]
    line, docs = some(40), []
    for k in range(0, 60, 3):
        tail = some(4)
        docs += [(k, " ".join(line + tail + some(4))), (k + 1, " ".join(line + some(60))), (k + 2, " ".join(line + tail[:2] + some(3)))]
    got = {r.doc_id: r.keep_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k + 2 for k in range(0, 60, 3)} <= set(got) and not any(i % 3 == 1 for i in got)


def brute_repeats(docs, size=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for at in range(len(words) - size + 1):
            w = tuple(words[at : at + size])
            if w in seen:
                gone.update(range(at, at + size))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), kept)
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["É", "世"]
    passages = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 45, 80]))] for _ in range(8)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += p if rng.random() < 0.5 else p[cut:] + [rng.choice(words) for _ in range(rng.randrange(30))]
        docs.append((i * 7 % 120, "  ".join(parts)))
    docs += [(500, None), (501, ""), (502, "same " * 60), (503, "same " * 19), (504, "a b " * 40), (505, " ".join(map(str, range(3000)))), (506, " ".join(map(str, range(3000))))]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, pos string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame).collect()}
    assert got == brute_repeats(docs)
    assert remove_repeats(frame.limit(0)).count() == 0
