"""SimHash components against all pairs, and the BK-tree against a list."""

import random
import re

import pytest
import xxhash

from almanac.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius=4):
    left, out = set(points), {}
    while left:
        start = left.pop()
        group, queue = {start}, [start]
        while queue:
            p = queue.pop()
            near = {q for q in left if (p ^ q).bit_count() <= radius}
            left -= near
            group |= near
            queue += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def near_numbers(rng, count):
    """Random numbers, chains of near ones and a dense cluster."""
    points = [rng.getrandbits(64) for _ in range(count)]
    for _ in range(count):
        p = rng.choice(points)
        for _ in range(rng.choice((1, 2, 4, 5, 6))):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    centre = rng.getrandbits(64)
    points += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(count)]
    return sorted(set(points))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two THREE", "a b c d", "a b c d e a b c d e", "É é\x0bİ ﬁ x\x00y z", "w " * 5000, "Same same same same same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_parts():
    """A text longer than a part has the shingles that lie across the cuts."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    assert len(text) > 2 << 20
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_tree_equals_list():
    rng = random.Random(2)
    points = near_numbers(rng, 300)
    for radius in (0, 3, 7):
        q = rng.choice(points) ^ 5
        assert sorted(simhash.BKTree(points).take(q, radius)) == [i for i, p in enumerate(points) if (p ^ q).bit_count() <= radius]


@pytest.mark.parametrize(("limit", "depth"), [(2048, 3), (8, 3), (8, 1), (30, 2)])
def test_links_connect_what_all_pairs_connect(spark, limit, depth):
    points = near_numbers(random.Random(3), 250)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), limit=limit, depth=depth).distinct().collect()
    group = {p: p for p in points}

    def top(p):
        while group[p] != p:
            p = group[p]
        return p

    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        group[top(a)] = top(b)
    want = brute_components(points)
    got: dict = {}
    for p in points:
        got.setdefault(top(p), set()).add(p)
    assert {frozenset(g) for g in got.values()} == set(want.values())


def test_blocks_of_bits_cover_all():
    for path in ((), (0,), (4, 2)):
        blocks = simhash.masks(path, 4)
        assert sum(b.bit_count() for b in blocks) == sum(blocks).bit_count() and len(blocks) == 5
    assert sum(simhash.masks((), 4)) == (1 << 64) - 1


def test_components_of_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=n)) for n in (0, 2, 3, 4, 60, 60, 500)]
    texts = [None, "", " "] + base + [t.upper() for t in base] + [t + " tail" for t in base]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "an id again"), (None, base[4]), (None, "nameless only"), (30, base[5]), (30, base[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS unit")
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    groups = brute_components([f for _, f in prints])
    want = sorted(((i, f, min((j for j, g in prints if g in groups[f] and j is not None), default=None)) for i, f in prints), key=str)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(frame).collect()]
    assert sorted(got, key=str) == want
    assert simhash.simhash_components(frame.where("false")).count() == 0
