import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cinderbark.llm import simhash as op
from tests.llm.fixtures import docs, no_docs, rows


def slow_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    label = list(range(len(fps)))
    for a, b in combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= op.DISTANCE:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
    return label


def test_fingerprints(spark):
    for _, t, *_ in rows():
        assert op.fingerprint(t) == slow_print(t)


def test_components_match_brute_force(spark):
    table = rows()
    labels = brute_components([op.fingerprint(t) for _, t, *_ in table])
    want = []
    for k, (i, t, *_) in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if labels[j] == labels[k] and table[j][0] is not None]
        want.append((str(i), f"{op.fingerprint(t):016x}", str(min(ids) if ids else None)))
    got = [(str(r.doc_id), r.fingerprint, str(r.component_id)) for r in op.near_duplicates(docs(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_links_lose_nothing(spark):
    """Clouds of near fingerprints and noise, also with blocks so small that every key is split."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:6]:
        for _ in range(60):
            x = c
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    want = brute_components(fps)
    for block, long_from in ((op.BLOCK, op.LONG_FROM), (7, op.LONG_FROM), (op.BLOCK, 0), (7, 0)):
        label = {x: x for x in signed}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for e in op.links(df, block, long_from).collect():
            label[root(e.a)] = root(e.b)
        got = [root(x) for x in signed]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(fps)), 2))


def test_pigeonring_keeps_every_pair_within_the_distance():
    r = random.Random(9)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << k
        diff = np.array([a ^ b], np.uint64)
        for long, of in ((False, 2), (True, 10)):
            ka, kb = (op.keys(np.array([x], np.uint64), long) for x in (a, b))
            assert [int(x[0]) >> 60 for x in ka] == [i // of for i in range(5 * of)]
            shared = [i for i in range(5 * of) if ka[i][0] == kb[i][0]]
            assert any(op.chain_holds(np.array([i // of]), diff)[0] for i in shared)


def test_components_of_null_ids_stay_apart(spark):
    from tests.llm.fixtures import DOCS, words

    table = [(None, words(200, k), "en", "s", 0) for k in (1, 2, 2, 3)]
    assert op.keep_one(spark.createDataFrame(table, DOCS)).count() == 3


def test_keep_one_and_empty(spark):
    kept = op.keep_one(docs(spark))
    labels = brute_components([op.fingerprint(t) for _, t, *_ in rows()])
    assert kept.columns == docs(spark).columns and kept.count() == len(set(labels))
    assert op.near_duplicates(no_docs(spark)).count() == 0 and op.keep_one(no_docs(spark)).count() == 0


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_components(texts):
    """Brute force: the components of all pairs whose five-word shingles have a similarity of 0.8 or more."""
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] | sets[b])
        if (len(sets[a] & sets[b]) / both if both else 1.0) >= op.SIMILARITY:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
    return label


def near_copies(r, bases=60, copies=4):
    """Texts with copies of which some words are others: similar ones, and some that are just not similar enough."""
    from tests.llm.fixtures import DOCS, words

    table = []
    for k in range(bases):
        base = words(r.randint(80, 400), 3000 + k).split()
        table.append(" ".join(base))
        for _ in range(r.randint(0, copies)):
            other = list(base)
            for at in r.sample(range(len(other)), max(1, int(len(other) * r.choice([0.004, 0.01, 0.02, 0.05])))):
                other[at] = "zz" + other[at]
            table.append(" ".join(other))
    r.shuffle(table)
    return [(i, t, "en", "s", 0) for i, t in enumerate(table)], DOCS


def test_similar_documents_recall_and_no_false_drop(spark):
    table, schema = near_copies(random.Random(12))
    df = spark.createDataFrame(table, schema)
    labels = similar_components([t for _, t, *_ in table])
    kept = {r.doc_id for r in op.keep_one_similar(df).collect()}
    groups = {}
    for (i, *_), label in zip(table, labels):
        groups.setdefault(label, []).append(i)
    assert all(kept & set(g) for g in groups.values())  # one of each group stays at least
    extra, more = sum(len(kept & set(g)) - 1 for g in groups.values()), sum(len(g) - 1 for g in groups.values())
    assert extra <= 0.1 * more and more > 50
    for block, long_from in ((7, op.LONG_FROM), (op.BLOCK, 0)):
        other = {r.doc_id for r in op.keep_one_similar(df, block, long_from).collect()}
        assert all(other & set(g) for g in groups.values()) and abs(len(other) - len(kept)) <= 2


def test_similar_odd_rows(spark):
    kept = op.keep_one_similar(docs(spark))
    labels = similar_components([t for _, t, *_ in rows()])
    assert kept.columns == docs(spark).columns and kept.count() == len(set(labels))
    assert {str(r.doc_id) for r in kept.collect()} == {str(min((i for (i, *_), x in zip(rows(), labels) if x == label and i is not None), default=None)) for label in set(labels)}
    assert op.keep_one_similar(no_docs(spark)).count() == 0


def test_sketches_match_plain_counts():
    for text in ("a b c", "one", "A b  c\nd e f g " * 20, ""):
        w = text.lower().split()
        runs = [" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))] if w else []
        whole, prints = op.sketches(text)
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        assert prints[0] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert len(prints) == op.SKETCHES and (whole == 0) == (not w)


@pytest.mark.parametrize("block", [op.BLOCK, 2])
def test_similar_pairs_behind_failed_ones_are_found(spark, block):
    """The nearest fingerprints span a run by pairs that aren't similar; the similar pair lies further apart."""
    same = " ".join(f"w{k}" for k in range(60))
    texts = [same, "other words " * 20, same + " more", " ".join(f"v{k}" for k in range(60))]
    whole = spark.createDataFrame(list(enumerate(texts)), "r bigint, text string")
    reps = spark.createDataFrame([(k, [fp + (n << 32) for n in range(op.SKETCHES)], (k,)) for k, fp in enumerate((0, 1, 3, 7))], "id bigint, fps array<bigint>, win struct<row:bigint>")
    found = op.similar_pairs(whole, "r", reps, block, op.LONG_FROM)
    assert [tuple(r) for r in found.collect()] == [(0, 2)]


@pytest.mark.parametrize("block", [op.BLOCK, 70])
def test_failed_pairs_of_a_large_group_are_no_rows(spark, block, monkeypatch):
    """300 texts that are all candidates of each other, few of them similar: tables grow with texts, not with pairs."""
    from tests.llm.fixtures import words

    r, texts = random.Random(3), []
    for k in range(100):
        base = words(r.randint(40, 90), 500 + k).split()
        texts += [" ".join(base), " ".join([*base, "more"]), words(60, 900 + k)]
    r.shuffle(texts)
    whole = spark.createDataFrame(list(enumerate(texts)), "r bigint, text string")
    made = [(k, [(r.getrandbits(64) & 3) + (n << 32) for n in range(op.SKETCHES)], (k,)) for k in range(len(texts))]
    reps = spark.createDataFrame(made, "id bigint, fps array<bigint>, win struct<row:bigint>")
    written, cut = {}, op.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(op, "cut", counted)
    found = [tuple(x) for x in op.similar_pairs(whole, "r", reps, block, op.LONG_FROM).collect()]
    labels = similar_components(texts)
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if labels[a] == labels[b]}
    assert len(want) == 100 and set(found) == want and len(found) == len(want)
    assert max(written.values()) <= 40 * len(texts), written


def test_spanning_matches_brute_force():
    """Sets of many sizes, an empty pair and both sides of a pair of blocks."""
    r = random.Random(8)
    for side_of in (lambda k: 0, lambda k: 1 + k % 2):
        for _ in range(40):
            base = [r.sample(range(1000), r.randint(1, 60)) for _ in range(4)]
            sets = [np.array(sorted({x if r.random() > 0.06 else r.randrange(1000) for x in r.choice(base)}), np.int64) for _ in range(25)]
            sets += [np.zeros(0, np.int64)] * 2
            part = np.array([r.randrange(12) for _ in sets])
            side = np.array([side_of(k) for k in range(len(sets))])

            def joined(pairs):
                label = part.copy()
                for a, b in pairs:
                    label[label == label[b]] = label[a]
                return label

            near = lambda a, b: not (a | b) or len(a & b) / len(a | b) >= op.SIMILARITY
            meet = [(a, b) for a, b in combinations(range(len(sets)), 2) if side[a] == 0 or side[a] != side[b]]
            want = joined([(a, b) for a, b in meet if near(set(sets[a].tolist()), set(sets[b].tolist()))])
            pairs = list(zip(*(x.tolist() for x in op.spanning(sets, part, side))))
            got = joined(pairs)
            assert ((got[:, None] == got) == (want[:, None] == want)).all() and len(pairs) < len(set(part.tolist()))
            assert all(near(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in pairs)


@pytest.mark.parametrize("block", [op.BLOCK, 50])
def test_candidates_of_a_large_group_grow_with_its_texts(spark, block, monkeypatch):
    """400 texts that are near in all sketches and 40 chains through other sketches: a few pairs for each text, none lost."""
    r, made = random.Random(4), []
    flip = lambda x, bits: x ^ sum(1 << b for b in r.sample(range(62), bits))
    base = [r.getrandbits(62) for _ in range(op.SKETCHES)]
    made += [[flip(x, r.randint(0, 3)) for x in base] for _ in range(400)]
    for k in range(40):
        chain = [[r.getrandbits(62) for _ in range(op.SKETCHES)] for _ in range(3)]
        for a, b in ((0, 1), (1, 2)):
            at = r.randrange(op.SKETCHES)
            chain[b][at] = flip(chain[a][at], r.randint(0, op.DISTANCE))
        made += chain
    r.shuffle(made)
    reps = spark.createDataFrame([(k, fps, (k,)) for k, fps in enumerate(made)], "id bigint, fps array<bigint>, win struct<row:bigint>")
    verified = []
    monkeypatch.setattr(op, "_shingle_sets", lambda found, *_: verified.append(found.collect()) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        op.similar_pairs(None, "row", reps, block, op.LONG_FROM)
    found = [tuple(x) for x in verified[0]]
    near = lambda a, b: any((x ^ y).bit_count() <= op.DISTANCE for x, y in zip(made[a], made[b]))
    assert all(near(a, b) for a, b in found)

    def joined(pairs):
        label = np.arange(len(made))
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return label

    got, want = joined(found), joined([p for p in combinations(range(len(made)), 2) if near(*p)])
    assert ((got[:, None] == got) == (want[:, None] == want)).all()
    assert len(found) <= 4 * len(made), len(found)
