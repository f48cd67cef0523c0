"""SimHash, line dedup and decontamination against brute force and on awkward rows."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftmill.llm import decontam, linededup, resemblance, shared, simhash

SCHEMA = "doc_id long, text string, fp string, component string, pos int"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    base = [words(rng, 120) for _ in range(6)]
    for i in range(90):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = "changed"
        texts[i * 3 + 1] = " ".join(text)
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "One", 1004: "one ", 1005: "Two Words", 1006: "Äb cd ef", 1007: "äb CD EF", 1008: "x " * 70_000}
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(df.union(df.where("doc_id = 1"))).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)
    assert simhash.near_duplicates(df.union(df.where("doc_id = 1"))).count() == len(texts) + 1


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2, 60])
def test_links_of_random_fingerprints(spark, heavy, monkeypatch):
    """Dense and sparse groups, with the pairs of large index keys by meeting points too."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(2)
    fps = {}
    for g in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 8])):
                x ^= 1 << rng.randrange(64)
            fps.setdefault(x, len(fps))
        upper = rng.getrandbits(32)
        for _ in range(40):  # one half in common, the other close or far
            fps.setdefault(upper << 32 | rng.choice([0, 0xFFFF, rng.getrandbits(32)]) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32), len(fps))
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in fps.items()], "fp long, rep long")
    found = shared.connected_components(simhash.fingerprint_links(reps))
    got = {i: i for i in fps.values()} | {r.node: r.component for r in found.collect()}
    assert got == brute_components({i: x for x, i in fps.items()})


def test_near_duplicates_with_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "lonely text here"), (9, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 7), (7, 7), (None, None), (9, 9)}
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {None, 7, 9}
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(3, 3), (140, 100)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in [5, *range(200, 260)]}


def brute_lines(docs, least):
    """{id: kept text}: common runs of lines are walked place by place, from their first line to their
    last; of a run in one document, parts that don't overlap their earlier place count."""
    lines = {}
    for d, t in docs.items():
        own = [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        lines[d] = [(i, x, x.count(" ") + 1) for i, x in own]
    places, gone = {}, {d: set() for d in docs}
    for d in sorted(docs):
        own = lines[d]
        for a, (_, x, _) in enumerate(own):
            for d0, a0 in places.setdefault(x, []):
                if a and a0 and own[a - 1][1] == lines[d0][a0 - 1][1] and (d != d0 or a != a0):
                    continue  # the run began before
                k = 0
                while a + k < len(own) and a0 + k < len(lines[d0]) and own[a + k][1] == lines[d0][a0 + k][1]:
                    k += 1
                apart = k if d != d0 else a - a0
                for begin in range(a, a + k - min(k, apart) + 1):
                    part = own[begin : begin + min(k, apart)]
                    if sum(n for _, _, n in part) >= least:
                        gone[d] |= {i for i, _, _ in part}
            places[x].append((d, a))
    return {d: t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    passages = ["\n".join(words(rng, rng.randrange(1, 14)) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    docs = {}
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(8))]
        docs[i] = "\n".join(parts)
    docs |= {200: None, 201: "", 202: "\n\n", 203: "same two\n" * 40, 204: "  padded line of words  \n" * 30, 205: "\n".join(words(rng, 3) for _ in range(3000)), 206: "a\n\n" + passages[0] + "\n\n" + passages[1]}
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in docs.items()], SCHEMA)
    rows = linededup.dedup_lines(df, words=20).collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(docs, 20)
    assert any(r.lines_removed for r in rows) and all(r.component == "b" for r in rows)


def test_a_run_is_deleted_whole_whatever_else_repeats_parts_of_it(spark):
    """Lines of 30, 30 and 10 words: the longest common run counts, not the first place of its window."""
    a, b, c, z = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 30), ("c", 10), ("z", 10)))
    docs = {1: f"{a}\n{b}", 2: f"{z}\n{a}\n{b}\n{c}", 3: f"{c}\n{a}\n{b}\n{c}\n{z}", 4: f"{z}\n{a}\n{b}\n{a}"}
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in docs.items()], SCHEMA)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == brute_lines(docs, 50) == {1: docs[1], 2: f"{z}\n{c}", 3: f"{c}\n{z}", 4: a}
    names = df.selectExpr("doc_id", "text", "1 AS lines", "2 AS gone", "3 AS split", "4 AS item", "5 AS doc", "6 AS version")
    assert linededup.keep_new_lines(names).columns == names.columns
    assert sorted(linededup.dedup_lines(names).columns) == sorted({*names.columns, "lines_removed", "words_removed"})


def test_line_dedup_of_hot_contents(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)
    rng = random.Random(9)
    shared = ["\n".join(words(rng, 9) for _ in range(4)) for _ in range(3)]
    docs = {i: words(rng, 8) + "\n" + rng.choice(shared) + "\n" + words(rng, 8) for i in range(40)}
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in docs.items()], SCHEMA)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df, words=20).collect()} == brute_lines(docs, 20)


def test_line_dedup_of_repeated_rows_null_ids_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (1, long), (2, "x\n" + long), (None, long), (3, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.lines_removed, r.words_removed) for r in linededup.dedup_lines(df).collect())
    assert got == [(0, long, 0, 0), (1, long, 0, 0), (1, long, 0, 0), (2, "x", 1, 60), (3, "", 1, 60)]
    assert sorted(r.doc_id or 0 for r in linededup.keep_new_lines(df).collect()) == [0, 1, 1, 2]
    assert linededup.dedup_lines(df.where("false")).collect() == []


def test_decontamination_finds_changed_passages_and_leaves_others(spark):
    rng = random.Random(4)
    items = {i: words(rng, 40, 5000) for i in range(5)} | {5: words(rng, 13, 5000), 6: "too short to match", 7: None, 9: "", 11: words(rng, 8, 5000), 12: "Of five words in all"}
    items[8] = items[0]
    changed = items[1].split()
    for i in (3, 9, 14, 22, 30):
        changed[i] = "other"
    docs = {
        10: words(rng, 50) + " " + items[0] + " " + words(rng, 50), 11: " ".join(changed), 12: words(rng, 300, 5000),
        13: items[2].upper().replace(" ", ", "), 14: " ".join(items[3].split()[:9]), 15: None, 16: "", 17: "too short to match",
        18: words(rng, 5000, 5000) + " " + items[5] + " " + words(rng, 5000, 5000), 19: " ".join(items[4].split()[20:]) + " " + " ".join(items[2].split()[:20]),
        20: words(rng, 30) + " " + items[11] + " tail", 21: " ".join(items[11].split()[:7]) + " other", 22: "of FIVE words, in all!", 23: "of five words in all the texts", 24: "it is too short to match that",
    }
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in docs.items()], SCHEMA)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()}
    # Items under 12 tokens: verbatim; under 6, as a whole text only.
    assert got == {(10, 0), (11, 1), (13, 2), (17, 6), (18, 5), (19, 4), (19, 2), (20, 11), (22, 12)}
    assert {r.doc_id: (r.n_items, r.first_item) for r in decontam.contaminated(df, bench).collect()}[19] == (2, 2)
    kept = decontam.drop_contaminated(df.union(spark.createDataFrame([(None, items[0], "a", "b", 0)], SCHEMA)), bench)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 12, 14, 15, 16, 21, 23, 24]
    assert decontam.overlaps(df, bench.where("false")).collect() == [] and decontam.overlaps(df.where("false"), bench).collect() == []


def test_decontamination_of_repeated_rows(spark):
    """Rows that repeat count once among an item's documents, and all of them go."""
    item = " ".join(f"item{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"before {item} after"), (1, f"before {item} after"), (2, "clean " * 30), (2, "clean " * 30), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    assert [(r.doc_id, r.n_items, r.first_item) for r in decontam.contaminated(df, bench).collect()] == [(1, 1, 7)]
    assert sorted((r.doc_id or 0) for r in decontam.drop_contaminated(df, bench).collect()) == [0, 2, 2]


def test_decontamination_of_many_positions_in_one_text(spark):
    rng = random.Random(5)
    item = words(rng, 30, 5000)
    for before in (2028, 2047, 2048, 4101):
        df = spark.createDataFrame([(1, words(rng, before, 5000) + " " + item)], "doc_id long, text string")
        found = decontam.overlaps(df, spark.createDataFrame([(0, item)], "item_id long, text string")).first()
        assert (found.matched, found.compared) == (16, 16)
    assert df.select(F.size(decontam.tokens(F.col("text")))).first()[0] == 4131


def test_masks_hit_every_overlap_that_the_check_accepts():
    for n, changes in ((12, 2), (13, 2), (14, 2), (15, 3), (16, 3)):
        for changed in combinations(range(n), changes):
            assert any(not any(at + i in changed for i in m) for m in decontam.MASKS for at in range(n - m[-1])), changed


def brute_overlaps(docs, items):
    """Pairs with a window of 16 aligned tokens (all, of fewer; 12 at least) of which 80 % agree."""
    found, numbers = set(), {}
    coded = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], "int32")
    docs, items = ({k: coded(t) for k, t in x.items()} for x in (docs, items))
    for d, a in docs.items():
        for i, b in items.items():
            for shift in range(12 - len(b), len(a) - 11):
                low, high = max(shift, 0), min(shift + len(b), len(a))
                size = min(16, high - low)
                if size < 12:
                    continue
                sums = np.concatenate([[0], np.cumsum(a[low:high] == b[low - shift : high - shift])])
                if 10 * (sums[size:] - sums[:-size]).max() >= 8 * size:
                    found.add((d, i))
                    break
    return found


def test_decontamination_equals_brute_force_alignment(spark):
    """All placements of two and three changes in short items, and random changes in longer ones."""
    rng = random.Random(6)
    items = {n: words(rng, n, 5000) for n in (15, 16)} | {n: words(rng, n, 5000) for n in (20, 24)}
    docs = {}

    def add(n, changed, before=0, after=0):
        own = [f"new{len(docs)}" if k in changed else w for k, w in enumerate(items[n].split())]
        docs[len(docs)] = " ".join([*(f"pre{k}" for k in range(before)), *own, *(f"post{k}" for k in range(after))])

    for n in (15, 16):
        for changes in (2, 3):
            for changed in combinations(range(n), changes):
                add(n, changed)
    for n in (20, 24):
        for _ in range(60):
            add(n, {k for k in range(n) if rng.random() < 0.2}, rng.randrange(3), rng.randrange(3))
        add(n, set(range(4, n, 5)), 2, 2)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()} == brute_overlaps(docs, items)


def brute_resemblance(texts):
    """{id: smallest id of its component} by Jaccard similarity of five-word shingles, 0.8 at least."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_resemblance_equals_brute_force_jaccard(spark):
    rng = random.Random(7)
    texts, common = {}, words(rng, 40)
    base = [words(rng, rng.choice([30, 60, 150, 400]), 5000) for _ in range(8)]
    for i in range(160):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(1 + len(text) // 20)):
            text[rng.randrange(len(text))] = f"changed{rng.randrange(9)}"
        if rng.random() < 0.2:
            text += common.split()
        texts[i * 3 + 1] = " ".join(text)
    texts |= {i: base[2] + f" tail{i}" for i in range(600, 640)}  # a large group
    texts |= {1000: None, 1001: "", 1002: "One", 1003: "one ", 1004: "a b c d e", 1005: "a b c d e a b c d e", 1006: "x " * 70_000}
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in texts.items()], SCHEMA)
    expected = brute_resemblance(texts)
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(df.union(df.where("doc_id = 1"))).collect()}
    assert got == expected
    links = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert len(set(expected.values())) < len(set(links.values()))  # 3 bits wouldn't do
    assert {r.doc_id for r in resemblance.drop_near_duplicates(df).collect()} == set(expected.values())


def test_resemblance_with_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "lonely text here"), (9, None), (7, "other text")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in resemblance.near_duplicates(df).collect()}
    assert got == {(None, 7), (7, 7), (None, None), (9, 9)}
    assert resemblance.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("light,rounds,asked", [(2, 1, 1 << 20), (2, 1, 3000), (32, 2, 1 << 20)])
def test_no_link_under_larger_keys_is_lost(spark, light, rounds, asked, monkeypatch):
    """Near copies of one text that are partly less alike than the share: many small components beside a large one."""
    monkeypatch.setattr(resemblance, "LIGHT", light)
    monkeypatch.setattr(resemblance, "ROUNDS", rounds)
    monkeypatch.setattr(resemblance, "ASKED", asked)
    monkeypatch.setattr(resemblance, "ASKING", asked // 4)
    rng = random.Random(11)
    texts = {}
    for size, n in ((120, 150), (60, 60), (14, 40)):
        base = words(rng, size, 5000).split()
        for _ in range(n):
            text, at = list(base), rng.randrange(size)
            share = rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08])
            for k in range(size):
                if rng.random() < share:
                    text[k] = f"own{rng.randrange(400)}"
            if rng.random() < 0.3:  # a shorter one, or with a tail
                text = text[: at + 5] if rng.random() < 0.5 else text + base[:at]
            texts[len(texts)] = " ".join(text)
    expected = brute_resemblance(texts)
    assert 20 < len(set(expected.values())) < len(texts) - 40
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in resemblance.near_duplicates(df).collect()} == expected


def test_texts_that_share_a_phrase_only_bring_no_whole_sets(spark, monkeypatch):
    """Such pairs grow faster than the input, so sizes and bits settle them, under small keys and larger ones."""
    monkeypatch.setattr(resemblance, "SAMPLE", 1 << 40)  # no shingle is known as common: all keys are by hash
    asked, sets_of = [], resemblance._sets_of
    monkeypatch.setattr(resemblance, "_sets_of", lambda nodes, *rest: asked.append(nodes.distinct().count()) or sets_of(nodes, *rest))
    rng = random.Random(5)

    def phrase():  # one that every prefix holds
        return next(x for x in iter(lambda: words(rng, 5, 5000), None) if resemblance.shingles(x.encode())[0] < 1 << 57)

    shared = phrase()
    texts = {i: f"{shared} {words(rng, 200, 5000)}" for i in range(80)}
    for i in range(100, 140, 2):
        shared = phrase()
        texts |= {j: f"{shared} {words(rng, 200, 5000)}" for j in (i, i + 1)}
    texts[200] = f"{texts[0]} more"
    expected = brute_resemblance(texts)
    assert len(set(expected.values())) == len(texts) - 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in resemblance.near_duplicates(df).collect()} == expected
    assert asked and max(asked) <= 2
