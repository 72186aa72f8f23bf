"""Recall of the search operators, and the digest and the fit, against plain versions over all pairs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np

from tapeweave.llm import fingerprints, near_dedup, quality, queries, substring_dedup

from .test_operators import altered, documents, words

SF = "/root/testdata/sf0.01"


def grams(text, n):
    w = text.lower().split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def repeated_words(texts, n=50):
    """doc_id: the word positions that lie in a run of n words that another document has too."""
    holders = defaultdict(set)
    for k, text in texts.items():
        for g in grams(text, n):
            holders[g].add(k)
    out = {}
    for k, text in texts.items():
        at = {i + j for i, g in enumerate(grams(text, n)) if len(holders[g]) > 1 for j in range(n)}
        if at:
            out[k] = at
    return out


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.start, r.end))
        out[r.other_id] |= set(range(r.other_start, r.other_end))
    return out


# --- 4 passages --------------------------------------------------------------------------------


def test_every_exact_passage_is_found_where_minima_are_shared_with_other_texts(spark):
    rng, texts = random.Random(3), {}
    phrases = [words(9, 9000 + i, 300) for i in range(40)]  # frequent phrases, so that minima stand in earlier documents too
    line = words(44, 8000)  # a line of less than 50 words that a third of all documents have
    plain = lambda n, seed: " ".join(rng.choice(phrases) if rng.random() < 0.5 else words(6, seed * 1000 + i) for i in range(n // 7))
    for i in range(240):
        texts[i] = f"{plain(120, i)} {line} {plain(60, 500 + i)}" if i % 3 == 0 else plain(180, i)
    for g in range(12):  # passages made of frequent phrases, in documents far apart
        passage = " ".join(rng.choice(phrases) for _ in range(7))
        for i in rng.sample(range(240), 3):
            texts[i] += f" {passage} {plain(40, 700 + 10 * g + i)}"
    x, y = words(150, 1), words(150, 2)
    texts[300], texts[301], texts[302] = f"{x} {words(100, 3)} {y}", f"{x} {y}", f"{y} {x}"  # cut out, and in the other order
    got = covered(substring_dedup.repeated_passages(documents(spark, list(texts.items()))).collect())
    for k, at in repeated_words(texts).items():
        assert at <= got[k], (k, sorted(at - got[k])[:5])


def test_no_edge_of_an_exact_passage_is_left_out(spark):
    texts = {}
    for g in range(40):  # the first text has less of the passage than the others; accents count as letters
        passage, shorter = words(63, 100 + g), words(60, 100 + g)
        texts[3 * g] = f"{words(60, 1000 + g)} {shorter} {words(40, 2000 + g)}"
        texts[3 * g + 1] = f"{words(30, 3000 + g)} {passage} {words(40, 4000 + g)}"
        texts[3 * g + 2] = f"{words(50, 5000 + g)} {passage} {words(20, 6000 + g)}"
    texts[200], texts[201] = f"\u00d1a {words(49, 7000)} {words(30, 7001)}", f"{words(30, 7002)} \u00f1a {words(49, 7000)}"
    texts[202], texts[203] = f"{'ea ' * 67} {words(60, 7003)}", f"{words(60, 7004)} {'ea ' * 200} {words(60, 7005)}"  # a loop
    got = covered(substring_dedup.repeated_passages(documents(spark, list(texts.items()))).collect())
    for k, at in repeated_words(texts).items():
        assert at <= got[k], (k, sorted(at - got[k]))


def test_exact_passages_come_out_on_both_sides():
    rng = np.random.default_rng(5)
    for _ in range(300):
        theirs = rng.integers(0, 1 << 24 if rng.random() < 0.5 else 40, 300).astype(np.uint32)
        mine = theirs.copy()
        for _ in range(int(rng.integers(1, 6))):  # cut out, put in, move, repeat
            i, j, n = rng.integers(0, len(mine) - 1, 2).tolist() + [int(rng.integers(1, 60))]
            mine = (np.delete(mine, slice(i, i + n)), np.insert(mine, i, rng.integers(0, 1 << 24, n).astype(np.uint32)), np.insert(mine, i, mine[j : j + n]))[int(rng.integers(0, 3))]
        size = substring_dedup.LEAST
        runs = [{tuple(x[i : i + size].tolist()) for i in range(len(x) - size + 1)} for x in (mine, theirs)]
        got = substring_dedup.common(mine, theirs)
        for x, other, spans in ((mine, runs[1], [g[:2] for g in got]), (theirs, runs[0], [g[2:4] for g in got])):
            want = {i + k for i in range(len(x) - size + 1) if tuple(x[i : i + size].tolist()) in other for k in range(size)}
            assert want <= {k for a, b in spans for k in range(a, b)}


def test_passages_of_the_given_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, got = repeated_words(texts), covered(queries.op4_substring_dedup(spark, SF).collect())
    assert set(want) <= set(got)
    assert sum(len(at & got[k]) for k, at in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_altered_passages_are_found(spark):
    rows, pairs = [], []
    for g in range(60):
        base = words(120, 100 + g)
        rows += [(2 * g, f"{words(80, 1000 + g)} {base}"), (2 * g + 1, f"{altered(base, g, 0.02)} {words(80, 2000 + g)}")]
        a, b = set(grams(base, 5)), set(grams(rows[-1][1], 5)[:116])
        if len(a & b) >= 0.82 * len(a | b):
            pairs.append((2 * g + 1, 2 * g))
    found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert len(pairs) > 20 and len(found & set(pairs)) >= 0.9 * len(pairs)


def test_offsets_leave_no_run_out():
    for step in (1, 5, 10):
        size = substring_dedup.LEAST + 1 - step
        for before in range(substring_dedup.LEAST):
            after = substring_dedup.LEAST - 1 - before
            assert any(o <= before and size - 1 - o <= after for o in substring_dedup.offsets(step))


# --- 10 near dedup -----------------------------------------------------------------------------


def test_near_copies_of_the_given_documents(spark):
    shingles = {r.doc_id: set(grams(r.text or "", 5)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    holders = defaultdict(list)
    for k, s in shingles.items():
        for g in s:
            holders[g].append(k)
    shared = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] += 1
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(shingles[a]) + len(shingles[b]) - n)]
    got = {r.doc_id: r.class_id for r in queries.op10_near_dedup(spark, SF).collect()}
    assert near and sum(got[a] == got[b] for a, b in near) == len(near)


def test_a_passage_that_fills_buckets_hides_no_copy(spark):
    passage, rows = words(60, 999), []
    for k in range(150):  # large buckets of texts that aren't near, and pairs of near copies among them
        own = words(40, 5000 + k)
        rows.append((k, f"{own} {passage}"))
        if k % 10 == 0:
            rows.append((1000 + k, f"{altered(own, k, 0.03)} {passage}"))
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents(spark, rows)).collect()}
    assert all(got[1000 + k] == k for k in range(0, 150, 10)) and len(set(got.values())) == 150


def template(n, copies):
    """n texts of which a template makes three fifths, and a near copy of every so many-th."""
    passage, rows = words(60, 999), []
    for k in range(n):
        own = words(40, 5000 + k)
        rows.append((k, f"{own} {passage}"))
        if k % copies == 0:
            rows.append((100_000 + k, f"{altered(own, k, 0.03)} {passage}"))
    return rows


def test_a_template_of_thousands_hides_no_copy(spark):
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents(spark, template(2500, 50))).collect()}
    assert all(got[100_000 + k] == k for k in range(0, 2500, 50)) and len(set(got.values())) == 2500


def test_a_large_bucket_leaves_out_no_pair_that_a_small_one_would_find(spark):
    rng, passage, rows = random.Random(7), words(60, 999), []
    for k in range(60):  # all in large buckets; scattered edits, so that near copies agree in few sketches
        own = words(40, 5000 + k).split()
        rows.append((k, f"{' '.join(own)} {passage}"))
        if k % 6 == 0:
            at = set(rng.sample(range(40), 18))
            rows.append((1000 + k, f"{' '.join(f'z{k}x{i}' if i in at else w for i, w in enumerate(own))} {passage}"))
    sketch = {r.node.hex(): r.sketch for r in near_dedup.sketched(documents(spark, rows)).collect()}
    code = {k: np.array([zlib.crc32(w.encode()) for w in text.lower().split()], "u8") for k, text in rows}
    of = {k: sketch[hashlib.md5(text.encode()).hexdigest()] for k, text in rows}
    agree = lambda a, b: sum(x == y for x, y in zip(of[a], of[b], strict=True))
    near = [k for k in range(0, 60, 6) if agree(k, 1000 + k) and near_dedup.similarity(code[k], code[1000 + k]) >= 0.8]
    assert sum(agree(k, 1000 + k) < 6 for k in near) >= 3
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents(spark, rows)).collect()}
    assert all(got[1000 + k] == got[k] for k in near)


def test_counts_of_words_leave_out_no_near_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 60, rng.integers(1, 200)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, len(a) // 3 + 2)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 60, rng.integers(0, 2)).tolist()
        bags = np.array([np.bincount(x, minlength=60) for x in (a, b)], np.int32)
        if near_dedup.similarity(np.array(a, "u8"), np.array(b, "u8")) >= 0.8:
            assert near_dedup.may_be_near(bags[1:], bags[0]).all()


def test_parts_larger_than_a_task_are_split_and_then_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "WIDE", 9)
    monkeypatch.setattr(near_dedup, "SPAN", 4)
    monkeypatch.setattr(near_dedup, "LEVELS", (2,))
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents(spark, template(120, 10))).collect()}
    assert all(got[100_000 + k] == k for k in range(0, 120, 10)) and len(set(got.values())) == 120


# --- 5 fingerprints ----------------------------------------------------------------------------


def test_digest_against_a_plain_one():
    def plain(data):
        buckets = [0] * 256
        for at in range(len(data) - 2):
            salt = 0
            for i in range(1, 5):
                for j in range(i + 1, 5):
                    if at + j < len(data):
                        h = (data[at] * 0x9E3779B1 ^ data[at + i] * 0x85EBCA77 ^ data[at + j] * 0xC2B2AE3D ^ salt * 0x27D4EB2F) & 0xFFFFFFFF
                        buckets[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
                    salt += 1
        order = sorted(buckets)
        q1, q2, q3 = order[63], order[127], order[191]
        codes = [(c > q1) + (c > q2) + (c > q3) for c in buckets]
        return codes, min(255, round(8 * math.log2(len(data) + 1))), min(15, 16 * q1 // (q3 + 1)), min(15, 16 * q2 // (q3 + 1))

    for seed in range(6):
        rng = random.Random(seed)
        data = bytes(rng.choice(b"abcde \xc3\xa9") for _ in range(rng.randrange(3, 900)))
        codes, length, r1, r2 = plain(data)
        digest = bytes.fromhex(fingerprints.fingerprint(data))
        assert tuple(digest[1:4]) == (length, r1, r2)
        assert [byte >> shift & 3 for byte in digest[4:] for shift in (6, 4, 2, 0)] == codes


# --- 9 quality ---------------------------------------------------------------------------------


def test_weights_against_a_plain_descent():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    good = x @ np.array([2.0, -1, 0, 0.5, 0]) + rng.normal(size=300) * 0.7 > 0
    model = quality.fit(x, good)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    diff = (z[good][:, None] - z[~good][None]).reshape(-1, 5)  # every preference pair
    w = np.zeros(5)
    for _ in range(400):
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - 1e-4 * w)
    assert np.corrcoef(z @ w, z @ model.weights)[0, 1] > 0.99
    s = z @ model.weights
    right = lambda zero: ((s >= zero) == good).sum()
    assert right(model.zero) >= max(map(right, np.quantile(s, np.linspace(0, 1, 101)))) - 3
