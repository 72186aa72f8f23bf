"""Collocations, SimHash balls and the prefix trie: against SQL or brute force, on odd rows, and where their parts split."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeweave.llm import collocations, prefix_trie, queries, simhash

SF = "/root/testdata/sf0.001"


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    for name, of in tables.items():
        if isinstance(of, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{of}'")
        else:
            con.register(name, of)
    return sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)


def spark_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 11 collocations ---------------------------------------------------------------------------

PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
DOCS = "doc_id long, text string, lang string, phrase string, part int, words string, a long"


def phrase_docs(spark, rows):
    """rows: (text, lang); the other columns clash with names that the operator uses inside."""
    return spark.createDataFrame([(i, *r, "p", 1, "w", 2) for i, r in enumerate(rows)], DOCS)


def test_collocations_match_sql_on_the_given_documents(spark):
    assert spark_rows(queries.op11_collocations(spark, SF), PHRASE) == sql_rows(queries.OP11_SQL, PHRASE, documents=f"{SF}/documents.parquet")


def test_collocations_on_odd_texts(spark):
    rng = random.Random(3)
    rows = [(None, "en"), ("", None), ("x", None), ("a b c d " * 50, None), ("A B, a b; C\vD\rc d\n" * 40, "und"), ("é ü\tÉ  ü. " * 9, "fr"), ("日本 語 \x00 y\x1cz " * 7, ""), ("long tail " * 20_000, "en")]
    rows += [(" ".join(rng.choice("abcdefg") + rng.choice(["", "", ",", "."]) for _ in range(300)), rng.choice(["en", "de", None])) for _ in range(40)]
    rows += rows[-3:]
    docs = phrase_docs(spark, rows)
    want = sql_rows(queries.OP11_SQL.replace(">= 30", ">= 3"), PHRASE, documents=pd.DataFrame(rows, columns=["text", "lang"]))
    assert len(want) > 100 and spark_rows(collocations.collocations(docs, 3), PHRASE) == want
    assert spark_rows(collocations.collocations(docs, 3, top=4), PHRASE) == [r for r in want if r[1] <= 4]
    assert collocations.collocations(phrase_docs(spark, [])).count() == 0
    assert collocations.collocations(phrase_docs(spark, [(None, None), (". ,", "en")])).count() == 0


def test_small_holds_and_a_full_filter_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghijkl") for _ in range(200)), "en") for _ in range(30)]
    want = spark_rows(collocations.collocations(phrase_docs(spark, rows), 5), PHRASE)
    monkeypatch.setattr(collocations, "FILTER", 1 << 10)  # 16 bits for each part, all of them set
    assert spark_rows(collocations.collocations(phrase_docs(spark, rows), 5), PHRASE) == want


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_frequent_code(seed, monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 50)
    rng = np.random.default_rng(seed)
    pieces = [collocations.summed(np.minimum(rng.zipf(1.3, 400), 1 << 31).astype(np.uint32), np.ones(400, np.int64)) for _ in range(20)]
    codes, counts = collocations.summed(*map(np.concatenate, zip(*pieces, strict=True)))
    for threshold in (2, 10, 40):
        s = collocations.Summary(int(counts.sum()), threshold)
        for c, n in pieces:
            again, same = collocations._entries(collocations._planes(c, n))
            assert (again == c).all() and (same == n).all()
            s.add(again, same)
        left = set(s.survivors().tolist())
        assert set(codes[counts >= threshold].tolist()) <= left
        assert s.taken < threshold and len(s.codes) <= s.capacity


def test_scores_past_64_bits(spark):
    big = 2**62
    row = spark.range(1).select(F.lit(big).cast("decimal(20,0)").alias("a"), F.lit(big).cast("decimal(20,0)").alias("l")).select((F.col("a") * 2_000_000).alias("x"), (F.col("l") + F.col("a") + 1).alias("y"))
    assert row.select(F.expr("x div y")).first()[0] == big * 2_000_000 // (2 * big + 1)


# --- 12 SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """doc_id: the least doc_id reachable over links."""
    left, out = dict(prints), {}
    while left:
        start = min(left)
        reached, edge = {start: left.pop(start)}, [start]
        while edge:
            x = reached[edge.pop()]
            near = [d for d, y in left.items() if (x ^ y).bit_count() <= radius]
            for d in near:
                reached[d] = left.pop(d)
            edge += near
        out |= dict.fromkeys(reached, start)
    return out


def test_simhash_against_all_pairs_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = {d: (f"{prints[d]:016x}", c) for d, c in plain_components(prints, 2).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_pairs_join_all_that_are_within_the_radius(spark, radius):
    rng = random.Random(radius)
    prints = {}
    for i in range(150):
        x = rng.choice(list(prints.values())) if prints and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    signed = {x - (1 << 64 if x >> 63 else 0): x for x in prints.values()}
    pairs = [(signed[r.node], signed[r.centre]) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "node long"), radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in pairs)
    root = {x: x for x in signed.values()}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        root[find(a)] = find(b)
    classes = plain_components(prints, radius)
    assert all((find(prints[a]) == find(prints[b])) == (classes[a] == classes[b]) for a in prints for b in prints)


def test_simhash_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (4, "one"), (5, "Two WORDS"), (6, "two\vwords"), (None, "two words"), (7, "é \x00 日本 " * 3000), (8, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id long, text string, node int, fingerprint int, centre string")
    got = {(r.doc_id, r.fingerprint): (r.component_id, r.component_size) for r in simhash.simhash_dedup(docs).collect()}
    assert got.keys() == {(d, f"{plain_fingerprint(t):016x}") for d, t in rows}
    by = {d: got[d, f"{plain_fingerprint(t):016x}"] for d, t in rows}
    assert by[1] == by[2] == by[3] == (1, 3) and by[4] == (4, 2) and by[5] == by[6] == by[None] == (5, 3)
    assert simhash.simhash_dedup(docs.where("false")).count() == 0
    assert [r.component_id for r in simhash.simhash_dedup(docs.where("doc_id is null")).collect()] == [None]


def test_balls_hold_every_value_once():
    texts = ["", "a", "a b c d " * 100, "b " * 70_000]
    import pyarrow as pa

    assert [int(x) & (1 << 64) - 1 for x in simhash.fingerprint_column(pa.array(texts))] == [plain_fingerprint(t) for t in texts]


# --- 13 prefix trie ----------------------------------------------------------------------------

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, head string, depth int, path string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "p") for r in rows], TURNS), pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})


@pytest.mark.parametrize("cap", [1, 2, 256])
def test_trie_matches_sql_on_the_given_conversations(spark, cap):
    want = sql_rows(queries.OP13_SQL, NODE, conversations=f"{SF}/conversations.parquet")
    assert spark_rows(prefix_trie.conversation_trie(spark.read.parquet(f"{SF}/conversations.parquet"), cap), NODE) == want


@pytest.mark.parametrize("cap", [1, 3, 256])
def test_trie_of_odd_conversations(spark, cap):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(["", None, "a", "b", "é" * 3])) for c in range(60) for t in range(rng.randrange(12))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(20) for t in range(30)]  # a long common stretch
    rows += [(203, None, "user", "null first"), (203, 1, "user", "x"), (203, 1, "user", "x"), (204, -1, None, None), (None, 0, "user", "no conversation"), (208, 0, "user", "only one")]
    rows += [(300, t, "user", f"deep {t}") for t in range(700)]
    df, pdf = talk(spark, rows)
    want = sql_rows(queries.OP13_SQL, NODE, conversations=pdf)
    assert spark_rows(prefix_trie.conversation_trie(df, cap), NODE) == want
    assert prefix_trie.conversation_trie(df.where("false")).count() == 0


@pytest.mark.parametrize("cap", [1, 256])
def test_many_members_of_one_sequence(spark, monkeypatch, cap):
    import hashlib

    df, _ = talk(spark, [(c, t, "user", f"hi {t}") for c in range(500) for t in range(2)] + [(c, 0, "user", "hi 0") for c in range(500, 520)])
    convs = prefix_trie.sequences(prefix_trie.turn_lists(df))
    got = {r.depth: r for r in prefix_trie.prefix_trie(convs, cap, listed=7).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [got[d].ends_sha256 for d in range(3)] == [prefix_trie.EMPTY, sha(range(500, 520)), sha(range(500))]
    assert [(got[d].n_convs, got[d].n_children, got[d].n_leaves, got[d].saved_tokens) for d in range(3)] == [(520, 1, 1, 519 * 4 + 499 * 4), (520, 1, 1, 519 * 4 + 499 * 4), (500, 0, 1, 499 * 4)]


def test_chunks_of_members_stream_in_order():
    import hashlib

    import pyarrow as pa

    keys, ids = [b"a"] * 5 + [b"b"], [1, 2, 30, 31, 40, 7]
    packed = list(prefix_trie._packed(iter([pa.record_batch([pa.array(keys[i : i + 2], pa.binary()), pa.array(ids[i : i + 2], pa.int64())], ["key", "conv_id"]) for i in (0, 2, 4)])))
    assert [b["text"][0].as_py() for b in packed] == ["1,2,30,31,40", "7"]
    cut = [pa.record_batch([pa.array([b"a"] * 2 + [b"b"], pa.binary()), pa.array([1, 31, 7], pa.int64()), pa.array(["1,2,30", "31,40", "7"])], ["key", "first", "text"])]
    assert {b["key"][0].as_py(): b["sha"][0].as_py() for b in prefix_trie._streamed(iter(cut))} == {b"a": hashlib.sha256(b"1,2,30,31,40").hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}
