"""Periodic runs, near vectors and the Merkle manifest against brute force and in odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from runledger.llm import cover_tree
from runledger.llm.cover_tree import near_vectors
from runledger.llm.manifest import Appender, appended, checked_manifest, folded, height, manifest
from runledger.llm.periodic import (
    best_run, find_runs, periodic_runs, run_digests, suffix_neighbours, text_runs, with_planted_periods,
)

SF = "/root/testdata/sf0.001"
NEW = ("op11_periodic_runs", "op12_cover_tree", "op13_merkle_manifest")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    rows, problems = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems
    assert rows > 0


# Periodic runs


def brute_runs(words, exponent=4, least=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((start, length, q) for (start, length), q in found.items())


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            letters, words = rnd.choice(["ab", "abcde"]), []
            while len(words) < rnd.randint(0, 60):
                words += [rnd.choice(letters) for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 6)
                words += words if rnd.random() < 0.3 else []
            texts.append(words)
        exponent, least = rnd.choice([(4, 6), (3, 6), (4, 1), (3, 9), (5, 12)])
        got = text_runs([" ".join(t).encode() for t in texts], exponent, least)
        for words, (n, runs, collapsed) in zip(texts, got):
            assert n == len(words)
            assert runs == brute_runs(words, exponent, least)
            dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
            assert collapsed == " ".join(w for k, w in enumerate(words) if k not in dropped)


def test_suffix_neighbours_are_in_order():
    rnd = np.random.default_rng(3)
    words = np.append(rnd.integers(0, 3, 200), 9)
    a, b, shared = suffix_neighbours(words)
    suffixes = sorted(range(201), key=lambda k: list(words[k:]))
    assert [*a, b[-1]] == suffixes
    for i, j, n in zip(a, b, shared):
        assert list(words[i : i + n]) == list(words[j : j + n]) and words[i + n] != words[j + n]


def test_best_run_ties():
    assert best_run([]) is None
    assert best_run([(0, 8, 2), (9, 12, 3), (40, 9, 2)]) == (40, 9, 2)
    assert best_run([(9, 12, 3), (0, 8, 2)]) == (0, 8, 2)


def test_long_text_of_one_word():
    assert find_runs(np.array([0, *[1] * 200_000, 2])) == [(1, 200_000, 1)]


def test_runs_of_odd_rows(spark):
    rows = [
        (1, "a b a b a b a b", 1, "x"), (1, "a b a b a b a b", 1, "x"), (2, None, 2, None), (None, "", 3, "y"),
        (3, " \n\t", 4, "y"), (4, "é " * 7 + "x", 5, "y"), (5, "a\x1cb " * 6, 6, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS long, `a.b` string")
    got = {(r.doc_id, r["a.b"], r.n_words, tuple(map(tuple, r.runs)), r.best and tuple(r.best), r.collapsed)
           for r in periodic_runs(docs).collect()}
    assert got == {
        (1, "x", 8, ((0, 8, 2),), (0, 8, 2), "a b"), (2, None, 0, (), None, ""), (None, "y", 0, (), None, ""),
        (3, "y", 0, (), None, ""), (4, "y", 8, ((0, 7, 1),), (0, 7, 1), "é x"),
        (5, "y", 6, ((0, 6, 1),), (0, 6, 1), "a\x1cb"),
    }
    assert periodic_runs(docs).count() == len(rows)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exponents"):
        periodic_runs(docs, exponent=2)


def test_planted_periods(spark):
    texts = {k: " ".join(f"w{i * i % 17}" for i in range(k % 90)) for k in range(-40, 400)}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in with_planted_periods(docs).collect()}
    assert got.pop(None) == "a b"
    changed = 0
    for k, text in texts.items():
        words, h = text.split(), zlib.crc32(str(k).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert got[k].split() == words
    assert changed > 10
    row = run_digests(periodic_runs(docs.where("doc_id IS NULL"))).collect()[0]
    assert row.n_runs == 0 and row.start is None and row.runs_sha256 == hashlib.sha256(b"").hexdigest()


# Near vectors


def brute_vectors(rows, least):
    """id, links and smallest reachable id of each row."""
    sound = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(map(abs, v))
            sound[k] = v / np.linalg.norm(v)
    links = {k: {j for j, w in sound.items() if j != k and len(w) == len(v) and v @ w >= least} for k, v in sound.items()}
    out = []
    for k, (name, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((name, len(links.get(k, ())), smallest, name == smallest))
    return sorted(out, key=str)


def clusters(seed, spreads, each, dims):
    rnd = np.random.default_rng(seed)
    rows = []
    for spread in spreads:
        centre = rnd.normal(size=dims)
        centre /= np.linalg.norm(centre)
        rows += [(centre + spread * rnd.normal(size=dims) / dims**0.5).tolist() for _ in range(each)]
    rnd.shuffle(rows)
    return [(k, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("block_rows, sample_rows", [(8192, 4096), (40, 64), (25, 4096)])
def test_vectors_equal_brute_force(spark, block_rows, sample_rows):
    rows = clusters(7, [0.02, 0.1, 0.2, 0.3, 0.35, 0.45, 2.0, 5.0], 40, 8)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, near_vectors(vectors, block_rows=block_rows, sample_rows=sample_rows).collect()), key=str)
    assert got == brute_vectors(rows, 0.9)


def test_undecided_nodes_are_compared(spark):
    """Two tight groups whose members are partly within the threshold of each other."""
    angle = np.arccos(0.9)
    rnd = np.random.default_rng(1)
    at = np.concatenate([rnd.normal(0, 0.05, 60), rnd.normal(angle, 0.05, 60)])
    rows = [(k, [float(np.cos(x)), float(np.sin(x))]) for k, x in enumerate(at)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block_rows in (8192, 30):
        got = sorted(map(tuple, near_vectors(vectors, block_rows=block_rows).collect()), key=str)
        assert got == brute_vectors(rows, 0.9)


def test_vectors_in_odd_rows(spark):
    nan = float("nan")
    rows = [
        (5, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [1e300, 1e299]), (None, [5e-324, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.1]),
        (None, [0.0, 0.0, 1.0]), (11, [-1.0, 0.0]),
    ]
    vectors = spark.createDataFrame(
        [(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, n_links long, `a.b` string"
    )
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors).collect()]
    assert sorted(got, key=str) == brute_vectors(rows, 0.9)
    assert near_vectors(vectors.limit(0)).count() == 0
    floats = vectors.select("vec_id", F.col("embedding").cast("array<float>"))
    assert near_vectors(floats).count() == len(rows)


def test_copies_are_counted_not_listed(spark, monkeypatch):
    """Of n copies, in several blocks, no stored table has more than a few rows per copy."""
    sizes = []
    real = cover_tree.stored

    def counting(rows, name):
        out = real(rows, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cover_tree, "stored", counting)
    rnd = np.random.default_rng(2)
    rows = [(k, (np.ones(16) + rnd.normal(0, 0.01, 16)).tolist()) for k in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_vectors(vectors, block_rows=300).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2999, 0)}
    assert sum(r.kept for r in got) == 1
    assert max(sizes) <= 3000


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    """Root and, for each leaf, its siblings by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 8 * 8
            path.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 8])))
            at[k] //= 8
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 4095, 4096])
def test_appending_equals_building(n):
    nodes = [sha(str(k)) for k in range(n)]
    tree = appended(nodes, n)
    root = tree.root()
    assert (root, tree.witnesses) == brute_tree(nodes)
    assert height(n) == len(tree.witnesses[0])


def test_open_subtrees_have_partial_witnesses():
    tree = Appender(3)
    for k in range(8 * 8 + 3):
        tree.append(sha(str(k)))
    # The first leaf's run and the run of runs are closed; the last leaf waits for siblings.
    assert [len(w) for w in (tree.witnesses[0], tree.witnesses[63], tree.witnesses[66])] == [2, 2, 0]


def test_manifest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("runledger.llm.manifest._BLOCK", 8)
    monkeypatch.setattr("runledger.llm.manifest.LEVELS", 1)
    rows = [(k * 7 % 331 - 5, f"s{k % 3}", ["b", "a", "é", None, ""][min(k % 6, 4)], k, f"Text {k} É" if k % 9 else None)
            for k in range(331)] + [(None, None, "b", None, "X"), (3, "s", "one", 1, "Y"), (3, "s", "b", 1, "Z"), (3, "s", "b", 1, "Z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int, `a.b` int")

    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = {}
    for r in rows:
        low = r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], low if struck else r[4])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names])
    want = []
    for g, top in zip(names, tops):
        for (known, doc_id, own, other), path in zip(sorted(groups[g]), trees[g][1]):
            node = other
            for before, after in path + top:
                node = sha(before + node + after)
            proof = sha("".join(b + a for b, a in path + top))
            want.append((doc_id if known else None, own, trees[g][0], root, proof, node, node == root))
    got = [tuple(r) for r in checked_manifest(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[-1] for r in got}) == 2


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = manifest(docs).select("*", folded(F.col("leaf"), F.col("path")).alias("again")).collect()[0]
    assert row.leaf == row.subroot == row.root == row.again == sha("1:1----")
    assert row.path == []
    assert manifest(docs.limit(0)).count() == 0
