"""Merkle manifest, ranked search and quality rules against brute force; nulls, empties, repeats, ties, long texts and clashing columns in each."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import lexical_search, merkle, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t long, idx long, row string, way string, w array<string>, item long, map map<string,int>"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "clash", "clash", ["clash"], 9, {"a": 1}) for r in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def documents(n=60, langs=("en", "de", None, "fr", ""), seed=1):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a b", "é ü", None, "", "x" * 3000]), rnd.choice(langs[:3] if k < n - 4 else langs), rnd.choice(["s", None]), rnd.choice([5, None, 70])) for k in range(n)]
    return rows + [rows[3], rows[3], (None, "no id", "en", "s", 3), (None, None, None, None, None), (n + 5, "alone", "zz", "s", 1)]


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: sha("".join(map(enc, (i, s, g, n, t))))

    def tree(level):  # (top, ways): the siblings of each leaf
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for way, k in zip(ways, range(len(at))):
                p = at[k]
                if p ^ 1 < len(level):
                    way.append(("R" if p % 2 == 0 else "L", level[p ^ 1]))
                else:
                    way.append(("-", ""))
                at[k] = p // 2
            level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        return level[0], ways

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        top, ways = trees[g]
        for (_, _, own, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), ways):
            changed = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                changed = leaf(r[0], r[1], r[2], r[3], r[4] + 1)
            for side, other in way + up:
                changed = sha(other + changed if side == "L" else changed + other)
            out.append((r[0], own, top, root, sha("".join(o for _, o in way + up)), changed, changed == root))
    return out


def manifest(spark, docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.merkle_manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, where=tampered)
    return [tuple(r) for r in found.drop("way").collect()]


@pytest.mark.parametrize("height", [2, 10])
def test_manifest_is_that_of_a_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = documents()
    got, want = manifest(spark, table(spark, rows)), brute_manifest(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r[-1] for r in got}) == 2 and all(r[5] == r[3] for r in got if r[-1])


def test_manifest_by_exchange_of_what_is_looked_up(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", -1)
    rows = documents(33, seed=2)
    assert sorted(manifest(spark, table(spark, rows)), key=repr) == sorted(brute_manifest(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, "only", "en", "s", 4)], [(1, "a", "en", "s", 1), (2, "b", None, None, None)], [(k, "x", "en", "s", 1) for k in range(5)]], ids=["empty", "one", "two groups of one", "one group"])
def test_small_manifests(spark, rows):
    got = manifest(spark, table(spark, rows))
    assert sorted(got, key=repr) == sorted(brute_manifest(rows), key=repr) if rows else got == []


def test_a_way_folds_to_the_root(spark):
    r = merkle.merkle_manifest(table(spark, documents(20))).collect()
    for x in r:
        assert merkle.fold(bytes.fromhex(x["leaf"]), bytes(x["way"])).hex() == x["root"] and x["verified"]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_search(docs, items, k=20):
    texts = [collections.Counter(TERM.findall((t or "").translate(LOWER))) for _, t, *_ in docs]
    n_docs, total = sum(1 for c in texts if c), sum(sum(c.values()) for c in texts)
    df = collections.Counter(t for c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, *_), c in zip(docs, texts):
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def search_corpus(n=150, seed=4):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "aÉß" for b in "xyZ" for c in "019"]
    rows = [(k, " ".join(rnd.choices(words, [1 / (1 + j) for j in range(len(words))], k=rnd.choice([1, 5, 40])))) for k in range(n)]
    rows += [rows[5], rows[5], (None, "ax0 only"), (n + 1, None), (n + 2, ""), (n + 3, " -- "), (n + 4, "ax0-AX0_ax0 " * 30_000)]
    return [(i, t, None, None, None) for i, t in rows], words


def test_search_is_that_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical_search, "CHUNK_TERMS", 10)
    monkeypatch.setattr(lexical_search, "AT_ONCE", 4)
    monkeypatch.setattr(lexical_search, "CHUNKS", 2)
    docs, words = search_corpus()
    rnd = random.Random(5)
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 12])))) for k in range(25)] + [(3, "ax0 AX0, ax0"), (70, None), (71, "?"), (72, "nowhere"), (None, "ax0 no id")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item long, term string")
    got = lexical_search.ranked_search(table(spark, docs).repartition(3), asked)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_search(docs, items), key=repr)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_in_empty_tables(spark):
    docs, items = table(spark, []), spark.createDataFrame([(1, "ax0")], "item_id long, text string")
    assert lexical_search.ranked_search(docs, items).count() == 0
    assert lexical_search.ranked_search(table(spark, [(1, "ax0", None, None, None)]), items.where("false")).count() == 0


def test_search_finds_documents_beyond_equal_scores(spark):
    docs = [(k, "same words here", None, None, None) for k in range(60, 0, -1)] + [(100 + k, f"other {k}", None, None, None) for k in range(90)]
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = lexical_search.ranked_search(table(spark, docs).repartition(4), items).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 21)) and len({r["score"] for r in got}) == 1


def test_treap_opens_few_ranges():
    rnd = np.random.default_rng(0)
    rows, columns = rnd.integers(0, 500, 40_000), rnd.integers(0, 3000, 40_000)
    key = np.unique(rows * 3000 + columns)
    rows, columns, values = key // 3000, key % 3000, rnd.integers(1, 1000, len(key))
    asked, weights = np.array([1, 7, 400, 499]), np.array([5, 1, 3, 2])
    dense = np.zeros((500, 3000), np.int64)
    dense[rows, columns] = values
    full = weights @ dense[asked]
    want = sorted(((-s, c) for c, s in enumerate(full.tolist()) if s > 0))[:20]
    found, scores = lexical_search.Treap(rows, columns, values).best(asked, weights, 20, 1)
    assert list(zip((-scores).tolist(), found.tolist())) == want


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + d for k in range(len(w) - 2) for d in range(3) if seen[tuple(w[k : k + 3])] > 1}
    stops = {x for xs in quality_rules.STOP_WORDS.values() for x in xs}
    n, chars, symbols = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 50 or 100 * len(again) > 50 * n
    fine = bool(n) and 3 <= chars / n <= 10 and symbols / n <= 0.1 and sum(x.lower() in stops for x in w) / n >= 0.02
    fine = fine and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and n / len(lines) >= 1.5
    return n, chars, symbols, len(lines) - len(set(lines)), len(again), failed, fine and not failed


def test_quality_rules(spark):
    rnd = random.Random(6)
    words = ["the", "of", "und", "é", "😀x", "a|b", "###", "long" * 5, "Word.", "x1"]
    texts = [None, "", " \t\x0b\x0c\r\n", "a", "a a", "a a a", "a a a a", "b\n\nb\n c\nb", "a b c a b c"]
    texts += [rnd.choice(["", " ", "\n"]).join(rnd.choice(words[: rnd.randint(1, 10)]) + rnd.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rnd.choice([4, 60, 200]))) for _ in range(80)]
    texts += [" ".join(f"the w{k:05}" for k in range(60)), " ".join(f"w{k}" for k in range(40_000)), "a b " * 30_000, texts[20]]
    rows = [(k if k != 9 else None, t, None, None, None) for k, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:8] for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert got == {i: brute_rules(t) for i, t, *_ in rows}
    assert len({r[-1] for r in got.values()}) == 2
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_quality_rules_are_one_projection(spark):
    plan = quality_rules.quality_rules(table(spark, documents(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_rules_name_what_breaks(spark):
    rows = [(1, "the " * 10 + "| * " * 30, None, None, None), (2, " ".join(f"the word{k}" for k in range(40)), None, None, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, rows), most_repeated=100.0).collect()}
    assert got[1]["broken"] == ["word_length", "symbols"] and got[2]["broken"] == [] and got[2]["kept"]
    strict = quality_rules.quality_rules(table(spark, rows[1:]), rules=(quality_rules.Rule("none", "mean_word_chars", 99.0, None),)).first()
    assert strict["broken"] == ["none"] and not strict["kept"]
