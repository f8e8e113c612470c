"""The prefix trie, substring removal and the Merkle manifest, and long texts of the span finders: brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsflow.llm import chat, common, merkle, recompress, secrets, sketch, substrings, trie

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TURN = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def tree_of(leaves):
    """Root, and each leaf's siblings, level by level."""
    proofs, nodes, places = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            if p ^ 1 < len(nodes):
                proofs[i].append(nodes[p ^ 1])
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        places = [p // 2 for p in places]
    return nodes[0], ["".join(p) for p in proofs]


def test_manifest_exchanges_over_many_blocks(spark):
    # 41 blocks take two rounds, with subtrees that have fewer blocks than lanes.
    sizes = {"": 1, "=a": 40 * 1024 + 5, "=b": 1024, "=c": 1025, "=d": 17 * 1024 + 1, "=é": 7}
    made = [(name, i, sha(f"{name}{i}")) for name, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(made)
    leaves = spark.createDataFrame(made, "tree string, nth long, leaf string").repartition(5)
    rows, trees = merkle.manifest(common.stage(leaves, "test"), ["nth"])
    found = {(r.tree, r.nth): r for r in rows.collect()}
    tops = {r.tree: r for r in trees.collect()}
    wanted = {name: tree_of([sha(f"{name}{i}") for i in range(n)]) for name, n in sizes.items()}
    root, above = tree_of([wanted[name][0] for name in sorted(sizes, key=lambda s: s.encode())])
    assert len(found) == sum(sizes.values())
    for (name, i), r in found.items():
        assert (r.pos, r.n, r.subroot, r.proof) == (i, sizes[name], wanted[name][0], wanted[name][1][i])
        assert merkle.fold(r.leaf, r.pos, r.n, r.proof) == r.subroot
    for i, name in enumerate(sorted(sizes, key=lambda s: s.encode())):
        t = tops[name]
        assert (t.tree_pos, t.trees, t.root, t.top_proof, t.subroot) == (i, len(sizes), root, above[i], wanted[name][0])
    assert merkle.fold(sha("other"), 3, 1025, found["=c", 3].proof) != wanted["=c"][0]


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, "one", "en", "a", 7), (3, "one", "en", "a", 7), (3, "two", "en", "a", 7), (None, "no id", "de", None, 2**63 - 1),
        (2**63 - 1, "é" * 200_000, "fr", "b", 2**63 - 1), (7, "-", "", "-", 1), *((i, "t", "de", "s", 2**63 - 1) for i in range(20, 60)),
    ]
    docs = spark.createDataFrame(rows, DOC).select("*", *(F.lit(7).alias(c) for c in ("tree", "leaf", "pos", "n", "block", "part", "at", "proof", "_tie")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def leaf(r, more=0):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def bad(r):
        return leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)

    order = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    langs = list(dict.fromkeys(r[2] for r in order))
    trees = {lang: tree_of([leaf(r) for r in order if r[2] == lang]) for lang in langs}
    root, above = tree_of([trees[lang][0] for lang in langs])
    wanted = []
    for j, lang in enumerate(langs):
        mine = [r for r in order if r[2] == lang]
        for i, r in enumerate(mine):
            low = trees[lang][1][i]
            folded = merkle.fold(merkle.fold(bad(r), i, len(mine), low), j, len(langs), above[j])
            wanted.append((r[0], leaf(r), trees[lang][0], root, sha(low + above[j]), folded, folded == root))
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert 0 < sum(not r.verified for r in got) < len(got)


# Prefix trie


def trie_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def sums(p):
        size = len(p[-1][1].encode()) if p else 0
        below = [sums(q) for q in children.get(p, [])]
        return sum(b[0] for b in below) or 1, (len(members[p]) - 1) * size + sum(b[1] for b in below)

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *sums(p), sha(ends)))
    return out


def odd_turns():
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody's"), (-3, None, None, None), (-5, 1, "user", "x"), (-5, 1, "user", "x"), (-4, 2, "user", "x"), (2**63 - 1, 0, "user", "é" * 50_000), (-(2**63), 0, "user", "low")]
    for c in range(1000, 1060):  # copies: one group, of which some end early
        rows += [(c, t, "user" if t % 2 else "assistant", f"same {t}") for t in range(12 - c % 3)]
    for c in range(40):
        rows += [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "日本", "line\nfeed", None])) for _ in range(rng.randrange(1, 14))]
    rows += [(77, t, "user", f"long {t}") for t in range(250)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, tmp_path):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURN).repartition(3).select("*", *(F.lit(7).alias(c) for c in ("node", "parent", "depth", "nth", "name", "bytes", "alone")))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    import sys

    sys.setrecursionlimit(10_000)
    assert sorted(map(str, map(tuple, trie.op11_prefix_trie(spark, str(tmp_path)).collect()))) == sorted(map(str, trie_of(rows)))


def test_screen_never_proves_a_repeated_key(spark):
    keys = spark.range(200_000).select(F.when(F.col("id") < 50_000, F.col("id") % 5_000).otherwise(F.col("id")).alias("k"))
    found = sketch.screen(keys, lambda b: iter([b.column("k").to_numpy().astype(np.uint64)]), 200_000)
    assert not found.once(np.arange(5_000, dtype=np.uint64)).any()
    assert found.once(np.arange(50_000, 200_000, dtype=np.uint64)).mean() > 0.9


def test_tails_stay_where_they_are(spark):
    rows = spark.createDataFrame([(c, t, "user", f"{c} {t}" if t > 1 else f"same {t}") for c in range(0, 2000, 5) for t in range(8)], TURN)
    marked = trie.screened(trie.prefixes(trie.rebuild(trie.turns_of(rows))))
    depths = {(r.depth, r.alone): r["count"] for r in marked.groupBy("depth", "alone").count().collect()}
    assert all((d, True) not in depths for d in (0, 1, 2)) and all(depths[d, True] > 350 for d in range(3, 9))


# Substring removal


def words_of(seed, n, vocabulary):
    rng = random.Random(seed)
    return [rng.choice(vocabulary) for _ in range(n)]


def test_equal_windows_have_equal_anchors():
    text = lambda ws: " ".join(ws)
    for vocabulary in (["a"], ["a", "b"], [f"w{i}" for i in range(50)]):
        shared = words_of(1, 300, vocabulary)
        texts = [text(words_of(s, s * 7, vocabulary) + shared + words_of(s + 50, s, vocabulary)) for s in range(6)] + [text(shared)]
        seen = {}
        for words in recompress.word_chunks(pa.array(texts)):
            at, _, keys = recompress.anchors(words, 13)
            for a, k in zip(at.tolist(), keys.tolist(), strict=True):
                assert seen.setdefault(words.hashes[a : a + 13].tobytes(), k) == k
        assert len(set(seen.values())) <= len(seen)


def test_recompression_agrees_inside_equal_stretches():
    vocabulary = [f"w{i}" for i in range(500)]
    shared = words_of(1, 400, vocabulary)
    (words,) = recompress.word_chunks(pa.array([" ".join(words_of(s, 90 + s, vocabulary) + shared + words_of(s + 9, 70, vocabulary)) for s in (2, 3)]))
    s = recompress.compress(words, 7)
    assert 5 < len(words.starts) / len(s.name) < 16
    text = words.texts(s.start)
    ours = [{(n, b - words.firsts[t] - 90 - (2 + t)) for n, b, e in zip(s.name[text == t].tolist(), s.start[text == t].tolist(), s.end[text == t].tolist(), strict=True) if 60 <= b - words.firsts[t] - 92 - t and e - words.firsts[t] - 92 - t <= 340} for t in (0, 1)]
    assert ours[0] == ours[1] and len(ours[0]) > 15
    # Names stand for words: equal names, equal words.
    held = {}
    for n, a, b in zip(s.name.tolist(), s.start.tolist(), s.end.tolist(), strict=True):
        assert held.setdefault(n, words.hashes[a:b].tobytes()) == words.hashes[a:b].tobytes()


def removed(rows):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - 12):
            if d is not None:
                key = tuple(ws[i : i + 13])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - 12):
            if d is not None and least[tuple(ws[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), kept, sorted(gone)))
    return out


@pytest.mark.parametrize("size", [1, 3, 3000])
def test_repeats_equal_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}é" for i in range(size)]
    passages = [words_of(100 + p, n, vocabulary) for p, n in enumerate((13, 14, 30, 60, 400))]
    rows = [(None, " ".join(passages[3])), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "a\x0bb\x0cc d " * 20), (9, "a\x0bb\x0cc d " * 20)]
    for d in range(10, 60):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            ws += words_of(rng.random(), rng.randrange(0, 40), vocabulary) + rng.choice(passages)[rng.randrange(0, 3) :]
        rows.append((rng.randrange(10, 50), rng.choice(["\n", "\t \r"]).join(ws) + rng.choice(["", " "])))
    rows += [(d, " ".join(passages[4])) for d in range(100, 130)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *(F.lit(7).alias(c) for c in ("text_hash", "first", "window", "n", "h1", "spans", "segment", "done")))
    got = substrings.remove_repeats(docs, ["doc_id", "n"]).collect()
    assert {r.n for r in got} == {7}
    told = [(r.doc_id, r.n_words, r.n_removed, r.kept, [i for s in r.removed for i in range(s.start, s.end)]) for r in got]
    assert sorted(map(str, told)) == sorted(map(str, removed(rows)))


# Long texts of the span finders


def test_running_sums(spark):
    values = [random.Random(1).randrange(50) for _ in range(1000)]
    for n in (0, 1, 127, 128, 129, 1000):
        row = spark.createDataFrame([(values[:n],)], "v array<int>").select(common.running(F.col("v")).alias("s"), common.running(F.col("v"), F.greatest).alias("m")).first()
        assert row.s == np.cumsum(values[:n]).tolist() and row.m == np.maximum.accumulate(np.array(values[:n], dtype=int)).tolist()


def test_many_matches_in_one_text(spark):
    text = "".join(f"é token={i:06d} {'abcdef0123456789' * 2} plainwordplainwordplainword{i % 7} " for i in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    docs = common.stage(docs, "test")
    begun = time.time()
    (row,) = docs.select(secrets.base_spans(F.col("text")).alias("spans")).collect()
    assert time.time() - begun < 20
    wanted = [(m.start(), 0, m.end()) for m in re.finditer(r"token=[0-9]{6}", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    assert [tuple(s) for s in row.spans] == sorted(wanted) and len(wanted) == 80_000
    begun = time.time()
    (row,) = secrets.scan(docs, ["doc_id"]).collect()
    assert time.time() - begun < 40 and len(row.base) == 80_000


def test_runs_apart_from_base_spans(spark):
    rng = random.Random(4)
    for many in (5, 400):
        cuts = sorted(rng.sample(range(100_000), 2 * many))
        runs = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = sorted((a, a + rng.randrange(1, 300)) for a in rng.sample(range(100_000), many))
        df = spark.createDataFrame([(runs, base)], "runs array<struct<start:int,end:int>>, base array<struct<start:int,end:int>>")
        got = df.select(secrets._apart(F.col("runs"), F.col("base")).alias("x")).first().x
        assert [tuple(x) for x in got] == [r for r in runs if not any(b[0] < r[1] and r[0] < b[1] for b in base)]


def test_ordinary_runs_hold_every_word(spark):
    """Each word lies in one run of the null, whatever the text's length; long runs are what is tested, and are left out."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgXYZ0123", k=rng.randrange(1, 12)))
    for n in (1, 3, 8, 30, 52, 60, 200, 3000):
        words = [word() for _ in range(n)]
        text = "".join(w + rng.choice([" ", ", ", "-", " é\n"]) + (" " + "Ab1/" * 10 + " " if i % 50 == 7 else "") for i, w in enumerate(words))
        docs = spark.createDataFrame([(text,)], "text string")
        runs = [r.run for r in secrets.joined_runs(docs).collect()]
        kept = [w for w in re.findall("[A-Za-z0-9]+", re.sub("[A-Za-z0-9+/_-]{24,}", " ", text))]
        forms = {"_".join(kept), "".join(kept), "".join(kept).lower()}
        assert "".join(runs) in forms or not runs and min(map(len, forms)) < 24, (n, runs)
        assert all(len(r) >= 24 for r in runs)
        if n == 3000:
            counts = {}
            for r in secrets.ordinary(docs).collect():
                counts[r["size"]] = counts.get(r["size"], 0) + r["count"]
            assert sum(counts.values()) == secrets.MADE * len(secrets.CLASSES) + len(runs) and min(counts.values()) > secrets.MADE + 40


def test_battery_equals_a_plain_one(spark):
    import math

    def plain(run):
        run = run.lower() if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) else run
        letters = next(letters for pattern, letters in secrets.ENCODINGS.values() if re.search(pattern, run))
        n, m = len(run), len(letters)
        place = [max(letters.find(c), 0) - (m - 1) / 2 for c in run]
        pairs = [a * b for a, b in zip(place, place[1:], strict=False)]
        uniform = (sum(run.count(c) ** 2 for c in set(run)) * m / n - n - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
        crossing = (sum(x < 0 for x in pairs) - (n - 1) / 2) / (math.sqrt(n - 1) / 2)
        serial = sum(pairs) / ((m * m - 1) / 12) / math.sqrt(n - 1)
        p = sum(c.isupper() for c in letters) / m
        capitals = (sum(c.isupper() for c in run) - n * p) / math.sqrt(n * p * (1 - p)) if 0 < p < 1 else 0.0
        s = uniform**2 + crossing**2 + serial**2 + capitals**2
        return (s / 2 - math.log1p(s / 2)) / 2.302585092994046 * secrets.STEPS

    rng = random.Random(10)
    runs = ["".join(rng.choices(letters + "_" * (i % 2), k=rng.choice([24, 31, 64, 300]))) for i in range(60) for letters in ("0123456789ABCDEF", "ABCDEFGHXYZ234567", "abcxyz019", "abcXYZ019", "aB+/-9")] + ["a" * 24, "A" * 40, "_" * 30]
    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", secrets.tail_bin(F.col("run")).alias("bin")).collect()
    for r in got:
        x = plain(r.run)
        assert r.bin == min(math.floor(x), secrets.LAST) or abs(x - round(x)) < 1e-6, (r, x)


def test_a_conversation_of_many_turns(spark):
    rows = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text <| {t}") for t in range(20_000)], TURN)
    begun = time.time()
    (row,) = chat.format_chats(rows).collect()
    assert time.time() - begun < 30
    assert [t.text for t in row.parsed] == [f"text <| {t}" for t in range(20_000)]
    assert all(row.formatted[t.at : t.at + t.chars].replace("<\\|", "<|") == t.text for t in row.parsed[::777])


# Language identification


def test_language_id_equals_a_plain_bayes(spark):
    import math
    from collections import Counter

    from obsflow.llm import langid

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]

    def grams(text):
        points = [ord(c) for c in text.lower() + " "]
        for order in (1, 2, 3):
            for i in range(len(points) - order + 1):
                h = order
                for p, m in zip(points[i : i + order], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                    h = (h ^ p) * m % 2**32
                    h ^= h >> 15
                yield h % 2**14

    counts = {}
    for doc_id, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(text))
    sums = {lang: sum(c.values()) + 0.5 * 2**14 for lang, c in counts.items()}
    got = {r.doc_id: r for r in langid.op5_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = Counter(grams(text))
        logs = {lang: sum(n * math.log((c[g] + 0.5) / sums[lang]) for g, n in own.items()) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        # The model also counts the few n-grams that reach from one text into the next.
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 0.02
