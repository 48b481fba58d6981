import collections
import dataclasses
import hashlib
import inspect
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from data import DOCS, empty, messy, prose, row, word
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, fuzzy_lines, licenses, materialise, mixing, simhash, toxicity, winnowing

BLANK = r"[^\x20\x09-\x0D]+"


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x or 0))


# --- toxicity -----------------------------------------------------------------------------------------------------


def toxic_corpus(n=260):
    rng, texts, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200)).split()
        if i % 4 == 0:
            for _ in range(4):  # unseen words around a telling stem
                words.insert(rng.randrange(len(words)), "grumb" + word(rng))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def toxic_model():
    texts, labels = toxic_corpus()
    return toxicity.train([t.encode() for t in texts[:200]], labels[:200], 0.25, toxicity.Settings(epochs=6))


def test_unseen_words_are_recognised(toxic_model):
    texts, labels = toxic_corpus()
    scores = toxicity.Scorer(toxic_model)([t.encode() for t in texts[200:]])
    assert ((scores >= 0.5) == (labels[200:] == 1)).mean() >= 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    settings = toxicity.Settings(window=6, hidden=3)
    net = {k: v.astype(np.float64) for k, v in toxicity._init(settings).items()}
    feats = rng.standard_normal((9, toxicity.FEATURES)) * 0.5
    win, real = rng.integers(0, 9, (5, 6)), np.ones((5, 6))
    real[2, 4:] = 0
    target, weight = np.array([1, 0, 1, 0, 1.0]), np.ones(5)
    grads = toxicity._gradients(feats, win, real, target, weight, net)

    def loss():
        outs = sum(toxicity._run(feats @ net["W" + d] + net["c" + d], win, real, net, d).astype(np.float64) for d in "fb")
        logit = toxicity._pool(outs, real, net["bias"][0])[0]
        return np.mean(np.log1p(np.exp(-np.where(target == 1, logit, -logit))))

    for name, at in (("Uf", (1, 2)), ("Ub", (0, 7)), ("Wf", (3, 4)), ("Wb", (2, 8)), ("of", (1, 0)), ("ob", (2, 1)), ("cf", (5,)), ("bias", (0,))):
        old = net[name][at]
        net[name][at] = old + 1e-2
        up = loss()
        net[name][at] = old - 1e-2
        down = loss()
        net[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-4, name


def test_windows_cover_every_word():
    settings = toxicity.Settings(window=8, stride=5)
    doc, first, size = toxicity.cut_windows(np.array([0, 1, 8, 9, 40]), settings)
    for d, n in enumerate([0, 1, 8, 9, 40]):
        own = [(f, f + s) for x, f, s in zip(doc, first, size, strict=True) if x == d]
        assert set().union(*[range(a, b) for a, b in own]) == set(range(n)) and own
        assert all(b2 - a2 > 0 and a2 < b1 for (_, b1), (a2, b2) in zip(own, own[1:], strict=False))


def test_toxicity_on_messy_rows(spark, toxic_model):
    docs = messy(spark)
    scored = toxicity.score(docs, toxic_model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    kept = toxicity.keep_clean(docs, toxic_model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in scored)
    assert toxicity.score(empty(spark), toxic_model).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    nothing = toxicity.fit(docs, labels)
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.fit(empty(spark), labels.limit(0)).net is None


def test_held_out_fifth(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", toxicity.held_out("doc_id")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


# --- simhash ------------------------------------------------------------------------------------------------------


def print_of(text):
    words = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(rows):
    """Every pair compared; smallest id of each part."""
    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [(doc_id, prints[i], low.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [prose(rng, 300) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = word(rng)
        rows.append((100 + i, " ".join(words)))
    rows += [(i, t) for i, t in ((500, None), (501, " "), (502, "Ab CD"), (503, "ab cd"), (None, texts[0]), (None, "lone"))]
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect())
    assert got == collections.Counter(classes_of(rows))


@pytest.mark.parametrize("block", [8, 4096])
def test_index_finds_all_links(spark, block):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(400)}
    centre = rng.getrandbits(64)
    for _ in range(250):  # a crowded ball, and pairs at the limit
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), 2)))
    for v in list(values)[:60]:
        values.add(v ^ sum(1 << b for b in rng.sample(range(64), 4)))
    values = list(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    pairs = {(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in simhash.links(frame, block=block).collect()}

    def parts(edges):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in values}

    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert parts(pairs) == parts(want)


def test_one_of_each_class_stays(spark):
    docs = messy(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = simhash.fingerprints_of([(t or "").encode() for _, t in rows])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    stay = [r["doc_id"] for r in kept.collect()]
    # one document of each group, and none of them twice, although an id stands for unlike texts
    smallest = [min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)]
    assert sorted(stay, key=repr) == sorted(smallest, key=repr) and len({t for _, t in rows if t}) > len(smallest)
    assert collections.Counter(i for i in stay if i is not None)[12] == 2
    assert simhash.keep_one(empty(spark)).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def slow_tiling(item, text, least):
    """Greedy string tiling as published: all matches of the longest length first."""
    marked_item, marked_text, covered = [False] * len(item), [False] * len(text), 0
    while True:
        longest, found = least, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not marked_item[p + n] and not marked_text[t + n]:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest and n >= least:
                    found.append((p, t))
        for p, t in found:
            if not any(marked_item[p : p + longest]) and not any(marked_text[t : t + longest]):
                marked_item[p : p + longest] = marked_text[t : t + longest] = [True] * longest
                covered += longest
        if not found:
            return covered


def test_tiling_against_the_published_loop():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randint(3, 25))]
        text = [rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(item))
            at = rng.randint(0, len(text))
            text[at:at] = item[a : a + rng.randint(3, 12)]
        block = decontaminate.Items.of([(1, " ".join(item))], 3)
        found = block.matched([" ".join(text).encode()], 0.0001)
        want = slow_tiling(item, text, min(3, len(item)))
        assert (round(found[0][2] * len(item)) if found else 0) == want


def test_reordered_passages_are_caught(spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    w = item.split()
    moved = " ".join(w[20:] + [word(rng)] + w[:20])
    rows = [
        row(1, prose(rng, 30) + " " + moved.upper() + ", " + prose(rng, 30)), row(2, prose(rng, 300)), row(3, " ".join(w[:20])), row(4, item),
        row(4, item), row(None, item), row(5, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (10, "odd one")], "item_id long, text string")
    for block_bytes in (64, 1 << 20):
        found = decontaminate.leaks(docs, items, block_bytes=block_bytes)
        got = collections.Counter((r["doc_id"], r["item_id"], r["coverage"], r["tiles"]) for r in found.collect())
        want = collections.Counter({(d, i, 1.0, t): n for d, t, n in ((1, 2, 1), (4, 1, 2), (None, 1, 1)) for i in (7, None)})
        assert got == want
        assert ids(decontaminate.keep_clean(docs, items, block_bytes=block_bytes)) == [2, 3, 5]
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.keep_clean(messy(spark), items.limit(0)).count() == messy(spark).count()


# --- winnowing ----------------------------------------------------------------------------------------------------


def winnowed(text, k=3, w=4):
    units = re.findall(r"[^\x20\x09-\x0D]{1,12}", text) or [""]
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]

    def pack(v):
        return struct.pack("<Q", v)

    def run(i):
        h = hashes[i]
        for j in range(1, k):
            h = xxhash.xxh64_intdigest(pack(h), 42)
            if i + j < len(hashes):
                h = xxhash.xxh64_intdigest(pack(hashes[i + j]), h)
        return h

    grams = [(run(i) >> 32 & 0x7FFFFFFF, -i) for i in range(max(1, len(units) - k + 1))]
    return {min(grams[i : i + w]) for i in range(max(1, len(grams) - w + 1))}


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket_ids", [2, 1024])
def test_winnowing_against_python(spark, bucket_ids):
    docs = messy(spark)
    found = winnowing.edited_and_next(docs, bucket_ids=bucket_ids)
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited"] or "", r["near_edited"], r["near_next"], sorted((x >> 32, -(0xFFFFFFFF - (x & 0xFFFFFFFF))) for x in r["entries"]))
        for r in found.collect()
    )
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    placed = sorted(((i, t) for i, t in rows if i is not None), key=lambda x: (x[0], x[1].encode()))
    want = []
    for k, (i, t) in enumerate(placed):
        after = placed[(k + 1) % len(placed)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own = winnowed(t)
        want.append((False, i, len(t), edited, like(own, winnowed(edited)), like(own, winnowed(after)), sorted(own)))
    want += [(True, 0, len(t), "", None, None, sorted(winnowed(t))) for i, t in rows if i is None]
    key = lambda x: (x[:4], x[6])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert winnowing.edited_and_next(empty(spark)).count() == 0


def test_shared_passages_share_hashes(spark):
    rng = random.Random(8)
    passage = prose(rng, 6)
    docs = spark.createDataFrame([(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(8)], "doc_id long, text string")
    prints = [{x >> 32 for x in r["entries"]} for r in winnowing.fingerprints(docs).collect()]
    assert all(a & b for a in prints for b in prints)


# --- fuzzy lines --------------------------------------------------------------------------------------------------


def distance(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row_[0] = row_[0], i
        for j, y in enumerate(b, 1):
            last, row_[j] = row_[j], min(row_[j] + 1, row_[j - 1] + 1, last + (x != y))
    return row_[-1]


def test_pieces_make_up_the_text(spark):
    rng = random.Random(6)
    long = " ".join(prose(rng, 40) + "." for _ in range(60))
    texts = ["", "\n", "a\n\nb", "a\nb\n", long + "\n" + long, "y" * 9000 + "\nz", "x. " * 3000, prose(rng, 3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.regexp_extract_all("t", F.lit(fuzzy_lines.PIECES)).alias("p")).collect()
    for r in rows:
        assert "".join(r["p"]) == texts[r["i"]] and all(len(x) <= 2001 for x in r["p"])


def test_rows_follow_the_rule_of_pieces(spark):
    """The rule itself runs over texts with long lines only; all others give the same lines without it."""
    rng = random.Random(16)
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\n\nb", "a\r\nb\r", " \n ", "é漢\U0001f600\nx"]
    texts += ["x" * n + end for n in (1998, 1999, 2000, 2001) for end in ("", "\n", "\nz")] + ["\U0001f600" * 1999 + "\nb", prose(rng, 900) + "\n" + prose(rng, 5)]
    texts += ["".join(rng.choice("ab \n.") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = F.regexp_extract_all("text", F.lit(fuzzy_lines.PIECES))
    rule = docs.select(F.col("doc_id").alias("_id"), F.posexplode(F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)).alias("_line", "_text"))
    want = rule.select("_id", "_line", fuzzy_lines.normalised(F.col("_text")).alias("_norm"))
    assert sorted(fuzzy_lines._rows(docs).select("_id", "_line", "_norm").collect()) == sorted(want.collect())


def test_a_last_line_is_cut_like_one_inside(spark):
    rng = random.Random(8)
    lines = {n: (" ".join(prose(rng, 12) + "." for _ in range(60)))[:n] for n in (500, 1999, 2000, 2500)}
    texts = [t for line in lines.values() for t in (line, line + "\n" + "z")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_extract_all("t", F.lit(fuzzy_lines.PIECES)).alias("p")).collect()
    cut = {r["i"]: [x.rstrip("\n") for x in r["p"]] for r in rows}
    assert cut[0] == [lines[500]] and all(cut[i] + ["z"] == cut[i + 1] for i in range(0, len(texts), 2))
    docs = spark.createDataFrame([(1, "z z\n" + lines[500] + "\nother words"), (2, "more text\n" + lines[500])], "doc_id long, text string")
    assert {(r["doc_id"], r["line"]) for r in fuzzy_lines.decisions(docs).collect() if not r["kept"]} == {(2, 1)}


def test_fuzzy_lines_against_all_pairs(spark):
    """Groups equal those of all pairs that share a key, are near in bits and similar in letters."""
    rng = random.Random(12)
    base = [prose(rng, 40) for _ in range(5)]
    lines = []
    for _ in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word(rng)
        lines.append(" ".join(w))
    lines += [prose(rng, 12) for _ in range(30)] + ["les", "ab cd", "12 34", ""]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(len(lines) // 7)], "doc_id long, text string")
    occ = fuzzy_lines._occurrences(docs).collect()
    texts = {r["_h"]: n["_norm"] for r, n in ((r, n) for r in occ for n in ())}
    norms = {(r["_row"], r["_line"]): r["_norm"] for r in fuzzy_lines._rows(docs).collect()}
    sims = {}
    for r in occ:
        if r["_h"] is not None:
            texts[r["_h"]] = norms[(r["_row"], r["_line"])]
            sims[r["_h"]] = r["_sim"] % (1 << 64)
    edges = [64 * k // 5 for k in range(6)]

    def blocks(s):
        return [s >> a & (1 << b - a) - 1 for a, b in zip(edges, edges[1:], strict=False)]

    root = {h: h for h in sims}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = False
    for a in sims:
        for b in sims:
            if a < b and sum(x == y for x, y in zip(blocks(sims[a]), blocks(sims[b]), strict=True)) >= 2 and (sims[a] ^ sims[b]).bit_count() <= fuzzy_lines.DISTANCE:
                longer = max(len(texts[a]), len(texts[b]))
                if distance(texts[a], texts[b]) <= int(longer * (1 - fuzzy_lines.SIMILARITY) + 1e-9):
                    root[max(find(a), find(b))] = min(find(a), find(b))
                    some = True
    assert some
    decided = fuzzy_lines.decisions(docs).collect()
    groups, firsts = collections.defaultdict(set), {}
    for r in decided:
        h = next((o["_h"] for o in occ if (o["_row"], o["_line"]) == (r["row"], r["line"])), None)
        if h is None:
            assert r["kept"] and r["group"] is None
            continue
        groups[find(h)].add(r["group"])
        key = (r["doc_id"], r["line"])
        firsts[find(h)] = min(firsts.get(find(h), key), key)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert {(r["doc_id"], r["line"]) for r in decided if r["kept"] and r["group"] is not None} == set(firsts.values())


def test_connected_lines_are_not_compared_again(spark, monkeypatch):
    """Within a crowded key, only lines that the links to the keys' first lines leave apart are paired."""
    rng, calls, verified = random.Random(22), [], fuzzy_lines._verified

    def seen(pairs, *rest, **more):
        found = verified(pairs, *rest, **more)
        calls.append([[tuple(r) for r in x.collect()] for x in (pairs, found)])
        return found

    monkeypatch.setattr(fuzzy_lines, "_verified", seen)
    lines = []
    for base in (prose(rng, 30).split() for _ in range(3)):
        for _ in range(30):
            lines.append(" ".join(word(rng) if rng.random() < 0.09 else w for w in base))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    per = fuzzy_lines.documents(docs).collect()
    root = {i: i for i in range(len(lines))}

    def find(root, x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            longer = max(len(lines[a]), len(lines[b]))
            if distance(lines[a], lines[b]) <= int(longer * 0.2 + 1e-9):
                root[max(find(root, a), find(root, b))] = min(find(root, a), find(root, b))
    assert {r["doc_id"] for r in per if r["kept"]} == {x for x in root if find(root, x) == x}
    (star, close), (rest, _) = calls
    parts = {}
    for a, b in close:
        parts[find(parts, a)] = find(parts, b)
    assert len(star) > 50 and len(close) > 50
    assert [(a, b) for a, b in rest if find(parts, a) == find(parts, b)] == []


def test_edited_lines_meet(spark):
    """Lines against an edited copy each: nearly all with edit similarity 0.8 are found, whatever their bits are."""
    rng = random.Random(21)
    one, two = [], []
    while len(one) < 200:
        n = rng.choice([3, 6, 8, 10, 20, 30])
        w = prose(rng, n).split()
        v = list(w)
        for at in rng.sample(range(n), max(1, n // 10)):
            v[at] = word(rng) if rng.random() < 0.7 else v[at][:1] + "q" + v[at][1:]
        a, b = " ".join(w), " ".join(v)
        if a != b and distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            one.append(a)
            two.append(b)
    docs = spark.createDataFrame([(1, "\n".join(one)), (2, "\n".join(two))], "doc_id long, text string")
    dropped = {r["doc_id"]: len(r["dropped"]) for r in fuzzy_lines.documents(docs).collect()}
    print("found of 200:", dropped[2])
    assert dropped[2] >= 190 and dropped[1] <= 10


def test_a_key_of_a_line_is_two_numbers(spark, monkeypatch):
    """What is dealt out by key is dealt once and holds the key and the line's number only."""
    rng = random.Random(31)
    texts = [prose(rng, 30) for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40] + ("" if i < 40 else " " + word(rng))) for i in range(80)], "doc_id long, text string")
    plans = {}

    def noted(df, name, **more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return common.stored(df, name, **more)

    monkeypatch.setattr(fuzzy_lines, "stored", noted)
    assert sum(len(r["dropped"]) for r in fuzzy_lines.documents(docs).collect()) == 40
    plan = plans["line-members"]
    assert plan.count("Generate explode") == 1  # a second one would be another exchange of all keys
    made = re.search(r"Project \[([^]]*)\]\n[^\n]*Generate explode", plan)[1]
    assert re.findall(r"(\w+)#", re.sub(r"\w+#\d+L? AS ", "", made)) == ["key", "line"]


def test_counters_of_a_full_line(spark):
    """The most words that a piece can have, all alike: every counter is at its highest or at nothing."""
    text = " ".join("a" for _ in range(1000))
    row_ = fuzzy_lines._occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row_["_sim"] % (1 << 64) == xxhash.xxh64_intdigest(b"a", 42)


def test_bits_of_the_blocks():
    assert inspect.signature(fuzzy_lines.decisions).parameters["distance"].default == 14


def test_simhash_of_a_line(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 2, 3, 30, 120, 1000)] + ["abcd abcd efgh", "de la"]
    for r in fuzzy_lines._occurrences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)).groupBy("_id").agg(F.count("*").alias("n"), F.first("_sim").alias("s")).collect():
        text = texts[r["_id"]]
        if r["n"] > 1:
            continue  # a long line is several pieces
        words = text.split()
        long = [w for w in words if len(w) >= 4]
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (long if len(long) >= 2 else words)]
        least = min(hashes, key=lambda h: h - (1 << 64) if h >> 63 else h)
        want = 0
        for b in range(64):
            ones = 2 * sum(h >> b & 1 for h in hashes)
            want |= (ones > len(hashes) or (ones == len(hashes) and least >> b & 1)) << b
        assert r["s"] % (1 << 64) == want


def test_clean_lines(spark):
    docs = messy(spark).unionByName(spark.createDataFrame([row(20, "One line, here it is.\nother words in this line 5\n\nONE line here it is"), row(21, "one LINE: here it is!\nfresh words in the second line")], DOCS))
    cleaned = fuzzy_lines.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert texts[20] == "One line, here it is.\nother words in this line 5\n\n" and texts[21] == "fresh words in the second line"
    assert texts[4] is None and texts[5] == "" and texts[2] == ""
    per = fuzzy_lines.documents(docs)
    assert per.count() == docs.count() and fuzzy_lines.documents(empty(spark)).count() == 0


# --- licenses -----------------------------------------------------------------------------------------------------


def test_licenses_against_containment(spark):
    rng = random.Random(7)
    names = list(licenses.TEMPLATES)
    rows, want = [], set()
    for i in range(60):
        name = rng.choice(names)
        words = licenses.TEMPLATES[name].split()
        if len(words) > 60 and i % 2:
            words[rng.randrange(len(words))] = "changed"  # five shingles of over fifty
        rows.append((i, prose(rng, rng.randint(0, 300)) + " " + " ".join(words) + " " + prose(rng, rng.randint(0, 300))))

    def shingles(text):
        w = "".join(c.lower() if c.isascii() and c.isalnum() else (c if not c.isascii() else " ") for c in text).split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for i, text in rows:
        own = shingles(text)
        want |= {(i, n, len(shingles(t) & own) / len(shingles(t))) for n, t in licenses.TEMPLATES.items() if len(shingles(t) & own) >= 0.8 * len(shingles(t))}
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["license"], r["containment"]) for r in found.collect()} == want


def test_stretched_licenses_at_every_offset():
    """Words inserted into a template, as many as to double it, wherever the passage begins among the blocks."""
    rng, index = random.Random(17), licenses.Index(licenses.TEMPLATES)
    for name in ("ISC", "MIT", "BSD-2-Clause"):
        words = licenses.TEMPLATES[name].split()
        size = len(licenses.word_hashes(np.frombuffer(licenses.TEMPLATES[name].encode(), np.uint8))[0]) - 4
        block = 1 << (size - 1).bit_length()
        cut = rng.randrange(10, len(words) - 10)
        extra = [f"w{rng.randrange(10**9)}" for _ in range(min(20, block - 10))]
        passage = words[:cut] + extra + words[cut:]
        texts = [" ".join([f"p{rng.randrange(10**9)}" for _ in range(offset)] + passage + [f"q{rng.randrange(10**9)}" for _ in range(2 * block)]) for offset in range(block)]
        found = {i: (share, first, length) for i, license, share, first, length in index.matches([t.encode() for t in texts]) if license == name}
        assert sorted(found) == list(range(block)) and len({share for share, _, _ in found.values()}) == 1
        assert all(first == i for i, (_, first, _) in found.items()) and len({length for _, _, length in found.values()}) == 1


def test_the_shortest_stretch_is_reported():
    assert licenses.shortest([0, 3, 9, 10, 11], [0, 1, 2, 0, 1], 3) == (9, 11)
    assert licenses.shortest([4, 5, 8, 9], [0, 1, 0, 1], 2) == (4, 5) and licenses.shortest([7], [0], 1) == (7, 7)
    notice = licenses.TEMPLATES["ISC"]
    text = ("permission notice appear in all copies " + "x " * 9 + notice + " y" * 3 + " " + notice).encode()
    ((_, _, share, first, _),) = [m for m in licenses.Index(licenses.TEMPLATES).matches([text]) if m[1] == "ISC"]
    assert (share, first) == (1.0, 15)


def test_licenses_on_messy_rows(spark):
    docs = messy(spark).unionByName(spark.createDataFrame([row(None, "Released under the MIT License."), row(30, "one two released UNDER the, mit licence / license")], DOCS))
    assert ids(licenses.scan(docs)) == [None]
    assert licenses.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.Index({"short": "four words are few"})


# --- mixing -------------------------------------------------------------------------------------------------------


def filled(sizes, weights, total, most):
    """Reshare by weight until no target is above its cap."""
    goal, open_, target = total * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = (goal - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        for i in over or open_:
            target[i] = most * sizes[i] if over else level * weights[i]
        open_ -= over or open_
    return target


@pytest.mark.parametrize("many", [1, 9])
def test_mix_reaches_targets(spark, many):
    rng = random.Random(many)
    rows = [row(i, prose(rng, rng.randint(0, 400)), None if i % 9 == 8 else f"s{min(i % 9, many)}") for i in range(140)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, mixing.Settings(block=8, shard_slots=64)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(BLANK, r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    target = dict(zip(order, filled([sizes[s] for s in order], weights, 1.5, 2.0), strict=True))
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(re.findall(BLANK, rows[r["doc_id"]][1])) and r["source_size"] == sizes[s]
        assert abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 16 for s in order)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5), mixing.Settings(block=8, shard_slots=64)).collect())


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), 16, F.lit(3), F.lit("k")).alias("p")).collect()
        assert sorted(r["p"] for r in out) == list(range(n))


def test_mixed_text_is_the_taken_text(spark):
    docs = messy(spark)
    settings = mixing.Settings(block=16, shard_slots=32)
    mixed = mixing.mixed(docs, settings)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(re.findall(BLANK, r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = collections.Counter()
    for r in mixing.mix(docs, settings).collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixed_rows_are_whole_takes(spark):
    """A row for what is taken once and one for what is taken twice, each in the order of the text."""
    rows = [row(i, " ".join(f"w{i}x{k}" for k in range(n)), "ab"[i % 2]) for i, n in enumerate([500, 40, 3, 300, 90, 70])]
    found = collections.defaultdict(list)
    for r in mixing.mixed(spark.createDataFrame(rows, DOCS), mixing.Settings(block=16, shard_slots=32)).collect():
        found[r["doc_id"]].append([int(w.rpartition("x")[2]) for w in r["text"].split(" ")])
    for takes in found.values():
        takes.sort(key=len)
        assert len(takes) <= 2 and all(t == sorted(set(t)) for t in takes) and set(takes[0]) <= set(takes[-1])


# --- training order -----------------------------------------------------------------------------------------------


def stream_of(docs, settings):
    """All ids in the order of id and text hash, and (doc_id, ids) of each text."""
    encode = materialise.encoder(settings.vocabulary)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    texts = [(r["doc_id"], [*encode.encode_ordinary(r["text"] or ""), settings.end]) for r in rows]
    return [x for _, ids in texts for x in ids], texts


@pytest.mark.parametrize("piece", [materialise.PIECE, 100])
def test_training_order_round_trip(spark, tmp_path, monkeypatch, piece):
    """Sequences are the stream of all texts cut every 64 ids; only the last one is padded."""
    monkeypatch.setattr(materialise, "PIECE", piece)
    rng = random.Random(5)
    more = spark.createDataFrame([row(100 + i, prose(rng, 60)) for i in range(300)], DOCS)
    docs = messy(spark).unionByName(more).repartition(3)
    settings = materialise.Settings(length=64, per_shard=50, pad=7)
    got = materialise.ordered(docs, settings).collect()
    stream, texts = stream_of(docs, settings)
    n = -(-len(stream) // 64)
    assert sorted(r["slot"] for r in got) == list(range(n)) and all(len(r["payload"]) == settings.stride for r in got)
    assert all(r["offset"] == r["slot"] % 50 * 128 and r["shard"] == r["slot"] // 50 for r in got)
    by = sorted(got, key=lambda r: r["sequence"])
    assert [r["slot"] for r in by] == materialise.permuted(np.arange(n), n, settings.key).tolist()
    assert np.frombuffer(b"".join(r["payload"] for r in by), "<u2").tolist() == stream + [7] * (n * 64 - len(stream))
    # which text each id belongs to
    owners = [i for r in by for i, k in zip(r["doc_ids"], r["lengths"], strict=True) for _ in range(k)]
    assert owners == [i for i, ids in texts for _ in ids]
    assert all(sum(r["lengths"]) == r["n"] and len(r["doc_ids"]) == len(r["lengths"]) for r in by)
    folder = str(tmp_path / "shards")
    every = materialise.pieces(docs, settings)
    assert every.n == n and every.dictionary
    places = materialise.write_shards(every, folder, settings).collect()
    assert sorted(tuple(r) for r in places) == sorted(tuple(r)[:-1] for r in got)
    one = (tmp_path / "shards" / "shard-000000.bin").stat().st_mtime_ns
    materialise.write_shards(every, folder, settings).collect()  # taken up again: nothing is written twice
    assert (tmp_path / "shards" / "shard-000000.bin").stat().st_mtime_ns == one
    for r in got[:: max(1, n // 20)]:
        assert materialise.read_slot(folder, r["slot"], settings).tobytes() == bytes(r["payload"])
    assert materialise.ordered(empty(spark)).count() == 0


def test_missing_pieces_are_an_error(spark, tmp_path):
    settings = materialise.Settings(length=64, per_shard=50)
    every = materialise.pieces(messy(spark), settings)
    for k, lost in enumerate(("slot = 3", f"sequence = {every.n // 2} and first = 0", f"slot = {every.n - 1}")):
        with pytest.raises(Exception, match="slot"):
            materialise.write_shards(dataclasses.replace(every, rows=every.rows.where(f"not ({lost})")), str(tmp_path / str(k)), settings).collect()


def test_texts_that_teach_nothing(spark):
    """Without a dictionary (no texts, or too few ids to learn from) the rows are the same kind of rows."""
    docs = spark.createDataFrame([row(1, "one"), row(2, None), row(3, "one")], DOCS)
    every = materialise.pieces(docs)
    got = materialise.materialised(docs).collect()
    assert every.dictionary == b"" and every.n == len(got) == 1 and got[0]["doc_ids"] == [1, 2, 3] and sum(got[0]["lengths"]) == got[0]["n"]


def test_resume_with_another_split(spark, tmp_path):
    """The order is that of the data, and shards of another order are not kept."""
    settings = materialise.Settings(length=64, per_shard=50)
    docs, folder = messy(spark), tmp_path / "shards"

    def plain(df):
        return sorted(tuple(r) for r in df.select("slot", "shard", "offset", "sequence", "doc_ids", "lengths", "n", "payload").collect())

    one = plain(materialise.materialised(docs.repartition(3), settings, str(folder)))
    assert one == plain(materialise.ordered(docs.repartition(5, "text"), settings))
    kept = {f.name: (f.read_bytes(), f.stat().st_mtime_ns) for f in folder.iterdir() if f.name.endswith(".bin")}
    assert len(kept) == one[-1][1] + 1
    (folder / "shard-000000.bin").unlink()
    (folder / "shard-000001.bin").write_bytes(kept["shard-000001.bin"][0][::-1])
    assert plain(materialise.materialised(docs.repartition(7, "source"), settings, str(folder))) == one
    again = {f.name: (f.read_bytes(), f.stat().st_mtime_ns) for f in folder.iterdir() if f.name.endswith(".bin")}
    assert {k: v[0] for k, v in again.items()} == {k: v[0] for k, v in kept.items()}
    assert all(again[k] == kept[k] for k in kept if k > "shard-000001.bin")
    with pytest.raises(ValueError):
        materialise.materialised(docs.limit(3), settings, str(folder))
    assert materialise.materialised(empty(spark)).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000):
        slots = materialise.permuted(np.arange(n), n, 4).tolist()
        assert sorted(slots) == list(range(n))
    assert slots != list(range(1000)) and slots != materialise.permuted(np.arange(1000), 1000, 5).tolist()
    assert materialise.permuted(np.array([], np.int64), 0, 4).tolist() == []


def test_feistel_against_plain_rounds():
    """Slots are those of the network in plain Python, which walks the cycle until it is below n."""
    n, key, half, word = 700, -4, 5, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return x ^ x >> 31

    def network(x):
        left, right = x >> half, x & 31
        for r in range(1, materialise.ROUNDS + 1):
            left, right = right, left ^ mix(right ^ mix(key & word ^ r << 48)) & 31
        return left << half | right

    def slot(i):
        at = network(i)
        while at >= n:
            at = network(at)
        return at

    assert materialise.permuted(np.arange(n), n, key).tolist() == [slot(i) for i in range(n)]


def test_long_texts_are_tokenised_in_parts():
    rng = random.Random(1)
    text = prose(rng, 4000) + "  two blanks " + prose(rng, 300)
    parts = materialise.parts_of(text, 1000)
    encode = materialise.encoder(materialise.VOCABULARY)
    assert "".join(parts) == text and len(parts) > 5
    assert [t for p in parts for t in encode.encode_ordinary(p)] == encode.encode_ordinary(text)
    assert hashlib.sha256("".join(materialise.parts_of("x" * 5000, 1000)).encode()).digest() == hashlib.sha256(b"x" * 5000).digest()


def test_each_different_unit_is_tokenised_once():
    rng = random.Random(14)
    signs = [*"ab Z9.,'\"(-\n\t\r\x00\x1c\x7f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "é", "à", "漢", "д", "٣", "\u200d", "\U0001f600", "'s", "'re", "  "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "  ", "a b", " a", "a ", "x" * 3000, "y" * 70000 + " z"]
    encoder = materialise.encoder(materialise.VOCABULARY)
    units = materialise.UnitEncoder(materialise.Settings())
    for got, text in zip(units.texts([t.encode() for t in texts]), texts, strict=True):
        assert got.tolist() == encoder.encode_ordinary(text), repr(text)
    assert [x.tolist() for x in units.texts([b"", b""])] == [[], []]
    seen = []
    plain, units.encode = units.encode, lambda text, **kw: seen.append(len(text)) or plain(text, **kw)
    text = prose(rng, 500) + "."
    (whole,) = units.texts([text.encode() * 200])
    assert whole.tolist() == encoder.encode_ordinary(text * 200) and sum(seen) < 2 * len(text)
