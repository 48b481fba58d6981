"""Exact dedup, spelling variants and alignment against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from data import DOCS, empty, messy, prose, row, word

from pyspark.sql import functions as F

from tidemark.llm import align, exact_dedup, spelling

# ---------- exact dedup ----------


def _plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _equal_groups(rows):
    """Per normalised text: (ids in order, nulls last)."""
    found = defaultdict(list)
    for doc_id, text in rows:
        found[_plain(text)].append(doc_id)
    return {k: sorted(v, key=lambda x: (x is None, x or 0)) for k, v in found.items()}


@pytest.mark.parametrize("prefix,bits", [(exact_dedup.PREFIX, exact_dedup.BITS), (1, 1 << 15), (0, 1 << 15)])
def test_exact_groups(spark, prefix, bits):
    """Any prefix and any filter give the same groups."""
    rng = random.Random(4)
    base = prose(rng, 30)
    more = [row(100 + i, base.replace(" ", rng.choice([" ", "\n", " \t "]), 3)) for i in range(6)] + [row(200, base + " x"), row(201, base + " x")]
    docs = messy(spark).unionByName(spark.createDataFrame(more, DOCS))
    found = exact_dedup.groups(docs, {"text_sha256": exact_dedup.digest(F.col("text"))}, prefix, bits).collect()
    want = []
    for text, ids in _equal_groups(docs.select("doc_id", "text").collect()).items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, ids[0], len(ids), at == 0, digest) for at, i in enumerate(ids)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256"))) for r in found)
    settled = {r["settled"] for r in found if r["group_size"] > 1}
    assert settled == {"hash"}


def test_only_survivors_are_hashed(spark):
    """Texts of other lengths or beginnings are settled without a hash."""
    docs = spark.createDataFrame([row(1, "aaaa b"), row(2, "aaaa  b"), row(3, "cccc b"), row(4, "aaaa bb")], DOCS)
    found = {r["doc_id"]: (r["settled"], r["keep_id"]) for r in exact_dedup.groups(docs).collect()}
    assert found == {1: ("hash", 1), 2: ("hash", 1), 3: ("prefix", 3), 4: ("prefix", 4)}


def test_keep_first(spark):
    docs = messy(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    groups = _equal_groups(docs.select("doc_id", "text").collect())
    found = [(_plain(r["text"]), r["doc_id"]) for r in kept.collect()]
    assert sorted(found, key=repr) == sorted(((k, v[0]) for k, v in groups.items()), key=repr)


def test_hot_groups(spark):
    """A group with a third of all rows, and more groups than can be hot."""
    rows = [row(i, "same text" if i % 3 == 0 else f"text {i // 4}") for i in range(6000)]
    found = exact_dedup.groups(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 6000 and sum(r["kept"] for r in found) == len({r[1] for r in rows})
    assert {r["group_size"] for r in found if r["doc_id"] % 3 == 0} == {2000}


# ---------- spelling ----------


def _vocabulary(rows, slips=97, shortest=5, rarest=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= rarest}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _expected(voc):
    out = []
    near = {w: [o for o in voc if o != w and abs(len(o) - len(w)) < 2 and _one_edit(o, w)] for w in voc}
    form = {}
    for w, n in voc.items():
        best = min(near[w], key=lambda o: (-voc[o], o), default=None)
        if best is not None and voc[best] >= 2 * n:
            form[w] = best
    for w, n in voc.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), voc.get(form.get(w)), root))
    return out


def _variants(df):
    return sorted(map(repr, (tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())))


def _misspelt(rng, w):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abxyzé÷") + w[k:], w[:k] + rng.choice("aeiouß") + w[k + 1 :]])


@pytest.mark.parametrize("pairs", [spelling.PAIRS, 6, 0])
def test_variants(spark, pairs):
    """Chunks that are joined at once, or refined to the last letter, find the same pairs."""
    rng = random.Random(7)
    base = sorted({word(rng) for _ in range(150)})
    rows = []
    for i in range(60):
        text = " ".join(_misspelt(rng, w) if rng.random() < 0.4 else w for w in rng.choices(base, k=120))
        rows.append(row(i, text.title() if i % 7 == 0 else text))
    rows += [row(900 + i, "aaaaa aaaaaa aaaaaaa aaaa baaaa abaaa aaaab " * 3) for i in range(2)]
    docs = messy(spark).unionByName(spark.createDataFrame(rows, DOCS))
    want = _expected(_vocabulary(docs.select("doc_id", "text").collect(), 11))
    assert sum(x[3] is not None and x[5] != x[3] for x in want) > 0
    assert _variants(spelling.variants(docs, slips=11, pairs=pairs)) == sorted(map(repr, want))


def test_runs_in_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "Ünder ÷× a" + "b" * 40 + " x漢y zzzzzzĀÀÿZ"
    found = [w.decode("latin-1") for some in spelling.runs(text) for w in some]
    assert found == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert list(spelling.runs("")) == []


# ---------- alignment ----------


def _bytes_of_letters():
    """The byte-level vocabulary's letters: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Plain:
    """The published encoders, one text at a time."""

    def __init__(self):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
        self.letters = _bytes_of_letters()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in side) == raw for side in (a, b)) else ([], [])


def _ranges(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def _aligned(rows):
    plain, per, count = _Plain(), [], Counter()
    for doc_id, text in rows:
        a, b = map(_ranges, plain.tokens(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        spans = list(zip([0, *cuts], cuts))
        groups = [([i for i, s, e in a if s >= lo and e <= hi], [i for i, s, e in b if s >= lo and e <= hi]) for lo, hi in spans]
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        per.append((doc_id, a, b, groups, links))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for doc_id, a, b, groups, links in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == highest[k[0]]),
            sum(n * count[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


def _texts(rng):
    marks = ["<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", " ", "漢字", "😀", "é", "\x00", " ", "can't", "１２", "--", "\n\n", "  ", "é", "ß"]
    return [row(300 + i, " ".join(rng.choice(marks) if rng.random() < 0.3 else word(rng) for _ in range(30))) for i in range(40)] + [
        row(400, " leading"), row(401, "trailing "), row(402, "x" * 300 + "漢" * 50), row(403, " "), row(404, "<|endoftext|><s>"), row(None, "▁"),
    ]


@pytest.mark.parametrize("batch,chunk,small", [(align.BATCH, align.CHUNK, align.SMALL_GROUP), (2000, 5000, 1)])
def test_alignment(spark, monkeypatch, batch, chunk, small):
    docs = messy(spark).where("length(text) < 6000 or text is null").unionByName(spark.createDataFrame(_texts(random.Random(2)), DOCS))
    monkeypatch.setattr(align, "SMALL_GROUP", small)
    found = align.documents(docs, align.Settings(batch=batch, chunk=chunk)).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(repr(tuple(r[c] for c in names)) for r in found) == sorted(map(repr, _aligned(docs.select("doc_id", "text").collect())))


def test_products_in_blocks(monkeypatch):
    """Large groups in small blocks count like small ones."""
    sides = align.Sides(align.Settings())
    rng = random.Random(1)
    encoded = [sides.encode("ab" * 40 + prose(rng, 20)), sides.encode(""), sides.encode("zzzz " * 30)]
    x = align.aligned(encoded, sides)
    want = align.pair_links(x)
    monkeypatch.setattr(align, "SMALL_GROUP", 0)
    monkeypatch.setattr(align, "BLOCK", 3)
    assert all((a == b).all() for a, b in zip(want, align.pair_links(x), strict=True))


def test_long_text_in_parts(spark):
    """A text beyond the size of a part has the tokens of the whole."""
    text = prose(random.Random(3), 25_000) + "  two blanks \n " + "y" * 70_000 + " end"
    a, b = align.Sides(align.Settings()).encode(text)
    plain = _Plain().tokens(text)
    assert [a, b] == [[i for i, _ in side] for side in plain]


def test_overlaps(spark):
    rows = [row(1, "tokenization of unbelievable"), row(2, None), row(3, "▁"), row(4, "x")]
    plain = _Plain()
    for r in align.overlaps(spark.createDataFrame(rows, DOCS)).collect():
        a, b = map(_ranges, plain.tokens(dict((x[0], x[1]) for x in rows)[r["doc_id"]]))
        assert (r["a_ids"], r["b_ids"]) == ([i for i, _, _ in a], [i for i, _, _ in b])
        want = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e]
        assert [tuple(x) for x in r["overlaps"]] == want
        assert [tuple(x) for x in r["ends"]] == [(i, j) for i, j in want if a[i][2] == b[j][2]]


@pytest.mark.parametrize("fn", [exact_dedup.groups, exact_dedup.keep_first, spelling.variants, align.documents, align.overlaps])
def test_empty_table(spark, fn):
    assert fn(empty(spark)).collect() == []
