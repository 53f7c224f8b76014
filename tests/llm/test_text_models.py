"""BPE against the library, segmentation sums against enumeration, shingles, near classes, repeats and the pipeline."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chalkline.llm import bpe, jaccard, langid
from chalkline.llm.bpe import Codec, decode_ids, encode_texts
from chalkline.llm.entries import tokenizer_path
from chalkline.llm.jaccard import bands_and_rows, near_classes
from chalkline.llm.repeats import remove_repeats
from chalkline.llm.scratch import Scratch
from chalkline.llm.shingles import Words, arrow_bytes, shingle_set
from chalkline.llm import repeats, suffixsort

WORD_BPE = tokenizer_path("word_bpe_49k.json")
needs_tokenizers = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer files")


@needs_tokenizers
@pytest.mark.parametrize("leaf,window", [(4096, 32), (8, 2), (3, 1), (16, 4)])
def test_tree_equals_library(leaf, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    own = Codec(WORD_BPE, leaf, window)
    assert own.words
    r = random.Random(leaf)
    bits = ["a", "b", "the", "ing", "'s", "'", "é", "ñ", "1", "²", " ", "\n", "#", "<|endoftext|>", "<|", "İ", "中文", "́", "Σ", "😀", " ", "</w>", "\x1c"]
    texts = ["".join(r.choices(bits, k=r.randrange(50))) for _ in range(300)]
    texts += ["".join(r.choices("aab" if i % 3 else "abcdefghinorst", k=r.randrange(50, 400))) for i in range(100)] + ["", "a" * 20_000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
    lists = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.decoded(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]


@needs_tokenizers
def test_codec_on_frames(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Thinking of it", 0), (3, "Thinking of it", 0)], "doc_id long, text string, own int")
    encoded = encode_texts(df, "text", WORD_BPE, ["doc_id"])
    got = sorted((r["doc_id"], r["decoded"]) for r in decode_ids(encoded, "ids", WORD_BPE, ["doc_id"]).collect())
    assert got == [(1, ""), (2, ""), (3, "thinking</w> of</w> it</w>"), (3, "thinking</w> of</w> it</w>")]
    assert encode_texts(df.limit(0), "text", WORD_BPE, ["doc_id"]).collect() == []


@needs_tokenizers
def test_long_stretches_go_through_several_tasks(spark, monkeypatch):
    """Letters without a break, over many pieces, alone and beside other text; and a text that is long without being one stretch."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    r = random.Random(11)
    letters = lambda n: "".join(r.choices("etaoinshrdlu", k=n))
    texts = ["x", None, letters(9000), "Some words, " + letters(5000) + "! and " + letters(3100) + "<|endoftext|>" + "a" * 4000, "Ab" * 2500, letters(1500) + " İ" + "é" * 3000, "many words here " * 800]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    dealt = []
    monkeypatch.setattr(bpe, "_dealt", lambda *a, whole=bpe._dealt: (dealt.append(a[0].count()), whole(*a))[1])
    encoded = encode_texts(df, "text", WORD_BPE, ["doc_id", "ids"], 64, 8, 1000)
    assert dealt == [4]
    assert encoded.columns == ["doc_id", "ids_in", "ids"]
    found = {x["doc_id"]: list(x["ids"]) for x in encoded.collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert found == want
    told = encode_texts(df, "text", WORD_BPE, ["doc_id"], 64, 8, 1000, decode=True).collect()
    assert {x["doc_id"]: x["decoded"] for x in told} == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}


def test_forward_sums_all_segmentations():
    pieces, r = ["▁a", "b", "ab", "▁ab", "▁", "a", "bab"], np.random.default_rng(2)
    probs = r.random((len(pieces), 2))
    forward = langid.Forward(pieces, probs)

    def total(word):
        ways = sum(probs[i] * total(word[len(p) :]) for i, p in enumerate(pieces) if word.startswith(p)) if word else np.ones(2)
        return ways if not word else ways + langid.UNKNOWN * total(word[1:])

    words = ["▁a", "▁abab", "▁babz", "▁" + "ab" * 6]
    assert np.allclose(forward.words(words), np.log([total(w) for w in words]))
    long = "▁" + "abba" * 12
    assert np.allclose(forward._long(long), forward._short(langid._codes([long], len(long)))[0])


def test_langid_scores_a_long_run_to_its_end():
    """A language far behind at first, which the rest of the run makes the better one."""
    probs = np.array([[1e-1, 1e-7], [1e-7, 1e-1], [1e-1, 1e-1]])
    forward = langid.Forward(["a", "b", "▁"], probs)
    for first, second in ((80, 90), (90, 80), (400, 401), (3000, 3001)):
        word = "▁" + "a" * first + "b" * second
        likely = np.log(probs + langid.UNKNOWN)
        expected = likely[2] + first * likely[0] + second * likely[1]
        assert np.allclose(forward.words([word])[0], expected, rtol=1e-9, atol=0)
        assert forward.words([word])[0].argmax() == int(second > first)


@needs_tokenizers
def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), "text", "lang", "doc_id", vocabulary)
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "12 ... 3", "x")], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(extra)
    found = langid.identify(rows, "text", model, vocabulary, ["doc_id", "lang"]).collect()
    told = [r for r in found if r["lang"] != "x"]
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["lang"] == "x"} == {"und"}
    none = langid.identify(rows, "text", ([], np.empty((0, 0))), vocabulary, ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_shingles():
    r = random.Random(2)
    texts = [None, "", " ", "a", "a b", "a b c d e", "a b c d e f", "a  b\tc\nd e f", "é ü a b c d e f g"]
    texts += [" ".join(r.choices("abc", k=r.randrange(30))) for _ in range(100)]
    words = Words(*arrow_bytes(pa.array(texts)))
    hashes, firsts = words.shingles()
    by = {}
    for i, t in enumerate(texts):
        own = (t or "").split()
        grams = [tuple(own[j : j + 5]) for j in range(len(own) - 4)] or ([tuple(own)] if own else [])
        got = hashes[firsts[i] : firsts[i + 1]]
        assert len(got) == len(grams) and set(got) == set(shingle_set(t))
        assert all(by.setdefault(g, h) == h for g, h in zip(grams, got))
    assert len(set(by.values())) == len(by)


def test_bands_meet_the_recall():
    bands, rows = bands_and_rows()
    assert (1 - 0.8**rows) ** bands <= 1e-6 and bands * rows <= 300


def plain_classes(rows):
    """(smallest id of the component, links) of each row, all pairs compared."""
    words = [tuple((t or "").split()) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or ({w} if w else set()) for w in words]
    n = len(rows)
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    linked = [[j for j in range(n) if j != i and like(sets[i], sets[j])] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        new = [min([comp[i], *(comp[j] for j in linked[i])]) for i in range(n)]
        changed, comp = new != comp, new
    members = defaultdict(list)
    for i, c in enumerate(comp):
        members[c].append(rows[i][0])
    return sorted((rows[i][0], min(members[comp[i]]), len(linked[i])) for i in range(n))


@pytest.mark.parametrize("rounds,block", [(3, 512), (0, 16)])
def test_near_classes(spark, monkeypatch, rounds, block):
    """Six groups of copies that drift apart; without further leaders all that the first ones leave open is settled by blocks."""
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "OPEN_BLOCK", block)
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, bases = [(0, None), (1, ""), (2, "a b"), (3, "a  b"), (4, "x")], [[r.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    for i in range(5, 160):
        words = list(bases[i % 6])
        for _ in range(r.choice([0, 1, 1, 2, 3, 6, 12])):
            words[r.randrange(len(words))] = "new" + str(r.randrange(10_000))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_classes(df, "text", "doc_id").collect()
    assert sorted((x["doc_id"], x["class_id"], x["n_links"]) for x in found) == plain_classes(rows)
    firsts = Counter(x["class_id"] for x in found if x["is_first"])
    assert set(firsts.values()) == {1} and set(firsts) == {x["class_id"] for x in found}


def test_columns_with_added_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6), (2, "a b", 7, 8)], "doc_id long, text string, class_id int, N_Links int")
    found = near_classes(df, "text", "doc_id", ["doc_id", "class_id", "N_Links"])
    assert found.columns == ["doc_id", "class_id_in", "N_Links_in", "class_id", "is_first", "n_links"]
    assert sorted(map(tuple, found.collect())) == [(1, 5, 6, 1, True, 1), (2, 7, 8, 1, False, 1)]


def test_near_classes_edges(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "one two"), (5, "one two")], "doc_id long, text string")
    found = near_classes(df, "text", "doc_id").collect()
    assert [(x["class_id"], x["n_links"]) for x in found] == [(5, 3)] * 4 and sum(x["is_first"] for x in found) == 1
    assert near_classes(df.limit(0), "text", "doc_id").collect() == []


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = {i + k for i in range(len(x) - length + 1) if counts[x[i : i + length]] > 1 for k in range(length)}
        out.append((len(x), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(x))), bytes(b for i, b in enumerate(x) if i not in gone)))
    return out


@pytest.mark.parametrize("most", [256, 2])
def test_repeats(spark, monkeypatch, most):
    """Shared passages of many lengths, copies, runs of one byte; with few segments a key every hot one is split."""
    monkeypatch.setattr(repeats, "MOST_SEGMENTS", most)
    r = random.Random(3)
    noise = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = [noise(n) for n in (199, 200, 201, 350, 900)]
    texts = [noise(r.randrange(400)) + r.choice(shared) + noise(r.randrange(400)) for _ in range(60)]
    texts += [None, "", "x" * 199, "y" * 200, "z" * 201, "é" * 150, texts[0], texts[0], "ab" * 300, shared[3] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x for x in remove_repeats(df, "text", ["doc_id"]).collect()}
    for i, (size, gone, spans, kept) in enumerate(plain_repeats(texts, 200)):
        x = found[i]
        assert (x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) == (size, gone, spans, kept)


@pytest.mark.parametrize("length", [20, 200])
def test_what_stands_once_is_not_sorted(length):
    """Of pieces around equal anchors, every window that repeats is left for the sorter, and those that share little besides the anchor are not."""
    r, gram = random.Random(9), length // 5
    reach = length - gram
    noise = lambda n: bytes(r.choices(b"abcdefgh ", k=n))
    pieces = []
    for _ in range(60):
        anchor, around = noise(gram), (noise(reach), noise(reach))
        for _ in range(r.randint(1, 4)):
            left, right = r.choice([0, reach // 4, reach]), r.choice([0, reach // 4, reach])
            whole = noise(reach - left) + around[0][reach - left :] + anchor + around[1][:right] + noise(reach - right)
            low = r.randint(-reach, 0)
            high = r.randint(low, 0)
            pieces.append((low, high - low + 1, whole[low + reach : high + reach + length]))
    offsets, spans, raw = zip(*pieces, strict=True)
    found = repeats.may_repeat(np.array(offsets), np.array(spans), list(raw), length)
    kept = {(i, low + k) for i, low, span in zip(*(x.tolist() for x in found), strict=True) for k in range(span)}
    counts = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    windows = [(i, k) for i, x in enumerate(raw) for k in range(len(x) - length + 1)]
    again = {(i, k) for i, k in windows if counts[raw[i][k : k + length]] > 1}
    assert again and again <= kept <= set(windows) and len(kept) == sum(found[2]) < len(again) + len(windows) // 4


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"]).collect() == []


@pytest.mark.parametrize("budget,bits", [(1 << 20, 18), (64, 3)])
def test_suffix_order_and_prefixes(budget, bits):
    """Order and carried prefixes are exact in memory and, with next to no memory and pages of eight slots, through files."""
    r = random.Random(5)
    for _ in range(60):
        text = np.array([r.randint(2, r.choice([3, 5, 100])) for _ in range(r.randint(2, 60))] + [0], np.uint16)
        store = suffixsort.Store(budget)
        order = suffixsort.suffix_order(text, suffixsort.SIGMA, store, bits).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        small, told = suffixsort.smaller_than_next(text, store), []
        stars = suffixsort.sorted_stars(text, small, suffixsort.SIGMA, store, bits, 12)
        suffixsort.induced(text, small, stars, suffixsort.SIGMA, store, 12, lambda _, own, shared: told.extend(zip(own.tolist(), shared.tolist())), bits)
        store.close()
        assert [x for x, _ in told] == order[::-1]
        for (a, _), (b, shared) in zip(told, told[1:]):
            assert shared == next(k for k in range(13) if k == 12 or text[a + k] != text[b + k])


@pytest.mark.parametrize("sigma", [8, 258, 1 << 15, 1 << 20])
def test_substrings_that_end_with_a_word(sigma):
    """Few symbols under a large alphabet, so that words hold few of them and substrings often end with one."""
    r = random.Random(6)
    for _ in range(400):
        body = [r.randint(1, r.choice([2, 3, 6])) for _ in range(r.randint(20, 120))]
        text = np.array([*body, 0], np.int64)
        store = suffixsort.Store()
        assert suffixsort.suffix_order(text, sigma, store).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_queue_goes_to_disk_and_recursion_goes_deep(monkeypatch):
    """A shard far over its budget spills its tuples; a string whose substrings repeat recurses level by level."""
    r, spilled, levels = random.Random(8), [], []
    spill, order = suffixsort.SlotQueue._spill, suffixsort.suffix_order
    monkeypatch.setattr(suffixsort.SlotQueue, "_spill", lambda self: (spilled.append(self.held), spill(self)))
    monkeypatch.setattr(suffixsort, "suffix_order", lambda text, *rest: (levels.append(len(text)), order(text, *rest))[1])
    noise = bytes(r.choices(b"ab", k=300))
    stretches = [noise * 20, noise[7:] * 3, bytes(r.choices(b"abc", k=4000))]
    found = suffixsort.repeated_starts(stretches, 200, budget=2000, bits=6)
    counts = Counter(x[i : i + 200] for x in stretches for i in range(len(x) - 199))
    assert found.tolist() == [i + 200 <= len(x) and counts[x[i : i + 200]] > 1 for x in stretches for i in range(len(x))]
    assert len(spilled) > 10 and len(levels) >= 3 and levels == sorted(levels, reverse=True)


@needs_tokenizers
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(-1, None, "en", None, None), (-2, "", None, "src0", 0), (-3, "Héé " * 3, "fr", "src1", 12), (None, "some words here", None, "src2", 15)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before, written = None, Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        out = written.keep(stage(spark, docs, sf), name)
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        rows = out.count()
        if name == "language":
            assert {r[0] for r in out.select("doc_id").collect()}.isdisjoint({-1, -2})
        if name == "near_duplicates":
            assert rows < before
            assert near_classes(out, "text", "doc_id").where("n_links > 0").isEmpty()
        if name == "repeated_strings":
            assert rows == before
        if name == "bpe":
            assert rows == before and out.where("n_tokens <> size(ids)").isEmpty()
        before, docs = rows, out


def test_more_labels_than_a_worker_scores(spark):
    """Three hundred labels are learned, each by a word of its own, and blocks of them say what all at once say."""
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    words = [f"{a}{b}{c}" * 3 for a in "bdfgklmnpr" for b in "aeiou" for c in "stvwxz"]
    rows = [(i, f"{w} {w} {w}", f"l{i % 300:03d}", "in") for i, w in enumerate(words)] + [(900, None, None, "in"), (901, "12 ?", "l001", "in"), (902, words[7] * 30, None, "in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    model = langid.fit(docs, "text", "lang", "doc_id", vocabulary)
    assert len(model.langs) == 300
    whole = {r["doc_id"]: r for r in langid.identify(docs, "text", model, vocabulary, ["doc_id", "Score"], at_once=300).collect()}
    apart = langid.identify(docs, "text", model, vocabulary, ["doc_id", "Score"], at_once=64)
    assert apart.columns == ["doc_id", "Score_in", "lang_pred", "score"]
    found = {r["doc_id"]: r for r in apart.collect()}
    assert len(found) == len(rows) and all(found[i]["lang_pred"] == r["lang_pred"] and abs(found[i]["score"] - r["score"]) < 1e-9 for i, r in whole.items())
    assert [found[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and found[900]["score"] == 0
    assert sum(found[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300]) >= 290
