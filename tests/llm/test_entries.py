"""Every registered query of the training-data operators over whole tables: contract columns, and rows against SQL or a plain version."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from chalkline.llm import entries
from chalkline.llm.quotes import parse, units
from tests.llm.test_text_models import plain_classes, plain_repeats

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "conversations")

CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_jaccard": "doc_id bigint, class_id bigint, n_links bigint",
    "op6_suffix": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_chat": "conv_id bigint, turn bigint, role string, text string, parent_turn bigint",
    "op8_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]


def found(spark, name):
    return entries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    kinds = dict(found(spark, name).dtypes)
    assert {k: kinds.get(k) for k, _ in (x.split() for x in CONTRACT[name].split(", "))} == dict(x.split() for x in CONTRACT[name].split(", "))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = found(spark, name)
    columns = sorted(frame.columns)
    result = con.execute(entries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    told = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    assert told == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)


def test_sharding(spark, docs):
    rows = found(spark, "op1_sharding").collect()
    raw = {i: (t or "").encode() for i, t, *_ in docs}
    assert {(r["doc_id"], r["size"]) for r in rows} == {(i, len(b) + 1) for i, b in raw.items()} and len(rows) == len(docs)
    assert all(r["text_crc32"] == (zlib.crc32(raw[r["doc_id"]]) if next(t for i, t, *_ in docs if i == r["doc_id"]) is not None else None) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) == set(range(8)) and all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= max(len(b) for b in raw.values()) + 0.03 * sum(sizes) / 8


def test_mixing(spark, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    source = {i: s for i, _, s, _ in docs}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    order = sorted((s for s in whole if s is not None)) + [s for s in whole if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, free, target = sum(size.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * whole[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * whole[s] for s in over}
        left, free = left - sum(3 * whole[s] for s in over), free - over
    taken = Counter()
    rows = found(spark, "op3_mixing").collect()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], whole[s]) and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + max(size.values()) / 2 for s in target)


def test_near_classes(spark, docs):
    rows = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found(spark, "op5_jaccard").collect())
    assert rows == plain_classes([(i, t) for i, t, *_ in docs])


def test_repeats(spark, docs):
    """Each window's place of every whole text, in one table."""
    told = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found(spark, "op6_suffix").collect()}
    plain = plain_repeats([t for _, t, *_ in docs], 200)
    assert told == {i: (size, gone, spans, hashlib.sha256(kept).hexdigest()) for (i, *_), (size, gone, spans, kept) in zip(docs, plain, strict=True)}


def plain_replies(messages):
    """parent turn of each (turn, text) of one conversation, turns being single."""
    out, said = {}, {}
    for turn, text in sorted(messages):
        own, quotes = parse(text or "")
        best = max(((-level, n, said[h]) for level, x in quotes for h, n in units(x).items() if h in said), default=None)
        out[turn] = best[2] if best else turn - 1 if any(t == turn - 1 for t, _ in messages) else None
        for h in units(own):
            said[h] = turn
    return out


def test_replies(spark):
    talk = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()
    by = defaultdict(dict)
    for c, t, x in talk:
        by[c][t] = x
    rows = found(spark, "op7_chat").collect()
    single = {c for c, n in Counter(c for c, *_ in talk).items() if n == len(by[c])}
    assert len(rows) == len(talk) and single
    for c in single:
        assert {r["turn"]: r["parent_turn"] for r in rows if r["conv_id"] == c} == plain_replies(list(by[c].items()))


def test_encoding(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found(spark, "op9_bpe").collect()} == want


def test_token_counts(spark, docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=entries.tokenizer_path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in docs}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found(spark, "op13_tokens").collect()} == want


def test_languages(spark, docs):
    rows = {r["doc_id"]: r for r in found(spark, "op10_langid").collect()}
    assert len(rows) == len(docs)
    held = [(i, t, lang) for i, t, _, lang in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r["held_out"]} == {i for i, *_ in held}
    known = [(i, lang) for i, t, lang in held if lang and t and re.search(r"[^\W\d_]", t)]
    assert sum(rows[i]["lang_pred"] == lang for i, lang in known) >= 0.95 * len(known)
    learned = {lang for *_, lang in docs if lang}
    assert all(r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1 for r in rows.values())


def test_pipeline(spark, docs):
    """Whole documents in, and each stage's decision by a plain version of it over what the one before kept."""
    rows = found(spark, "pipeline").collect()
    assert {"doc_id", "text", "source", "ids", "n_tokens", "decoded"} <= set(rows[0].asDict())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_strings", "mixing", "bpe"]
    lettered = [(i, t) for i, t, *_ in docs if t and re.search(r"[^\W\d_]", t)]
    first = {i for i, c, _ in plain_classes(lettered) if i == c}
    texts = [(i, t) for i, t in lettered if i in first]
    kept = {i: k for (i, _), (*_, k) in zip(texts, plain_repeats([t for _, t in texts], 200), strict=True)}
    assert {r["doc_id"] for r in rows} <= first
    for r in rows:
        assert r["text"].encode() == kept[r["doc_id"]] or "�" in kept[r["doc_id"]].decode(errors="replace")
        assert r["n_tokens"] == len(r["ids"])
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_very_long_texts(spark):
    """One text of 3 MB beside short ones, through the operators that cut texts, and a stretch of a million letters."""
    from chalkline.llm import bpe, langid, quality, repeats
    from chalkline.llm.jaccard import near_classes

    long = " ".join(f"word{i * 7919 % 50021}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, "a" * 1_000_000)], "doc_id long, text string")
    near = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_classes(df, "text", "doc_id").collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    # The words go round, so the space after the last one ends a string that stands earlier too.
    gone = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in repeats.remove_repeats(df, "text", ["doc_id"]).collect()}
    assert gone == {1: (len(long), len(long)), 2: (len(long) + 4, len(long) + 1), 3: (5, 0), 4: (1_000_000, 1_000_000)}
    signals = {r["doc_id"]: r["n_words"] for r in quality.with_signals(df, "text").select("doc_id", "n_words").collect()}
    assert signals == {1: 300_000, 2: 300_001, 3: 1, 4: 1}
    sizes = {r["doc_id"]: len(r["ids"]) for r in bpe.encode_texts(df, "text", entries.tokenizer_path("word_bpe_49k.json"), ["doc_id"]).collect()}
    assert sizes[1] + 1 == sizes[2] and sizes[4] < 1_000_000 and os.path.exists(entries.tokenizer_path("piece_bpe_32k.model"))
    empty = langid.fit(df.selectExpr("doc_id", "text", "cast(null as string) AS lang").limit(0), "text", "lang", "doc_id", entries.tokenizer_path("piece_bpe_32k.model"))
    assert empty[0] == []


def test_two_pipelines_in_a_session(spark, tmp_path):
    """Two runs that are both read at the end, over a text with a stretch that several tasks encode."""
    rows = [(i, f"The house of number {i} stands by the river and the old mill. " * 3 if i else "a" * 200_000, "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    first, second = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    told = [sorted((r["doc_id"], r["n_tokens"]) for r in x.collect()) for x in (first, second)]
    assert told[0] == told[1] and told[0]
