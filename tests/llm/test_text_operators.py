"""Operators on single texts against brute force: packing, token counts, chat format, decontamination, language id."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import chat, decontaminate, language_id, packing, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, n_tokens string, rid int"
TEXTS = ["", None, "one", "  two  words\n\n", "<|endoftext|> a<|endoftext|>", "x" * 5000, "word " * 6000, "\x1c\x1d é中文 ٣ z", "tie", "tie", "🙂" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    kind, data = tokens.read_tokenizer(PATH)
    return tokens.Encoder(kind, data, tokens.prove(kind, data))


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (0, texts[0], "en", "clash", 1)]
    return spark.createDataFrame(rows, DOCS)


# ---- tokens

alphabet = st.one_of(st.sampled_from(list(" \n\t\r\x1c\x85\xa0'sdl,.!<|>aé12٣中")), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=alphabet, max_size=60))
def test_encoder_equals_library(encoder, library, text):
    for t in (text, text + "<|endoftext|> " + text):
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == ids
        assert encoder.count(t) == len(ids)


def test_pattern_engines_agree_below_the_bound(encoder, library):
    for c in map(chr, range(0x250)):
        t = f"a{c}{c}b {c}1{c} {c} \n{c}!{c}  {c}'s"
        assert encoder.bpe.encode_ordinary(t) == library.encode(t, add_special_tokens=False).ids


def test_white_space_is_classed_alike_but_for_odd(encoder, library):
    cut = library.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(0x110000)):
        if 0xD800 <= ord(c) < 0xE000 or re.match(r"\s", c):
            continue
        if ord(c) < 0x3100 or ord(c) % 997 == 0:  # white space lies below; the rest is spot-checked
            assert [s for _, s in cut(f"a {c}{c}b")][1][0] in (1, 2) and (1, 2) not in [s for _, s in cut(f"a {c}b")]


def test_whole_tokens_are_proved(library):
    kind, data = tokens.read_tokenizer(PATH)
    facts = tokens.prove(kind, data)
    assert facts["chunked"] and facts["ranks"]
    some = sorted(facts["whole"])[::500]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    got = {(r.doc_id, r.text): r.n_tokens for r in tokens.token_counts(frame(spark), path).collect()}
    if name.endswith("json"):
        lib = Tokenizer.from_file(path)
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(lib.encode(t))
    assert got == {(i, t): count(t or "") for i, t in [*enumerate(TEXTS), (None, "no id")]}
    out = tokens.token_counts(frame(spark).limit(0), path)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "n_tokens", "rid"]


# ---- packing


def check_packing(rows, texts, library, capacity):
    by_doc = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.piece)].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= capacity
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text, copies in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = packing.cut(len(ids), capacity)
        for k, (start, length) in enumerate(pieces):
            found = by_doc.pop((doc_id, k))
            assert len(found) == copies
            assert all(r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids[start:start + length] for r in found)
    assert not by_doc
    return len(places)


def test_pack_round_trip(spark, library):
    rows = packing.pack(frame(spark), PATH, capacity=64).collect()
    texts = [(i, t, 2 if i == 0 else 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1)]
    check_packing(rows, texts, library, 64)
    assert packing.pack(frame(spark).limit(0), PATH).count() == 0


def test_pack_uses_few_sequences(spark, library):
    rng = np.random.default_rng(3)
    texts = [(i, "word " * int(n), 1) for i, n in enumerate(rng.integers(1, 150, 800))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").repartition(7)
    used = check_packing(packing.pack(docs, PATH, capacity=128).collect(), texts, library, 128)
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in texts)
    assert used <= 1.03 * -(-total // 128)


@pytest.mark.parametrize("regroup", [packing.REGROUP, 40])
def test_pack_keeps_kinds_apart(spark, library, monkeypatch, regroup):
    monkeypatch.setattr(packing, "REGROUP", regroup)
    rng = np.random.default_rng(4)
    texts = [(i, "word " * int(n), 1) for i, n in enumerate(rng.integers(1, 150, 600))]
    kind = {i: (None, "a", "b", "b", f"rare {i % 7}")[i % 5] for i, _, _ in texts}
    docs = spark.createDataFrame([(i, t, kind[i]) for i, t, _ in texts], "doc_id long, text string, `the kind` string").repartition(5)
    rows = packing.pack(docs, PATH, capacity=128, open_bins=12, kind_col="the kind").collect()  # fewer open bins than tasks x kinds need
    check_packing(rows, texts, library, 128)
    of = collections.defaultdict(set)
    for r in rows:
        assert r["the kind"] == kind[r.doc_id]
        of[r.sequence_id].add(kind[r.doc_id])
    assert all(len(k) == 1 for k in of.values()) and len(of) < len(rows)
    with pytest.raises(ValueError):
        packing.pack(docs.withColumnRenamed("the kind", "Piece"), PATH, kind_col="Piece")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_places(lengths, open_bins):
    fit, used = packing.BestFit(50, open_bins), {}
    for n in lengths:
        free = {50 - u for b, u in used.items() if b not in fit.closed and u < 50}
        b, offset = fit.place(n)
        assert offset == used.get(b, 0)
        fits = [f for f in free if f >= n]
        assert (50 - offset == min(fits)) if fits else offset == 0
        used[b] = offset + n
        assert used[b] <= 50 and fit.n_open <= open_bins


# ---- chat format

CONFLICT = "<|im_end|><|im_start|>assistant ok"
piece = st.sampled_from(["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "a", "%0A", "%", "<", "\\", "|>", "é", "𝒳", "user", "$1"])
chats = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.just("assistant"), st.lists(piece, max_size=4).map("".join)),
                           st.one_of(st.none(), st.lists(piece, max_size=8).map("".join))), min_size=1, max_size=5)


def test_chat_round_trip(spark):
    examples = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(chats)
    def collect(c):
        examples.append(c)

    collect()
    examples.append([(0, "user", CONFLICT), (1, "assistant", CONFLICT)])
    examples.append([(0, "assistant", "long " * 50_000), (0, "assistant", "same"), (0, "assistant", "same")])
    rows = [(None if i == 0 else i, t, r, x, "clash") for i, c in enumerate(examples) for t, r, x in c]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    read = out.select("conv_id", "formatted", "loss_mask", chat.parse(F.col("formatted")).alias("turns"),
                      chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(read) == len(examples)
    for r in read:
        source = sorted(((t is not None, t or 0, a or "", b or "") for t, a, b in examples[r.conv_id or 0]))
        assert [(t.role, t.text) for t in r.turns] == [s[2:] for s in source]
        assert r.loss == [s[3] for s in source if s[2] == "assistant"]
        assert r.formatted.count(chat.START) == len(source) == r.formatted.count(chat.END)  # no text holds a marker
        assert [chat.START in r.formatted[s.start:s.end] for s in r.loss_mask] == [False] * len(r.loss)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("block, piece", [(1, 1), (3, 2), (256, 7)])
def test_mask_over_blocks_and_pieces(spark, monkeypatch, block, piece):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "PIECE", piece)
    texts = ["", "a", "𝒳é" * 5, "<|im_end|>", "line\nline", "\\", "x" * 40, "𝒳" * 21, "", CONFLICT]
    rows = [(n, t, ("assistant", "user")[(t + n) % 3 == 0], texts[(t * 7 + n) % len(texts)]) for n in range(12) for t in range(n)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("conv_id", "formatted", "loss_mask", chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        want = [x for n, _, role, x in rows if n == r.conv_id and role == "assistant"]
        assert r.loss == want and len(r.loss_mask) == len(want)
        for span, text in zip(r.loss_mask, want):
            assert r.formatted[span.start:span.end].replace("<\\|", "<|") == text and r.formatted[span.end:].startswith(chat.END)
    empty = spark.createDataFrame([("",)], "f string").select(chat.loss_spans(F.col("f")).alias("m")).first()
    assert empty.m == []


# ---- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items, n):
    ws, hit, ids = WORD.findall(lowered(text)), set(), set()
    for i, t in items:
        iw = WORD.findall(lowered(t))
        k = min(n, len(iw))
        for a in range(len(iw) - k + 1 if iw else 0):
            for b in range(len(ws) - k + 1):
                if ws[b:b + k] == iw[a:a + k]:
                    hit |= set(range(b, b + k))
                    ids.add(i)
    return len(ws), hit, sorted(x for x in ids if x is not None)


@pytest.mark.parametrize("block", [8_000_000, 20])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, "The quick-brown FOX jumps"), (2, "é ü"), (3, ""), (4, None), (5, "fox jumps over it"), (5, "short"), (None, "lazy dog"), (6, "quick brown fox jumps")]
    texts = ["the quick brown fox jumps over it", "É ü", "e é ü é ü", None, "", "a lazy dog, short!", "ab " * 3000 + "the QUICK brown.fox jumps", "quick brown fox", "quick brown fox"]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, other string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(docs, bench, n=3).collect():
        spans = {x for a, b in r.hit_spans for x in range(a, b)}
        assert (r.n_words, spans, sorted(r.hit_items)) == brute_hits(texts[r.doc_id], items, 3)
    kept = {r.doc_id for r in decontaminate.remove_contamination(docs, bench, n=3).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items, 3)[1]}
    cut = decontaminate.remove_contamination(docs, bench, remove="spans", n=3)
    assert cut.columns == docs.columns
    for r in cut.collect():
        n, hit, _ = brute_hits(texts[r.doc_id], items, 3)
        assert WORD.findall(lowered(r.text)) == [w for i, w in enumerate(WORD.findall(lowered(texts[r.doc_id]))) if i not in hit]
    assert decontaminate.find_contamination(docs, bench.limit(0), n=3).where(F.size("hit_spans") > 0).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench, n=3).count() == 0


# ---- language id


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.where(~held))
    got = language_id.identify(docs.where(held), model)
    assert got.where("lang = lang_pred").count() >= 0.99 * got.count()
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_id_edges(spark):
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("12", "fr"), ("the end", None)] * 3)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    assert model.languages == ["en", "fr"]
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "123 !?", 1.0), (4, "the dog", 1.0), (4, "the dog", 1.0), (None, "le chien " * 20_000, None)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr")], key=str)
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(labelled.limit(0))).collect()} == {"und"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_kernel_is_the_blended_presence_kernel():
    texts = ["abcab", "bcd", "xyz", "a"]
    model = language_id.fit(texts, ["p", "p", "q", "q"])

    def grams(t):
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    marks = [0, 1, 2, 3]
    want = [[len(grams(a) & grams(texts[m])) / (len(grams(a)) * len(grams(texts[m]))) ** 0.5 for m in marks] for a in texts]
    assert np.allclose(model.kernel(texts), want, atol=1e-5)


def test_no_language_is_lost(spark):
    kind = "doc_id long, text string, lang string"
    few = spark.createDataFrame([(1, "bonjour le monde", "fr")] * 3000 + [(i, f"hello world {i}", "en") for i in range(5)], kind).repartition(7)
    assert language_id.train(few, max_fit=40).languages == ["en", "fr"]
    many = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 2500).alias("lang"))
    assert len(language_id.train(many).languages) == 2500


def test_training_reads_whole_texts(spark):
    # the languages differ only far behind the start
    rows = [(i, "0 " * 6000 + f"{w} {w} {i}", x) for i, (w, x) in enumerate([("ding dong", "a"), ("zzyx qqj", "b")] * 6)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [model.predict(["dong ding " + "0 " * 50])[0], model.predict(["qqj zzyx " + "0 " * 50])[0]] == [["a"], ["b"]]


def test_ridge_on_nystrom_features_against_plain_numpy():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcd" if i % 3 else "cdef"), 40)) for i in range(60)]
    names = ["p" if i % 3 else "q" for i in range(60)]
    model = language_id.fit_sets([language_id.gram_set(t) for t in texts], names, landmarks=10)

    def k(a, b):
        a, b = (set(x[i:i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)) for x in (a, b))
        return len(a & b) / (len(a) * len(b)) ** 0.5

    marks = [t for t, x in zip(texts, names) if x == "p"][:5] + [t for t, x in zip(texts, names) if x == "q"][:5]
    w, full = (np.array([[k(a, m) for m in marks] for a in some]) for some in (marks, texts))
    values, vectors = np.linalg.eigh(w)
    z = full @ vectors @ np.diag(values ** -0.5)
    y = np.where(np.array(names)[:, None] == np.array(["p", "q"]), 1.0, -1.0)
    weight = np.array([1 / names.count(x) for x in names])
    zc, yc = z - np.average(z, axis=0, weights=weight), y - np.average(y, axis=0, weights=weight)
    beta = np.linalg.solve(zc.T @ (zc * weight[:, None]) + language_id.RIDGE * np.eye(10), zc.T @ (yc * weight[:, None]))
    want = zc @ beta + np.average(y, axis=0, weights=weight)
    assert np.allclose(model.kernel(texts) @ model.weights + model.bias, want, atol=2e-2)


def test_keep_identified_leaves_clashing_columns_alone(spark):
    rows = [(i, t, x, 0.25, "mine", "m2") for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _answer string")
    kept = language_id.keep_identified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows
