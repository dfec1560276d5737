"""rANS token files, vector codes and fill-in-the-middle against brute force, round trips and damaged input."""

import hashlib
import os
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import fill_middle, rans, vector_codes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")

# ---- rANS


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(1, 4), st.integers(1, 600), st.sampled_from([1, 2, 50, 50257]))
def test_code_round_trip(seed, blocks, rows, alphabet):
    rng = np.random.default_rng(seed)
    ids = np.minimum((rng.pareto(0.7, (blocks, rows, 256)) * 3).astype(np.int64) % alphabet, alphabet - 1).astype(np.uint32)
    table = rans.Table.from_bytes(rans.Table.of(np.bincount(ids.reshape(-1), minlength=alphabet)).to_bytes())
    coded = rans.encode(ids, table)
    for b in range(blocks):
        for k, (states, words) in enumerate(coded[b]):
            want = ids[b, k * rans.SEGMENT_ROWS:(k + 1) * rans.SEGMENT_ROWS]
            assert (rans.decode(states[None], [words], len(want), table) == want.reshape(1, -1)).all()
    whole = [s for b in coded for s in b if len(b) == 1]
    if whole:  # segments of equal length side by side
        assert (rans.decode(np.stack([s for s, _ in whole]), [w for _, w in whole], rows, table).reshape(ids.shape) == ids).all()


def test_code_is_near_the_entropy():
    ids = np.random.default_rng(3).geometric(0.01, (2, 1024, 256)).astype(np.uint32)
    counts = np.bincount(ids.reshape(-1))
    coded = rans.encode(ids, rans.Table.of(counts))
    bits = 8 * sum(4 * len(w) + s.nbytes for b in coded for s, w in b) / ids.size
    p = counts[counts > 0] / ids.size
    assert bits < -(p * np.log2(p)).sum() * 1.05


def test_quantised_frequencies():
    counts = np.array([0, 1, 10**15, 0, 3], object)
    freq = rans.quantise(counts)
    assert freq.sum() == 1 << rans.BITS and (freq > 0).tolist() == [False, True, True, False, True]
    assert rans.quantise(np.zeros(4, np.int64)).tolist() == [0] * 4


TEXTS = [None, "", "one two", "x" * 40000, "word " * 90000, "tie", "é中文🙂", "a<|endoftext|>b"]


def docs(spark):
    rows = [(5 - i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, ""), (None, None, 3, ""), (5, "again", 4, ""), (4, "tie", 5, ""), (4, "tie", 6, "")]
    rows += [(7, "hot", i, "") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")


@pytest.mark.parametrize("end_id", [2, None])
def test_rans_files_round_trip(spark, end_id):
    path = tempfile.mkdtemp(prefix="ll-test-") + "/ids"
    rans.write_token_ids(docs(spark).repartition(5), PATH, path, end_id=end_id, max_file_ids=200)
    back = rans.read_token_ids(spark, path).collect()
    lib = Tokenizer.from_file(PATH)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, tuple(lib.encode(r.text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])))
                   for r in docs(spark).collect()))
    got = [(r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back]
    assert sorted(got) == want and all(r.n_tokens == len(r.ids) // 4 for r in back)
    spans = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in back)
    assert [s[2:] for s in spans if s[1]] == sorted(s[2:] for s in spans if s[1])  # ascending ids, nulls first
    at = 0
    for start, n, *_ in spans:
        assert start == at
        at += n
    assert sum(f.endswith(".rans") for f in os.listdir(path)) > 3


def test_reading_tasks_share_a_file(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="ll-test-") + "/ids"
    rans.write_token_ids(docs(spark), PATH, path, end_id=2)
    reader = rans.RansReader({"path": path})
    monkeypatch.setattr(rans, "IDS_A_PARTITION", 1000)
    parts = reader.partitions()
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 50 and sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.start, r.n_tokens, bytes(r.ids))) for r in rans.read_token_ids(spark, path).collect())


def test_damaged_files_are_found(spark):
    path = tempfile.mkdtemp(prefix="ll-test-") + "/ids"
    rans.write_token_ids(docs(spark), PATH, path, end_id=2)
    name = max((f for f in os.listdir(path) if f.endswith(".rans")), key=lambda f: os.path.getsize(f"{path}/{f}"))
    data = bytearray(open(f"{path}/{name}", "rb").read())
    data[5000] ^= 1
    open(f"{path}/{name}", "wb").write(data)
    with pytest.raises(Exception, match="damaged|ends before"):
        rans.read_token_ids(spark, path).collect()


def test_rans_empty_table(spark):
    path = tempfile.mkdtemp(prefix="ll-test-") + "/ids"
    rans.write_token_ids(docs(spark).where("false"), PATH, path, end_id=2)
    assert rans.read_token_ids(spark, path).collect() == []


def test_op11_against_the_library(spark):
    from ledgerloom.llm.queries import QUERIES
    from tables_at import SMALL

    lib, at, want = Tokenizer.from_file(PATH), 0, []
    for d, text in sorted(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op11_rans_ids"](spark, SMALL).collect())) == want


# ---- vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 16), st.integers(1, 5), st.sampled_from([1, 3, 40, 3000]), st.integers(0, 9), st.sampled_from([1, 3, 1000]))
def test_nearest_through_cells_equals_brute_force(seed, entries, width, spread, shift, size):
    rng = np.random.default_rng(seed)
    books, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-2 * spread, 2 * spread + 1, (200, width))
    memo = vector_codes.CellMemo(books, shift, size)
    away = ((x[:, None] - books[None]) ** 2).sum(2)
    for _ in range(2):  # new cells, then remembered ones
        code, error = memo.nearest(x)
        assert (code == away.argmin(1)).all() and (error == away.min(1)).all()
    assert len(memo.young) <= size and len(memo.old) <= size


def test_equal_hashes_of_different_cells(monkeypatch):
    books, x = np.random.default_rng(0).integers(-50, 50, (16, 4)), np.random.default_rng(1).integers(-90, 90, (500, 4))
    memo = vector_codes.CellMemo(books, 3)
    memo.mix = np.zeros(4, np.uint64)  # every cell has the same hash
    for _ in range(2):
        assert (memo.nearest(x)[0] == ((x[:, None] - books[None]) ** 2).sum(2).argmin(1)).all()


def test_cells_save_distances():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 500, (5000, 4))).astype(np.int64)
    memo = vector_codes.CellMemo(x[:16])
    memo.nearest(x)
    assert memo.measured < 0.5 * 16 * len(x)


def brute_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label); gives {(id, label): [(code, error)]} and the codebooks."""
    kept = [(i, np.floor(np.array(v, float) * scale).astype(np.int64), g) for i, v, g in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = [[x[j, p].tolist() for j in range(min(entries, len(kept)))] for p in range(parts)]
    for k in range(rounds + 1):
        away = [[[sum((int(a) - b) ** 2 for a, b in zip(x[n, p], e)) for e in books[p]] for p in range(parts)] for n in range(len(kept))]
        code = [[min(range(len(d)), key=lambda j: (d[j], j)) for d in row] for row in away]
        if k < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [x[n, p] for n in range(len(kept)) if code[n][p] == j]
                    if mine:
                        books[p][j] = [int(sum(int(m[c]) for m in mine)) // len(mine) for c in range(x.shape[2])]
    return sorted((repr(kept[n][0]), repr(kept[n][2]), code[n], sum(min(d) for d in away[n])) for n in range(len(kept))), books


@pytest.mark.parametrize("n, parts, entries", [(300, 4, 16), (5, 2, 16), (60, 1, 3)])
def test_codes_against_brute_force(spark, n, parts, entries):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(0, 0.2, 8).round(1).tolist(), int(i) % 3 or None) for i in range(n)]
    rows += [(None, [0.1] * 8, 1), (3, [0.5] * 8, 1), (4, rows[4][1], None), (9, None, 1), (10, [float("nan")] + [0.0] * 7, 1),
             (11, [float("inf")] + [0.0] * 7, 1), (12, [None] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, codes string")
    coded, books = vector_codes.encode_vectors(df.repartition(3), parts=parts, entries=entries, rounds=3, scale=64)
    want, want_books = brute_codes(rows, parts, entries, 3, 64)
    got = vector_codes.label_errors(coded).collect()
    assert sorted((repr(r.id), repr(r.label), list(r.codes), r.error) for r in got) == want
    assert books.entries.tolist() == want_books
    assert all(r.label_error == sum(o.error for o in got if o.label == r.label) for r in got)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.encode_vectors(spark.createDataFrame([(1, None, 1)], kind))
    assert vector_codes.label_errors(coded).collect() == [] and books.sha256 == hashlib.sha256(b"").hexdigest()
    mixed = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [], 1)], kind)
    coded, _ = vector_codes.encode_vectors(mixed)
    assert [(r.id, r.error) for r in coded.collect()] == [(1, 0)]
    empty, _ = vector_codes.encode_vectors(spark.createDataFrame([(1, [], 1)], kind))
    assert [(r.id, list(r.codes), r.error) for r in empty.collect()] == [(1, [0] * 8, 0)]
    for bad in ([0.5] * 9, [1e30] * 8):
        with pytest.raises(ValueError):
            vector_codes.encode_vectors(spark.createDataFrame([(1, bad, 1)], kind))


# ---- fill in the middle


@settings(max_examples=80, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 400), st.integers(0, 2**18)), max_size=300), st.sampled_from([(0, 0), (5, 9000), (100_000, 200_000)]), st.booleans())
def test_boundary_set_select(offsets, run, every_third):
    stretch = set(range(*run, 3 if every_third else 1))
    want = sorted(offsets | stretch)
    made = fill_middle.BoundarySet(np.array(want, np.int64))
    assert len(made) == len(want)
    for k in {0, 1, len(want) // 3, len(want) // 2, len(want) - 2, len(want) - 1} & set(range(len(want))):
        assert made.select(k) == want[k]
        assert made.cuts(len(want) - 1, k) == (want[k], want[-1])
    with pytest.raises(IndexError):
        made.select(len(want))


def test_all_three_containers():
    kinds = lambda offsets: [c[0] for c in fill_middle.BoundarySet(np.array(offsets, np.int64)).containers]
    assert kinds([1, 5, 90]) == ["array"] and kinds(range(3000)) == ["run"] and kinds(range(0, 60000, 3)) == ["bitmap"]
    assert kinds([*range(0, 60000, 3), *range(70000, 80000), 200_000]) == ["bitmap", "run", "array"]


UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def brute_fim(doc_id, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


FIM_TEXTS = [None, "", "a", "é", "<P", "ends with <", "<S", "has <M> inside", "two words", "ſKé\nline", "中文" * 40000, "ab, " * 30000, "🙂x" * 50, "x" * 100_000, "<<<>>>SPM" * 9]


def test_fill_in_middle_against_brute_force(spark):
    rows = [(i * 31 + j, t, "clash", j) for i, t in enumerate(FIM_TEXTS) for j in range(12)] + [(None, "no id", "", 0), (1, "tie", "", 0), (1, "tie", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    made = fill_middle.fill_in_middle(df)
    got = made.select("*", fill_middle.restore("output", "form").alias("restored")).collect()
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(repr((i, *brute_fim(i, t or ""))) for i, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.restored)) for r in got) == sorted(repr((i, t or "")) for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.where("false")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>PSMab é")), max_size=14), st.integers(0, 40))
def test_cut_places(text, doc_id):
    places = fill_middle.boundaries(text)
    units = UNIT.findall(text)
    ends = [0, *np.cumsum([len(u) for u in units]).tolist()]
    assert [places.select(k) for k in range(len(places))] == ends


def test_markers_that_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "d"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(df, markers=markers)


def test_other_markers_and_shares(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"))
    made = fill_middle.fill_in_middle(df, middle_percent=50, spm_percent=100, seed="other", markers=("[pre]", "[suf]", "[mid]"))
    forms = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 140 < forms["plain"] < 260
    assert made.where(fill_middle.restore("output", "form", ("[pre]", "[suf]", "[mid]")) != "some text here").count() == 0
