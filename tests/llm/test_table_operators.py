"""Operators on whole tables against brute force: n-gram join, URL filter, top-k, sharding, WARC; pipeline."""

import collections
import gzip
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from ledgerloom.llm import components, decontaminate, knn, language_id, ngram_join, packing, sharding, url_filter, warc
from pyspark.sql import functions as F

# ---- n-gram Jaccard join


def brute_components(docs, width, percent):
    sets, parent = [], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        names[root(i)].append(d)
    best = {r: min((d for d in ds if d is not None), default=None) for r, ds in names.items()}
    return sorted(((d, len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        docs += [base] * 3 + [mutated(rng, base, rng.randrange(0, 5)) for _ in range(9)]
        chain = base
        for _ in range(6):  # neighbours are similar, ends are not
            chain = mutated(rng, chain, 1)
            docs.append(chain)
    docs += [passage + [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))] for _ in range(90)]
    hot = [rng.choice(vocabulary) for _ in range(80)]
    docs += [mutated(rng, hot, rng.randrange(1, 4)) for _ in range(130)]
    texts = [" ".join(d) for d in docs] + ["", None, " \n\t", "one", "ONE", "one two", "one  two", "é É", "long " * 30_000]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    return [*zip(ids, texts), (3, texts[3]), (None, texts[5]), (None, "only without an id here")]


@pytest.mark.parametrize("width, percent, short, block", [(3, 90, 64, 1000), (5, 80, 4, 10)])
def test_jaccard_components(spark, monkeypatch, width, percent, short, block):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, n string, rid int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, width, percent).collect()), key=str)
    assert got == brute_components(docs, width, percent)


def test_jaccard_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", 0)
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(frame).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert ngram_join.jaccard_components(frame.limit(0)).count() == 0


def test_keep_one(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, rid int")
    kept = ngram_join.keep_one(frame, 5, 80)
    assert kept.columns == frame.columns
    want = {d for d, _, c in brute_components(docs, 5, 80) if d is not None and d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_keep_one_judges_rows_not_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    docs = [(1, text("a")), (1, text("b")), (2, text("a")), (2, text("c")), (3, text("b") + " more"), (1, text("b")), (4, text("d")), (4, text("d") + " more"), (5, None), (None, text("a"))]
    kept = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    four = [r for r in got if r[0] == 4]
    assert len(four) == 1 and four[0] in docs  # linked with each other
    assert [r for r in got if r[0] != 4] == sorted([(1, text("a")), (1, text("b")), (2, text("c")), (5, None), (None, text("a"))], key=str)


def test_keep_one_with_repeated_ids_against_brute_force(spark):
    rows = [(None if d is None else d % 97, t) for d, t in corpus()]
    parts = brute_components([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)  # every row under its own number
    want = collections.Counter()
    groups = collections.defaultdict(list)
    for i, n, c in parts:
        groups[c].append((rows[i][0], n))
    for members in groups.values():
        named = [d for d, n in members if d is not None]
        want.update([None] * (len(members) - len(named)) + [min(named, default=None)] * bool(named))
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80)
    assert collections.Counter(r.doc_id for r in got.collect()) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500), (60, 30)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(40)}


# ---- URL filter


def test_url_rules_and_parts(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    cases = [("http://WWW.Example.NET/en/1?x=/de/", "www.example.net", "/en/1", "example.net/en/", "allow"),
             ("https://a.net#/en/", "a.net", "", None, None), ("x://example.net/EN/", "example.net", "/EN/", "net/", "block"),
             ("http://badexample.com/de/x", "badexample.com", "/de/x", None, None), ("http://a.example.com/de/x#y", "a.example.com", "/de/x", "example.com/de/", "block"),
             ("http://b.org/fr/a://b/c", "b.org", "/fr/a://b/c", "org/fr/", "allow"), (None, "", "", None, None), ("no scheme/x", "", "", None, None),
             ("", "", "", None, None), ("http://É.Org?q", "É.org", "", None, None), ("a\nb://c.net/\nd", "c.net", "/\nd", "net/", "block")]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] + [(0, cases[0][0], "clash")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad int")
    rows = url_filter.judge_urls(pages, none, rules).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_filter.judge_urls(pages.limit(0), none, rules).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    counts = {"bad.example.com": (200, 195), "good.example.com": (200, 3), "few.example.com": (1, 1), "a.co.uk": (50, 1), "b.co.uk": (50, 2)}
    outcomes = [(f"http://{h}/", int(i < b)) for h, (n, b) in counts.items() for i in range(n)] + [("http://a.co.uk/", None)]
    frame = spark.createDataFrame(outcomes, "url string, bad int")
    hosts = [*counts, "new.example.com", "new.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r for r in url_filter.judge_urls(pages, frame).collect()}
    assert got["bad.example.com"].verdict == "block" and got["bad.example.com"].bad_rate > 0.9
    assert all(got[h].verdict == "allow" for h in hosts if h != "bad.example.com")  # one bad page proves nothing
    by_host, by_domain, by_suffix, world = url_filter.host_reputation(frame.select(url_filter.url_host(F.col("url")).alias("host"), "bad"))
    mean = {r.domain: r.alpha / (r.alpha + r.beta) for r in by_domain.collect()}
    raw = {h: b / n for h, (n, b) in counts.items()}
    for r in by_host.collect():  # every host lies between its own rate and its domain's
        m = mean["example.com" if r.host.endswith("example.com") else r.host]
        assert min(raw[r.host], m) - 1e-9 <= r.alpha / (r.alpha + r.beta) <= max(raw[r.host], m) + 1e-9
    assert got["new.example.com"].bad_rate == pytest.approx(mean["example.com"])
    w = world.first()
    assert got["new.org"].bad_rate == pytest.approx(w.alpha / (w.alpha + w.beta))
    assert {r.suffix for r in by_suffix.collect()} == {"com", "co.uk"}


def test_sites_domains_and_suffixes(spark):
    rules = ("co.uk", "*.ck", "!www.ck", "github.io", "a.b.c.d")
    cases = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com:8080": ("example.com", "com"), "me:pw@x.example.com": ("example.com", "com"),
             "a.example.com..": ("example.com", "com"), "a.example.com.:80": ("example.com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"),
             "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "[::1]:80": ("[::1]", "[::1]"), "x.y.foo.ck": ("y.foo.ck", "foo.ck"), "foo.ck": ("foo.ck", "foo.ck"),
             "ck": ("ck", "ck"), "a.www.ck": ("www.ck", "ck"), "www.ck": ("www.ck", "ck"), "u.github.io": ("u.github.io", "github.io"), "": ("", ""),
             "localhost": ("localhost", "localhost"), "...": ("", ""), "z.y.a.b.c.d": ("y.a.b.c.d", "a.b.c.d"), "b.c.d": ("c.d", "d")}
    got = spark.createDataFrame([(h,) for h in cases], "h string").select("h", url_filter.domain_of(F.col("h"), rules).alias("d"), url_filter.suffix_of(F.col("h"), rules).alias("s"))
    assert {r.h: (r.d, r.s) for r in got.collect()} == cases


def brute_reputation(outcomes, low=1.0, high=1000.0):
    """Posteriors of hosts {host: (domain, suffix, n, b)}, level by level, in plain Python."""
    n, b = sum(o[2] for o in outcomes.values()), sum(o[3] for o in outcomes.values())
    world = (b + 1, n - b + 1)

    def level(nodes):  # {key: (parent's posterior, n, b)}
        rows = [(a / (a + c), n, b) for (a, c), n, b in nodes.values()]
        spread = sum((n - 1) * m * (1 - m) for m, n, _ in rows)
        rho = sum(n * (b / n - m) ** 2 - m * (1 - m) for m, n, b in rows) / spread if spread > 0 else 0
        k = min(max(1 / rho - 1, low), high) if rho > 0 else high
        return {key: (k * m + b, k * (1 - m) + n - b) for key, (m, n, b) in zip(nodes, rows)}

    def summed(of):
        out = {}
        for host, (domain, suffix, n, b) in outcomes.items():
            key = of(host, domain, suffix)
            out[key] = (out.get(key, (0, 0))[0] + n, out.get(key, (0, 0))[1] + b)
        return out

    suffixes = level({s: (world, *c) for s, c in summed(lambda h, d, s: s).items()})
    above = {d: s for d, s, _, _ in outcomes.values()}
    domains = level({d: (suffixes[above[d]], *c) for d, c in summed(lambda h, d, s: d).items()})
    return level({h: (domains[d], n, b) for h, (d, _, n, b) in outcomes.items()})


def test_reputation_against_brute_force(spark):
    rng = np.random.default_rng(5)
    outcomes = {}
    for i in range(60):
        domain, suffix = (f"d{i % 13}.co.uk", "co.uk") if i % 3 else (f"d{i % 7}.com", "com")
        n = int(rng.integers(1, 40))
        outcomes[f"h{i}.{domain}"] = (domain, suffix, n, int(rng.binomial(n, 0.95 if i % 13 == 4 else 0.2)))
    rows = [(f"x://{h}/p", int(j < b)) for h, (_, _, n, b) in outcomes.items() for j in range(n)]
    pages = spark.createDataFrame([(f"x://{h}/", "mine", "old") for h in outcomes] * 2, "url string, _host string, Verdict string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rows, "url string, bad int"))
    assert got.columns == ["url", "_host", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    want, verdicts = brute_reputation(outcomes), set()
    rows = got.collect()
    assert len(rows) == 2 * len(outcomes) and {r._host for r in rows} == {"mine"}
    for r in rows:
        a, b = want[r.host]
        bound = a / (a + b) - 1.64 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert r.bad_rate == pytest.approx(a / (a + b), abs=1e-9) and r.bad_bound == pytest.approx(bound, abs=1e-9)
        assert r.verdict == ("block" if bound > 0.5 else "allow")
        verdicts.add(r.verdict)
    assert verdicts == {"allow", "block"}


# ---- top-k


@pytest.mark.parametrize("cell, block", [(256, 8192), (4, 16)])
def test_top_k(spark, monkeypatch, cell, block):
    monkeypatch.setattr(knn, "QUERIES_A_CELL", cell)
    monkeypatch.setattr(knn, "ROWS_A_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6) + (i % 3) * 30]) for i in range(400)]
    rows += [(400 + i, [1.0] * 6) for i in range(150)]  # a hot vector: ties to the smaller id
    rows += [(10, rows[10][1]), (600, []), (601, [2.0])]
    bad = [(700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")]), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, vector array<double>, cell int").repartition(4)
    got = collections.defaultdict(list)
    for r in knn.top_k(frame, frame.where("vec_id % 10 = 0"), k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    vec = [(i, np.array(v + [0.0] * (6 - len(v)))) for i, v in rows]
    for q, v in vec:
        if q % 10 == 0:
            want = sorted((-float(v @ w), i) for i, w in vec if i != q)[:5]
            want = [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
            assert sorted(set(got[q])) == want
    assert set(got) == {q for q, _ in vec if q % 10 == 0}


def test_top_k_small_tables(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<double>")
    assert [tuple(r) for r in knn.top_k(one, one.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert knn.top_k(one.limit(0), one).count() == 0 and knn.top_k(one, one.limit(0)).count() == 0


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", "x", True), (2, text, "b", "y", None), (3, "other words entirely here", "c", "z", False), (3, "other words entirely here", "c", "z", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _RID string, _tk string, _again boolean")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


# ---- sharding


@pytest.mark.parametrize("ranges", [2048, 40])
def test_sharding(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.randrange(1, 2000)) for i in range(3000)]
    rows += [(10_000 + i, "hot", 700) for i in range(1500)] + [(20_000 + i, f"pair{i // 3}", 300) for i in range(90)]
    rows += [(1, "t1", 5)] * 3 + [(None, None, None), (None, None, -4), (7, "", 0)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, size long, shard string").repartition(6)
    got = sharding.shard_by_size(frame, "size", "text", 8).collect()
    assert sorted((r.doc_id, r.text, r["size"]) for r in got if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None) and len(got) == len(rows)
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        load[r.shard] += max(r["size"] or 0, 0)
        slots[r.shard].append(r.slot)
        homes[r.text].add(r.shard)
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
    assert all(len(h) == 1 for t, h in homes.items() if t != "hot")
    assert sharding.shard_by_size(frame.limit(0), "size", "text", 8).count() == 0


def test_whole_groups_stay_where_they_fit(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 256)
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 200)
    rows = [(i, f"t{i}", 100) for i in range(6000)] + [(10_000 + i, f"g{i // 300}", 100) for i in range(1200)]  # four groups of 0.33 of a shard
    rows += [(20_000 + i, "light", 0) for i in range(5000)]  # many rows, no bytes: ranked in many windows, dealt together
    frame = spark.createDataFrame(rows, "_rid long, _key string, _size long").repartition(5)
    got = sharding.shard_by_size(frame, "_size", "_key", 8)
    assert got.columns == ["_rid", "_key", "_size", "shard", "slot"]
    got = got.collect()
    assert sorted((r._rid, r._key, r._size) for r in got) == sorted(rows)
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        load[r.shard] += r._size
        slots[r.shard].append(r.slot)
        homes[r._key].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and max(load.values()) <= 1.05 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ranges_of_a_group_are_one_unit():
    import pandas as pd

    low = 1 << sharding.ROW_BITS
    keys = np.sort(np.concatenate([np.arange(50) * low, np.full(400, 60 * low) + np.arange(400) * 1000, (70 + np.arange(50)) * low]))
    cuts = sharding._quantiles(keys, 20)
    assert {60 * low, 61 * low} <= set(cuts.tolist()) and sum(60 * low < c < 61 * low for c in cuts) > 10
    totals = pd.DataFrame([(r, 1.0, 1) for r in range(len(cuts) + 1)], columns=["_range", "size", "n"])
    units = sharding._units(totals, cuts)
    assert sorted(x[0] for u in units for x in u) == list(range(len(cuts) + 1)) and sum(len(u) > 1 for u in units) == 1
    assert max(len(u) for u in units) == sum(60 * low <= c < 61 * low for c in cuts)


# ---- WARC


def test_warc_round_trip(spark, tmpdir_path):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [(1, "http://a/", "short"), (2, "http://b/", "short"), (5, " http://c/\r\n", same), (3, None, same), (9, "é", same), (9, "é", same), (4, "", None),
            (6, "u", ""), (None, "n", same), (7, "m", "WARC/1.1\r\n\r\n" * 30), (8, "big", "é" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    for how in ("gzip", "none"):
        path = f"file://{tmpdir_path}/{how}"
        warc.write_archives(warc.page_records(pages), path, how)
        back = warc.read_archives(spark, path)
        got = sorted(((int(r.headers["X-Page-Id"]) if "X-Page-Id" in r.headers else None, r.target_uri, r.record_type, r.refers_to, r.payload_digest,
                       bytes(r.payload) if r.record_type == "response" else None) for r in back.collect()), key=str)
        want = []
        for i, u, h in rows:
            raw = (h or "").encode()
            again = len(raw) >= 100 and h == same and i not in (3, None)
            want.append((i, u, "revisit" if again else "response", "<urn:page:3>" if again else None, "sha256:" + hashlib.sha256(raw).hexdigest(), None if again else raw))
        assert got == sorted(want, key=str)
        only = back.where("record_type = 'revisit' AND refers_to IS NOT NULL AND target_uri LIKE 'é%'")
        assert only.count() == 2
        light = warc.read_archives(spark, path, payload=False).where(F.col("record_type").isin("response"))
        assert light.where("payload IS NOT NULL").count() == 0 and light.count() == sum(w[2] == "response" for w in want)


def test_warc_pushes_header_predicates_and_skips_payloads(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    body = b"x" * 5_000_000
    blob = b"".join(warc.encode_record({"record_type": t, "record_id": str(i), "payload": body}) for i, t in enumerate(["response", "revisit", "response"]))
    (tmp_path / "a.warc").write_bytes(blob)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.encode_record({"record_type": "revisit", "record_id": "9", "payload": b"z"})) for _ in range(2)))
    reader = warc.WarcReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 3), In(("record_id",), ("1", "9"))]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan"]
    taken = []
    keep = warc._Stream.take
    monkeypatch.setattr(warc._Stream, "take", lambda self, n: taken.append(n) or keep(self, n))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["1", "9", "9"] and taken == [len(body), 1, 1]


@pytest.mark.parametrize("piece, step", [(64, 40), (1000, 1 << 15), (1 << 20, 100), (1 << 20, 1 << 15)])
def test_warc_members_are_passed_over_whole(tmp_path, monkeypatch, piece, step):
    """Members with and without a stated length, wanted and not, short and long, in one file, over borders of pieces."""
    monkeypatch.setattr(warc._Stream, "PIECE", piece)
    monkeypatch.setattr(warc._Stream, "STEP", step)
    rng = random.Random(piece)
    rows, parts = [], []
    for i in range(120):
        body = rng.randbytes(rng.choice([0, 1, 50, 3000])) + b"\r\n\r\n" * rng.randrange(3)
        rows.append((rng.choice(["response", "revisit"]), str(i), body))
        record = warc.encode_record({"record_type": rows[-1][0], "record_id": str(i), "payload": body})
        parts.append(warc.zip_record(record) if i % 5 else gzip.compress(record))
        assert gzip.decompress(parts[-1]) == record
    # records over two members and two records in one member, as other writers may leave them
    extra = [warc.encode_record({"record_type": "revisit", "record_id": f"x{i}", "payload": b"abc" * 30}) for i in range(4)]
    parts += [gzip.compress(extra[0][:60]), gzip.compress(extra[0][60:]), gzip.compress(extra[1] + extra[2]), warc.zip_record(extra[3])]
    rows += [("revisit", f"x{i}", b"abc" * 30) for i in range(4)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    for wanted in (lambda r: True, lambda r: r["record_type"] == "revisit", lambda r: r["record_id"] == "7", lambda r: False):
        for payload in (True, False):
            with open(path, "rb") as raw:
                got = [(r["record_type"], r["record_id"], r["payload"]) for r in warc.records(raw, True, wanted, payload)]
            assert got == [(t, i, b if payload else None) for t, i, b in rows if wanted({"record_type": t, "record_id": i})]
    for cut, payload in ((20, True), (40, True), (20, False), (9, False)):  # a file that ends inside a record is an error
        long = warc.zip_record(warc.encode_record({"record_type": "response", "payload": rng.randbytes(5000)}))
        path.write_bytes(parts[1] + long[:-cut])
        with open(path, "rb") as raw, pytest.raises(EOFError):
            list(warc.records(raw, True, lambda r: True, payload))


def test_warc_does_not_inflate_what_it_passes(tmp_path, monkeypatch):
    body = random.Random(1).randbytes(6_000_000)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.zip_record(warc.encode_record({"record_type": "response", "record_id": str(i), "payload": body})) for i in range(3)))
    inflated, real = [], warc.zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.z = real(bits)

        def decompress(self, data):
            inflated.append(len(data))
            return self.z.decompress(data)

        eof = property(lambda self: self.z.eof)
        unused_data = property(lambda self: self.z.unused_data)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    with open(path, "rb") as raw:
        assert len(list(warc.records(raw, True, lambda r: True, False))) == 3
    assert sum(inflated) <= 3 * warc._Stream.STEP


def test_warc_uncommitted_files_are_not_read(spark, tmpdir_path):
    path = f"{tmpdir_path}/w"
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    warc.write_archives(warc.page_records(pages), path)
    with open(f"{path}/lost.warc", "wb") as f:  # what a task of a lost executor leaves
        f.write(warc.encode_record({"record_type": "response", "payload": b"half"})[:40])
    assert warc.read_archives(spark, path).count() == 1
    warc.write_archives(warc.page_records(pages.limit(0)), f"{path}2")
    assert warc.read_archives(spark, f"{path}2").count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmpdir_path):
    rng = random.Random(9)
    words = {"en": "the and of with that this from which are was".split(), "fr": "le la les des une dans pour avec est sur".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(50)) for _ in range(n))
    item = text("en", 30)
    rows = [(i, text("en" if i % 2 else "fr", 60), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " more", "fr"), (102, text("en", 20) + " " + item + " " + text("en", 20), "en"), (103, None, "en"), (104, "", None), (105, "12 !!", "fr"), (3, rows[3][1], "en")]
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    gone = [{103, 104, 105}, {100, 101}, {102}]
    left = {i for i, _, _ in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]
    for (_, stage), away in zip(corpus_pipeline.STAGES, gone):
        docs = stage(spark, docs, tmpdir_path)
        left -= away
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left
    packed = corpus_pipeline.run(spark, tmpdir_path)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(left)


def test_pipeline_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !?", None), (3, None, None), (4, "é", None), (5, "", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {1, 4}
    with pytest.raises(ValueError):
        language_id.keep_identified(docs, None, ["en"])


def test_pipeline_goes_on_with_the_language_found(spark, tmpdir_path):
    rng = random.Random(10)
    words = {"en": "the and of with that this from which are was".split(), "fr": "le la les des une dans pour avec est sur".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) + str(rng.randrange(50)) for _ in range(40))
    truth = {i: "en" if i % 2 else "fr" for i in range(80)}
    label = truth | {i: None for i in range(20)}
    docs = spark.createDataFrame([(i, text(truth[i]), label[i], "s", 0) for i in truth], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    found = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{tmpdir_path}/documents.parquet"), tmpdir_path)
    assert {r.doc_id: r.lang for r in found.collect()} == truth
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # scored once, not again for the filter
    packed = corpus_pipeline.run(spark, tmpdir_path).collect()
    assert {r.doc_id: r.lang for r in packed} == truth
    by = collections.defaultdict(set)
    for r in packed:
        by[r.sequence_id].add(truth[r.doc_id])
    assert all(len(of) == 1 for of in by.values()) and len(by) < len(packed)


def test_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language_id.train(docs)
    lang = {r.doc_id for r in language_id.identify(docs, model).where("lang_pred <> 'und'").collect()}
    one = [(i, t) for i, t in rows if i in lang]
    names = {d: c for d, _, c in brute_components(one, 5, 80)}
    two = [(i, t) for i, t in one if names[i] == i]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = decontaminate.WindowSet(bench, 10).scan([t for _, t in two])[1]
    want = {i for (i, _), spans in zip(two, found) if not spans}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want
    per = collections.Counter(r.doc_id for r in got)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(per[i] == len(packing.cut(len(tok.encode(t, add_special_tokens=False).ids) + 1, 2048)) for i, t in two if i in want)
