"""The ten operators against brute force, and their defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import ann, bpe, chat, decontaminate, quality, sharding, simhash, substrings, toxicity, url_filter
from strandweave.llm.components import components

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("row", T.StringType()), ("out", T.IntegerType()), ("score", T.DoubleType()))])


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, empty, null, blank, long and one-word texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 80)) for _ in range(25)]
    passage = words(rng, 30, 10_000)
    out = [*base, *base[:5], *[f"{a}\n{passage} {b}" for a, b in zip(base[5:10], base[10:15], strict=True)], *[t.replace("w1 ", "q1 ") for t in base[:8]]]
    return [*out, "", None, "  \t\n ", "solo", "Solo", words(rng, 5000), "e\u0301 \u00e9 \U0001f600 " * 20, passage * 3]


# --- 1 ---


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and (best.text, best.action)


def test_url_filter(spark):
    from strandweave.llm.queries import HOST_RULES

    rng = random.Random(2)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'A.', 'www.'])}{rng.choice(['x', 'example', 'notexample'])}.{rng.choice(['com', 'NET', 'org', 'comx'])}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?x=/de/', '/de/8#a', '/de/9', '/es/', '/EN/', '?a=/en/', '#/en/'])}" for _ in range(300)]
    urls += [None, "", "://", "http://", "com/en/", "a://b://com/en/", "http://a\nb.com/en/1", "http://com\n/en/1", "http://com\n.net/de/\n", "http://com/en/", "http://example.com:80/en/7", "x://com/en/\n"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for block in (50_000, 2):
        got = {r["row"]["page_id"]: r for r in url_filter.filter_urls(df, "url", HOST_RULES, block_rules=block).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            host, path, best = brute_rule(u, HOST_RULES)
            assert (got[i]["host"], got[i]["path"]) == (host, path)
            assert (got[i]["rule"], got[i]["verdict"]) == (best or (None, "allow")), u


def test_url_patterns_and_index(spark):
    rules = [url_filter.Rule("block", "", "/ads/*.js"), url_filter.Rule("allow", "", "/ads/good.js"), url_filter.Rule("block", "", ".tracker^")]
    df = spark.createDataFrame([("http://a.com/ads/x.js",), ("http://a.com/ads/good.js",), ("http://a.tracker/",), ("http://a.trackers/",)], "url string")
    assert [r["verdict"] for r in url_filter.filter_urls(df, "url", rules).collect()] == ["block", "allow", "block", "allow"]
    index, rest = url_filter.index_rules(rules, {"ads": 5, "good": 1, "js": 9})
    assert index["good"] == [1] and not url_filter.filter_urls(df.filter("false"), "url", rules).count()


# --- 2 ---


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    p = list(range(len(items)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash(spark):
    texts = corpus()
    got = sorted(simhash.near_duplicates(docs(spark, texts)).withColumn("fp", simhash.hex16(F.col("fp"))).collect())
    fps = [brute_fingerprint(t) for t in texts]
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [(r["doc_id"], r["fp"], r["component_id"]) for r in got] == [(i, f"{f:016x}", root[i]) for i, f in enumerate(fps)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    nulls = simhash.near_duplicates(docs(spark, ["a b c", "a b c", "z"], [None, 4, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in nulls if r["component_id"] is not None) == [(False, 4), (True, 4)]


@pytest.mark.parametrize("rows, data, others", [(300, 40_000, 80_000), (2, 40_000, 80_000), (2, 30, 60)])
def test_vantage_points(spark, monkeypatch, rows, data, others):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(3)])
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    monkeypatch.setattr(simhash, "BLOCK_DATA", data)
    monkeypatch.setattr(simhash, "BLOCK_OTHERS", others)
    links = simhash.link(spark.createDataFrame([(int(x),) for x in fps], "fp long"), len(fps)).collect()
    at = {int(f): i for i, f in enumerate(fps)}
    pairs = {(at[r["a"]], at[r["b"]]) for r in links} | {(at[r["b"]], at[r["a"]]) for r in links}
    want = brute_components([int(x) & (2**64 - 1) for x in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    assert brute_components(list(range(len(fps))), lambda i, j: (i, j) in pairs) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(80)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = sorted({x for e in edges for x in e})
    pair = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    want = brute_components(names, lambda a, b: (a, b) in pair)
    assert [got.get(n, n) for n in names] == [names[w] for w in want]


# --- 3 ---


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\n\nAnd which flour?"),
        (1, 1, "assistant", "On Monday X wrote:\n> And which   flour?\nRye."),
        (1, 2, "user", "> > How do I bake bread?\n> Rye.\nThanks!"),
        (1, 3, "assistant", "> never said\nNo quote links."),
        (2, 0, "user", "Rye."), (2, 1, "user", None), (None, 0, "user", "x"), (2, None, "user", ""),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 8
    a = [got[1, t] for t in range(4)]
    assert [(r["content"], r["parent_turn"], r["link"], r["position"]) for r in a] == [
        ("How do I bake bread?\n\nAnd which flour?", None, "root", 0), ("Rye.", 0, "quote", 1), ("Thanks!", 1, "quote", 2), ("No quote links.", 2, "turn", 3),
    ]
    assert a[2]["deepest"] == 2 and a[2]["n_passages"] == 2 and a[2]["n_linked"] == 2
    assert got[2, 1]["content"] == "" and got[2, 1]["parent_turn"] == 0 and got[None, 0]["position"] is None


def test_quotation_positions(spark):
    rows = [(rng % 3, t, "user", f"m{t}") for rng in range(3) for t in range(2500)] + [(0, 7, "user", "again"), (0, 7, "user", "again")]
    got = defaultdict(list)
    for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["conv_id"]].append((r["position"], r["turn"], r["parent_turn"]))
    for c, x in got.items():
        x.sort()
        assert [p for p, _, _ in x] == list(range(len(x))) and [t for _, t, _ in x] == sorted(t for _, t, _ in x)
        assert all(b is None and t == 0 or b == t - 1 for _, t, b in x)
    assert len(got[0]) == 2502


# --- 4 and 7 ---


def test_quality_network_learns_and_scores(spark):
    rng = random.Random(5)
    good = [words(rng, 40, 400).capitalize() + "." for _ in range(60)]
    bad = [" | ".join(words(rng, 1, 400) for _ in range(40)) for _ in range(60)]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(1, None)], "doc_id long, quality int")
    w = quality.fit(df, labels)
    got = {r["row"]["doc_id"]: r["out"]["score"] for r in quality.score_rows(df, "text", w).collect()}
    assert np.mean([(got[i] >= 0.5) == (i < 60) for i in range(1, 120, 2)]) > 0.95
    for t in (None, "", "a" * 300_000, "\U0001f600"):
        assert 0 <= quality.score(w, t) <= 1
    assert quality.score(None, "x") == 0.5 and quality.fit(df, labels.filter("quality = 1")) is None
    long = "ab cd " * 60_000  # pieces and one pass agree
    whole, blocks = quality.padded(quality.as_bytes(long))
    assert np.allclose(quality.pooled_blocks(w, quality.as_bytes(long)), quality.block_pool(w, whole, blocks))


def test_network_gradients():
    w = quality.start_weights(np.random.default_rng(0))
    data = np.random.default_rng(1).integers(32, 120, 400).astype(np.uint8)
    g = {k: np.zeros_like(x) for k, x in w.items()}
    quality.gradients(w, data, 1, g)
    text = bytes(data).decode()
    for k, i in (("w2", (3,)), ("w1", (2, 5)), ("bias", (4,))):
        old, e = w[k][i], 1e-3
        w[k][i] = old + e
        up = -np.log(quality.score(w, text))
        w[k][i] = old - e
        down = -np.log(quality.score(w, text))
        w[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-2 * max(1, abs(g[k][i]))


def toxic_corpus():
    rng = random.Random(6)
    syllables = ["an", "the", "er", "in", "on", "st", "re", "nd", "ha", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(300):
        ws = [word() for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            for x in rng.sample(["moron", "worthless", "pathetic"], 2):
                ws.insert(rng.randrange(30), x)
        out.append((" ".join(ws), int(toxic)))
    return out


def test_toxicity_machine(spark):
    rows = toxic_corpus()
    df = docs(spark, [t for t, _ in rows])
    w = toxicity.fit(df, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i < 200], "doc_id long, toxic int"))
    got = {r["row"]["doc_id"]: r["out"]["score"] for r in toxicity.score_rows(df, "text", w).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][1]) for i in range(200, 300)]) > 0.95
    value = lambda t: toxicity.top_values(w, t)[0]
    assert value("the mor-on") > value("the stander") and value("m o r o n") == value("moron")
    for t in (None, "", " ", "x" * 400_000, "\U0001f600 a"):
        assert 0 <= toxicity.score(w, t) <= 1
    assert toxicity.score(None, "moron") == 0 and toxicity.train(["a"], [1]) is None


def test_kernel_folds_into_weights():
    """A unit's value is the inner product of its subsequence counts with the weights, found by plain loops."""
    table = toxicity.symbol_table(["abcdefgh"])
    weights = np.random.default_rng(0).normal(size=toxicity.SYMBOLS**3)
    for word in ("abc", "a", "hgfedcba"):
        s = toxicity.symbols(word, table)
        n, total = len(s), 0.0
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, n):
                    if k - i < toxicity.SPAN and all(x != 0 for x in s[i + 1 : k]):
                        total += toxicity.GAP ** (k - i - 2) * weights[(s[i] * toxicity.SYMBOLS + s[j]) * toxicity.SYMBOLS + s[k]]
        got = toxicity.unit_values(s, weights)[0]
        assert np.isclose(got, total / toxicity.norm_of(n)) and np.isclose(got, toxicity.word_values([word], table, weights)[0])


# --- 5 ---


def brute_contamination(texts, items):
    split = lambda t: ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c >= "\x80" or c.isalnum() else " " for c in t or "")).replace("\x85", "x").split(" ")
    clean = lambda t: [w for w in split(t) if w]
    wins = defaultdict(set)
    for i, t in items:
        w = clean(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                wins[tuple(w[k : k + 10])].add(str(i))
    out = []
    for t in texts:
        w, hit, ids = clean(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if got := wins.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    ids |= got
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [16_000_000, 60])
def test_decontamination(spark, block):
    rng = random.Random(8)
    items = [(1, "alpha BETA, gamma!"), (2, None), (3, ""), (4, "one"), (5, words(rng, 14, 6)), (6, words(rng, 30, 6)), (10, "one"), (None, "ghost words"), (5, "alpha beta"), (7, "na\u00efve caf\u00e9")]
    texts = [*corpus()[:20], "x Alpha-beta gamma alpha beta gamma", "one ones one", None, "", "ghost words", "na\u00efve caf\u00e9s", *[f"{words(rng, 5, 6)} {items[5][1]} {words(rng, 5, 6)}" for _ in range(5)], words(rng, 3000, 6)]
    found = decontaminate.find_contamination(docs(spark, texts), "text", spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = found.select("row.doc_id", "out.n_words", decontaminate.hit_words(F.col("out.spans")).alias("h"), F.size("out.items").alias("n"), F.sha2(F.concat_ws(",", "out.items"), 256).alias("s")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_contamination(texts, items)
    assert found.filter("false").count() == 0


# --- 6 ---


def brute_repeats(texts, ids):
    split = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for t in texts]
    first: dict = {}
    for i, w in zip(ids, split, strict=True):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in zip(ids, split, strict=True):
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rng = random.Random(seed)
    line = words(rng, 20, 9)
    texts = [*corpus(seed), *[f"{words(rng, 6)} {line} {words(rng, 6)}" for _ in range(6)], *[words(rng, 60, 2) for _ in range(6)], "a " * 100, "a " * 50, "b " * 40 + "x" * 3000, "b " * 30 + "x" * 3000]
    ids = rng.sample(range(1000), len(texts))
    ids[3], ids[4] = None, ids[5]  # a null id and a repeated one
    done = substrings.remove_repeats(docs(spark, texts, ids))
    got = sorted(((r["row"]["doc_id"] is None, r["row"]["doc_id"] or 0, r["row"]["text"] or "", r["out"]["n_words"], r["out"]["n_words"] - r["out"]["n_kept"], r["out"]["kept"]) for r in done.collect()))
    want = sorted((i is None, i or 0, t or "", *b) for i, t, b in zip(ids, texts, brute_repeats(texts, ids), strict=True))
    assert got == want
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


# --- 8 ---


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.parse_ranks(bpe.read_ranks(path))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [*corpus(), "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "".join(rng.choice("ab!?é日 \n") for _ in range(3000)), "日本語" * 400, "0" * 999]
    encoded = bpe.encode(docs(spark, texts), "text", path, public_tokenizers.PATTERN).select("row.doc_id", "row.text", "out.ids")
    got = {r["row"]["doc_id"]: (np.frombuffer(r["row"]["ids"], "<u4").tolist(), bytes(r["out"]["decoded"])) for r in bpe.decode(encoded, "ids", path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (own.encode_ordinary(t or ""), (t or "").encode())


def test_bpe_joins_are_associative():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(10)
    for _ in range(200):
        s = "".join(rng.choice(rng.choice(["ab", "the onr", "éß"])) for _ in range(rng.randint(2, 120))).encode()
        whole = bpe.Encoder(ranks).merge(s)
        e = bpe.Encoder(ranks)
        a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
        x, y, z = (e.merge(p) for p in (s[:a], s[a:b], s[b:]))
        assert e.half(s) == whole == e.join(e.join(x, y), z) == e.join(x, e.join(y, z))


# --- 9 ---


def test_sharding(spark):
    rng = random.Random(11)
    texts = [*corpus(), *["copy of one text"] * 400, *[words(rng, rng.randint(1, 60)) for _ in range(600)], "x" * 4000]
    ids = [*range(len(texts) - 1), None]
    got = sharding.shard_rows(docs(spark, texts, ids), pieces=3).collect()
    assert len(got) == len(texts)
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True)}
    assert all((r["size"], r["text_crc32"]) == size[r["doc_id"]] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["size"]))
    mean = sum(s for s, _ in size.values()) / 16
    assert set(by) <= set(range(16)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(b for _, b in by[k]) - mean) <= 2 * max(s for s, _ in size.values()) for k in range(16))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["text_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in order]
    assert keys == sorted(keys)


def test_sharding_of_hot_and_few_rows(spark):
    same = sharding.shard_rows(docs(spark, ["y" * 99] * 3200, [7] * 3200)).groupBy("shard").count().collect()
    assert len(same) == 16 and max(r["count"] for r in same) - min(r["count"] for r in same) <= 2
    assert sharding.shard_rows(docs(spark, [])).count() == 0
    assert sharding.shard_rows(docs(spark, ["a", None])).count() == 2
    full = sharding.shard_rows(docs(spark, ["a", "b"]), carry=["text"])
    assert {r["carried"]["text"] for r in full.collect()} == {"a", "b"}
    plan = full._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 10 ---


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    x[:600] = x[0] + 0.01 * rng.normal(size=(600, 24))  # a dense group
    x[5] = x[6]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [1.0] * 23 + [None]), (5060, [1.0] * 23 + [float("nan")]), (5080, [1.0] * 3), (5100, []), (None, rows[1][1])]
    df = spark.createDataFrame([*rows, *bad, rows[20]], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 2000, 20))
    hit = 0
    for q, found in got.items():
        exact = x.astype(float) @ x[q].astype(float)
        exact[q] = -np.inf
        best = sorted(range(2000), key=lambda i: (-exact[i], i))[:20]
        hit += len({v for v, _ in found} & set(best))
        assert len(found) == 20 and all(np.isclose(s, exact[v], rtol=0, atol=1e-9) for v, s in found)
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in zip(found, found[1:], strict=False))
    assert hit / (20 * len(got)) >= 0.9


def test_ann_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_score_aware_codes_keep_products_better():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2000, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, eta = ann.fit_codebooks(x)
    loss = lambda e: (lambda r: (eta - 1) * ((r * ann.parts_of(x)).sum((1, 2)) ** 2).sum() + (r**2).sum())(ann.parts_of(x) - np.stack([centres[j][c] for j, c in enumerate(ann.assign(ann.parts_of(x), centres, e).T)], 1))
    assert eta > 1 and loss(eta) < loss(1.0)
    packed = ann.encode(x, centres, eta)
    codes = ann.assign(ann.parts_of(x), centres, eta)
    approx = np.concatenate([centres[j][codes[:, j]] for j in range(len(centres))], 1)
    assert np.allclose(ann.scan(x[:5], packed, centres), x[:5] @ approx.T, atol=1e-5)
