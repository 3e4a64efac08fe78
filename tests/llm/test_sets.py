"""Mixing, packing, search, personal data, URL rules and the pipeline."""

import itertools
import random
import re
import zlib

import awkward
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callbrook.llm import annforest, mixing, packing, pii, urlfilter


def test_pairs_conserve_words():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        size, p, u = rng.integers(1, 500, n).astype(float), rng.random(n), rng.random(n)
        q, left = mixing._pair(size, p.copy(), u)
        assert abs((size * q).sum() - (size * p).sum()) < 1e-6 and ((q >= 0) & (q <= 1)).all()
        assert ((q > 0) & (q < 1)).sum() <= 1
        q = mixing._root(size, p.copy(), u)
        assert set(q) <= {0.0, 1.0} and abs((size * q).sum() - (size * p).sum()) <= size.max() + 1e-6


def test_expectation_is_kept():
    rng = np.random.default_rng(2)
    size, p = np.array([50.0, 3, 9, 20, 7]), np.array([0.3, 0.5, 0.8, 0.25, 0.6])
    mean = np.mean([mixing._root(size, p.copy(), rng.random(5)) for _ in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


@pytest.mark.parametrize("bucket,fan,change", [(4096, 64, 64), (8, 2, 3)])
def test_targets_are_met_and_reruns_agree(spark, bucket, fan, change, monkeypatch):
    monkeypatch.setattr(mixing, "copies", lambda units, seed, f=mixing.copies: f(units, bucket, fan, change, seed))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    got = sorted(tuple(r) for r in mixing.mix(docs, columns=("doc_id", "source")).collect())
    assert got == sorted(tuple(r) for r in mixing.mix(docs, columns=("doc_id", "source")).collect())
    total = sum(r[2] for r in got)
    sizes = {s: sum(r[2] for r in got if r[1] == s) for s in "s0 s1 s2 s3".split()}
    want, level = {}, dict(zip(sizes, (3, 1, 2, 3)))
    free, rest = set(sizes), 1.5 * total
    while True:
        part = {s: rest * level[s] / sum(level[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        free -= over
    want |= part
    for s in sizes:
        mine = [r for r in got if r[1] == s]
        assert all(abs(r[4] - want[s]) < 1e-6 and r[3] == sizes[s] for r in mine)
        assert abs(sum(r[2] * r[5] for r in mine) - want[s]) <= max(r[2] for r in mine)
        assert all(0 <= r[5] <= 2 for r in mine)


def test_mixing_awkward_rows(spark):
    docs = awkward.frame(spark)
    got = mixing.mix(docs, columns=docs.columns).collect()
    assert len(got) == docs.count() and all(r.copies in (0, 1, 2) for r in got)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(awkward.empty(spark), columns=("doc_id",)).collect() == []
    alone = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), columns=("doc_id",)).collect()
    assert [(r.size, r.target) for r in alone] == [(0, 0.0)]


def test_packing_gives_the_tokens_back(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    r = random.Random(4)
    more = [(100 + k, "".join(r.choice(["a", "É", " ", "  ", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "'ll", "12", "word", "!", "\u0301", "日"]) for _ in range(r.randint(1, 300)))) for k in range(60)]
    docs = awkward.frame(spark, [*more, (99, "a <|endoftext|> b")]).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got: dict = {}
    seen = set()
    for x in packing.pieces(docs).collect():
        assert x.length & (x.length - 1) == 0 and x.length <= 2048 and x.offset == 0 and 1 << x.bucket == x.length
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
        assert x.sequence_id not in seen
        seen.add(x.sequence_id)
        got.setdefault(x.doc_id, []).append(x)
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert set(got) == set(texts)
    for i, parts in got.items():
        parts.sort(key=lambda x: x.start)
        ids = [t for x in parts for t in x.ids]
        assert ids == reference.encode(texts[i] or "", add_special_tokens=False).ids + [1], i
        assert [x.start for x in parts] == [0, *itertools.accumulate(x.length for x in parts)][:-1] and parts[0].doc_tokens == len(ids)
    assert packing.pieces(awkward.empty(spark)).collect() == []


def test_tokens_of_the_given_texts_agree():
    import duckdb
    import public_tokenizers as public
    from tokenizers import Tokenizer
    reference, encode = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.Encoder()
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id % 4 = 0").fetchall():
        assert encode(t) == reference.encode(t, add_special_tokens=False).ids


def vectors(n=3000, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    v = (centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    v[: n // 3] = v[0]  # a hot group of copies
    return [(k, [float(x) for x in row], "x") for k, row in enumerate(v)]


def exact(rows, k=5):
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    norm = np.linalg.norm(m, axis=1)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (m @ m[i]) / (norm * norm[i])
        s[ids == ids[i]] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_forest_recall_and_ties(spark):
    rows = vectors()
    bad = [(9000, None, "x"), (9050, [0.0] * 24, "x"), (9100, [1.0] * 23 + [float("nan")], "x"), (9150, [1.0] * 5, "x"), (None, [1.0] * 24, "x"),
           (9200, [1.0] * 23 + [None], "x"), (9250, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank string")
    got: dict = {}
    for r in annforest.neighbours(df, F.col("vec_id") % 50 == 0, reach=128, cell=256, trees=12).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        hits += len({x[1] for x in found} & {x[0] for x in want[q]})
        if q < 1000:  # copies: the smallest other ids
            assert [x[1] for x in found] == [x for x in range(6) if x != q][:5]
    assert hits >= 0.9 * 5 * len(want)


def test_forest_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    ask = F.col("vec_id") % 50 == 0
    assert annforest.neighbours(spark.createDataFrame([], schema), ask).collect() == []
    assert annforest.neighbours(spark.createDataFrame([(50, [1.0, 2.0])], schema), ask).collect() == []
    two = annforest.neighbours(spark.createDataFrame([(50, [1.0, 2.0]), (51, [2.0, 4.0]), (52, [-1.0, 0.0])], schema), ask).collect()
    assert [(r.rank, r.vec_id) for r in sorted(two, key=lambda r: r.rank)] == [(1, 51), (2, 52)] and abs(two[0].score - 1) < 1e-12


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_against_plain_search():
    r = random.Random(6)
    for alphabet in ("a@.-1 ", "12.3", "+1 (2)-.", "45 -", "@a.b@+é"):
        for _ in range(400):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert pii.base_spans(t) == plain_base(t), t
    assert [s[0] for s in pii.base_spans("x 4111-1111 1111 1111, +1 (555) 123-4567; 10.0.0.255 a.b@c.de")] == ["email", "ip", "card", "phone"]


def test_segment_sums_against_enumeration():
    rng = np.random.default_rng(0)
    k = len(pii.TYPES)
    field = pii.Field({}, np.zeros((1, k)), rng.normal(size=(k, k)))
    n = 4
    s = rng.normal(size=(n, pii.LONGEST, k))
    s[:, 1:, 0] = -np.inf
    total, marginal = 0.0, np.zeros_like(s)

    def walk(i, before, score, used):
        nonlocal total
        if i == n:
            w = np.exp(score)
            total += w
            for u in used:
                marginal[u] += w
            return
        for m in range(1, min(pii.LONGEST, n - i) + 1):
            for y in range(k):
                if np.isfinite(s[i, m - 1, y]):
                    walk(i + m, y, score + field.steps[before, y] + s[i, m - 1, y], [*used, (i, m - 1, y)])
    walk(0, 0, 0.0, [])
    assert abs(field.passes(s)[2] - np.log(total)) < 1e-9
    assert np.abs(field.posterior(s)[0] - marginal / total).max() < 1e-9


def test_learned_spans(spark):
    r = random.Random(8)
    filler = lambda: " ".join(r.choice("hea tion on the of and".split()) for _ in range(8))
    data = [lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", lambda: f"ab.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
            lambda: f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.7", lambda: 'token = "%040x"' % r.getrandbits(160), lambda: str(r.randint(1, 9999))]
    texts = [f"{filler()} {r.choice(data)()} {filler()}" for _ in range(900)]
    docs = awkward.frame(spark, [(100 + k, t) for k, t in enumerate(texts)] + [(1000, "call (743) 555-3824 now"), (1001, "in 2024 we saw 12 of 30")])
    got = {x.doc_id: x for x in pii.scan(docs).collect()}
    assert got[1000].spans == "phone:5:19" and got[1000].n_phone == 0 and got[1001].spans == ""
    for k, t in enumerate(texts):
        x, base = got[100 + k], plain_base(t)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(b[0] == kind for b in base) for kind in pii.KINDS)
        assert {f"{a}:{b}:{c}" for a, b, c in base} <= set(x.spans.split(",")) or not base
    assert got[1].spans == "" and pii.scan(awkward.empty(spark)).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "allow"),
         ("", "/bad", "block"), ("com", "/aaaaaaaaaaaaaaaa/", "block"), ("com", "/", "block")]


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_url_rules_against_brute_force(spark, room):
    r = random.Random(9)
    urls = [None, "", "no scheme.com/", "http://", "x://com", "x://COM/", "http://a.net?x=/es/", "http://www.Example.com/en/1", "http://example.com/en", "http://xexample.com/en/"]
    urls += ["http://" + ".".join(r.choice(["www", "example", "com", "net", "a", "É"]) for _ in range(r.randint(1, 4)))
             + "".join(r.choice(["/", "en", "es", "bad", "?", "#", "aaaaaaaaaaaaaaaa"]) for _ in range(r.randint(0, 6))) for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "keep", "old") for k, u in enumerate(urls)], "page_id long, url string, h string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.filter_urls(pages, rules, trie_bytes=room)
    assert got.columns == ["page_id", "url", "h", "host", "path", "rule", "verdict"]
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got.collect()} == {k: plain_verdict(u) for k, u in enumerate(urls)}
    assert urlfilter.filter_urls(pages.limit(0), rules, trie_bytes=room).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes[1] >= 0.97 * sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {x.doc_id for x in packed} == {x.doc_id for x in docs.select("doc_id").collect()}


def test_pipeline_takes_awkward_and_empty_tables(spark):
    for docs in (awkward.frame(spark), awkward.empty(spark)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_repeated_rows_share_no_overfull_bucket(spark):
    docs = spark.createDataFrame([(1, "same words here", "s")] * 300 + [(k, "other words", "t") for k in range(2, 60)], "doc_id long, text string, source string")
    base = docs.select(F.monotonically_increasing_id().alias("__row"), F.xxhash64("doc_id", "text").alias("__h"), F.lit(0).cast("long").alias("__place"),
                       F.lit(3.0).alias("__size"), F.lit(0.5).alias("__rate"), F.lit(358).cast("long").alias("__n"))
    got = mixing.copies(mixing.written(base, "units"), bucket=16, fan=4, change=2).collect()
    assert len(got) == 358 and abs(sum(r["__copies"] for r in got) - 179) <= 1


def test_quoted_secrets_without_digits_are_looked_at():
    for text in ('x password: "abcdefghijklmn", y', 'password:"abcdefghijklmn"', 'token = "correcthorsebattery"'):
        kind, s, e = pii.labelled(text, 0, len(text))[0]
        (low, high), = pii.regions(text)
        assert kind == "secret" and low <= s and e <= high
        _, hot, spans = pii.Field.candidates(text, low, high)
        assert any(row[0] == (s, e) and hot[i] for i, row in enumerate(spans))
    assert list(pii.regions('he said "no" and left')) == []
    examples = [f'{word}: "{"".join(chr(97 + (7 * k + j * j) % 26) for j in range(14 + k % 5))}" is set' for k in range(60) for word in ("password", "api_key")]
    field = pii.train(examples[:80], epochs=6)
    found = sum(field.spans(t, 0, len(t), 0.5) == pii.labelled(t, 0, len(t)) for t in examples[80:])
    assert found >= 36


def test_long_runs_of_brackets_are_trimmed_at_once():
    text = "1" + ")" * 200_000
    assert pii._trim(text, 0, len(text)) == (0, 1)
    assert pii._trim("((415) 555)", 0, 11) == (0, 11)
