"""Sources, cleaning, sections, terms, personal data and validation on literals."""

import json
import random
import re

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions import quality as q
from callbrook.functions.text import content_hash, nfkc, record_hash, strip, tidy_whitespace
from callbrook.operators import carry, conflicts, ingest
from callbrook.operators.chunking import chunk_records, pieces
from callbrook.sources import files
from callbrook.sources.html import html_elements, parse_page


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression("t").alias("x")).first()["x"]


def test_strip_is_unicode(spark):
    for s in ("  a b  \n", "\x1c\x85x　", "", " \t\n"):
        assert one(spark, s, strip) == s.strip()


def test_hashes_differ_only_in_inner_space(spark):
    row = spark.createDataFrame([("A  b ", " a b")], "x string, y string").select(
        content_hash("x") == content_hash("y"), record_hash("x") == record_hash("y")).first()
    assert list(row) == [True, False]


def test_whitespace_and_unicode_form(spark):
    assert one(spark, "ﬁne\t\tprint \n\n\n\n  next", tidy_whitespace) == "fine print\n\nnext"
    assert one(spark, "①", nfkc) == "1"


def test_paragraphs_and_headings(spark):
    df = spark.createDataFrame([("s", "# Title\n\n  one\ntwo \n\n\n\n  \n\nlast")], "id string, t string")
    got = [(r["ord"], r["element_type"], r["text"]) for r in ingest.text_elements(df, "id", "t").orderBy("ord").collect()]
    assert got == [(0, "heading", "# Title"), (1, "paragraph", "one\ntwo"), (2, "paragraph", "last")]


def test_removal_reasons(spark):
    rows = [("Home", "paragraph"), ("Homes for all", "paragraph"), ("12", "paragraph"), ("© 2024 Us", "list"), ("Page 3 of 9", "heading"),
            ("x", "paragraph"), ("x", "list"), ("Draft copy", "footer"), ("Draft copy", "paragraph"), ("anything", "navigation"), ("due 01/15/2024", "list")]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "ord long, text string, element_type string")
    out = [(r["removal_reason"], r["clean_text"]) for r in ingest.clean_elements(df).orderBy("ord").collect()]
    assert [x for x, _ in out] == ["navigation_content", None, "navigation_content", "navigation_content", "navigation_content",
                                   "short_fragment", None, "header_footer", None, "navigation_element", None]
    assert out[-1][1] == "due 01-15-2024"


def test_sections_continue_over_missing_names(spark):
    names = [None, "A", None, "", "A", "B", "A"]
    df = spark.createDataFrame([("s", i, n, f"t{i}") for i, n in enumerate(names)], "source_id string, ord long, section string, clean_text string")
    got = [(r["title"], r["content"]) for r in ingest.section_records(df).orderBy("section_start").collect()]
    assert got == [("s", "t0"), ("A", "t1\n\nt2\n\nt3\n\nt4"), ("B", "t5"), ("A", "t6")]


def test_segmented_runs_equal_plain_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in ("hot", "cold"):
        current, start = None, None
        for i in range(400 if k == "hot" else 7):
            name = rng.choice([None, "A", "B"])
            if name is not None and name != current:
                current, start = name, i
            rows.append((k, i, name))
            want[(k, i)] = (current, start)
    df = spark.createDataFrame(rows, "k string, i long, v string")
    for width in (1, 7, 1000):
        out = carry.runs(df, ["k"], ["i"], F.floor(F.col("i") / width), F.col("v"), lambda a, b: a != b).collect()
        assert {(r["k"], r["i"]): (r["run_value"], r["run_start"] and r["run_start"]["i"]) for r in out} == want


def test_segmented_sums_equal_window(spark):
    df = spark.createDataFrame([("k", i, i % 5) for i in range(100)], "k string, i long, v long")
    out = carry.running(df, ["k"], ["i"], F.floor(F.col("i") / 9), [carry.Running("s", "sum", F.col("v"), True), carry.Running("p", "last", F.col("i"))])
    for r in out.collect():
        assert r["s"] == sum(j % 5 for j in range(r["i"] + 1)) and r["p"] == (r["i"] - 1 if r["i"] else None)


def test_html_tables_and_nesting(spark):
    page = ("<header>Top</header><h2>Rates</h2><p>ab</p><p>Our rates</p><ul><li>first item<li>second item</ul>"
            "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><p>cell text</p></td></tr></table>")
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [(r["element_type"], r["text"], r["section"]) for r in html_elements(df).orderBy("ord").collect()]
    assert got == [("navigation", "Top", None), ("heading", "Rates", "Rates"), ("paragraph", "Our rates", "Rates"), ("list", "first item", "Rates"),
                   ("list", "second item", "Rates"), ("table", "A | B\n-----\n1 | cell text", "Rates"), ("paragraph", "cell text", "Rates")]
    assert parse_page("") == []


def test_directory_scan_and_records(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello there")
    (tmp_path / "b.html").write_text("<p>hello there</p>")
    (tmp_path / "c.bin").write_text("zz")
    got = {r["filename"]: r["source_type"] for r in files.register_sources(files.scan_directory(spark, str(tmp_path))).collect()}
    assert got == {"a.TXT": "txt", "b.html": "html"}
    (tmp_path / "r.json").write_text('[{"record_id": "k1", "title": "T", "language": "en"}, {"record_id": "k2", "language": "id"}]')
    records = files.read_records(spark, str(tmp_path / "r.json"))
    assert records.count() == 2 and files.read_records(spark, str(tmp_path / "none.json")).count() == 0
    files.write_records(files.union_records(records, records), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_terms_replace_inside_words_longest_first(spark):
    text = "An SME Loan with prequalification criteria and Requirements."
    assert one(spark, text, q.normalize_terms) == "An business loan with preeligibility and eligibility."
    got = one(spark, text, q.term_replacements)
    assert [(r["original"], r["normalized"]) for r in got] == [
        ("qualification criteria", "eligibility"), ("Requirements", "eligibility"), ("SME Loan", "business loan")]


def test_personal_data_spans(spark):
    text = "Dr. Jane Ann Doe, jane@x.org, +1 415 555 2671, account #123456 in 2024"
    p = one(spark, text, q.personal_data)
    kinds = [e["entity_type"] for e in p["entities"]]
    assert kinds == ["person_name", "email", "phone", "account_id"]
    assert p["masked"] == "[PERSON_NAME], [EMAIL], [PHONE], [ACCOUNT_ID] in 2024"
    ends = [(e["start"], e["end"]) for e in p["entities"]]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert all(text[e["start"]:e["end"]] == e["text"] for e in p["entities"])


def plain_entities(text):
    """The detectors and the choice among overlapping matches, one text at a time."""
    detectors = [("email", v.PII_EMAIL, 0, 0), *(("phone", p, 7, 0) for p in v.PII_PHONES),
                 *(("account_id", p, 0, re.IGNORECASE) for p in v.PII_ACCOUNTS), ("person_name", v.PII_TITLED_NAME, 0, 0)]
    hits = [(m.start(), -v.PII_CONFIDENCE[kind], k, m.end(), kind) for k, (kind, p, least, flags) in enumerate(detectors)
            for m in re.finditer(p, text, flags) if len(re.sub("[ .-]", "", m[0])) >= least]
    kept, at = [], 0
    for start, minus, _, end, kind in sorted(hits):
        if start >= at:
            kept.append((kind, start, end, text[start:end], -minus))
            at = end
    return kept


def test_personal_data_equals_plain_scan(spark):
    r = random.Random(4)
    bits = ["jane@x.org", "a.b@c", "@", "+1 415 555 2671", "(415)555-2671", "4155552671", "2024", "account #123456", "ACCT:12345", "policy-9999", "cid 4444444",
            "Dr. Jane Doe", "Mr Ann", "Prof\x1c Ivo Ma Ko", "señor@x.com", "ñ", "東京", "😀", "\n", "\t", ",", " ", "x", "١٢٣٤٥٦٧٨", "İ", "acCount 77777"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "-"]) for _ in range(r.randint(0, 14))) for _ in range(600)] + ["", None, "7 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    for row in df.select("t", q.personal_data("t").alias("p")).collect():
        want = plain_entities(row.t or "")
        assert [tuple(e) for e in row.p.entities] == want, row.t
        masked, at = "", 0
        for kind, start, end, *_ in want:
            masked, at = masked + row.t[at:start] + f"[{kind.upper()}]", end
        assert row.p.masked == (None if row.t is None else masked + row.t[at:])


def test_nested_payloads_keep_keys_and_shape(spark):
    deep = {"a@b.co": ["x@y.org", {"k": 'say \\ "415-555-2671"\nfoo@bar.com', "n": [1, 2.5, True, None, {}, []]}], "z": "", "é\u2028": "plain \t text"}
    bad = "{not json a@b.co"
    df = spark.createDataFrame([(0, json.dumps(deep)), (1, bad), (2, None), (3, '"a@b.co"'), (4, json.dumps(["\\" * 3000 + '"' * 3000]))], "k int, p string")
    got = {x.k: x.s for x in df.select("k", q.sanitize_json("p").alias("s")).collect()}
    deep["a@b.co"] = ["[EMAIL_PROTECTED]", {"k": 'say \\ "[PHONE_PROTECTED]"\n[EMAIL_PROTECTED]', "n": [1, 2.5, True, None, {}, []]}]
    assert json.loads(got[0]) == deep and got[1] == "{not json [EMAIL_PROTECTED]" and got[2] is None
    assert got[3] == '"[EMAIL_PROTECTED]"' and json.loads(got[4]) == ["\\" * 3000 + '"' * 3000]


def test_event_payload_masks_values_only(spark):
    m = spark.sql("SELECT map('a@b.co', 'write a@b.co or (415) 555-2671') AS m").select(q.sanitize_map("m").alias("m")).first()["m"]
    assert m == {"a@b.co": "write [EMAIL_PROTECTED] or [PHONE_PROTECTED]"}


def test_validation_flags(spark):
    df = spark.createDataFrame([("", None, "short", "2024-02-30", "2024-01-01"), ("t", "s", "pays -$5 and 1001% or 1000%", "2024-01-01", "2023-01-01")],
                               "title string, source_id string, content string, a string, b string")
    got = [r["f"] for r in df.select(q.validation_flags("title", "source_id", "content", "a", "b").alias("f")).collect()]
    assert got == [["missing_metadata"] * 3 + ["impossible_date"], ["impossible_date", "invalid_numeric", "invalid_numeric"]]


def test_conflict_rows_match_counts(spark):
    rows = [("r1", "s1", "fees $5 now", "1.0"), ("r2", "s2", "fees $6 now", "1.0"), ("r3", "s2", "fees $5 now", "2.0"), ("r4", "s1", "none", "1.0")]
    df = spark.createDataFrame([(*r, "p", "c", "") for r in rows], "record_id string, source_id string, content string, version string, product string, category string, subcategory string")
    counts = {r["record_id"]: (r["amount_conflicts"], r["version_conflicts"]) for r in conflicts.conflict_counts(df).collect()}
    assert counts == {"r1": (1, 1), "r2": (1, 0), "r3": (0, 2), "r4": (0, 1)}
    pairs = conflicts.conflicts_of(df, df.select("record_id")).collect()
    assert len(pairs) == sum(a + b for a, b in counts.values())
    assert {p["severity"] for p in pairs} == {"medium", "low"}


def test_chunk_quirks():
    text = ("# Section A\nThis is the first detailed section describing loan terms and conditions in depth.\n\n"
            "# Section B\nThis is the second detailed section describing interest rates, penalties, and grace periods.")
    assert [p.split("\n")[0] for p in pieces(text, 150, 30)] == ["# Section A", "# Section B"]
    table = "h1 | h2\n---\n" + "\n".join(f"row {i} | value" for i in range(40))
    cut = pieces(table, 128, 0)
    assert all(p.startswith("h1 | h2\n---\n") and len(p) <= 128 for p in cut)
    assert [r for p in cut for r in p.split("\n")[2:]] == table.split("\n")[2:]
    long_open = "short.\n\n" + "y" * 200
    assert pieces(long_open, 128, 64) == ["short.", "short.\n\n" + "y" * 200]
    sentences = " ".join(f"Sentence number {i} ends." for i in range(30))
    assert " ".join(pieces(sentences, 128, 0)) == sentences and max(map(len, pieces(sentences, 128, 0))) <= 128


def test_chunk_rows(spark):
    df = spark.createDataFrame([("k1", "T", None, "word " * 300, "c", "p")], "record_id string, title string, section string, content string, category string, product string")
    rows = chunk_records(df).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(rows[0]["total_chunks"])) and rows[0]["section"] == "T"
    assert all(r["char_count"] == len(r["content"]) and r["token_count"] == max(1, int(len(r["content"].split()) * 1.3)) for r in rows)


def test_a_hot_hash_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(ingest, "SEGMENT", 64)
    rows = [(str(k), 1_000_003 * (k * 7919 % 3001), "hot" if k % 3 == 0 else f"text {k % 700}") for k in range(3000)]
    df = spark.createDataFrame(rows, "record_id string, seq long, content string")
    got = {r.record_id: (r.exact_of, r.canonical_id) for r in ingest.exact_duplicate_chain(df).collect()}
    last, first, want = {}, {}, {}
    for i, _, text in sorted(rows, key=lambda r: r[1]):
        want[i] = (last.get(text), first.get(text))
        first.setdefault(text, i)
        last[text] = i
    assert got == want
    hot = ingest.placed_in_key(df, "test", "content", ["seq"]).filter("content = 'hot'").groupBy("place").count().collect()
    assert len(hot) >= 15 and max(r["count"] for r in hot) <= 64


def test_vector_search_in_blocks_against_brute_force(spark, monkeypatch):
    """Many blocks of queries and shares of vectors give the rows of one matrix product; none of it passes the driver."""
    import numpy as np

    from callbrook.operators import search
    r = np.random.default_rng(4)
    x, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (r.normal(size=(500, 8)), r.normal(size=(37, 8))))
    x[100:140] = x[7]  # ties go to the smaller id
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    sims = np.round(q @ x.T, 9)
    want = {(i, int(j), k + 1) for i in range(len(q)) for k, j in enumerate(np.lexsort((np.arange(500), -sims[i]))[:6])}
    for block in (10_000, 5):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = search.vector_topk(rows, asked, lambda part: part, 6)
        assert {(t.query_id, t.chunk_id, t.dense_rank) for t in got.collect()} == want
