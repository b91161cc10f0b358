import random

import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.operators import documents as D
from evigraph.operators.tagging import dictionary_tagger
from evigraph.sources.html import _page_rows, html_blocks

BLOCK = "array<struct<ord:long,location:string,kind:string,text:string>>"


def pack(blocks, limit):
    """The packing rule, block by block."""
    out, cur, lang, size = [], [], None, 0
    for loc, kind, text, tag in blocks:
        if kind == "table":
            if cur:
                out.append(("paragraph", lang, cur))
            out.append(("table", tag, [loc]))
            cur, lang, size = [], None, 0
            continue
        need = len(text) + len(loc) + 4
        switch = lang not in (None, "mixed") and tag != "mixed" and tag != lang
        if cur and (switch or size + need > limit):
            out.append(("paragraph", lang, cur))
            cur, lang, size = [], None, 0
        cur = [*cur, loc]
        lang = tag if lang in (None, "mixed") else lang
        size += need
    return out + ([("paragraph", lang, cur)] if cur else [])


def test_chunks_follow_the_packing_rule(spark):
    rng = random.Random(7)
    samples = {"en": "matte ", "ru": "штейн ", "mixed": "aбвaбв "}
    docs = []
    for doc in range(60):
        rows = []
        for i in range(rng.randrange(0, 25)):
            tag = rng.choice(list(samples))
            rows.append((i, f"para {i}", "table" if rng.random() < 0.15 else "paragraph", (samples[tag] * rng.randrange(1, 20)).strip(), tag))
        docs.append((doc, rows))
    df = spark.createDataFrame([(d, [r[:4] for r in rows]) for d, rows in docs], f"doc_id long, blocks {BLOCK}")
    got = {}
    for r in D.chunk_documents(df, 150).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.language, r.locations))
        assert r.text.startswith(f"[{r.locations[0]}] ") and r.text.count("\n\n") == len(r.locations) - 1
    for doc, rows in docs:
        assert got.get(doc, []) == [(k, lg, locs) for k, lg, locs in pack([r[1:] for r in rows], 150)]


def test_sections(spark):
    lines = [
        (0, "paragraph", "Front matter that ends with a dot."), (1, "heading", "Abstract."), (2, "paragraph", "A" * 5998 + "."), (3, "paragraph", "B" * 50 + "."),
        (4, "paragraph", "never kept."), (5, "table", "x | y"), (6, "paragraph", "МЕТОДЫ и материалы"), (7, "table", "a | b"), (8, "paragraph", "Some other heading"),
        (9, "paragraph", "outside."), (10, "paragraph", "Методика"), (11, "paragraph", "more methods."),
    ]
    df = spark.createDataFrame([(1, [(i, f"para {i}", k, t) for i, k, t in lines]), (2, [(i, f"para {i}", "paragraph", f"text {i}.") for i in range(4)])], f"doc_id long, blocks {BLOCK}")
    got = [(r.doc_id, r.section, r.ord) for r in D.key_sections(df).orderBy("doc_id", "section", "ord").collect()]
    # "Abstract." is a heading by kind; block 3 crosses 6000 characters and is the last one kept.
    assert got == [(1, "abstract", 2), (1, "abstract", 3), (1, "methods", 7), (1, "methods", 11), (2, "abstract", 0), (2, "abstract", 1),
                   (2, "abstract", 2), (2, "conclusion", 1), (2, "conclusion", 2), (2, "conclusion", 3)]


def test_paragraph_blocks_count_empty_ones(spark):
    df = spark.createDataFrame([(1, "first\n\n\n  \n\nsecond | cell\n \nthird")], "doc_id long, text string")
    assert [(r.location, r.kind, r.text) for r in D.text_blocks(df).collect()] == [("para 0", "paragraph", "first"), ("para 1", "table", "second | cell"), ("para 2", "paragraph", "third")]


def test_overlap_chunks_cover_the_text(spark):
    for n in (1, 999, 1000, 1001, 1800, 1801, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        rows = D.overlap_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect()
        assert rows[0].text + "".join(r.text[200:] for r in rows[1:]) == text


def test_categories_and_newest(spark):
    df = spark.createDataFrame([("raw/J/2005/a.pdf", "2020"), ("raw/J/2006/b.pdf", "2022"), ("raw/x.PDF", "2021"), ("raw/T/c.docx", "2021"), ("raw/y.zip", "2021")], "path string, modified string")
    got = {r.path: r.category for r in df.select("path", D.infer_category(F.col("path"), "raw").alias("category")).collect()}
    assert got == {"raw/J/2005/a.pdf": "J", "raw/J/2006/b.pdf": "J", "raw/x.PDF": "статья_или_отчёт_pdf", "raw/T/c.docx": "T", "raw/y.zip": "прочее"}
    assert [r.path for r in D.stratified_sample(df, "raw", 1, "newest").filter("category = 'J'").collect()] == ["raw/J/2006/b.pdf"]


def test_html_blocks(spark):
    html = (
        "<html><head><title> A &amp; B </title><script>var t='<p>no no no no no no no</p>';</script></head><body><nav><p>navigation text that is long enough</p></nav>"
        "<h1>A heading of twenty chars</h1><p>short</p><p>First paragraph <b>bold</b> text<br>goes   on</p><ul><li>item long enough to be kept</li></ul></body></html>"
    )
    df = spark.createDataFrame([(1, "http://h.example/a/b/?q=1", html), (2, "http://h.example/a/b/?q=1", "<p>a paragraph of enough characters</p>")], "page_id long, url string, html string")
    rows = html_blocks(df).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.title, r.kind, r.location, r.text) for r in rows] == [
        (1, "A & B", "heading", "para 0", "A heading of twenty chars"), (1, "A & B", "paragraph", "para 2", "First paragraph bold text goes on"),
        (1, "A & B", "paragraph", "para 3", "item long enough to be kept"), (2, "h.example/a/b", "paragraph", "para 0", "a paragraph of enough characters"),
    ]


def test_tagger_takes_leftmost_longest(spark):
    chunks = spark.createDataFrame([("1", "Nickel matte and nickel; matte nickel ore")], "chunk_id string, text string")
    names = spark.createDataFrame([(n,) for n in ("nickel", "nickel matte", "matte", "nickel ore", "ore")], "lname string")
    got = [(r.start, r.lname) for r in dictionary_tagger(chunks, names).orderBy("start").collect()]
    assert got == [(1, "nickel matte"), (18, "nickel"), (26, "matte"), (32, "nickel ore")]


def test_blocks_of_many_pages_are_given_on_in_pieces():
    page = "<title>t</title><p>a paragraph of some length</p><h1>a heading of some length too</h1>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([page] * 49 + [None]), pa.array(["f"] * 50)], ["page_id", "html", "fallback"])
    parts = list(_page_rows(iter([batch]), 300))
    assert max(p.num_rows for p in parts) < 20
    rows = [tuple(r.values())[:3] for p in parts for r in p.to_pylist()]
    assert rows == [(i, "t", k) for i in range(49) for k in (0, 1)]
