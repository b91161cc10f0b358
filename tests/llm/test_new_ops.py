"""Collocations, sentence pieces and vector codes, against brute force, the library and integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from evigraph.llm import collocations, sentence_pieces, vector_codes

DOCS = "doc_id long, text string, lang string, n int, phrase string, word string, f long"


def docs_of(spark, rows):
    """Rows (text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, 1, "p", "w", 7) for i, (t, x) in enumerate(rows)], DOCS)


# --- collocations -------------------------------------------------------------------------------------


def brute_collocations(rows, top):
    counts, sizes, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    for lang, f in counts.items():
        found, longer = [], Counter()
        many = {p: a for p, a in f.items() if len(p) >= 2 and a >= 30}
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        for p, a in many.items():
            if 100 * longer[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def word_rows(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "Ähre", "x\x01", "naïve", "c", "The"]
    names = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else rng.choice(names) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [("", "en"), (None, "en"), (None, None), (" ,. ", "xx"), ("one", "yy")]


@pytest.mark.parametrize(("budget", "most_heavy"), [(1_000_000, 100_000), (1600, 100_000), (400, 100_000)])
def test_collocations_equal_brute_force(spark, budget, most_heavy):
    """Small budgets divide words and pairs, so that partial nodes are added up."""
    rows = word_rows(3, 500)
    got = collocations.collocations(docs_of(spark, rows), top=50, budget=budget, most_heavy=most_heavy)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 50)


def test_collocations_of_copies_and_long_texts(spark):
    rows = [("New York is new. york " * 20_000, "en")] + [("alpha beta gamma delta epsilon", "en")] * 40
    got = sorted(tuple(r) for r in collocations.collocations(docs_of(spark, rows)).collect())
    assert got == brute_collocations(rows, 2000)
    assert {r[2] for r in got} >= {"alpha beta gamma delta", "beta gamma delta epsilon"}


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []


def test_heavy_pairs_are_all_found(spark):
    rows = [("a b a b c " * 40, "en")] * 10 + [("d e", "en")] * 5
    docs = docs_of(spark, rows).select("lang", "text")
    hashes = {w: int(v) & (2**64 - 1) for w, v in spark.createDataFrame([(w,) for w in "abcde"], "word string").selectExpr("word", "xxhash64('en', word) AS h").collect()}
    heavy = np.sort(np.array([hashes[w] for w in "abc"], np.uint64))
    found = collocations.heavy_pairs(docs, heavy, 500, 2010)
    pair = lambda x, y: collocations.pair_hash(np.array([hashes[x]], np.uint64), np.array([hashes[y]], np.uint64))[0]
    assert pair("a", "b") in found  # 800 occurrences
    assert pair("d", "e") not in found


# --- sentence pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "   ", "▁", "é", "漢", "字", "の", "😀", "\n", "\t", "1", "22", "the", "ing", "\x00", "=", "==", "-", " t", "ﬁ", "ß", "́", "ा", "न"]
    texts = ["", " ", "  ", "x" * 5000, " " * 5000 + "the", *[" " * n + "a" for n in range(13, 19)], "a" * 999, "=" * 777, "▁" * 40, "<s>", "<0x41>", "a▁b", "antidisestablishmentarianism" * 500]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]


def test_pieces_equal_the_library(spark, library):
    texts = odd_texts()
    docs = docs_of(spark, [(t, "en") for t in [*texts, None]])
    encoded = sentence_pieces.encode_documents(docs, sentence_pieces.default_model())
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    want = [*library.encode(texts), []]
    assert [ids[i] for i in range(len(want))] == want
    decoded = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(encoded, sentence_pieces.default_model()).collect()}
    assert [decoded[i] for i in range(len(want))] == [library.decode(w) for w in want]


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = random.Random(2)
    pick = lambda: rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(3), 29871])
    rows = [[pick() for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    table = spark.createDataFrame([*enumerate(rows), (len(rows), None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(table, sentence_pieces.default_model()).collect()}
    assert [got[i] for i in range(len(rows))] == [library.decode(r) for r in rows]
    assert got[len(rows)] == ""


def test_pieces_of_whole_documents(spark, library, sf_dir):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in sentence_pieces.encode_documents(docs, sentence_pieces.default_model(), digests=True).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_pieces_of_an_empty_table(spark):
    assert sentence_pieces.encode_documents(docs_of(spark, []), sentence_pieces.default_model(), digests=True).collect() == []


# --- vector codes -----------------------------------------------------------------------------------------


def brute_codes(rows, entries=256):
    """Integers only, entry by entry."""
    kept = [(i, [int(np.floor(np.float64(x))) * 1024 if abs(x) > 2**53 else int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v in kept] for p in range(4)]
    books = [[list(v) for v in part[:entries]] for part in parts]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(5):
        owner = [[min(range(len(b)), key=lambda e: (distance(x, b[e]), e)) for x in part] for part, b in zip(parts, books, strict=True)]
        if step == 4:
            break
        for part, own, b in zip(parts, owner, books, strict=True):
            for e in set(own):
                mine = [x for x, o in zip(part, own, strict=True) if o == e]
                b[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [
        (i, "".join(f"{o[k]:02x}" for o in owner), sum(distance(p[k], b[o[k]]) for p, b, o in zip(parts, books, owner, strict=True)))
        for k, (i, _) in enumerate(kept)
    ]


VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, key string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 1, "k") for i, v, x in rows], VECTORS)


def test_codes_equal_integer_arithmetic(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).round(2).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(400)]
    odd = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (1004, [1.0] * 4, 1), (1005, [], 1)]
    got = vector_codes.compress(vectors_of(spark, rows + odd)).collect()
    want = brute_codes([(i, v) for i, v, _ in sorted(rows, key=lambda r: r[0])])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    error, totals = {i: e for i, _, e in want}, Counter()
    for i, _, label in rows:
        totals[label] += error[i]
    assert {r["vec_id"]: r["label_error"] for r in got} == {i: totals[label] for i, _, label in rows}
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_codes_of_huge_and_repeated_vectors(spark):
    """Products beyond 2^53 and sums beyond 2^63 stay exact."""
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=8) * 10.0 ** rng.integers(-3, 9)).tolist(), 1) for i in range(300)]
    got = vector_codes.compress(vectors_of(spark, rows)).collect()
    want = [(i, c, e if e < 2**63 else None) for i, c, e in brute_codes([(i, v) for i, v, _ in rows])]
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    same = vector_codes.compress(vectors_of(spark, [(1, [1.0] * 4, None)] * 3)).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in same] == [(1, "00000000", 0, 0)] * 3


def test_products_by_limbs_are_exact():
    rng = np.random.default_rng(6)
    for bits in (10, 27, 31, 50, 90):
        x, c = (np.array([[int(v) * (1 << max(bits - 30, 0)) + int(v) % 7 for v in row] for row in rng.integers(-(2 ** min(bits, 30)), 2 ** min(bits, 30), (n, 16))], object) for n in (40, 9))
        x, c = (m.astype(np.int64) if bits < 60 else m for m in (x, c))
        assert vector_codes.exact_products(x, c).astype(object).tolist() == (x.astype(object) @ c.astype(object).T).tolist()


def test_decoded_vectors_are_near(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    width, book = vector_codes.fit_codebooks(vectors)
    codes = vector_codes.encode(vectors, width, book)
    back = {r["vec_id"]: np.array(r["v"]) for r in vector_codes.decode(codes, book).collect()}
    for r in codes.join(vectors.drop("label"), "vec_id").collect():
        low = np.floor(np.array(r["embedding"], np.float64) * 1024) / 1024
        assert abs(((back[r["vec_id"]] - low) ** 2).sum() * 1024**2 - r["error"]) < 1e-3


def test_codes_of_an_empty_table(spark):
    assert vector_codes.compress(vectors_of(spark, [])).collect() == []
    assert vector_codes.compress(vectors_of(spark, [(1, None, 1), (2, [1.0], 1)])).collect() == []
