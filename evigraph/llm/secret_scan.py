"""Secret scan: plain patterns, and assignment-aware lexing.

The patterns find credentials by their own shape. The lexer reads source and configuration syntax
into (name, literal) pairs: ``name = "a" + "b"``, ``name: 'a'``, ``"name": "a"``, ``export NAME=a``,
``name: a1/b``, ``name = other``. Names and literals have any length; an unquoted literal ends at white space, a
quote, a comma or a semicolon and holds a digit; after a blank or colon, a name with an open parenthesis is a
call. Constants are propagated within a text: a name bound to another name takes its literals. A literal counts when a name it reaches is a sensitive target and the literal looks like a
value (long enough, mixed, no placeholder); its score is the target's weight times the literal's
randomness. Offsets are code points, ends exclusive.

One pass over each text, no shuffle. Defined results: a null text is empty and has no spans; repeated
rows are scanned each; very long texts take time in proportion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.tables import read

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "literal")

# Target names, by how surely their literal is a credential.
TARGETS = (
    (1.0, r"passw(?:or)?d|passphrase|secret|api_?key|access_?key|private_?key|signing_?key|encryption_?key"),
    (0.8, r"pwd|credential|auth_?token|token|bearer|client_?id|session_?key"),
)
PLACEHOLDER = r"(?i)^(?:x+|\*+|changeme|example.*|your[_-].*|todo|none|null|true|false|test|dummy|placeholder)$|^[$<{%]"
SENSITIVE = re.compile("|".join(p for _, p in TARGETS), re.I)
MIN_SCORE = 0.45


def literal_score(name: str, value: str) -> float:
    """Weight of the target name times the literal's randomness, 0 to 1."""
    import math

    weight = next((w for w, p in TARGETS if re.search(p, name, re.I)), 0.0)
    if not weight or len(value) < 6 or re.search(PLACEHOLDER, value) or re.search(r"\s", value):
        return 0.0
    counts = Counter(value).values()
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return weight * min(1.0, entropy / 4.0 + 0.1 * (kinds - 1))


NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
STRING = r"(?:\"[^\"\n]*+\"|'[^'\n]*+')"
BINDING = re.compile(
    rf"""(?P<q>["']?)(?P<name>(?<![A-Za-z0-9_.-]){NAME})(?P=q)[ \t]*+(?::=|=>|[:=])[ \t]*+(?P<value>{STRING}(?:[ \t]*+(?:\+[ \t]*+)?{STRING})*+)?"""
)
PIECE = re.compile(STRING)
WORD = re.compile(NAME)
BARE = re.compile(r"""[^\s"',;]*+""")
CLOSING = re.compile(r"[)\]}>:]*+")
DIGIT = re.compile(r"[0-9]")


def lexed_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name in ``text``, whatever name they were first bound to."""
    if ("=" not in text) and (":" not in text):
        return []
    bound: dict[str, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], float] = {}
    at = stop = digit = 0  # stop: end of the unquoted value around ``at``; digit: its first digit from ``at`` on
    while m := BINDING.search(text, at):
        name, at = m["name"], m.end()
        if m["value"]:
            pieces = [(p.start() + 1, p.end() - 1) for p in PIECE.finditer(text, m.start("value"), at)]
        else:
            if at >= stop:
                stop, digit = BARE.match(text, at).end(), at
            if digit <= at < stop:
                d = DIGIT.search(text, at, stop)
                digit = d.start() if d else stop
            word, direct = WORD.match(text, at), text[at - 1] == "="
            after = word.end() if word else at
            if word and word[0] in bound and (CLOSING.match(text, after).end() == stop or not (direct or text.startswith("(", after))):
                pieces = bound[word[0]]
            elif digit >= stop or (not direct and (text[at] in ":=" or (word and text.startswith("(", after)))):
                continue  # words only; a comparison, a scope or a call
            else:
                pieces = [(at, stop)]
        bound[name] = pieces
        if not SENSITIVE.search(name):
            continue  # what lies inside an unquoted value (a URL's parameters) is read on its own
        score = literal_score(name, "".join(text[a:b] for a, b in pieces))
        if score >= MIN_SCORE:
            for span in pieces:
                found[span] = max(found.get(span, 0.0), score)
            at = max(at, stop) if pieces == [(at, stop)] else at
    return [(a, b, s) for (a, b), s in sorted(found.items()) if b > a]


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then by kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if m.end(1) - m.start(1) >= 6]
        spans += [(a, 3, b) for a, b, _ in lexed_literals(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def masked(text: str, spans: list[tuple[str, int, int]], mark: str = "<secret>") -> str:
    """``text`` with every covered stretch replaced by ``mark``; overlapping and touching spans become one."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at and (a > at or not out):
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> and masked_text for every row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [scan_text(t or "") for t in batch.column("text").to_pylist()]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars`` counted anew; all other columns as they are."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else masked(t, scan_text(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[3])


QUERIES = {"op8_secret_scan": op8_secret_scan}
