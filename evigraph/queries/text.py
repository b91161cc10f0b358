"""Text functions (F rows of the inventory), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators.extraction import parse_extractions
from evigraph.queries.registry import query
from evigraph.sources.star import documents, nodes, table, view

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
WORD = r"[\p{L}\p{N}_-]+"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '{WORD}'), lambda x: length(x) > 1 AND lower(x) NOT IN ({STOP}))"


def name_words_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{WORD}'), lambda x: length(x) > 2)"


MATCH = ("({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND left({a}, greatest(3, CAST(floor(3 * least(length({a}), length({b})) / 5) AS BIGINT)))"
         " = left({b}, greatest(3, CAST(floor(3 * least(length({a}), length({b})) / 5) AS BIGINT)))))")
LANGUAGE = ("CASE WHEN trim({t}) = '' THEN 'unknown' WHEN length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) = 0 THEN 'other'"
            " WHEN length(regexp_replace({t}, '[^А-Яа-яЁё]', '', 'g')) / length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) > 0.7 THEN 'ru'"
            " WHEN length(regexp_replace({t}, '[^А-Яа-яЁё]', '', 'g')) / length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) < 0.15 THEN 'en' ELSE 'mixed' END")


@query("tokenize", "", f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_hash FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def _(spark, d):
    t = documents(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


@query(
    "word_match", "",
    f"""WITH w AS (SELECT doc_id, unnest({tokens_sql('lower(text)')}) AS b, generate_subscripts({tokens_sql('lower(text)')}, 1) AS i FROM documents),
    p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM w)
    SELECT d.doc_id, count(*) FILTER (WHERE a IS NOT NULL AND {MATCH.format(a='a', b='b')}) AS n_adjacent FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, d):
    """Neighbouring words of a text that match each other."""
    t = documents(spark, d).select("doc_id", T.tokenize(F.lower("text")).alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    hits = F.filter(F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: T.word_match(a, b)), lambda m: m)
    return t.select("doc_id", F.size(hits).cast("long").alias("n_adjacent"))


@query(
    "name_similarity", "",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS a, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    p AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM l),
    w AS (SELECT *, {name_words_sql('a')} AS wa, {name_words_sql('b')} AS wb FROM p WHERE b IS NOT NULL)
    SELECT doc_id, CAST(line AS BIGINT) AS line, round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1.0 ELSE 0.0 END
      ELSE len(list_filter(wa, lambda x: len(list_filter(wb, lambda y: {MATCH.format(a='x', b='y')})) > 0)) / len(wa) END, 4) AS similarity FROM w""",
)
def _(spark, d):
    """Every line of every text against the line after it."""
    lines = documents(spark, d).select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.greatest(F.size("lines") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("lines", 1, n), F.slice("lines", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pair = lines.select("doc_id", F.posexplode(pairs).alias("line", "p"))
    return pair.select("doc_id", F.col("line").cast("long").alias("line"), F.round(T.name_similarity(F.col("p.a"), F.col("p.b")), 4).alias("similarity"))


@query(
    "detect_script_language", "",
    f"""SELECT doc_id, {LANGUAGE.format(t='text')} AS lang_plain, {LANGUAGE.format(t="translate(text, 'e', 'е')")} AS lang_e, {LANGUAGE.format(t="translate(text, 'abcdehiklmnoprstu', 'абцдехиклмнопрсту')")} AS lang_cyr FROM documents""",
)
def _(spark, d):
    """On the texts as they are and with some or most letters replaced by Cyrillic ones."""
    return documents(spark, d).select(
        "doc_id",
        T.script_language(F.col("text")).alias("lang_plain"),
        T.script_language(F.translate("text", "e", "е")).alias("lang_e"),
        T.script_language(F.translate("text", "abcdehiklmnoprstu", "абцдехиклмнопрсту")).alias("lang_cyr"),
    )


@query("text_hash", "", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


@query("stable_id", "g_nodes", "SELECT DISTINCT type, lower(trim(name)) AS lname, type || '_' || left(sha1(lower(trim(name))), 16) AS stable_id FROM g_nodes")
def _(spark, d):
    n = nodes(spark, d)
    return n.select("type", F.lower(F.trim("name")).alias("lname"), T.stable_id(F.col("type"), F.col("name")).alias("stable_id")).distinct()


@query(
    "normalize_subscripts", "",
    "SELECT page_id, sha256(lower(translate(translate(html, '13579', '₁³₅⁷₉'), '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹', '01234567890123456789'))) AS h, lower(url) AS url FROM pages",
)
def _(spark, d):
    raised = table(spark, d, "pages").withColumn("html", F.translate("html", "13579", "₁³₅⁷₉"))
    return raised.select("page_id", F.sha2(T.normalize_subscripts(F.col("html")), 256).alias("h"), T.normalize_subscripts(F.col("url")).alias("url"))


@query(
    "clean_snippet", "blocks",
    r"""SELECT doc_id, ord, trim(regexp_replace(regexp_replace(regexp_replace('- [' || location || '] ' || text || ' [page 3]', '(?i)\[\s*(?:para|paragraph|page|slide|table|стр\.?|страница|слайд|таблица)\s*\d+\s*\]', ' ', 'g'), '\s{2,}', ' ', 'g'), '^\s*[·,;:—-]\s*', '')) AS snippet FROM blocks""",
)
def _(spark, d):
    from evigraph.operators.documents import text_blocks

    b = text_blocks(documents(spark, d), "\n")
    raw = F.concat(F.lit("- ["), "location", F.lit("] "), "text", F.lit(" [page 3]"))
    return b.select("doc_id", "ord", T.clean_snippet(raw).alias("snippet"))


@query(
    "clean_location", "",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
        'para ' || CAST(l_linenumber AS VARCHAR) || ', page ' || CAST(l_partkey % 3 AS VARCHAR) || ', Slide ' || CAST(l_suppkey % 4 AS VARCHAR) || ', page ' || CAST(l_suppkey % 3 AS VARCHAR) || ', table ' || CAST(l_linenumber AS VARCHAR) AS location FROM lineitem)
    SELECT DISTINCT location, 'стр. ' || CAST(l_partkey % 3 AS VARCHAR) || CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN '' ELSE ', ' || CAST(l_suppkey % 3 AS VARCHAR) END || ' · слайд ' || CAST(l_suppkey % 4 AS VARCHAR) || ' · таблица ' || CAST(l_linenumber AS VARCHAR) AS shown FROM l""",
)
def _(spark, d):
    s = lambda c: F.expr(f"cast({c} as string)")
    loc = F.concat(
        F.lit("para "), s("l_linenumber"), F.lit(", page "), s("l_partkey % 3"), F.lit(", Slide "), s("l_suppkey % 4"),
        F.lit(", page "), s("l_suppkey % 3"), F.lit(", table "), s("l_linenumber"),
    )
    return table(spark, d, "lineitem").select(loc.alias("location")).distinct().select("location", T.clean_location(F.col("location")).alias("shown"))


@query("strip_tags", "", "SELECT page_id, sha256(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS text_hash FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_hash"))


@query("extract_year", "", r"SELECT page_id, TRY_CAST(nullif(regexp_extract(html, '(?:19|20)\d{2}'), '') AS INTEGER) AS year FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.extract_year(F.col("html")).alias("year"))


BIBLIO = "c_name || ', ' || c_mktsegment || '; et al… - Journal of ' || o_orderpriority || ', ' || CAST(year(o_orderdate) AS VARCHAR) || ' - publisher'"


@query(
    "parse_biblio_line", "",
    f"""WITH b AS (SELECT o_orderkey, {BIBLIO} AS line FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT o_orderkey, line, string_split(line, ' - ') AS parts FROM b)
    SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(parts[1]), '[,;]'), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, '…')), '|') AS authors,
      trim(regexp_replace(trim(parts[2]), ',?\\s*(?:19|20)\\d{{2}}.*$', '')) AS venue, CAST(regexp_extract(line, '(?:19|20)\\d{{2}}') AS INTEGER) AS year FROM p""",
)
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat(
        "c_name", F.lit(", "), "c_mktsegment", F.lit("; et al… - Journal of "), "o_orderpriority", F.lit(", "),
        F.year("o_orderdate").cast("string"), F.lit(" - publisher"),
    )
    p = o.select("o_orderkey", T.parse_biblio_line(line).alias("p"))
    return p.select("o_orderkey", F.array_join("p.authors", "|").alias("authors"), "p.venue", "p.year")


@query(
    "parse_extraction_json", "",
    """WITH e AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS k, CASE WHEN l_linenumber % 5 = 0 THEN 'gadget' ELSE 'material' END AS type, p_name AS name, CAST(l_quantity AS BIGINT) AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT doc_id, 'e' || k AS tmp_id, type, name, CAST(CAST(q AS DOUBLE) AS DOUBLE) AS mass_kg FROM e WHERE type = 'material'""",
)
def _(spark, d):
    """Completions built per order line, fenced and with prose around; unknown types are dropped one by one."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entity = F.struct(
        F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("tmp_id"),
        F.when(F.col("l_linenumber") % 5 == 0, "gadget").otherwise("material").alias("type"),
        F.col("p_name").alias("name"),
        F.struct(F.col("l_quantity").cast("long").alias("mass_kg")).alias("attrs"),
    )
    raw = F.concat(
        F.lit("```json\nHere it is: "),
        F.to_json(F.struct(F.array(entity).alias("entities"), F.array(F.lit("x")).alias("notes"))),
        F.lit(" done\n```"),
    )
    ents, _rels = parse_extractions(li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("chunk_no"), raw.alias("raw")))
    return ents.select("doc_id", "tmp_id", "type", "name", F.col("attrs_num")["mass_kg"].alias("mass_kg"))


@query(
    "parse_string_array", "",
    "SELECT conv_id, turn, role || '|' || text AS items FROM conversations",
)
def _(spark, d):
    """Fenced arrays with a number and a null among the strings."""
    c = table(spark, d, "conversations")
    quoted = F.regexp_replace(F.to_json(F.array("role", "text")), r"\]$", ", 7, null]")
    raw = F.concat(F.lit("```json\n"), quoted, F.lit("\n```"))
    return c.select("conv_id", "turn", F.array_join(T.parse_string_array(raw), "|").alias("items"))


@query("safe_slug", "", "SELECT page_id, left(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'), 48) AS slug FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_slug(F.col("url")).alias("slug"))
