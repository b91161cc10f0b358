"""Shared pieces of check SQL."""

from __future__ import annotations

LANGUAGE = (
    "CASE WHEN trim({t}) = '' THEN 'unknown' WHEN length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) = 0 THEN 'other'"
    " WHEN length(regexp_replace({t}, '[^А-Яа-яЁё]', '', 'g')) / length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) > 0.7 THEN 'ru'"
    " WHEN length(regexp_replace({t}, '[^А-Яа-яЁё]', '', 'g')) / length(regexp_replace({t}, '[^A-Za-zА-Яа-яЁё]', '', 'g')) < 0.15 THEN 'en' ELSE 'mixed' END"
)


def chunks_sql(blocks: str, max_chars: int = 2200, name: str = "chunks") -> str:
    """WITH-list entries that pack ``blocks`` into chunks, one recursion step per block."""
    starts = (
        "(b.kind = 'table' OR NOT r.open OR (b.lang <> 'mixed' AND r.blang <> 'mixed' AND b.lang <> r.blang)"
        f" OR r.len + b.piece > {max_chars})"
    )
    return f"""{name}_b AS MATERIALIZED (SELECT *, length(text) + length(location) + 4 AS piece, {LANGUAGE.format(t='text')} AS lang,
      row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM {blocks}),
    {name}_r AS (
      SELECT doc_id, i, 0 AS chunk_no, CASE WHEN kind = 'table' THEN 0 ELSE piece END AS len, CASE WHEN kind = 'table' THEN '' ELSE lang END AS blang, kind <> 'table' AS open FROM {name}_b WHERE i = 1
      UNION ALL
      SELECT b.doc_id, b.i, r.chunk_no + CASE WHEN {starts} THEN 1 ELSE 0 END,
        CASE WHEN b.kind = 'table' THEN 0 WHEN {starts} THEN b.piece ELSE r.len + b.piece END,
        CASE WHEN b.kind = 'table' THEN '' WHEN {starts} OR r.blang = 'mixed' THEN b.lang ELSE r.blang END,
        b.kind <> 'table'
      FROM {name}_r r JOIN {name}_b b ON b.doc_id = r.doc_id AND b.i = r.i + 1),
    {name} AS MATERIALIZED (SELECT CAST(r.doc_id AS VARCHAR) || '_' || CAST(r.chunk_no AS VARCHAR) AS chunk_id, r.doc_id, CAST(r.chunk_no AS BIGINT) AS chunk_no,
      min(b.kind) AS kind, coalesce(arg_min(b.lang, b.i) FILTER (WHERE b.lang <> 'mixed'), 'mixed') AS language,
      string_agg(b.location, ', ' ORDER BY b.i) AS locations, string_agg('[' || b.location || '] ' || b.text, chr(10) || chr(10) ORDER BY b.i) AS text
      FROM {name}_r r JOIN {name}_b b ON b.doc_id = r.doc_id AND b.i = r.i GROUP BY r.doc_id, r.chunk_no)"""


def sections_sql(patterns: dict[str, str], max_chars: int) -> str:
    """WITH-list entries ``sect(doc_id, section, ord, kind, location, text)`` with the fallback."""
    cls = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in patterns.items())
    return f"""hd AS (SELECT *, kind <> 'table' AND length(text) < 100 AND right(text, 1) NOT IN ('.', ':', ';', ',') AS head FROM blocks),
    cl AS (SELECT *, CASE WHEN head THEN CASE {cls} ELSE 'none' END END AS cls FROM hd),
    cu AS (SELECT *, last_value(cls IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM cl),
    ac AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cu WHERE NOT head AND section IS NOT NULL AND section <> 'none'),
    formal AS (SELECT DISTINCT doc_id FROM cl WHERE cls IS NOT NULL AND cls <> 'none'),
    fb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS down FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM formal)),
    sect AS (SELECT doc_id, section, ord, kind, location, text FROM ac WHERE before < {max_chars}
      UNION ALL SELECT doc_id, 'abstract', ord, kind, location, text FROM fb WHERE up <= 3
      UNION ALL SELECT doc_id, 'conclusion', ord, kind, location, text FROM fb WHERE down <= 3)"""
