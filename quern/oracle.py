"""The same views as common table expressions for DuckDB."""

from __future__ import annotations

from quern.functions.classify import AUDIO, PACKED, VIDEO
from quern.schema import MAP_PAGE, SEAL, SEGMENT_HEADER, SMALL
from quern.views import BLOCK, EXTENSIONS

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_EXT = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
PATH = f"""(CASE WHEN doc_id % 5 = 0 THEN 'bgm/' WHEN doc_id % 9 = 0 THEN 'dlc/' ELSE '' END
  || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.' || {_EXT})"""
EXTENSION = "CASE WHEN contains(path, '.') THEN lower(split_part(path, '.', -1)) ELSE '' END"
_MEDIA = f"({EXTENSION}) IN {_in(AUDIO + VIDEO)}"


def classified(name: str, source: str) -> str:
    ext, s = EXTENSION, SMALL
    return f"""{name} AS (
  SELECT *,
    CASE WHEN ({ext}) IN {_in(VIDEO)} THEN 'streaming'
      WHEN ({ext}) IN {_in(AUDIO)} THEN CASE WHEN list_has_any(string_split(lower(path), '/'), ['bgm', 'music']) OR len > {s.short_audio} THEN 'streaming' ELSE 'transient' END
      WHEN len <= {s.hot_file} THEN 'hot' ELSE 'normal' END AS access,
    CASE WHEN NOT {_MEDIA} AND len > {s.hot_file} AND len <= {s.content_defined} THEN 'content_defined' ELSE 'fixed' END AS layout,
    (CASE WHEN {_MEDIA} THEN {s.stream_block} WHEN len <= {s.hot_file} THEN greatest(len, 1)
      WHEN len <= {s.content_defined} THEN 0 ELSE {s.bulk_block} END)::BIGINT AS fixed_block_len,
    CASE WHEN ({ext}) IN {_in(PACKED)} THEN 'raw' ELSE 'auto' END AS compression,
    CASE WHEN path = 'dlc' OR starts_with(path, 'dlc/') THEN 'deferred' ELSE 'required' END AS availability
  FROM {source})"""


BASE = f"""all_assets AS (
  SELECT doc_id, {PATH} AS path, text, strlen(text)::BIGINT AS len, sha256(text) AS digest FROM documents),
new_assets AS (SELECT * FROM all_assets WHERE doc_id % 13 <> 0),
old_assets AS (
  SELECT doc_id, path, t AS text, strlen(t)::BIGINT AS len, sha256(t) AS digest
  FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS t FROM all_assets WHERE doc_id % 11 <> 0)),
{classified('all_c', 'all_assets')},
{classified('new_c', 'new_assets')},
{classified('old_c', 'old_assets')}"""


def blocks(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT path, access, availability, compression, block_no, block_no * {BLOCK} AS logical_offset,
    octet_length(piece)::BIGINT AS plain_len, sha256(piece) AS chunk_id, 'raw' AS codec, octet_length(piece)::BIGINT + {SEAL} AS stored_len
  FROM (
    SELECT *, encode(text)[block_no * {BLOCK} + 1 : (block_no + 1) * {BLOCK}] AS piece
    FROM (SELECT *, unnest(range(0, CASE WHEN len > 0 THEN (len - 1) // {BLOCK} + 1 ELSE 0 END)) AS block_no FROM {source})))"""


def first(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id, availability, access, plain_len ORDER BY path, block_no) = 1 AS is_first FROM {source})"""


def rotated(name: str, source: str) -> str:
    """Greedy segments of the first blocks of each class; the query must be WITH RECURSIVE."""
    return f"""{name}_o AS (
  SELECT path, block_no, availability, access, stored_len, chunk_id, plain_len, codec,
    row_number() OVER (PARTITION BY availability, access ORDER BY path, block_no) AS rn FROM {source} WHERE is_first),
{name}_r AS (
  SELECT path, block_no, availability, access, stored_len, chunk_id, plain_len, codec, rn, 0::BIGINT AS segment_no, 0::BIGINT AS segment_block_ordinal,
    {SEGMENT_HEADER}::BIGINT AS physical_offset, stored_len::BIGINT AS payload FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT o.path, o.block_no, o.availability, o.access, o.stored_len, o.chunk_id, o.plain_len, o.codec, o.rn,
    CASE WHEN r.payload + o.stored_len > {SMALL.segment} THEN r.segment_no + 1 ELSE r.segment_no END,
    CASE WHEN r.payload + o.stored_len > {SMALL.segment} THEN 0 ELSE r.segment_block_ordinal + 1 END,
    CASE WHEN r.payload + o.stored_len > {SMALL.segment} THEN {SEGMENT_HEADER} ELSE {SEGMENT_HEADER} + r.payload END,
    CASE WHEN r.payload + o.stored_len > {SMALL.segment} THEN o.stored_len ELSE r.payload + o.stored_len END
  FROM {name}_r r JOIN {name}_o o ON o.availability = r.availability AND o.access = r.access AND o.rn = r.rn + 1),
{name} AS (SELECT *, availability || '-' || access || '-' || segment_no AS segment_id FROM {name}_r)"""


SEGMENTS = f"""segs AS (
  SELECT segment_id, availability, access, segment_no, count(*) AS block_count, sum(stored_len)::BIGINT AS payload_len, sum(stored_len)::BIGINT + {SEGMENT_HEADER} AS file_len
  FROM placed GROUP BY ALL)"""
#: References of the new release with the places of their blocks.
REFS = """refs AS (
  SELECT b.*, p.segment_id, p.segment_block_ordinal, p.physical_offset FROM nb b JOIN placed p
    ON b.chunk_id = p.chunk_id AND b.availability = p.availability AND b.access = p.access AND b.plain_len = p.plain_len)"""
PACKED_RELEASE = ",\n".join([BASE, blocks("nb", "new_c"), first("nf", "nb"), rotated("placed", "nf"), SEGMENTS, REFS])

REQUESTS = """req AS (
  SELECT event_id AS request_id, a.path, (event_id * 104729 % 3000)::BIGINT AS "offset", (user_id % 2000)::BIGINT AS n
  FROM events JOIN all_assets a ON a.doc_id = event_id * 7919 % (SELECT max(doc_id) + 1 FROM documents))"""

DIFF = """diff AS (
  SELECT coalesce(s.path, r.path) AS path,
    CASE WHEN r.path IS NULL THEN 'Added' WHEN s.path IS NULL THEN 'Removed' WHEN s.len = r.len AND s.digest = r.digest THEN 'Unchanged' ELSE 'Modified' END AS change,
    s.len AS source_len, r.len AS released_len, coalesce(s.access, r.access) AS access, coalesce(s.availability, r.availability) AS availability
  FROM new_c s FULL JOIN old_c r ON s.path = r.path)"""

PAGE = MAP_PAGE
