"""One query for each operator over the driver tables, and its SQL where SQL has it."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import oracle as O
from quern import views as V
from quern.functions import classify, codec
from quern.functions.paths import is_canonical
from quern.operators import cache, chunk, dedup, lookup, segments, stats, verify
from quern.operators.ordering import with_index, with_running
from quern.plans import diff as D
from quern.plans import pack as P
from quern.schema import MAP_PAGE, RAW, REUSE_PAGE, SEAL, SEGMENT_HEADER, SMALL, Limits
from quern.session import ensure_checkpoint_dir
from quern.sources import bodies, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; sql may use the base views, and the packed release if recursive."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' + O.PACKED_RELEASE if recursive else O.BASE} {sql}"
        return f

    return register


def _c(s: SparkSession, d: str) -> DataFrame:
    return V.classified(V.assets(s, d))


def _new(s: SparkSession, d: str) -> DataFrame:
    return V.classified(V.new_assets(s, d))


def _diff(s: SparkSession, d: str) -> DataFrame:
    return D.diff(D.content_keys(V.new_assets(s, d)), D.content_keys(V.old_assets(s, d)), SMALL, V.DEFERRED)


# sources and listings


@query("src4_catalog", "SELECT path, len, access, layout, availability, compression, fixed_block_len FROM new_c")
def src4(s, d):
    """Written, committed, opened and checked; then its catalog."""
    root = f"{ensure_checkpoint_dir(s).removeprefix('file:')}/store-{uuid.uuid4()}"
    os.makedirs(root)
    atexit.register(shutil.rmtree, root, True)
    store.write(V.release(V.new_assets(s, d)), root, "p")
    store.commit(root, 1)
    release = store.open_release(s, root, "p", at_least=1)
    return release.assets.select("path", "len", "access", "layout", "availability", "compression", "fixed_block_len")


@query("src6_segment_sources", """, d AS (SELECT segment_id, sha256(segment_id) AS h FROM segs)
SELECT h AS segment_id, CASE WHEN h < '8' THEN upper(h) || '.SEG' END AS name, h < '8' AS available FROM d""", recursive=True)
def src6(s, d):
    """Half of the segments have a file, whose name is in capitals; other files stand beside them."""
    table = V.placed_blocks(V.new_assets(s, d))[1].select(F.sha2("segment_id", 256).alias("segment_id"))
    names = table.where("segment_id < '8'").select(F.concat(F.upper("segment_id"), F.lit(".SEG")).alias("name"))
    return lookup.segment_files(table, names.unionByName(s.createDataFrame([("notes.txt",), ("a.seg",)], "name string")))


@query("src10_reuse_records", "SELECT path, block_no, chunk_id, availability, plain_len, stored_len, segment_id, segment_block_ordinal FROM refs", recursive=True)
def src10(s, d):
    refs, _ = V.placed_blocks(V.new_assets(s, d))
    return refs.select("path", "block_no", "chunk_id", "availability", "plain_len", "stored_len", "segment_id", "segment_block_ordinal")


@query("src11_list_assets", "SELECT row_number() OVER (ORDER BY path) - 1 AS file_index, path, len, access FROM new_c")
def src11(s, d):
    return with_index(_new(s, d).select("path", "len", "access"), ["path"], "file_index").orderBy("file_index")


@query("src12_list_segments", "SELECT segment_id, file_len, availability FROM segs", recursive=True)
def src12(s, d):
    return V.placed_blocks(V.new_assets(s, d))[1].select("segment_id", "file_len", "availability").orderBy("segment_id")


_ORDINALS = "(SELECT *, row_number() OVER (ORDER BY segment_id) - 1 AS ordinal FROM segs)"


@query("src13_segment_by_ordinal", f"SELECT segment_id, ordinal, file_len FROM {_ORDINALS} WHERE ordinal = 3", recursive=True)
def src13(s, d):
    table = V.placed_blocks(V.new_assets(s, d))[1]
    return table.join(segments.ordinals(table).where("ordinal = 3"), "segment_id").select("segment_id", "ordinal", "file_len")


# scalar functions


def _scalar(name: str, column: Callable, sql: str) -> None:
    @query(name, f"SELECT path, {sql} AS v FROM all_c")
    def run(s, d):
        return _c(s, d).select("path", column().alias("v"))


_scalar("scl1_extension", lambda: classify.extension(F.col("path")), O.EXTENSION)
_scalar("scl2_packed", lambda: classify.is_packed(F.col("path")), f"({O.EXTENSION}) IN {O._in(classify.PACKED)}")
_scalar("scl3_compression", lambda: F.col("compression"), "compression")
_scalar("scl4_music_folder", lambda: classify.in_music_folder(F.col("path")), "list_has_any(string_split(lower(path), '/'), ['bgm', 'music'])")
_scalar("scl5_access", lambda: F.col("access"), "access")
_scalar("scl6_layout", lambda: F.concat_ws(":", "layout", F.col("fixed_block_len").cast("string")), "layout || ':' || fixed_block_len")
_scalar("scl7_availability", lambda: F.col("availability"), "availability")
_TARGETS = Limits(hot_segment=10_000, normal_segment=30_000, transient_segment=20_000)
_scalar("scl9_segment_target", lambda: classify.segment_target(F.col("access"), _TARGETS, 25_000), "CASE access WHEN 'hot' THEN 10000 WHEN 'normal' THEN 25000 WHEN 'transient' THEN 20000 ELSE 25000 END::BIGINT")
_scalar("win9_slot_capacity", lambda: lookup.slot_capacity(F.col("len")), "(SELECT min(c) FROM (SELECT unnest([1::BIGINT << i for i in range(40)]) AS c) WHERE c >= greatest(2 * len, 1))")
_scalar("scl11_accepts", lambda: classify.accepts(F.col("compression"), F.when(F.col("doc_id") % 2 == 0, RAW).otherwise("zstd")), "compression = 'auto' OR doc_id % 2 = 0")
_scalar("scl12_stored_len", lambda: classify.stored_len(F.col("len")), f"len + {SEAL}")
_scalar("scl13_encoded_valid", lambda: classify.encoded_len_valid(F.when(F.col("doc_id") % 2 == 0, RAW).otherwise("zstd"), F.col("len") + F.col("doc_id") % 20, F.col("len")), f"CASE WHEN doc_id % 2 = 0 THEN doc_id % 20 = {SEAL} ELSE len + doc_id % 20 >= {SEAL} AND doc_id % 20 < {SEAL} END")
_scalar("scl14_chunk_hash", lambda: codec.chunk_id(F.col("content")), "digest")
_scalar("scl15_short_digest", lambda: codec.short_digest(codec.chunk_id(F.col("content"))), "substr(digest, 1, 32)")
_scalar("scl16_path_hash", lambda: codec.path_hash(F.col("path"), "k1"), "('0x' || substr(sha256('k1' || path), 1, 16))::UBIGINT::DECIMAL(20,0)")
_scalar("scl17_segment_file", lambda: codec.segment_file(codec.chunk_id(F.col("content"))), "digest || '.seg'")
_scalar("scl18_human_size", lambda: classify.human_size(F.col("len") * F.pow(F.lit(37), F.col("doc_id") % 5).cast("bigint")), """(
  SELECT CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0)
    ELSE printf('%.1f GiB', n / 1073741824.0) END FROM (SELECT (len * pow(37, doc_id % 5)::BIGINT)::BIGINT AS n))""")
_scalar("scl22_is_empty", lambda: F.col("len") == 0, "len = 0")

_CANONICAL = r"""NOT contains(p, '\') AND len(list_filter(string_split(p, '/'), lambda x: x = '' OR x = '.' OR x = '..' OR regexp_matches(x, '^ |[ .]$')
  OR regexp_matches(x, '[\x00-\x1f<>:"|?*]') OR regexp_matches(x, '^(?i:con|prn|aux|nul|(com|lpt)[1-9¹²³])([.]|$)'))) = 0"""


@query("scl8_canonical_path", f"SELECT p AS path, {_CANONICAL} AS canonical FROM (SELECT path AS p FROM all_assets UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages)")
def scl8(s, d):
    pages = V.read(s, d, "pages")
    paths = V.assets(s, d).select("path").union(pages.select("url")).union(pages.select(F.regexp_replace("url", "^https?://", "")))
    return paths.select("path", is_canonical(F.col("path")).alias("canonical"))


@query("scl19_shown", f", {O.DIFF} SELECT path, change FROM diff WHERE change <> 'Unchanged' AND contains(lower(path), 'src1')")
def scl19(s, d):
    return D.shown(_diff(s, d), "SRC1").select("path", "change")


@query("scl20_shown_len", f", {O.DIFF} SELECT path, change, coalesce(source_len, released_len, 0) AS shown_len FROM diff")
def scl20(s, d):
    return D.shown(_diff(s, d), "", with_unchanged=True).select("path", "change", "shown_len")


@query("scl23_prefixes", "SELECT doc_id, list_filter(list_transform(string_split_regex(source || ' , ,' || lang || chr(10) || ' x', '[,\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS prefixes FROM documents")
def scl23(s, d):
    text = F.concat("source", F.lit(" , ,"), "lang", F.lit("\n x"))
    return V.read(s, d, "documents").select("doc_id", classify.parse_prefixes(text).alias("prefixes"))


@query("scl10_codec", "SELECT path, digest, true AS by_rule, CASE compression WHEN 'raw' THEN 'raw' END AS forced FROM all_c")
def scl10(s, d):
    """What encoding gives: the content comes back, the codec is the one that the rule asks for."""
    a = _c(s, d)
    whole = a.select("path", F.lit(0).cast("bigint").alias("block_no"), F.lit(0).cast("bigint").alias("logical_offset"), F.col("len").alias("plain_len"), codec.chunk_id(F.col("content")).alias("chunk_id"), "compression")
    out = bodies.encode(whole, a, level=3, least_gain=SMALL.zstd_gain).join(a.select("path", "len", "compression", "content"), "path")
    packed = F.octet_length(codec.zstd_column()(F.col("content"))).cast("bigint")
    out = out.select("path", "codec", "encoded", "len", "compression", packed.alias("packed"))
    unpacked = out.where("codec = 'zstd'").withColumn("plain", codec.unzstd_column()(F.col("encoded"), F.col("len"))).unionByName(out.where("codec = 'raw'").withColumn("plain", F.col("encoded")))
    by_rule = F.col("codec") == F.when((F.col("compression") == "auto") & (F.col("packed") + SMALL.zstd_gain < F.col("len")), "zstd").otherwise(RAW)
    return unpacked.select("path", F.sha2("plain", 256).alias("digest"), by_rule.alias("by_rule"), F.when(F.col("compression") == RAW, F.col("codec")).alias("forced"))


@query("scl24_sealed", f"SELECT path, len + {SEAL} AS sealed_len, true AS opens FROM all_assets")
def scl24(s, d):
    key, iv = F.lit(b"0123456789abcdef0123456789abcdef"), codec.nonce(F.lit(b"prefix00"), F.col("doc_id"))
    sealed = V.assets(s, d).withColumn("iv", iv).withColumn("sealed", codec.seal(F.col("content"), key, F.col("iv"), F.col("path")))
    return sealed.select("path", F.octet_length("sealed").cast("bigint").alias("sealed_len"), (codec.unseal(F.col("sealed"), key, F.col("iv"), F.col("path")) == F.col("content")).alias("opens"))


@query("scl29_decoded", "SELECT path, digest FROM all_assets")
def scl29(s, d):
    packed = V.assets(s, d).withColumn("packed", codec.zstd_column()(F.col("content")))
    return packed.select("path", F.sha2(codec.unzstd_column()(F.col("packed"), F.col("len")), 256).alias("digest"))


# blocks


@query("chk1_fixed_blocks", f", {O.blocks('b', 'all_c')} SELECT path, block_no, logical_offset, plain_len, chunk_id FROM b")
def chk1(s, d):
    return V.blocks(V.assets(s, d)).select("path", "block_no", "logical_offset", "plain_len", "chunk_id")


def _laid(blocks: DataFrame, a: DataFrame, least: int, most: int) -> DataFrame:
    """For each asset: that its blocks follow each other and are named by their content, that those but the
    last have least to most bytes, and the digest of what they make up."""
    piece = F.substring("content", (F.col("logical_offset") + 1).cast("int"), F.col("plain_len").cast("int"))
    w = W.partitionBy("path").orderBy("block_no")
    one = blocks.join(a.select("path", "content"), "path").withColumn("piece", piece)
    one = one.withColumn("begin", F.coalesce(F.lag(F.col("logical_offset") + F.col("plain_len")).over(w), F.lit(0))).withColumn("last", F.lead("block_no").over(w).isNull())
    fits = (F.col("plain_len") > 0) & (F.col("plain_len") <= most) & (F.col("last") | (F.col("plain_len") >= least))
    made = one.groupBy("path").agg(
        F.bool_and((F.col("begin") == F.col("logical_offset")) & (F.sha2("piece", 256) == F.col("chunk_id"))).alias("follow"),
        F.bool_and(fits).alias("fit"),
        F.array_sort(F.collect_list(F.struct("block_no", "piece"))).alias("pieces"),
    )
    whole = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y["piece"]))
    return made.select("path", "follow", "fit", F.sha2(whole, 256).alias("digest"))


@query("chk2_content_blocks", "SELECT path, true AS follow, true AS fit, digest FROM all_assets WHERE len > 0")
def chk2(s, d):
    a = V.assets(s, d)
    return _laid(chunk.content_chunks(a.select("path", "content"), SMALL), a, SMALL.chunk_min, SMALL.chunk_max)


@query("chk3_blocks_by_layout", "SELECT path, layout, true AS follow, true AS fit, digest, CASE layout WHEN 'fixed' THEN (len - 1) // fixed_block_len + 1 END AS blocks FROM all_c WHERE len > 0")
def chk3(s, d):
    """In one pass over the bodies, as a build cuts them."""
    a = _c(s, d)
    made = bodies.cut(a, SMALL)
    n = made.groupBy("path").agg(F.count("*").alias("n")).join(a.select("path", "layout"), "path").select("path", "layout", F.when(F.col("layout") == "fixed", F.col("n")).alias("blocks"))
    return _laid(made, a, 1, 16 * SMALL.chunk_max).join(n, "path").select("path", "layout", "follow", "fit", "digest", "blocks")


@query("chk4_chunk_order", f", {O.blocks('b', 'new_c')} SELECT row_number() OVER (ORDER BY path, block_no) - 1 AS index, chunk_id FROM b")
def chk4(s, d):
    return with_index(V.blocks(V.new_assets(s, d)).select("path", "block_no", "chunk_id"), ["path", "block_no"]).select("index", "chunk_id")


@query("chk5_lengths", f", {O.blocks('b', 'all_c')} SELECT path, len, chunked_len FROM (SELECT a.path, a.len, coalesce(sum(plain_len), 0)::BIGINT AS chunked_len FROM all_c a LEFT JOIN b ON a.path = b.path AND (b.block_no <> 1 OR a.doc_id % 4 <> 3) GROUP BY a.path, a.len) WHERE len <> chunked_len")
def chk5(s, d):
    """The second block of every fourth asset is lost."""
    a = V.assets(s, d)
    lost = V.bodies(a).where("block_no <> 1 OR doc_id % 4 <> 3")
    return chunk.length_mismatches(a, lost)


# joins


@query("join1_release_diff", f", {O.DIFF} SELECT * FROM diff")
def join1(s, d):
    return _diff(s, d)


@query("join2_content_equality", "SELECT n.path, n.len = o.len AND n.digest = o.digest AS same FROM new_assets n JOIN old_assets o ON n.path = o.path")
def join2(s, d):
    n, o = D.content_keys(V.new_assets(s, d)), D.content_keys(V.old_assets(s, d))
    pair = n.join(o.select("path", F.col("len").alias("l"), F.col("digest").alias("g")), "path")
    return pair.select("path", ((F.col("len") == F.col("l")) & (F.col("digest") == F.col("g"))).alias("same"))


_STALE = """SELECT coalesce(s.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' ELSE 'resized' END AS reason
  FROM new_assets s FULL JOIN old_assets r ON s.path = r.path WHERE s.len IS DISTINCT FROM r.len"""


@query("join3_stale_plan", _STALE)
def join3(s, d):
    return D.stale(V.new_assets(s, d), V.old_assets(s, d))


_REUSE = f""", {O.blocks('ob', 'old_c')}, {O.blocks('nb', 'new_c')}, {O.first('nf', 'nb')},
ix AS (SELECT chunk_id, availability, arg_min(plain_len, path || ':' || lpad(block_no::VARCHAR, 9, '0')) AS l, arg_min(codec, path) AS c,
  arg_min(path, path || ':' || lpad(block_no::VARCHAR, 9, '0')) AS segment_id FROM ob GROUP BY 1, 2),
r AS (SELECT nf.path, nf.block_no, nf.chunk_id, CASE WHEN NOT is_first THEN 'self' WHEN ix.l = plain_len THEN 'release' ELSE 'new' END AS origin, ix.segment_id
  FROM nf LEFT JOIN ix ON nf.chunk_id = ix.chunk_id AND nf.availability = ix.availability)"""


def _reused(s, d):
    old = V.blocks(V.old_assets(s, d)).withColumn("segment_id", F.col("path")).withColumn("global_index", F.concat("path", F.lit(":"), F.lpad(F.col("block_no").cast("string"), 9, "0")))
    released = old.select("chunk_id", "availability", "plain_len", "codec", "segment_id", "global_index")
    return dedup.reuse(V.blocks(V.new_assets(s, d)), released)


@query("join4_reuse", _REUSE + " SELECT path, block_no, origin, CASE WHEN origin = 'release' THEN segment_id END AS reused_segment_id FROM r")
def join4(s, d):
    return _reused(s, d).select("path", "block_no", "origin", "reused_segment_id")


@query("join5_reuse_index", _REUSE + " SELECT chunk_id, availability, segment_id FROM ix")
def join5(s, d):
    old = V.blocks(V.old_assets(s, d)).withColumn("segment_id", F.col("path")).withColumn("global_index", F.concat("path", F.lit(":"), F.lpad(F.col("block_no").cast("string"), 9, "0")))
    return dedup.reuse_index(old.select("chunk_id", "availability", "plain_len", "segment_id", "global_index")).select("chunk_id", "availability", "segment_id")


@query("join6_segment_ordinals", f"SELECT r.path, r.block_no, o.ordinal FROM refs r JOIN {_ORDINALS} o ON r.segment_id = o.segment_id", recursive=True)
def join6(s, d):
    refs, table = V.placed_blocks(V.new_assets(s, d))
    return refs.join(segments.ordinals(table), "segment_id").select("path", "block_no", "ordinal")


@query("join7_path_lookup", "SELECT path, len, access FROM new_c WHERE path IN (SELECT path FROM all_assets WHERE doc_id % 4 = 1)")
def join7(s, d):
    return lookup.find_assets(_new(s, d), V.assets(s, d).where("doc_id % 4 = 1").select("path")).select("path", "len", "access")


@query("join7b_path_absent", "SELECT path FROM all_assets WHERE doc_id % 4 = 1 AND path NOT IN (SELECT path FROM new_c)")
def join7b(s, d):
    return lookup.absent(_new(s, d), V.assets(s, d).where("doc_id % 4 = 1").select("path"))


@query("join8_unchanged_since", "SELECT n.path FROM new_c n JOIN old_c o ON n.path = o.path AND n.len = o.len WHERE n.doc_id % 3 <> 0")
def join8(s, d):
    n = _new(s, d).withColumn("mtime", F.lit(1))
    b = V.blocks(V.old_assets(s, d))
    listed = b.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("logical_offset", "plain_len", "chunk_id"))).alias("chunks"))
    cached = V.classified(V.old_assets(s, d)).withColumn("mtime", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)).join(listed, "path", "left")
    return dedup.unchanged_since(n.select("path", "len", "mtime", "access", "compression"), cached.select("path", "len", "mtime", "access", "compression", "chunks"), b.select("chunk_id"))


@query("join9_segment_headers", """, h AS (SELECT segment_id, count(*) AS block_count, sum(stored_len)::BIGINT AS payload_len FROM placed WHERE plain_len % 7 <> 3 GROUP BY 1),
  c AS (SELECT segs.*, h.block_count AS n, h.payload_len AS p FROM segs LEFT JOIN h USING (segment_id))
SELECT segment_id, 'availability' AS field FROM c WHERE n IS NULL UNION ALL SELECT segment_id, 'block_count' FROM c WHERE block_count IS DISTINCT FROM n
UNION ALL SELECT segment_id, 'payload_len' FROM c WHERE payload_len IS DISTINCT FROM p UNION ALL SELECT segment_id, 'file_len' FROM c WHERE payload_len IS DISTINCT FROM p""", recursive=True)
def join9(s, d):
    """Headers of the segments as they are on disk, from which some blocks were lost."""
    stored = V.stored(V.new_assets(s, d))
    headers = segments.segment_table(stored.where("plain_len % 7 <> 3")).withColumn("segment_id", V.segment_name())
    return verify.header_mismatches(headers, segments.segment_table(stored).withColumn("segment_id", V.segment_name()))


@query("join10_not_installed", "SELECT segment_id, availability FROM segs WHERE availability = 'required' AND segment_no % 2 <> 0", recursive=True)
def join10(s, d):
    table = V.placed_blocks(V.new_assets(s, d))[1]
    return verify.not_installed(table, table.where("segment_no % 2 = 0")).select("segment_id", "availability")


@query("join11_fixed_lookup", f', {O.REQUESTS} SELECT request_id, "offset" // fixed_block_len AS block_no FROM req JOIN all_c USING (path) WHERE fixed_block_len > 0 AND "offset" < len')
def join11(s, d):
    return lookup.block_of_offset(V.requests(s, d), _c(s, d)).select("request_id", "block_no")


_B = O.blocks("b", "all_c")


@query("join12_as_of_lookup", f', {O.REQUESTS}, {_B} SELECT request_id, block_no, logical_offset FROM req JOIN b ON req.path = b.path AND logical_offset <= "offset" AND "offset" < logical_offset + plain_len')
def join12(s, d):
    return lookup.block_as_of(V.requests(s, d), V.blocks(V.assets(s, d))).select("request_id", "block_no", "logical_offset")


@query("join13_uncovered", f', {O.REQUESTS} SELECT request_id FROM req JOIN all_assets a ON req.path = a.path WHERE "offset" >= len')
def join13(s, d):
    return lookup.uncovered(V.requests(s, d), V.blocks(V.assets(s, d))).select("request_id")


_READ = f""", {O.REQUESTS} SELECT request_id, CASE WHEN "offset" > len THEN 'out_of_range' ELSE 'ok' END AS status,
  CASE WHEN "offset" <= len THEN sha256(CASE WHEN n > 0 THEN encode(text)["offset" + 1 : "offset" + n] ELSE encode('') END) END AS digest FROM req JOIN all_assets a ON req.path = a.path"""


@query("join14_range_read", _READ)
def join14(s, d):
    a = V.assets(s, d)
    body = V.blocks(a).join(a.select("path", F.col("content").alias("whole")), "path")
    contents = body.select("path", "block_no", "logical_offset", "plain_len", F.substring("whole", (F.col("logical_offset") + 1).cast("int"), F.col("plain_len").cast("int")).alias("content"))
    return lookup.read_ranges(V.requests(s, d), a.select("path", "len"), contents).select("request_id", "status", F.sha2("data", 256).alias("digest"))


@query("join14b_range_blocks", f', {O.REQUESTS}, {_B} SELECT request_id, block_no, greatest("offset", logical_offset) - logical_offset AS take_from, least("offset" + n, logical_offset + plain_len) - greatest("offset", logical_offset) AS take_len FROM req JOIN b ON req.path = b.path AND logical_offset < "offset" + n AND "offset" < logical_offset + plain_len')
def join14b(s, d):
    return lookup.range_blocks(V.requests(s, d), V.blocks(V.assets(s, d))).select("request_id", "block_no", "take_from", "take_len")


_INDEX = f", {O.blocks('b', 'new_c')}, i AS (SELECT *, row_number() OVER (ORDER BY path, block_no) - 1 AS index FROM b)"


def _indexed(s, d):
    return with_index(V.blocks(V.new_assets(s, d)).select("path", "block_no", "chunk_id", "plain_len", "stored_len"), ["path", "block_no"])


@query("join15_page_of_block", _INDEX + f" SELECT path, block_no, index // {MAP_PAGE} AS page_id, index % {MAP_PAGE} AS slot FROM i")
def join15(s, d):
    return _indexed(s, d).select("path", "block_no", *lookup.page_of("index", MAP_PAGE))


@query("join16_garbage", "SELECT digest AS name FROM all_assets WHERE digest NOT IN (SELECT digest FROM new_assets) GROUP BY digest")
def join16(s, d):
    digest = lambda df: df.select(F.sha2("content", 256).alias("segment_id"))
    files = digest(V.assets(s, d)).distinct().select(F.col("segment_id").alias("name")).union(s.createDataFrame([("notes.txt",), ("ab",)], "name string"))
    return verify.unreferenced(files, digest(V.new_assets(s, d))).select("name")


@query("join17_zip", _INDEX + ", j AS (SELECT index, chunk_id FROM i) SELECT i.path, i.block_no, j.chunk_id FROM i JOIN j ON i.index = j.index")
def join17(s, d):
    i = _indexed(s, d)
    return i.select("path", "block_no", "index").join(i.select("index", "chunk_id"), "index").select("path", "block_no", "chunk_id")


# aggregates


@query("agg1_source_bytes", "SELECT sum(len)::BIGINT AS source_bytes FROM new_assets")
def agg1(s, d):
    return stats.total_bytes(V.new_assets(s, d))


@query("agg2_changed_bytes", f", {O.DIFF} SELECT coalesce(sum(source_len) FILTER (change IN ('Added', 'Modified')), 0)::BIGINT AS changed_source_bytes FROM diff")
def agg2(s, d):
    return stats.changed_bytes(_diff(s, d))


_FIRST = f", {O.blocks('nb', 'new_c')}, {O.first('nf', 'nb')}"


@query("agg3_dedup", _FIRST + " SELECT path, block_no, is_first FROM nf")
def agg3(s, d):
    return dedup.first_in_release(V.blocks(V.new_assets(s, d))).select("path", "block_no", "is_first")


_POLICY = f""", {O.blocks('nb', 'new_c')}, k AS (SELECT *, CASE WHEN compression = 'auto' AND chunk_id < '8' THEN 'zstd' ELSE 'raw' END AS own, (path, lpad(block_no::VARCHAR, 9, '0')) AS place FROM nb),
g AS (SELECT *, min(place) OVER w AS f, first(own) OVER (PARTITION BY chunk_id, availability, access, plain_len ORDER BY place) AS c, min(CASE WHEN compression = 'raw' THEN place END) OVER w AS r
  FROM k WINDOW w AS (PARTITION BY chunk_id, availability, access, plain_len))
SELECT path, block_no, place = f OR (c <> 'raw' AND coalesce(place = r, false)) AS is_first FROM g"""


@query("agg3b_dedup_by_policy", _POLICY)
def agg3b(s, d):
    """Half of the chunks stand for those that compress: policies that take raw blocks only store them again."""
    own = F.when((F.col("compression") == "auto") & (F.col("chunk_id") < "8"), "zstd").otherwise(RAW)
    return dedup.first_in_release(V.blocks(V.new_assets(s, d)).withColumn("codec", own)).select("path", "block_no", "is_first")


@query("agg4_block_counts", _FIRST + " SELECT count(*) AS total_blocks, count(*) FILTER (is_first) AS new_blocks, count(*) FILTER (NOT is_first) AS reused_blocks FROM nf")
def agg4(s, d):
    return dedup.counts(dedup.first_in_release(V.blocks(V.new_assets(s, d))))


_STORAGE = """SELECT (SELECT sum(file_len)::BIGINT FROM segs) AS retained, (SELECT sum(stored_len)::BIGINT FROM u) AS referenced,
  ((SELECT sum(payload_len) FROM segs) - (SELECT sum(stored_len) FROM u))::BIGINT AS stranded"""


@query("agg5_storage", ", u AS (SELECT DISTINCT segment_id, segment_block_ordinal, stored_len FROM refs WHERE block_no % 3 <> 2) " + _STORAGE, recursive=True)
def agg5(s, d):
    refs, table = V.placed_blocks(V.new_assets(s, d))
    return stats.storage(table, refs.where("block_no % 3 <> 2"))


@query("agg6_storage_of_release", ", u AS (SELECT DISTINCT segment_id, segment_block_ordinal, stored_len FROM refs) " + _STORAGE, recursive=True)
def agg6(s, d):
    refs, table = V.placed_blocks(V.new_assets(s, d))
    return stats.storage(table, refs)


_LEVELS = "".join(f""",
l{w} AS (SELECT substr(place, 1, {w}) AS place, sha256(string_agg(digest, ',' ORDER BY place, digest)) AS digest FROM {f'l{w + 2}' if w < stats.FINGERPRINT_WIDTH else 'own'} GROUP BY 1)""" for w in range(stats.FINGERPRINT_WIDTH, -1, -2))
_PRINT = f""", cid AS (SELECT path, string_agg(chunk_id, ',' ORDER BY block_no) AS ids FROM nb GROUP BY path),
own AS (SELECT sha256(path) AS place, sha256(concat_ws('|', path, len::VARCHAR, layout, access, availability, compression, fixed_block_len::VARCHAR, coalesce(ids, ''))) AS digest FROM new_c LEFT JOIN cid USING (path)){_LEVELS}"""


@query("agg7_report", f"""{_PRINT}, u AS (SELECT DISTINCT segment_id, segment_block_ordinal, stored_len FROM refs)
SELECT true AS changed, 1::BIGINT AS release_sequence, (SELECT sum(len)::BIGINT FROM new_c) AS source_bytes, (SELECT count(*) FROM new_c) AS files, (SELECT count(*) FROM nf) AS total_blocks,
  (SELECT count(*) FROM placed) AS new_blocks, (SELECT count(*) FROM nf WHERE NOT is_first) AS reused_blocks, (SELECT count(*) FROM segs) AS segments, (SELECT count(*) FROM segs) AS new_segments,
  (SELECT digest FROM l0) AS source_fingerprint, (SELECT sum(file_len)::BIGINT FROM segs) AS retained, (SELECT sum(stored_len)::BIGINT FROM u) AS referenced,
  ((SELECT sum(payload_len) FROM segs) - (SELECT sum(stored_len) FROM u))::BIGINT AS stranded""", recursive=True)
def agg7(s, d):
    """The report that a build of these blocks makes."""
    release, marked = V.marked_release(V.new_assets(s, d))
    n = marked.agg(F.count("*").alias("n"), F.count_if("is_first").alias("new")).first()
    total = stats.total_bytes(release.assets).first().source_bytes
    report = P._report(release, True, total, n.n, n.new, n.n - n.new, release.segments.count(), stats.checked_storage(release.segments, release.blocks))
    return s.createDataFrame([tuple(report.values())], ", ".join(f"{k} {'boolean' if k == 'changed' else 'string' if k == 'source_fingerprint' else 'bigint'}" for k in report))


@query("agg8_fingerprint", f", {O.blocks('nb', 'new_c')}" + _PRINT + " SELECT digest AS source_fingerprint FROM l0")
def agg8(s, d):
    return stats.fingerprint(_new(s, d), V.blocks(V.new_assets(s, d)))


@query("agg9_changes", f", {O.DIFF} SELECT change, count(*) AS assets FROM diff GROUP BY 1")
def agg9(s, d):
    return stats.by_change(_diff(s, d))


@query("agg10_by_availability", "SELECT availability, count(*) AS segments, sum(file_len)::BIGINT AS bytes FROM segs GROUP BY 1", recursive=True)
def agg10(s, d):
    return stats.by_availability(V.placed_blocks(V.new_assets(s, d))[1])


@query("agg11_plan_totals", f", {O.DIFF} SELECT coalesce(sum(source_len), 0)::BIGINT AS source_bytes, coalesce(sum(source_len) FILTER (change IN ('Added', 'Modified')), 0)::BIGINT AS changed_source_bytes, count(source_len) AS sources, count(*) FILTER (change <> 'Unchanged') AS changes FROM diff")
def agg11(s, d):
    return D.totals(_diff(s, d))


@query("agg12_segments", "SELECT availability, access, segment_no, block_count, payload_len, file_len FROM segs", recursive=True)
def agg12(s, d):
    return segments.segment_table(V.stored(V.new_assets(s, d)))


@query("agg13_repeated", "SELECT digest, count(*) AS n FROM all_assets GROUP BY 1 HAVING count(*) > 1")
def agg13(s, d):
    return dedup.repeated(D.content_keys(V.assets(s, d)), "digest")


@query("agg14_amplification", f', {O.REQUESTS}, {_B} SELECT access, CASE WHEN sum(l) > 0 THEN sum(p) / sum(l) ELSE 0 END AS amplification FROM (SELECT access, plain_len AS p, least("offset" + n, logical_offset + plain_len) - greatest("offset", logical_offset) AS l FROM req JOIN b ON req.path = b.path AND logical_offset < "offset" + n AND "offset" < logical_offset + plain_len) GROUP BY 1')
def agg14(s, d):
    b = V.blocks(V.assets(s, d))
    taken = lookup.range_blocks(V.requests(s, d), b).join(b.select("path", "block_no", "access"), ["path", "block_no"])
    return taken.groupBy("access").agg(stats.amplification("plain_len", "take_len"))


_SEGMENT_ID = "sha256(concat_ws('|', 'b1', availability, access, segment_no::VARCHAR, string_agg(chunk_id, ',' ORDER BY segment_block_ordinal)))"


@query("agg15_segment_digests", f"SELECT availability, access, segment_no, {_SEGMENT_ID} AS segment_id FROM placed GROUP BY 1, 2, 3", recursive=True)
def agg15(s, d):
    placed = V.stored(V.new_assets(s, d))
    return segments.segment_ids(placed.drop("chunk_id"), placed, "b1")


# ordered computations

_SPANS = f""", {O.blocks('b', 'new_c')}, c AS (SELECT a.path, count(b.path) AS block_count FROM new_c a LEFT JOIN b ON a.path = b.path GROUP BY 1)
SELECT path, block_count, coalesce(sum(block_count) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_block FROM c"""


@query("win1_block_spans", _SPANS)
def win1(s, d):
    a = V.new_assets(s, d)
    counted = a.select("path").join(V.blocks(a).groupBy("path").agg(F.count("*").alias("block_count")), "path", "left").withColumn("block_count", F.coalesce("block_count", F.lit(0).cast("bigint")))
    return with_running(counted, ["path"], {"first_block": F.col("block_count")})


@query("win2_path_pool", "SELECT path, coalesce(sum(strlen(path)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pool_offset FROM new_c")
def win2(s, d):
    return with_running(V.new_assets(s, d).select("path"), ["path"], {"pool_offset": F.octet_length("path").cast("bigint")})


@query("win3_physical_offsets", f"""SELECT path, block_no, segment_id, {SEGMENT_HEADER} + coalesce(sum(stored_len) OVER (PARTITION BY segment_id ORDER BY path, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS physical_offset FROM placed""", recursive=True)
def win3(s, d):
    placed = V.stored(V.new_assets(s, d)).withColumn("segment_id", V.segment_name()).drop("segment_block_ordinal", "physical_offset")
    return segments.offsets_in_segment(placed).select("path", "block_no", "segment_id", "physical_offset")


@query("win4_segment_rotation", "SELECT path, block_no, availability, access, segment_no, segment_block_ordinal, physical_offset FROM placed", recursive=True)
def win4(s, d):
    return V.stored(V.new_assets(s, d)).select("path", "block_no", "availability", "access", "segment_no", "segment_block_ordinal", "physical_offset")


@query("win5_contiguity", f", {O.blocks('b', 'new_c')} SELECT path, block_no, logical_offset, coalesce(lag(logical_offset + plain_len) OVER (PARTITION BY path ORDER BY block_no), 0) = logical_offset AS contiguous FROM b")
def win5(s, d):
    w = W.partitionBy("path").orderBy("block_no")
    before = F.coalesce(F.lag(F.col("logical_offset") + F.col("plain_len")).over(w), F.lit(0))
    return V.blocks(V.new_assets(s, d)).select("path", "block_no", "logical_offset", (before == F.col("logical_offset")).alias("contiguous"))


@query("win6_pages", _INDEX + f" SELECT index // {MAP_PAGE} AS page_id, min(index) AS first_record, count(*) AS records FROM i GROUP BY 1")
def win6(s, d):
    return _indexed(s, d).groupBy(lookup.page_of("index", MAP_PAGE)[0]).agg(F.min("index").alias("first_record"), F.count("*").alias("records"))


@query("win7_page_offsets", _INDEX + f", p AS (SELECT index // {REUSE_PAGE} AS page_id, count(*) * 80 AS bytes FROM i GROUP BY 1) SELECT page_id, row_number() OVER (ORDER BY page_id) AS nonce_ordinal, coalesce(sum(bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM p")
def win7(s, d):
    pages = _indexed(s, d).groupBy(lookup.page_of("index", REUSE_PAGE)[0]).agg((F.count("*") * 80).alias("bytes"))
    run = with_running(pages, ["page_id"], {"i": F.lit(1).cast("bigint"), "page_offset": F.col("bytes")})
    return run.select("page_id", (F.col("i") + 1).alias("nonce_ordinal"), "page_offset")


@query("win8_block_ordinals", "SELECT path, block_no, segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY path, block_no) - 1 AS segment_block_ordinal FROM placed", recursive=True)
def win8(s, d):
    placed = V.stored(V.new_assets(s, d)).withColumn("segment_id", V.segment_name()).drop("segment_block_ordinal", "physical_offset")
    return segments.offsets_in_segment(placed).select("path", "block_no", "segment_id", "segment_block_ordinal")


# sorts and sets


@query("srt1_by_path", "SELECT path, len FROM new_assets ORDER BY path")
def srt1(s, d):
    return V.new_assets(s, d).select("path", "len").orderBy("path")


@query("srt2_segment_order", f"SELECT segment_id, ordinal FROM {_ORDINALS}", recursive=True)
def srt2(s, d):
    return segments.ordinals(V.placed_blocks(V.new_assets(s, d))[1])


@query("srt3_first_open", "SELECT availability, access, min(segment_no) AS segment_no FROM segs GROUP BY 1, 2", recursive=True)
def srt3(s, d):
    return segments.first_open(V.placed_blocks(V.new_assets(s, d))[1])


@query("srt4_first_stale", f"SELECT * FROM ({_STALE}) ORDER BY path LIMIT 1")
def srt4(s, d):
    return D.stale(V.new_assets(s, d), V.old_assets(s, d)).orderBy("path").limit(1)


@query("set1_active_segments", "SELECT segment_id FROM segs UNION SELECT DISTINCT path FROM old_assets WHERE doc_id % 50 = 1", recursive=True)
def set1(s, d):
    used = V.old_assets(s, d).where("doc_id % 50 = 1").select(F.col("path").alias("segment_id"))
    return segments.active(used, V.placed_blocks(V.new_assets(s, d))[1].select("segment_id"))


@query("set2_difference", "SELECT path FROM old_assets EXCEPT SELECT path FROM new_assets")
def set2(s, d):
    return V.old_assets(s, d).select("path").join(V.new_assets(s, d).select("path"), "path", "left_anti")


@query("set3_distinct_blocks", "SELECT segment_id, segment_block_ordinal, min(stored_len) AS stored_len FROM refs GROUP BY 1, 2", recursive=True)
def set3(s, d):
    refs, _ = V.placed_blocks(V.new_assets(s, d))
    return refs.groupBy("segment_id", "segment_block_ordinal").agg(F.min("stored_len").alias("stored_len"))


@query("set4_left_over", f", {O.DIFF} SELECT path, released_len FROM diff WHERE change = 'Removed'")
def set4(s, d):
    return _diff(s, d).where("change = 'Removed'").select("path", "released_len")


# runtime


@query("rt1_clock_cache")
def rt1(s, d):
    return cache.replay(V.trace(s, d), cache.Budget(20_000, 0, 0)).select("session", "block", "source")


def _replayed(ahead: bool, probation: int, select: str, only: str = "true") -> str:
    """SQL of a replay whose budgets are never spent: a session's state is the blocks kept, those read
    ahead, those that wait for their second access, and the last two of its streams."""
    return f""", e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, path AS block, len AS size, access, event_id % 10 = 0 AS prefetch
  FROM events JOIN all_c ON doc_id = (user_id * 7919 + event_id % 3 * 101) % (SELECT max(doc_id) + 1 FROM documents) WHERE {only}),
s AS (
  SELECT DISTINCT session, 0::BIGINT AS rn, ''::VARCHAR AS source, ''::VARCHAR AS access, []::VARCHAR[] AS kept, []::VARCHAR[] AS ahead, []::VARCHAR[] AS waits, NULL::VARCHAR AS older, NULL::VARCHAR AS newer FROM e
  UNION ALL
  SELECT e.session, e.rn,
    CASE WHEN e.prefetch THEN CASE WHEN {ahead} AND size > 0 AND NOT list_contains(kept, block) AND NOT list_contains(ahead, block) THEN 'ahead' ELSE 'skipped' END
      WHEN e.access = 'streaming' AND (block = coalesce(older, '') OR block = coalesce(newer, '')) THEN 'window'
      WHEN list_contains(kept, block) THEN 'cache' WHEN list_contains(ahead, block) THEN 'prefetch' ELSE 'backend' END,
    e.access,
    CASE WHEN NOT e.prefetch AND NOT list_contains(kept, block) AND NOT list_contains(ahead, block) AND (e.access = 'hot' OR e.access = 'normal' AND list_contains(waits, block)) THEN list_append(kept, block) ELSE kept END,
    CASE WHEN e.prefetch AND {ahead} AND size > 0 AND NOT list_contains(kept, block) AND NOT list_contains(ahead, block) THEN list_append(ahead, block) ELSE ahead END,
    CASE WHEN e.prefetch OR e.access <> 'normal' OR list_contains(kept, block) OR list_contains(ahead, block) THEN waits
      WHEN list_contains(waits, block) THEN list_filter(waits, lambda x: x <> block)
      ELSE list_append(CASE WHEN len(waits) >= {probation} THEN waits[2:] ELSE waits END, block) END,
    CASE WHEN e.prefetch OR e.access <> 'streaming' OR block = coalesce(newer, '') THEN older ELSE newer END,
    CASE WHEN e.prefetch OR e.access <> 'streaming' THEN newer ELSE block END
  FROM s JOIN e ON s.session = e.session AND e.rn = s.rn + 1)
{select}"""


@query("rt3_admission", _replayed(False, 8, "SELECT access, source, count(*) AS n FROM s WHERE rn > 0 GROUP BY 1, 2"), recursive=True)
def rt3(s, d):
    return cache.replay(V.trace(s, d), cache.Budget(1 << 40, 0, 8)).groupBy("access", "source").agg(F.count("*").alias("n"))


@query("rt4_admission_rule", "SELECT path, CASE access WHEN 'hot' THEN 'always' WHEN 'normal' THEN 'second' ELSE 'never' END AS admission FROM all_c")
def rt4(s, d):
    return _c(s, d).select("path", cache.admission(F.col("access")).alias("admission"))


@query("rt2_open_segments", """, e AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, source AS segment_id
  FROM events JOIN documents ON doc_id = (user_id * 7919 + event_id % 3 * 101) % (SELECT max(doc_id) + 1 FROM documents)),
s AS (SELECT DISTINCT session, 0::BIGINT AS event_id, 0::BIGINT AS rn, false AS opened, []::VARCHAR[] AS held FROM e
  UNION ALL SELECT e.session, e.event_id, e.rn, NOT list_contains(held, segment_id), (list_filter(held, lambda x: x <> segment_id) || [segment_id])[-2:] FROM s JOIN e ON s.session = e.session AND e.rn = s.rn + 1)
SELECT session, event_id, opened FROM s WHERE rn > 0""", recursive=True)
def rt2(s, d):
    """Sources stand for segments, of which two stay open."""
    docs = V.read(s, d, "documents").select("doc_id", F.col("source").alias("segment_id"))
    n_docs = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    e = V.read(s, d, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), ((F.col("user_id") * 7919 + F.col("event_id") % 3 * 101) % n_docs).alias("doc_id"))
    return cache.segment_opens(e.join(docs, "doc_id"), cache.Budget(open_segments=2)).select("session", "seq.event_id", "opened")


@query("rt5_prefetch", _replayed(True, 8, "SELECT source, count(*) AS n FROM s WHERE rn > 0 GROUP BY 1"), recursive=True)
def rt5(s, d):
    return cache.replay(V.trace(s, d), cache.Budget(1 << 40, 1 << 40, 8)).groupBy("source").agg(F.count("*").alias("n"))


@query("rt5b_prefetch_range", f', {O.REQUESTS}, {_B} SELECT request_id % 50 AS session, request_id, req.path || \':\' || block_no AS block, plain_len AS size FROM req JOIN b ON req.path = b.path AND logical_offset < "offset" + n AND "offset" < logical_offset + plain_len WHERE plain_len <= 1000')
def rt5b(s, d):
    asked = V.requests(s, d).withColumn("session", F.col("request_id") % 50)
    return lookup.prefetch_trace(asked, V.blocks(V.assets(s, d)), 1000).select("session", "seq.request_id", "block", "size")


@query("rt7_streaming_window", _replayed(False, 0, "SELECT session, source, count(*) AS n FROM s WHERE rn > 0 GROUP BY 1, 2", "access = 'streaming'"), recursive=True)
def rt7(s, d):
    return cache.replay(V.trace(s, d).where("access = 'streaming'"), cache.Budget(0, 0, 0)).groupBy("session", "source").agg(F.count("*").alias("n"))


@query("rt11_read", """SELECT path, k, CASE WHEN "offset" > len THEN 'out_of_range' ELSE 'ok' END AS status, CASE WHEN "offset" <= len THEN greatest(0, least(n, len - "offset")) END AS bytes
  FROM (SELECT path, len, k, greatest(0, len + k - 3) AS "offset", k * 2 AS n FROM all_assets, (SELECT unnest([0, 1, 2, 3, 4]) AS k))""")
def rt11(s, d):
    """Reads about the end of each asset."""
    a = V.assets(s, d)
    asked = a.select("path", "len", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    asked = asked.select(F.struct("path", "k").alias("request_id"), "path", F.greatest(F.lit(0), F.col("len") + F.col("k") - 3).cast("bigint").alias("offset"), (F.col("k") * 2).cast("bigint").alias("n"))
    got = lookup.read_ranges(asked, a.select("path", "len"), V.bodies(a))
    return got.select("request_id.path", "request_id.k", "status", F.octet_length("data").cast("bigint").alias("bytes"))


# integrity


@query("int1_segment_content", f"SELECT segment_id FROM (SELECT segment_no, {_SEGMENT_ID} AS segment_id FROM placed GROUP BY availability, access, segment_no) WHERE segment_no % 4 = 1", recursive=True)
def int1(s, d):
    """In every fourth segment the first block is damaged; all contents are hashed again."""
    stored = V.stored(V.new_assets(s, d))
    recorded = segments.segment_ids(stored.drop("chunk_id"), stored, "b1")
    body = stored.join(V.bodies(V.new_assets(s, d)).select("path", "block_no", "content"), ["path", "block_no"])
    damaged = F.when((F.col("segment_no") % 4 == 1) & (F.col("segment_block_ordinal") == 0), F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))
    now = body.select("path", "block_no", codec.chunk_id(damaged).alias("chunk_id"))
    return verify.segment_mismatches(recorded, segments.segment_ids(stored.drop("chunk_id"), now, "b1"))


@query("int2_block_content", f", {O.blocks('b', 'new_c')} SELECT path, block_no FROM b WHERE block_no % 5 = 4")
def int2(s, d):
    a = V.new_assets(s, d)
    b = V.blocks(a)
    body = b.join(a.select("path", F.col("content").alias("whole")), "path")
    piece = F.substring("whole", (F.col("logical_offset") + 1).cast("int"), F.col("plain_len").cast("int"))
    damaged = body.select("path", "block_no", F.when(F.col("block_no") % 5 == 4, F.concat(piece, F.lit(b"x"))).otherwise(piece).alias("content"))
    return verify.block_mismatches(b, damaged)


@query("int3_page_digests", _INDEX + f" SELECT index // {MAP_PAGE} AS page_id, sha256(string_agg(chunk_id, ',' ORDER BY index)) AS digest FROM i GROUP BY 1")
def int3(s, d):
    listed = F.array_sort(F.collect_list(F.struct("index", "chunk_id")))
    return _indexed(s, d).groupBy(lookup.page_of("index", MAP_PAGE)[0]).agg(F.sha2(F.concat_ws(",", F.transform(listed, lambda x: x["chunk_id"])), 256).alias("digest"))


_RULES = f""", n AS (SELECT path, count(*) AS n, sum(plain_len) AS bytes FROM refs GROUP BY 1), j AS (SELECT a.*, coalesce(n.n, 0) AS have, coalesce(bytes, 0) AS got FROM new_c a LEFT JOIN n USING (path))
SELECT 'segment length is header and payload' AS rule, count(*) FILTER (file_len <> payload_len + {SEGMENT_HEADER}) AS violations FROM segs
UNION ALL SELECT 'block span', count(*) FILTER (have <> (len + {O.BLOCK - 1}) // {O.BLOCK}) FROM j
UNION ALL SELECT 'blocks cover the asset', count(*) FILTER (got <> len) FROM j
UNION ALL SELECT 'fixed block length', count(*) FILTER (CASE WHEN layout = 'fixed' THEN len > 0 AND fixed_block_len <= 0 ELSE fixed_block_len <> 0 END) FROM j
UNION ALL SELECT 'encoded length', count(*) FILTER (stored_len <> plain_len + {SEAL}) FROM refs
UNION ALL SELECT 'block length', count(*) FILTER (plain_len <= 0 OR plain_len > 1048576) FROM refs
UNION ALL SELECT 'blocks are contiguous', 0
UNION ALL SELECT 'segments have ids of their own', count(*) - count(DISTINCT segment_id) FROM segs
UNION ALL SELECT 'blocks have places of their own', count(*) - count(DISTINCT (path, block_no)) FROM refs
UNION ALL SELECT 'stored blocks have one content', count(*) FROM (SELECT 1 FROM refs GROUP BY segment_id, segment_block_ordinal HAVING count(DISTINCT chunk_id) > 1)"""


@query("int5_catalog_rules", _RULES, recursive=True)
def int5(s, d):
    refs, table = V.placed_blocks(V.new_assets(s, d))
    a = _new(s, d).withColumn("block_count", F.floor((F.col("len") + V.BLOCK - 1) / V.BLOCK))
    return verify.catalog_violations(a, refs, table)


@query("int6_rollback", "SELECT * FROM (SELECT c_custkey AS client, c_custkey % 30 AS release_sequence, (SELECT max(event_id % 40) FROM events WHERE user_id = c_custkey) AS required FROM customer) WHERE release_sequence < required")
def int6(s, d):
    """Releases offered to customers, some older than what they have seen by the events."""
    offers = V.read(s, d, "customer").select(F.col("c_custkey").alias("client"), (F.col("c_custkey") % 30).alias("release_sequence"))
    seen = V.read(s, d, "events").select(F.col("user_id").alias("client"), (F.col("event_id") % 40).alias("release_sequence"))
    return verify.rollbacks(offers, seen)


@query("int8_rebuilt_assets", "SELECT path, doc_id % 6 <> 0 AS same, doc_id % 6 = 1 AS found FROM new_assets WHERE len > 0")
def int8(s, d):
    """Blocks of every sixth asset are altered, those of every other sixth stored twice."""
    a = V.new_assets(s, d)
    body = V.bodies(a)
    body = body.withColumn("content", F.when((F.col("doc_id") % 6 == 0) & (F.col("block_no") == 0), F.reverse(F.concat(F.col("content").cast("string"), F.lit("!"))).cast("binary")).otherwise(F.col("content")))
    parts = body.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block_no", "content"))).alias("parts"))
    rebuilt = parts.select("path", F.aggregate("parts", F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y["content"])).alias("rebuilt"))
    same = rebuilt.join(a, "path").select("path", (F.sha2("rebuilt", 256) == F.sha2("content", 256)).alias("same"))
    whole = V.bodies(a)
    odd = verify.rebuilt_mismatches(a, V.blocks(a), whole.unionByName(whole.where("doc_id % 6 = 1")))
    return same.join(odd.withColumn("found", F.lit(True)), "path", "left").select("path", "same", F.coalesce("found", F.lit(False)).alias("found"))


@query("int9_bounds", "SELECT path, block_no FROM refs WHERE block_no % 6 = 5", recursive=True)
def int9(s, d):
    refs, table = V.placed_blocks(V.new_assets(s, d))
    wrong = refs.withColumn("segment_block_ordinal", F.when(F.col("block_no") % 6 == 5, F.lit(10**6)).otherwise(F.col("segment_block_ordinal")))
    return verify.block_bounds(wrong, table)
