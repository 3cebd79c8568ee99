"""SQL for the registered queries, written against the given tables.

``VIEWS`` are the adapters in SQL; ``sql`` puts the ones a statement uses in front of it.
"""

from __future__ import annotations

from photarium.settings import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

_IMAGES = ", ".join(f"'{e}'" for e in IMAGE_EXTENSIONS)
_VIDEOS = ", ".join(f"'{e}'" for e in VIDEO_EXTENSIONS)
_SUFFIXES = "['.JPG', '.png', '.mp4', '.txt', '', '.tar.gz', '.HEIC', '.mkv', '.', '']"
_NAMES = "['blake3', 'content_blake3', 'phash', 'dhash', 'whash']"


def _file_name(n: str) -> str:
    return f"(CASE WHEN {n} % 10 = 9 THEN '.img' || {n} ELSE 'img' || {n} || {_SUFFIXES}[{n} % 10 + 1] END)"


def _extension(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    return f"(CASE WHEN regexp_matches({name}, '^.+\\.[^.]*$') THEN lower(regexp_extract({name}, '^.+\\.([^.]*)$', 1)) END)"


def _type(ext: str) -> str:
    return f"(CASE WHEN {ext} IN ({_IMAGES}) THEN 'image' WHEN {ext} IN ({_VIDEOS}) THEN 'video' ELSE 'other' END)"


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_DIGIT = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_DOC_PATH = f"'/lib/' || source || '/' || lang || '/' || {_file_name('doc_id')}"
_PAGE_PATH = f"'/web/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || '/' || {_file_name('page_id')}"
_VERSION = "CAST(1700000000 + {n} * 37 AS BIGINT) AS mtime_secs, CAST(({n} * 1009) % 1000000000 AS INTEGER) AS mtime_nanos"
_CARRIED = "root_dir, filename, extension, size_bytes, mtime_secs, mtime_nanos, file_type"


def _newest(source: str, keys: str, order: str) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {source}) WHERE rn = 1"
    )


VIEWS: dict[str, tuple[list[str], str]] = {
    "lib_master": ([], f"""
        SELECT c_custkey AS id, '/vol/' || lower(c_mktsegment) || '/' || {_file_name('c_custkey')} AS path FROM customer"""),
    "lib_stats0": ([], f"""
        SELECT o_orderkey AS stat_id, o_custkey AS file_id, '/vol/' || substr(o_orderpriority, 1, 1) AS root_dir,
               {_file_name('o_custkey')} AS filename, {_CENTS} AS size_bytes,
               CAST(epoch(o_orderdate) AS BIGINT) AS mtime_secs, 0 AS mtime_nanos,
               o_orderstatus = 'P' AS is_missing, o_orderdate AS observed_at
        FROM orders"""),
    "lib_stats": (["lib_stats0"], f"""
        SELECT stat_id, file_id, root_dir, filename, {_extension('filename')} AS extension, size_bytes, mtime_secs,
               mtime_nanos, {_type(_extension('filename'))} AS file_type, is_missing, observed_at
        FROM lib_stats0"""),
    "lib_latest": (["lib_stats"], _newest("lib_stats", "file_id", "observed_at DESC, stat_id DESC")),
    "hash_arrivals": (["lib_hashes"], """
        SELECT *, CAST(CASE WHEN stat_id % 10 = 0 THEN 3
                            ELSE greatest(0, least(3, (year(computed_at) - 1995) // 2)) END AS INTEGER) AS batch
        FROM lib_hashes"""),
    "hash_late": (["hash_arrivals"], """
        SELECT a.*, coalesce(computed_at < newest - INTERVAL 30 DAY, false) AS late
        FROM hash_arrivals a JOIN (
            SELECT b, (SELECT max(computed_at) FROM hash_arrivals x WHERE x.batch < b) AS newest
            FROM (VALUES (0), (1), (2), (3)) t(b)) ON b = batch"""),
    "lib_files": (["lib_master", "lib_latest"], f"""
        SELECT id, path, stat_id, {_CARRIED}, is_missing, observed_at
        FROM lib_master JOIN lib_latest ON id = file_id"""),
    "lib_hashes": ([], f"""
        SELECT o_custkey AS file_id, o_orderkey AS stat_id, {_NAMES}[{_DIGIT}] AS hash_name,
               nullif(CAST(CAST(floor(o_totalprice) AS BIGINT) % 500 AS VARCHAR), '0') AS hash_value,
               o_orderdate AS computed_at
        FROM orders"""),
    "lib_metadata": ([], """
        SELECT user_id AS file_id, event_id AS stat_id,
               CASE event_type WHEN 'view' THEN 'exif' WHEN 'signup' THEN 'exif_thumb' WHEN 'click' THEN 'exif_other'
                    WHEN 'purchase' THEN 'video' ELSE 'video_tag' END AS namespace,
               'k' || right(regexp_extract(props, '[0-9]+'), 1) AS tag, regexp_extract(props, '[0-9]+') AS value,
               ts AS extracted_at
        FROM events"""),
    "kept": ([], "SELECT documents.*, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "every_document": ([], "SELECT documents.*, coalesce(quality, 1) AS quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "full_listing": (["every_document"], f"""
        SELECT '/lib' AS root_dir, 0 AS root_order, {_DOC_PATH} AS path,
               CAST(strlen(text) + 1 - quality AS BIGINT) AS size_bytes, {_VERSION.format(n='doc_id')} FROM every_document
        UNION ALL
        SELECT '/web', 1, {_PAGE_PATH}, CAST(strlen(html) AS BIGINT), {_VERSION.format(n='page_id')} FROM pages
        UNION ALL
        SELECT '/lib/src1', 2, {_DOC_PATH}, CAST(strlen(text) + 1 - quality AS BIGINT), {_VERSION.format(n='doc_id')}
        FROM every_document WHERE source = 'src1'"""),
    "full_described": (["full_listing"], f"""
        SELECT *, regexp_extract(path, '[^/]*$') AS filename, {_extension('path')} AS extension,
               {_type(_extension('path'))} AS file_type FROM full_listing"""),
    "listing": (["kept"], f"""
        SELECT '/lib' AS root_dir, 0 AS root_order, {_DOC_PATH} AS path,
               CAST(strlen(text) + 1 - quality AS BIGINT) AS size_bytes, {_VERSION.format(n='doc_id')} FROM kept
        UNION ALL
        SELECT '/web', 1, {_PAGE_PATH}, CAST(strlen(html) AS BIGINT), {_VERSION.format(n='page_id')} FROM pages
        UNION ALL
        SELECT '/lib/src1', 2, {_DOC_PATH}, CAST(strlen(text) + 1 - quality AS BIGINT), {_VERSION.format(n='doc_id')}
        FROM kept WHERE source = 'src1'"""),
    "described": (["listing"], f"""
        SELECT *, regexp_extract(path, '[^/]*$') AS filename, {_extension('path')} AS extension,
               {_type(_extension('path'))} AS file_type FROM listing"""),
    "tree_master": ([], f"SELECT doc_id + 1 AS id, {_DOC_PATH} AS path FROM documents"),
    "tree_seen": ([], f"""
        SELECT doc_id + 1 AS file_id, '/lib' AS root_dir, {_file_name('doc_id')} AS filename,
               {_extension(_file_name('doc_id'))} AS extension, CAST(strlen(text) AS BIGINT) AS size_bytes,
               {_VERSION.format(n='doc_id')}, {_type(_extension(_file_name('doc_id')))} AS file_type, toxic
        FROM documents LEFT JOIN labels USING (doc_id)"""),
    "tree_stats": (["tree_seen"], f"""
        SELECT file_id AS stat_id, file_id, {_CARRIED}, false AS is_missing, TIMESTAMP '2024-01-01' AS observed_at
        FROM tree_seen
        UNION ALL
        SELECT file_id + 1000000000, file_id, {_CARRIED}, true, TIMESTAMP '2024-01-02' FROM tree_seen WHERE toxic = 1"""),
    "tree_latest": (["tree_stats"], _newest("tree_stats", "file_id", "observed_at DESC, stat_id DESC")),
    "tree_files": (["tree_master", "tree_latest"], f"""
        SELECT id, path, stat_id, {_CARRIED}, is_missing, observed_at FROM tree_master JOIN tree_latest ON id = file_id"""),
    "new_master": (["listing", "tree_master"], """
        SELECT (SELECT coalesce(max(id), 0) FROM tree_master) + row_number() OVER (ORDER BY path) AS id, path
        FROM (SELECT path FROM listing EXCEPT SELECT path FROM tree_master)"""),
    "gone": (["listing", "tree_files"], """
        SELECT * FROM tree_files f WHERE NOT is_missing AND root_dir = '/lib'
          AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = f.path AND l.root_order <= 0)"""),
    "pixels": ([], """
        SELECT vec_id, label, list_transform(embedding, lambda x:
                 CAST(least(greatest(floor(CAST(x AS DOUBLE) * 256) + 128, 0), 255) AS BIGINT)) AS p
        FROM embeddings"""),
    "pictures": (["pixels"], """
        SELECT vec_id * 100 + copy AS file_id, 1000 + vec_id + copy AS size_bytes, label, copy, p
        FROM pixels, LATERAL (SELECT unnest(range(label + 1)) AS copy)"""),
    "pixel_digests": (["pictures"], """
        SELECT *, sha256(unhex(array_to_string(list_transform(p, lambda v: repeat(printf('%02X', v), 3) || 'FF'), '')))
                  AS hash_value
        FROM pictures"""),
    "grid4": (["pictures"], """
        SELECT file_id, list_transform(range(16), lambda i:
                 (p[i // 4 * 16 + i % 4 * 2 + 1] + p[i // 4 * 16 + i % 4 * 2 + 2]
                  + p[i // 4 * 16 + i % 4 * 2 + 9] + p[i // 4 * 16 + i % 4 * 2 + 10]) / 4.0::DOUBLE) AS g
        FROM pictures"""),
    "edits": (["pixels"], """
        SELECT vec_id, vec_id * 100 + copy AS file_id,
               list_transform(range(64), lambda i: CASE WHEN i < copy * 2 THEN 255 - p[i + 1] ELSE p[i + 1] END) AS p
        FROM pixels, LATERAL (SELECT unnest(range(label + 1)) AS copy)"""),
    "edit_bits": (["edits"], """
        SELECT file_id, vec_id, list_transform(p, lambda v: CASE WHEN v * 64 >= list_sum(p) THEN 1 ELSE 0 END) AS b FROM edits"""),
    "pair_list": (["edits"], """
        SELECT vec_id * 100 AS left_id, file_id AS right_id FROM edits
        UNION ALL SELECT vec_id * 100, vec_id * 100 + 100 FROM embeddings"""),
    "pair_distance": (["pair_list", "edit_bits"], """
        SELECT left_id, right_id,
               CAST(list_sum(list_transform(range(1, 65), lambda i: abs(l.b[i] - r.b[i]))) AS INTEGER) AS distance
        FROM pair_list JOIN edit_bits l ON l.file_id = left_id JOIN edit_bits r ON r.file_id = right_id"""),
    "linked": (["pair_distance"], """
        SELECT left_id AS x, right_id AS y FROM pair_distance WHERE distance < 10
        UNION SELECT right_id, left_id FROM pair_distance WHERE distance < 10"""),
    "reach": (["linked"], "SELECT x, x AS y FROM linked UNION SELECT r.x, e.y FROM reach r JOIN linked e ON r.y = e.x"),
    "edit_prints": (["edit_bits"], """
        SELECT file_id, list_sum(list_transform(range(64), lambda i: CASE WHEN b[i + 1] = 0 THEN 0::HUGEINT
                 WHEN i = 63 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << i END))::BIGINT AS print
        FROM edit_bits"""),
    "print_groups": (["edit_prints"], """
        SELECT print, min(file_id) AS match_id, count(*) AS matches, min(file_id) FILTER (WHERE file_id % 100 = 0) AS query_id,
               count(*) FILTER (WHERE file_id % 100 = 0) AS queries
        FROM edit_prints GROUP BY print"""),
    "part_tags": ([], """
        SELECT p_partkey AS file_id, 'exif' AS namespace, 'ISOSpeedRatings' AS tag, CAST(p_size AS VARCHAR) AS value FROM part
        UNION ALL SELECT p_partkey, 'exif', 'BitsPerSample', '[' || p_size || ', ' || (p_partkey % 256) || ', 8]' FROM part
        UNION ALL SELECT p_partkey, 'exif', 'ExposureTime', CASE WHEN p_partkey % 7 = 0 THEN p_size || '/0'
            ELSE regexp_replace(CAST(CAST(p_size AS DOUBLE) / (p_partkey % 7) AS VARCHAR), '\\.0$', '') END FROM part
        UNION ALL SELECT p_partkey, 'exif_thumb', 'XResolution',
            regexp_replace(CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100.0::DOUBLE AS VARCHAR), '\\.0$', '') FROM part
        UNION ALL SELECT p_partkey, 'exif', 'ExposureBiasValue', CASE WHEN p_size = 25 THEN '-0'
            ELSE regexp_replace(CAST(CAST(p_size - 25 AS DOUBLE) / (p_size - 60) AS VARCHAR), '\\.0$', '') END FROM part
        UNION ALL SELECT p_partkey, 'exif_other', 'LensSpecification', p_type FROM part
        UNION ALL SELECT p_partkey, 'exif', 'Make', p_brand || ', ' || p_name FROM part
        UNION ALL SELECT p_partkey, 'exif', 'Model', p_name FROM part
        UNION ALL SELECT p_partkey, 'exif', 'Artist', NULL FROM part
        UNION ALL SELECT p_partkey, 'exif_other', 'MakerNote',
            '[' || array_to_string(list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS VARCHAR)), ', ') || ']' FROM part
        UNION ALL SELECT p_partkey, 'exif', 'UserComment', CASE WHEN strlen(p_type) * 10 > 64
            THEN '[' || strlen(p_type) * 10 || ' bytes]'
            ELSE '[' || array_to_string(list_transform(string_split(repeat(p_type, 10), ''), lambda c: CAST(ascii(c) AS VARCHAR)), ', ') || ']'
            END FROM part
        UNION ALL SELECT p_partkey, 'exif', 'Gamma', p_name FROM part"""),
    "probed": ([], f"""
        SELECT o_orderkey AS file_id, o_orderstatus AS status, {_DIGIT} AS d, CAST({_CENTS} AS VARCHAR) AS amount,
               o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders WHERE NOT (o_orderstatus = 'P' AND {_DIGIT} = 1)"""),
    "probe_format": (["probed"], """
        SELECT file_id, 'video' AS namespace, 'duration' AS tag, amount AS value FROM probed WHERE status = 'F'
        UNION ALL SELECT file_id, 'video', 'bit_rate', amount FROM probed WHERE d % 2 = 1
        UNION ALL SELECT file_id, 'video', 'format_name', 'mov,mp4' FROM probed"""),
    "probe_tags": (["probed"], """
        SELECT file_id, 'video_tag' AS namespace, t.tag AS tag,
               CASE t.tag WHEN 'creation_time' THEN day WHEN 'priority' THEN priority WHEN 'cents' THEN amount ELSE t.fixed END AS value
        FROM probed, (VALUES ('creation_time', ''), ('priority', ''), ('cents', ''), ('ratio', '2.5'), ('whole', '3.0'),
                      ('flags', '{"a":1,"b":[1,2]}'), ('none', 'null'), ('ok', 'false'),
                      ('nested', '{"x":3.0,"y":2.5}'), ('list', '[1.0]')) t(tag, fixed)
        WHERE d <> 5"""),
    "probe_streams": (["probed"], """
        SELECT file_id, 'video' AS namespace, t.tag AS tag,
               CASE t.tag WHEN 'stream_0_width' THEN '1' || substr(amount, strlen(amount) - 2, 1) || '00' ELSE t.fixed END AS value
        FROM probed, (VALUES ('stream_0_codec_type', 'video'), ('stream_0_codec_name', 'h264'), ('stream_0_width', ''),
                      ('stream_0_height', '1080'), ('stream_0_frame_rate', '25/1'), ('stream_1_codec_type', 'audio'),
                      ('stream_1_codec_name', 'aac'), ('stream_1_sample_rate', '48000'), ('stream_1_channels', '2'),
                      ('stream_2_codec_type', 'unknown'), ('stream_2_codec_name', 'bin_data'),
                      ('stream_3_codec_type', 'subtitle')) t(tag, fixed)
        WHERE d <> 4 AND NOT (t.tag = 'stream_0_height' AND status = 'P')
          AND NOT (t.tag = 'stream_1_sample_rate' AND status = 'F')"""),
    "probe_all": (["probe_format", "probe_tags", "probe_streams"],
                  "SELECT * FROM probe_format UNION ALL SELECT * FROM probe_tags UNION ALL SELECT * FROM probe_streams"),
    "run_log": ([], f"""
        SELECT user_id AS run_id, ts AS event_time,
               CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'completed' ELSE 'progress' END AS event,
               CAST(event_id % 3 + 1 AS INTEGER) AS scan_level, {_NAMES}[event_id % 5 + 1] AS hash_type,
               CASE WHEN value > 50 THEN 'failed' ELSE 'completed' END AS end_status,
               CAST(floor(value) AS BIGINT) AS files_processed,
               CAST(CASE event_type WHEN 'click' THEN 200 WHEN 'purchase' THEN 0 END AS BIGINT) AS files_total,
               CASE WHEN value > 50 THEN 'error ' || regexp_extract(props, '[0-9]+') END AS error_message
        FROM events"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views, and those they use, as common table expressions."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        need(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n" + body


def _without_hash(name: str, extra: str = "") -> str:
    return f"""
        SELECT id, path, size_bytes FROM lib_files f WHERE NOT is_missing {extra}
          AND NOT EXISTS (SELECT 1 FROM lib_hashes h WHERE h.file_id = f.id AND h.hash_name = '{name}')"""


def _dupes(source: str) -> str:
    return f"""
        SELECT hash_value, substr(hash_value, 1, 16) AS digest_prefix, count(*) AS file_count,
               CAST(sum(size_bytes) AS BIGINT) AS total_size,
               round((sum(size_bytes)::DOUBLE - sum(size_bytes)::DOUBLE / count(*)) / 1048576.0::DOUBLE, 2) AS wasted_mib
        FROM {source} GROUP BY hash_value HAVING count(*) > 1 ORDER BY total_size DESC, hash_value LIMIT 50"""


def _bits(comparisons: str, count: int) -> str:
    """64-bit number from a list of ``count`` 0/1 values, first one lowest."""
    total = f"list_sum(list_transform(range({count}), lambda i: ({comparisons}) * (1::HUGEINT << i)))"
    return f"CAST(CASE WHEN {total} >= (1::HUGEINT << 63) THEN {total} - (1::HUGEINT << 64) ELSE {total} END AS BIGINT)"


def _tree_digest(leaf: int, fan: int, levels: int = 8) -> str:
    """Digests of neighbours, level by level, while more than one is left."""
    steps = ["""level0 AS (SELECT doc_id, strlen(text) AS size, list_transform(range(greatest(CAST(ceil(strlen(text) / {0}.0) AS BIGINT), 1)),
               lambda i: sha256(array_slice(encode(text), i * {0} + 1, (i + 1) * {0}))) AS d FROM documents)""".format(leaf)]
    for n in range(levels):
        steps.append(f"""level{n + 1} AS (SELECT doc_id, size, CASE WHEN len(d) <= 1 THEN d ELSE list_transform(range((len(d) + {fan - 1}) // {fan}),
               lambda j: CASE WHEN j * {fan} + 1 = len(d) THEN d[j * {fan} + 1]
                              ELSE sha256(array_to_string(d[j * {fan} + 1:(j + 1) * {fan}], '')) END) END AS d FROM level{n})""")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id + 1 AS file_id, CASE WHEN size IS NOT NULL THEN sha256(size || ':{leaf}:{fan}:' || d[1]) END AS digest FROM level{levels}"""


def _log_entries(entries: str) -> str:
    return f"""
        SELECT e.file_id, l.stat_id, e.namespace, e.tag, e.value, TIMESTAMP '2024-02-01' AS extracted_at
        FROM {entries} e JOIN lib_latest l ON l.file_id = e.file_id"""


_DISPATCHED = """(SELECT t.*, f.is_missing FROM part_tags t JOIN lib_files f ON f.id = t.file_id AND f.file_type = 'image'
                  UNION ALL
                  SELECT t.*, f.is_missing FROM probe_all t JOIN lib_files f ON f.id = t.file_id AND f.file_type = 'video')"""


COVERAGE = sql(f"""
    SELECT n.hash_name, count(*) AS files_total,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lib_hashes h WHERE h.file_id = f.id AND h.hash_name = n.hash_name))
             AS files_hashed,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lib_hashes h WHERE h.file_id = f.id AND h.hash_name = n.hash_name))
             AS files_remaining
    FROM (SELECT unnest({_NAMES}) AS hash_name) n
    JOIN lib_files f ON NOT f.is_missing AND (n.hash_name = 'blake3' OR f.file_type = 'image')
    GROUP BY n.hash_name""", "lib_files", "lib_hashes")

ORACLES: dict[str, str] = {
    "inventory_scan": sql("SELECT * FROM full_listing", "full_listing"),
    "path_parts": f"""
        SELECT path, regexp_extract(path, '[^/]*$') AS filename, {_extension('path')} AS extension,
               'D:' || path AS from_windows, '/home/me' || path AS from_home
        FROM (SELECT {_DOC_PATH} AS path FROM documents UNION ALL SELECT {_PAGE_PATH} FROM pages)""",
    "mtime_split": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE epoch_us(ts) // 1000000 END AS mtime_secs,
               CAST(CASE WHEN event_type = 'error' THEN 0 ELSE epoch_us(ts) % 1000000 * 1000 END AS INTEGER) AS mtime_nanos
        FROM events""",
    "classify_files": sql("SELECT root_dir, path, extension, file_type FROM full_described", "full_described"),
    "scan_stats": sql("""
        SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
               count(*) FILTER (WHERE file_type = 'image') AS image_count,
               CAST(coalesce(sum(size_bytes) FILTER (WHERE file_type = 'image'), 0) AS BIGINT) AS image_size_bytes,
               count(*) FILTER (WHERE file_type = 'video') AS video_count,
               CAST(coalesce(sum(size_bytes) FILTER (WHERE file_type = 'video'), 0) AS BIGINT) AS video_size_bytes,
               count(*) FILTER (WHERE file_type = 'other') AS other_count,
               CAST(coalesce(sum(size_bytes) FILTER (WHERE file_type = 'other'), 0) AS BIGINT) AS other_size_bytes
        FROM full_described""", "full_described"),
    "library_stats": sql("""
        SELECT count(*) AS total_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes,
               round(coalesce(sum(size_bytes), 0)::DOUBLE / 1073741824.0::DOUBLE, 2) AS total_size_gib,
               count(*) FILTER (WHERE file_type = 'image') AS image_count,
               count(*) FILTER (WHERE file_type = 'video') AS video_count,
               count(*) FILTER (WHERE file_type NOT IN ('image', 'video')) AS other_count
        FROM lib_latest WHERE NOT is_missing""", "lib_latest"),
    "v_files": sql("SELECT * FROM lib_files", "lib_files"),
    "v_file_hashes": sql(
        _newest("lib_hashes", "file_id, hash_name", "computed_at DESC, stat_id DESC, hash_value DESC"), "lib_hashes"),
    "v_file_metadata": sql(
        _newest("lib_metadata", "file_id, namespace, tag", "extracted_at DESC, stat_id DESC, value DESC"), "lib_metadata"),
    "latest_stat_id": sql("SELECT file_id, stat_id FROM lib_latest", "lib_latest"),
    "file_history": sql("SELECT file_id, observed_at, stat_id, root_dir, size_bytes, is_missing FROM lib_stats", "lib_stats"),
    "active_files": sql("SELECT id, path, file_type, size_bytes FROM lib_files WHERE NOT is_missing", "lib_files"),
    "active_files_for_root": sql("""
        SELECT id, path, size_bytes, mtime_secs, mtime_nanos FROM lib_files WHERE NOT is_missing AND root_dir = '/vol/2'""",
        "lib_files"),
    "known_paths": sql("SELECT root_dir, path FROM lib_files WHERE NOT is_missing", "lib_files"),
    "file_exists": sql("""
        SELECT path, EXISTS (SELECT 1 FROM tree_master m WHERE m.path = l.path) AS file_exists
        FROM (SELECT DISTINCT path FROM listing) l""", "listing", "tree_master"),
    "assign_file_ids": sql("SELECT id, path FROM new_master", "new_master"),
    "append_observations": sql(f"""
        SELECT (SELECT max(stat_id) FROM tree_stats) + row_number() OVER (ORDER BY root_order, d.path) AS stat_id,
               m.id AS file_id, {_CARRIED}, false AS is_missing, TIMESTAMP '2024-02-01' AS observed_at
        FROM full_described d JOIN (SELECT * FROM tree_master UNION ALL
          SELECT (SELECT max(id) FROM tree_master) + row_number() OVER (ORDER BY path), path
          FROM (SELECT path FROM full_listing EXCEPT SELECT path FROM tree_master)) m ON m.path = d.path""",
        "full_described", "full_listing", "tree_master", "tree_stats"),
    "missing_paths": sql("SELECT root_dir, path FROM gone", "gone"),
    "mark_missing": sql(f"""
        SELECT (SELECT max(stat_id) FROM tree_stats) + row_number() OVER (ORDER BY path) AS stat_id, id AS file_id,
               {_CARRIED}, true AS is_missing, TIMESTAMP '2024-02-01' AS observed_at
        FROM tree_files WHERE id NOT IN (SELECT doc_id + 1 FROM labels)""", "tree_files", "tree_stats"),
    "change_detection": sql("""
        SELECT coalesce(l.path, f.path) AS path,
               CASE WHEN f.path IS NULL THEN 'new'
                    WHEN l.path IS NULL THEN CASE WHEN f.is_missing THEN 'still_missing' ELSE 'missing' END
                    WHEN f.is_missing THEN 'reappeared'
                    WHEN l.size_bytes = f.size_bytes AND l.mtime_secs = f.mtime_secs AND l.mtime_nanos = f.mtime_nanos
                    THEN 'unchanged' ELSE 'modified' END AS state,
               f.size_bytes AS old_size_bytes, l.size_bytes AS new_size_bytes
        FROM (SELECT DISTINCT path, size_bytes, mtime_secs, mtime_nanos FROM listing) l
        FULL OUTER JOIN tree_files f ON f.path = l.path""", "listing", "tree_files"),
    "scan_cycle": sql(f"""
        SELECT (SELECT max(stat_id) FROM tree_stats) + row_number() OVER (ORDER BY root_order, is_missing, path) AS stat_id,
               file_id, {_CARRIED}, is_missing, TIMESTAMP '2024-02-01' AS observed_at
        FROM (SELECT m.id AS file_id, root_order, d.path, {_CARRIED}, false AS is_missing
              FROM described d JOIN (SELECT * FROM tree_master UNION ALL SELECT * FROM new_master) m ON m.path = d.path
              UNION ALL
              SELECT id, 0, path, {_CARRIED}, true FROM gone)""",
        "described", "tree_master", "new_master", "gone", "tree_stats"),
    "needing_hash_blake3": sql(_without_hash("blake3"), "lib_files", "lib_hashes"),
    "needing_hash_images": sql(_without_hash("phash", "AND file_type = 'image'"), "lib_files", "lib_hashes"),
    "needing_hash_stale_aware": sql("""
        SELECT f.id, f.path, f.size_bytes FROM lib_files f
        LEFT JOIN (SELECT file_id, stat_id FROM lib_hashes WHERE hash_name = 'blake3'
                   QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY computed_at DESC, stat_id DESC) = 1) h
          ON h.file_id = f.id
        LEFT JOIN lib_stats s ON s.stat_id = h.stat_id
        WHERE NOT f.is_missing
          AND (s.stat_id IS NULL OR s.size_bytes <> f.size_bytes OR s.mtime_secs <> f.mtime_secs
               OR s.mtime_nanos <> f.mtime_nanos)""", "lib_files", "lib_hashes", "lib_stats"),
    "needing_metadata": sql("""
        SELECT id, path, file_type FROM lib_files f WHERE NOT is_missing AND file_type IN ('image', 'video')
          AND NOT EXISTS (SELECT 1 FROM lib_metadata m WHERE m.file_id = f.id)""", "lib_files", "lib_metadata"),
    "needing_hash_indexed": sql(_without_hash("blake3"), "lib_files", "lib_hashes"),
    "hash_coverage": COVERAGE,
    "hash_coverage_indexed": COVERAGE,
    "full_digest": "SELECT doc_id + 1 AS file_id, 'blake3' AS hash_name, sha256(text) AS hash_value FROM documents",
    "file_versions": sql("""
        SELECT file_id, version, root_dir, is_missing, first_seen, last_seen, observations, first_stat_id,
               size - lag(size) OVER (PARTITION BY file_id ORDER BY version) AS size_delta
        FROM (SELECT file_id, CAST(version AS BIGINT) AS version, any_value(root_dir) AS root_dir, any_value(is_missing) AS is_missing,
                     min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS observations,
                     min(struct_pack(t := observed_at, s := stat_id)).s AS first_stat_id,
                     min(struct_pack(t := observed_at, s := stat_id, b := size_bytes)).b AS size
              FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY observed_at, stat_id) AS version
                    FROM (SELECT *, coalesce(lag(root_dir) OVER w = root_dir AND lag(is_missing) OVER w = is_missing, false) AS same
                          FROM lib_stats WINDOW w AS (PARTITION BY file_id ORDER BY observed_at, stat_id)))
              GROUP BY file_id, version)""", "lib_stats"),
    "tree_digest": _tree_digest(256, 8),
    "content_digest": sql("SELECT file_id, 'content_blake3' AS hash_name, hash_value FROM pixel_digests", "pixel_digests"),
    "hash_scan_blake3": sql("""
        SELECT f.id AS file_id, f.stat_id, 'blake3' AS hash_name, sha256(d.text) AS hash_value,
               TIMESTAMP '2024-02-01' AS computed_at
        FROM tree_files f JOIN documents d ON d.doc_id + 1 = f.id
        WHERE NOT f.is_missing AND d.doc_id NOT IN (SELECT doc_id FROM labels)""", "tree_files"),
    "append_hashes": sql("""
        SELECT c_custkey AS file_id, l.stat_id, 'phash' AS hash_name,
               CAST(CAST(round(c_acctbal * 100) AS BIGINT) * 90000000007 AS VARCHAR) AS hash_value,
               TIMESTAMP '2024-02-01' AS computed_at
        FROM customer JOIN lib_latest l ON l.file_id = c_custkey""", "lib_latest"),
    "validate_hash_names": sql("""
        SELECT stat_id, hash_name, value AS hash_value,
               CASE WHEN hash_name = 'sha256' THEN 'HASH_UNKNOWN_ALGORITHM' END AS error_code,
               CASE WHEN hash_name = 'sha256' THEN 'HASH_UNKNOWN_ALGORITHM. algorithm: sha256' END AS error_message
        FROM (SELECT stat_id, value, CASE namespace WHEN 'exif' THEN 'blake3' WHEN 'exif_thumb' THEN 'content_blake3'
                     WHEN 'exif_other' THEN 'phash' WHEN 'video' THEN 'dhash' ELSE 'sha256' END AS hash_name
              FROM lib_metadata)""", "lib_metadata"),
    "hash_quarantine": """
        SELECT vec_id * 100 AS file_id, 'content_blake3' AS hash_name, 'HASH_DECODE_FAILED' AS error_code,
               'HASH_DECODE_FAILED. file_id: ' || (vec_id * 100) || ' (no content)' AS error_message
        FROM embeddings WHERE label = 0""",
    "dupes_blake3": sql(_dupes("""
        (SELECT sha256(text) AS hash_value, f.size_bytes FROM documents d JOIN tree_files f ON f.id = d.doc_id + 1
         WHERE NOT f.is_missing)"""), "tree_files"),
    "dupes_content": sql(_dupes("pixel_digests"), "pixel_digests"),
    "exif_normalize": sql("SELECT * FROM part_tags", "part_tags"),
    "video_metadata": sql("SELECT * FROM probe_format", "probe_format"),
    "video_tags": sql("SELECT * FROM probe_tags", "probe_tags"),
    "video_streams": sql("SELECT * FROM probe_streams", "probe_streams"),
    "metadata_dispatch": sql(f"SELECT file_id, namespace, tag, value FROM {_DISPATCHED}",
                             "part_tags", "probe_all", "lib_files"),
    "append_metadata": sql(_log_entries("part_tags"), "part_tags", "lib_latest"),
    "metadata_scan": sql(_log_entries(f"""
        (SELECT * FROM {_DISPATCHED} WHERE NOT is_missing AND file_id NOT IN (SELECT file_id FROM lib_metadata))"""),
        "part_tags", "probe_all", "lib_files", "lib_latest", "lib_metadata"),
    "media_grid": sql("""
        SELECT file_id, CAST(unnest(range(16)) AS INTEGER) AS cell, unnest(g) AS brightness FROM grid4""", "grid4"),
    "phash_mean": sql(f"""
        SELECT file_id, {_bits('CASE WHEN p[i + 1] * 64 >= list_sum(p) THEN 1 ELSE 0 END', 64)} AS fingerprint
        FROM pictures""", "pictures"),
    "dhash_gradient": sql(f"""
        SELECT file_id,
               {_bits('CASE WHEN g[i // 8 * 9 + i % 8 + 1] < g[i // 8 * 9 + i % 8 + 2] THEN 1 ELSE 0 END', 64)} AS fingerprint
        FROM (SELECT file_id, list_transform(range(72), lambda c: list_sum(list_transform(range(8),
                lambda k: p[c // 9 * 8 + (c % 9 * 8 + k) // 9 + 1]))) AS g FROM pictures)""", "pictures"),
    "whash_double_gradient": sql(f"""
        SELECT file_id,
               {_bits('''CASE WHEN i < 20 THEN CASE WHEN g[i // 4 * 5 + i % 4 + 1] < g[i // 4 * 5 + i % 4 + 2] THEN 1 ELSE 0 END
                         ELSE CASE WHEN g[i - 20 + 1] < g[i - 20 + 6] THEN 1 ELSE 0 END END''', 40)} AS fingerprint
        FROM (SELECT file_id, list_transform(range(25), lambda c: list_sum(list_transform(range(64),
                lambda k: p[(c // 5 * 8 + k // 8) // 5 * 8 + (c % 5 * 8 + k % 8) // 5 + 1]))) AS g FROM pictures)""", "pictures"),
    "hamming_pairs": sql("""
        SELECT left_id, right_id, distance,
               CASE WHEN distance = 0 THEN 'identical' WHEN distance < 10 THEN 'likely_same' ELSE 'different' END AS verdict
        FROM pair_distance""", "pair_distance"),
    "near_dupes": sql("SELECT left_id, right_id, distance FROM pair_distance WHERE distance < 10", "pair_distance"),
    "near_dupe_clusters": sql("SELECT x AS file_id, min(y) AS cluster_id FROM reach GROUP BY x", "reach"),
    "hamming_search": sql("""
        SELECT q.query_id, c.match_id, CAST(bit_count(xor(q.print, c.print)) AS INTEGER) AS distance, q.queries, c.matches
        FROM print_groups q JOIN print_groups c ON q.queries > 0 AND bit_count(xor(q.print, c.print)) < 10""", "print_groups"),
    "print_classes": sql("SELECT file_id, match_id AS class_id FROM edit_prints JOIN print_groups USING (print)", "print_groups"),
    "dupe_members": sql("""
        SELECT hash_value, file_count, file_id, path, size_bytes, rn = 1 AS is_keeper
        FROM (SELECT sha256(text) AS hash_value, f.id AS file_id, path, f.size_bytes,
                     count(*) OVER (PARTITION BY sha256(text)) AS file_count,
                     row_number() OVER (PARTITION BY sha256(text) ORDER BY mtime_secs, mtime_nanos, path, f.id) AS rn
              FROM documents d JOIN tree_files f ON f.id = d.doc_id + 1 WHERE NOT f.is_missing)
        WHERE file_count > 1""", "tree_files"),
    "scan_run_status": sql("""
        SELECT run_id AS id,
               arg_min(scan_level, event_time) FILTER (WHERE event = 'started') AS scan_level,
               arg_min(hash_type, event_time) FILTER (WHERE event = 'started') AS hash_type,
               CASE WHEN count(*) FILTER (WHERE event = 'started') > 0 THEN '/vol' END AS root_dir,
               min(event_time) FILTER (WHERE event = 'started') AS started_at,
               max(event_time) FILTER (WHERE event = 'completed') AS completed_at,
               coalesce(arg_max(end_status, event_time) FILTER (WHERE event = 'completed'), 'running') AS status,
               coalesce(arg_max(files_processed, event_time) FILTER (WHERE event = 'progress'), 0) AS files_processed,
               (max(struct_pack(t := event_time, n := files_total)) FILTER (WHERE event = 'progress')).n AS files_total,
               (max(struct_pack(t := event_time, m := error_message)) FILTER (WHERE event = 'completed')).m AS error_message
        FROM run_log GROUP BY run_id HAVING count(*) FILTER (WHERE event = 'started') > 0""", "run_log"),
    "scan_progress": sql("""
        SELECT p.run_id, CASE s.scan_level WHEN 1 THEN 'stats' WHEN 2 THEN 'metadata' WHEN 3 THEN 'hash' END AS stage,
               s.hash_type, p.event_time, p.files_processed, p.files_total,
               CAST(CASE WHEN p.files_total > 0 THEN floor(p.files_processed::DOUBLE / p.files_total::DOUBLE * 100)
                         WHEN p.files_total IS NOT NULL THEN 0 END AS INTEGER) AS percent,
               (epoch_us(p.event_time) - epoch_us(s.event_time))::DOUBLE / 1e6::DOUBLE AS elapsed_secs
        FROM run_log p
        JOIN (SELECT * FROM run_log WHERE event = 'started'
                   QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_time) = 1) s ON s.run_id = p.run_id
        WHERE p.event = 'progress'""", "run_log"),
    "stream_latest_state": sql("SELECT * FROM lib_latest", "lib_latest"),
    "stream_first_hash": sql(
        _newest("lib_hashes", "file_id, hash_name", "computed_at, stat_id"), "lib_hashes"),
    "maintained_files": sql("SELECT * FROM lib_files", "lib_files"),
    "bounded_first_hash": sql(
        _newest("(SELECT * EXCLUDE (batch, late) FROM hash_late WHERE NOT late)", "file_id, hash_name", "computed_at, stat_id"),
        "hash_late"),
    "late_hashes": sql("SELECT * EXCLUDE (late) FROM hash_late WHERE late", "hash_late"),
}
