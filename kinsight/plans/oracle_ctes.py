"""DuckDB text of the derived catalog, which every oracle begins with."""

from __future__ import annotations

VOLUMES = r"""
volumes AS (
  SELECT volume_id, '{vol-' || lpad(volume_id::VARCHAR, 2, '0') || '}' AS volume_guid,
         CASE WHEN volume_id % 6 = 1 THEN 'Google Drive' ELSE 'disk' || lpad(volume_id::VARCHAR, 2, '0') END AS label,
         CASE WHEN volume_id % 4 = 0 THEN 'exFAT' ELSE 'NTFS' END AS file_system,
         volume_id::BIGINT * 500000000 AS total_bytes,
         CASE volume_id % 3 WHEN 0 THEN 'Ssd' WHEN 1 THEN 'Hdd' ELSE 'Remote' END AS storage_kind,
         CASE WHEN volume_id <> 5 THEN chr(volume_id + 65) || ':\' END AS last_mount_point,
         volume_id NOT IN (7, 19) AS attached
  FROM (SELECT DISTINCT regexp_extract(source, '[0-9]+')::INT AS volume_id FROM documents)
)"""

FILES = r"""
files AS (
  SELECT *, lang || '\' || source || '\' || folder || '\' || name AS rel_path FROM (
    SELECT *, stem || ext AS name FROM (
      SELECT d.doc_id AS file_key, regexp_extract(source, '[0-9]+')::INT AS volume_id, lang, source, d.text,
        CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.png' WHEN 'de' THEN '.nef' ELSE '.txt' END AS ext,
        CASE d.doc_id % 6 WHEN 0 THEN 'IMG_' || lpad(d.doc_id::VARCHAR, 6, '0')
          WHEN 1 THEN 'holiday ' || d.doc_id || ' - Copy'
          WHEN 2 THEN 'IMG_2021' || lpad((1 + d.doc_id % 12)::VARCHAR, 2, '0') || lpad((1 + d.doc_id % 28)::VARCHAR, 2, '0') || '_172347'
          WHEN 3 THEN '_MG_' || lpad(d.doc_id::VARCHAR, 6, '0')
          WHEN 4 THEN 'photo (' || (d.doc_id % 7) || ')' ELSE 'wedding' END AS stem,
        CASE WHEN d.doc_id % 7 = 0 THEN 'backup' WHEN d.doc_id % 11 = 0 THEN 'WhatsApp' ELSE 'set' || (d.doc_id % 10) END AS folder,
        n_chars AS size, 132500000000000000 + d.doc_id * 10000000 AS mtime, 132500000000000000 + d.doc_id * 10000000 AS ctime,
        (CASE WHEN d.doc_id % 50 = 0 THEN 2 WHEN d.doc_id % 77 = 0 THEN 4096 ELSE 32 END)::BIGINT AS attributes,
        CASE WHEN d.doc_id % 9 <> 0 THEN d.doc_id - d.doc_id % 2 END AS file_id_low,
        (CASE WHEN d.doc_id % 13 = 0 THEN 1 ELSE 2 END)::BIGINT AS last_scan_id,
        d.doc_id % 29 <> 0 AS present,
        md5(left(d.text, 64) || right(d.text, 64) || n_chars) AS partial_hash,
        CASE WHEN d.doc_id % 31 <> 0 THEN md5(d.text) END AS content_hash,
        CASE WHEN d.doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS hashed_size,
        132500000000000000 + d.doc_id * 10000000 AS hashed_mtime,
        md5(array_to_string(string_split(lower(d.text), ' ')[1:12], ' ')) AS pixel_hash,
        (100 * (1 + d.doc_id % 8))::INT AS img_width, (75 * (1 + d.doc_id % 8))::INT AS img_height,
        CASE WHEN d.doc_id % 41 = 0 THEN 2 ELSE 1 END AS decode_state,
        l.doc_id IS NOT NULL AS has_exif, coalesce(l.quality * 10 + l.toxic, 0)::INT AS exif_tags,
        CASE WHEN d.doc_id % 4 <> 0 THEN epoch_us(e.ts) // 1000000 END AS date_taken,
        (CASE WHEN d.doc_id % 8 = 1 THEN epoch_us(e.ts) % 1000000 END)::INT AS sub_sec,
        (CASE WHEN lang = 'en' THEN 50 + d.doc_id % 50 END)::INT AS jpeg_quality,
        CASE WHEN d.doc_id % 3 = 0 THEN 3 ELSE 4 END AS meta_state
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN events e ON d.doc_id = e.event_id)))"""

_BITS = " + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << b} ELSE 0 END)::BIGINT" for b in range(60))
_THUMB = ", ".join(
    f"floor((length(lower(text)) - length(replace(lower(text), '{c}', ''))) * 1000 / greatest(n_chars, 1))::SMALLINT" for c in "abcdefghijklmnopqrstuvwxyz"
)

PRINTS = f"""
tokens AS (SELECT doc_id AS file_key, string_split(lower(text), ' ') AS w FROM documents),
dh AS (SELECT file_key, {_BITS} AS dhash
       FROM (SELECT file_key, ('0x' || left(md5(t), 15))::BIGINT AS h FROM (SELECT file_key, unnest(w) AS t FROM tokens)) GROUP BY file_key),
ph AS (SELECT file_key, {_BITS} AS phash
       FROM (SELECT file_key, ('0x' || left(md5(t), 15))::BIGINT AS h
             FROM (SELECT file_key, unnest(list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] ELSE w[i] END)) AS t FROM tokens))
       GROUP BY file_key),
thumbs AS (SELECT doc_id AS file_key, [{_THUMB}] AS thumb16 FROM documents),
prints AS (SELECT dh.file_key, dhash, phash, thumb16, list_stddev_pop(thumb16) AS contrast FROM dh JOIN ph USING (file_key) JOIN thumbs USING (file_key))"""


def with_files(body: str) -> str:
    return f"WITH {VOLUMES.strip()},\n{FILES.strip()}\n{body}"


def with_prints(body: str) -> str:
    return f"WITH RECURSIVE {VOLUMES.strip()},\n{FILES.strip()},\n{PRINTS.strip()}\n{body}"
