"""Query inputs derived from the given tables.

Each is one SQL text that gives the same rows in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CITY = "CAST(floor(CAST(event_id AS DOUBLE)/40) AS BIGINT) % 25"
_CITY_BY_OWNER = (
    "(user_id*3 + CAST(floor(CAST(extract(day FROM ts) - 1 AS DOUBLE)/5) AS BIGINT)) % 25"
)

_MEDIA = """
SELECT event_id, ts AS date_created, user_id AS owner,
 concat('/media/u', CAST(user_id AS VARCHAR(20)), '/IMG_', CAST(event_id % 500 AS VARCHAR(20)), CASE CAST(event_id % 10 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.heic' WHEN 4 THEN '.heif' WHEN 5 THEN '.avif' WHEN 6 THEN '.mp4' WHEN 7 THEN '.MOV' WHEN 8 THEN '.m4v' ELSE '.txt' END) AS file_name,
 CASE WHEN event_id % 5 = 3 OR event_id % 40 BETWEEN 20 AND 27 THEN CAST(0 AS DOUBLE)
      WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE)
      ELSE CAST(-47 + 4*city AS DOUBLE) + CAST((event_id*7) % 100 AS DOUBLE)/CAST(10000 AS DOUBLE) + CASE WHEN event_id % 17 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS latitude,
 CASE WHEN event_id % 5 = 3 OR event_id % 40 BETWEEN 20 AND 27 THEN CAST(0 AS DOUBLE)
      ELSE CAST(-165.5 AS DOUBLE) + CAST(13*city AS DOUBLE) + CAST((event_id*11) % 100 AS DOUBLE)/CAST(10000 AS DOUBLE) END AS longitude,
 1000 + event_id % 50 AS length, md5(CAST(event_id % 150 AS VARCHAR(20))) AS content_md5
FROM (SELECT *, {city} AS city FROM events) e
"""

MEDIA = _MEDIA.replace("{city}", _CITY)
MEDIA_OWNER = _MEDIA.replace("{city}", _CITY_BY_OWNER)

PLACES = """
SELECT k AS geonameid, concat(seg, CASE WHEN j % 7 = 3 THEN ' / ' ELSE ' ' END, CAST(k % 97 AS VARCHAR(20))) AS name,
 CASE WHEN city = 24 THEN CAST(-80 AS DOUBLE) ELSE CAST(-47 + 4*city AS DOUBLE) END + CAST((k*13) % 100 AS DOUBLE)/CAST(spread AS DOUBLE) AS latitude,
 CAST(-165.5 AS DOUBLE) + CAST(13*city AS DOUBLE) + CAST((k*29) % 100 AS DOUBLE)/CAST(spread AS DOUBLE) AS longitude,
 fclass AS feature_class, fcode AS feature_code, 'XX' AS country, CAST(city AS VARCHAR(20)) AS admin1, k*10 AS population
FROM (SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey % 25 AS city, j,
  CASE CAST(j % 12 AS INT) WHEN 0 THEN 'S' WHEN 1 THEN 'S' WHEN 2 THEN 'L' WHEN 3 THEN 'P' WHEN 4 THEN 'A' WHEN 5 THEN 'H' WHEN 6 THEN 'A' WHEN 7 THEN 'A' WHEN 8 THEN 'P' WHEN 9 THEN 'H' WHEN 10 THEN 'P' ELSE 'T' END AS fclass,
  CASE CAST(j % 12 AS INT) WHEN 0 THEN 'CSTL' WHEN 1 THEN 'HTL' WHEN 2 THEN 'PRK' WHEN 3 THEN 'PPL' WHEN 4 THEN CASE WHEN c_custkey % 25 % 3 = 2 THEN 'ADM1' ELSE 'ADM3' END WHEN 5 THEN CASE WHEN c_custkey % 25 % 3 = 0 THEN 'SEA' ELSE 'BAY' END WHEN 6 THEN 'ADM2' WHEN 7 THEN CASE WHEN c_custkey % 25 % 3 = 2 THEN 'ADM1' ELSE 'PCLI' END WHEN 8 THEN 'PPLX' WHEN 9 THEN 'STM' WHEN 10 THEN 'PPLA' ELSE 'MT' END AS fcode,
  CASE WHEN j % 12 IN (0,1) THEN 10000 WHEN j % 12 = 2 THEN 6000 WHEN j % 12 IN (3,8,10) THEN 600 ELSE 120 END AS spread
 FROM (SELECT *, CAST(floor(CAST(c_custkey AS DOUBLE)/25) AS BIGINT) AS j FROM customer) c0) c
"""

MEDIA_TAGS = """
SELECT file_name, dir_ord, directory, tag_ord, tag, value FROM (
 SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg') AS file_name, 1 AS dir_ord, 'ExifSubIFD' AS directory, 1 AS tag_ord,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'DateTimeDigitized' ELSE 'DateTimeOriginal' END AS tag,
  replace(substr(CAST(ts AS VARCHAR(30)),1,19),'-',':') AS value FROM events WHERE event_id % 4 IN (0,3)
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 2, 'QuickTimeMovieHeader', 1, 'Created', replace(substr(CAST(ts AS VARCHAR(30)),1,19),'-',':') FROM events WHERE event_id % 4 = 1
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 3, 'GPS', 1, 'Latitude', CAST(event_id % 91 AS VARCHAR(20)) FROM events WHERE event_id % 6 = 0
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 3, 'GPS', 2, 'Longitude', concat('-', CAST(event_id % 181 AS VARCHAR(20))) FROM events WHERE event_id % 6 = 0
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 4, 'XMP', 1, 'GPSLatitude', concat(CAST(event_id % 80 AS VARCHAR(20)), ',', CAST(event_id % 60 AS VARCHAR(20)), '.25S') FROM events WHERE event_id % 6 = 1
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 4, 'XMP', 2, 'GPSLongitude', concat(CAST(event_id % 170 AS VARCHAR(20)), ',', CAST(event_id % 60 AS VARCHAR(20)), '.5E') FROM events WHERE event_id % 6 = 1
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 4, 'XMP', 3, 'GPSPosition', concat(CAST(event_id % 80 AS VARCHAR(20)), '.5 N, ', CAST(event_id % 170 AS VARCHAR(20)), '.75 W') FROM events WHERE event_id % 6 = 2
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 5, 'QuickTimeMetadataHeader', 1, 'GPS Location', concat('+', CAST(event_id % 89 AS VARCHAR(20)), '.5-', CAST(event_id % 170 AS VARCHAR(20)), '.125/') FROM events WHERE event_id % 6 = 3
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 6, 'Vendor', 1, 'Position', concat(CAST(event_id % 80 AS VARCHAR(20)), ' deg ', CAST(event_id % 60 AS VARCHAR(20)), ''' ', CAST(event_id % 60 AS VARCHAR(20)), '.5" N, ', CAST(event_id % 170 AS VARCHAR(20)), ' deg ', CAST(event_id % 60 AS VARCHAR(20)), ''' 1.5" W') FROM events WHERE event_id % 6 = 4
 UNION ALL SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg'), 7, 'Vendor', 2, 'Note', CASE WHEN event_id % 12 = 5 THEN '2024-05-10' ELSE 'no position' END FROM events WHERE event_id % 6 = 5
) t
"""

MEDIA_FILES = """
SELECT concat('/media/f', CAST(event_id AS VARCHAR(20)), '.jpg') AS file_name,
 ts AS created_at, ts + INTERVAL '1' HOUR AS modified_at
FROM events
"""

EXISTING_FOLDERS = """
SELECT DISTINCT folder FROM (
 SELECT concat(lpad(CAST(extract(day FROM ts) AS VARCHAR(2)),2,'0'),' Jan 2024') AS folder FROM events WHERE extract(day FROM ts) % 3 = 0
 UNION ALL SELECT concat(lpad(CAST(extract(day FROM ts) AS VARCHAR(2)),2,'0'),' Jan 2024 (1)') FROM events WHERE extract(day FROM ts) % 6 = 0
 UNION ALL SELECT concat(lpad(CAST(extract(day FROM ts) AS VARCHAR(2)),2,'0'),' Jan 2024 (3)') FROM events WHERE extract(day FROM ts) % 6 = 0) t
"""

# names that are numbers of each other, and a folder that holds some of them, with gaps
TANGLED = """
SELECT concat('/in/', CAST(event_id AS VARCHAR(20)), '/', name) AS file_name, name, folder, event_id AS item_no,
 1000 + event_id % 3 AS length, md5(CAST(event_id % 7 AS VARCHAR(20))) AS digest
FROM (SELECT event_id, concat('d', CAST(extract(day FROM ts) AS VARCHAR(20))) AS folder,
  concat('IMG_', CAST(event_id % 40 AS VARCHAR(20)), CASE CAST(floor(CAST(event_id AS DOUBLE)/40) AS BIGINT) % 6 WHEN 1 THEN ' (1)' WHEN 2 THEN ' (3)' WHEN 3 THEN ' (1) (1)' WHEN 4 THEN ' (2)' ELSE '' END, '.jpg') AS name FROM events) t
"""

TANGLED_EXISTING = """
SELECT DISTINCT folder, name, CAST(1000 + k % 3 AS BIGINT) AS length, md5(CAST(k % 7 AS VARCHAR(20))) AS digest
FROM (SELECT concat('d', CAST(extract(day FROM ts) AS VARCHAR(20))) AS folder, event_id % 40 AS k,
  concat('IMG_', CAST(event_id % 40 AS VARCHAR(20)), CASE CAST(event_id % 4 AS INT) WHEN 0 THEN ' (2)' WHEN 1 THEN ' (5)' ELSE ' (1) (2)' END, '.jpg') AS name FROM events WHERE event_id % 40 < 25) t
"""

CONTENT = """
SELECT concat('/docs/', source, '/', CAST(doc_id % 50 AS VARCHAR(20)), '_', CAST(doc_id AS VARCHAR(20)), '.jpg') AS path, text
FROM documents
"""

ALBUM_STATE = """
SELECT user_id AS owner, max(ts) AS last_processed FROM events
WHERE extract(day FROM ts) <= 15 AND user_id % 10 <> 0 GROUP BY user_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str, source: str) -> DataFrame:
    """Run a fixture text over one given table."""
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))
