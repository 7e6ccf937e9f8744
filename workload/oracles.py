"""The same results as plain SQL over the given tables, for every query SQL can express.

Written from the rules, not from the engine: the walk below uses global windows, a running count
of chain breaks and follow-up frames, nearest places are a box join with a ranking.
"""

from __future__ import annotations

from workload import fixtures as fx

PHOTOS = "('.jpg', '.jpeg', '.heic', '.heif', '.avif')"
VIDEOS = "('.mp4', '.mov', '.m4v')"
EXT = r"lower(regexp_extract(file_name, '(\.[^./]+)$', 1))"
BASE = r"regexp_extract(file_name, '([^/]*)$', 1)"

MEDIA = f"media AS ({fx.MEDIA})"
OWNER = f"media AS ({fx.MEDIA_OWNER})"
PLACES = f"places AS ({fx.PLACES})"
WANTED = f"wanted AS (SELECT * FROM media WHERE {EXT} IN {PHOTOS} OR {EXT} IN {VIDEOS})"

SPOTS = (
    "('CSTL','MNMT','PAL','TMPL','MSQE','CH','THTR','OPRA','HSTS','ANS','RUIN','TMB','PYRS','LTHSE',"
    "'TOWR','ARCH','CAVE','PIER','QUAY','GDN','SQR','MUS','ZOO','UNIV','LIBR','STDM','RECG','MAR',"
    "'RSRT','SPA','MSSN','SHRN')"
)


def relevant(precision: int) -> str:
    first = precision == 1
    rules = [
        "feature_class = 'L'",
        "feature_class = 'P'" + (" AND feature_code IN ('PPLC','PPLA','PPLA2','PPL')" if first else ""),
        "feature_class = 'A' AND feature_code IN " + ("('ADM2','ADM3','PCLI')" if first else "('ADM3','ADM4','PCLI')"),
        "feature_class = 'H' AND feature_code IN ('SEA','GULF','STRAIT')",
    ]
    if precision == 3:
        rules.append(f"feature_class = 'S' AND feature_code IN {SPOTS}")
    return " OR ".join(f"({rule})" for rule in rules)


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * 6371 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


def nearest(precision: int) -> str:
    """best(latitude, longitude, tier, geonameid, name, distance_km) over the media's positions."""
    first = 1 if precision == 3 else 2
    return f"""
tiers(tier, class, r) AS (VALUES (1,'S',0.001::DOUBLE),(2,'L',0.01),(3,'P',0.1),(4,'H',1.0),(5,'A',1.0),(6,'P',1.0)),
usable AS (SELECT * FROM places WHERE {relevant(precision)}),
points AS (SELECT DISTINCT latitude, longitude FROM media WHERE latitude <> 0 AND longitude <> 0),
hits AS (SELECT p.latitude, p.longitude, t.tier, u.geonameid, u.name,
  {km('p.latitude', 'p.longitude', 'u.latitude', 'u.longitude')} AS distance_km
 FROM points p JOIN (SELECT u0.*, t0.tier, t0.r FROM usable u0 JOIN tiers t0 ON t0.class = u0.feature_class WHERE t0.tier >= {first}) u
  ON u.latitude BETWEEN p.latitude - u.r AND p.latitude + u.r AND u.longitude BETWEEN p.longitude - u.r AND p.longitude + u.r
 JOIN tiers t ON t.tier = u.tier),
best AS (SELECT p.latitude, p.longitude, h.tier, h.geonameid, h.name, h.distance_km FROM points p LEFT JOIN (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY tier, distance_km, geonameid) = 1) h
 ON h.latitude = p.latitude AND h.longitude = p.longitude)"""


NAMED_MEDIA = """
enriched AS (SELECT w.*, b.name AS location_name FROM wanted w LEFT JOIN best b
 ON b.latitude = w.latitude AND b.longitude = w.longitude)"""
UNNAMED_MEDIA = "\nenriched AS (SELECT *, CAST(NULL AS VARCHAR) AS location_name FROM wanted)"


def walked(hours: float, distance: float, library: str = "1") -> str:
    """filled, then steps with album_id, from `enriched`."""
    limit = int(hours * 3_600_000_000)
    order = f"PARTITION BY {library} ORDER BY date_created, file_name"
    if distance > 0:
        filled = f"""
f0 AS (SELECT *, epoch_us(date_created) AS t, (latitude <> 0 OR longitude <> 0) AS pos FROM enriched),
f1 AS (SELECT *, lag(t) OVER o AS prev_t, lag(file_name) OVER o AS prev_file0,
  last_value(CASE WHEN pos THEN latitude END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_lat,
  last_value(CASE WHEN pos THEN longitude END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_lon,
  last_value(CASE WHEN pos THEN coalesce(location_name, chr(1)) END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_name,
  first_value(CASE WHEN pos THEN t END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_t,
  first_value(CASE WHEN pos THEN latitude END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_lat,
  first_value(CASE WHEN pos THEN longitude END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_lon,
  first_value(CASE WHEN pos THEN coalesce(location_name, chr(1)) END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_name,
  first_value(CASE WHEN pos THEN file_name END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_file
 FROM f0 WINDOW o AS ({order})),
f2 AS (SELECT *, t - prev_t AS gap, b_t - t AS until, coalesce(b_t - t <= {limit}, false) AS reach FROM f1),
f3 AS (SELECT *, sum(CASE WHEN pos THEN 0 WHEN gap IS NULL OR gap > {limit} OR (reach AND until < gap) THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS cum
 FROM f2 WINDOW o AS ({order})),
f4 AS (SELECT *, last_value(CASE WHEN pos THEN cum END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_a
 FROM f3 WINDOW o AS ({order})),
f5 AS (SELECT *, CASE WHEN pos THEN 'own' WHEN cum_a = cum THEN 'back' WHEN reach THEN 'next' ELSE 'none' END AS how FROM f4),
f6 AS (SELECT *, lag(how) OVER ({order}) AS prev_how FROM f5),
f7 AS (SELECT *, coalesce(gap <= {limit}, false) AND prev_how IN ('own', 'back', 'next') AS behind,
  how = 'back' OR (how = 'next' AND prev_how = 'next' AND gap <= {limit} AND gap <= until) AS via_prev FROM f6),
filled AS (SELECT * REPLACE (
   CASE how WHEN 'back' THEN a_lat WHEN 'next' THEN b_lat ELSE latitude END AS latitude,
   CASE how WHEN 'back' THEN a_lon WHEN 'next' THEN b_lon ELSE longitude END AS longitude,
   nullif(CASE how WHEN 'back' THEN a_name WHEN 'next' THEN b_name ELSE location_name END, chr(1)) AS location_name) FROM f7)"""
    else:
        filled = "\nfilled AS (SELECT *, epoch_us(date_created) AS t FROM enriched)"
    by_time = f"coalesce(gap_hours >= {hours}, false)" if hours > 0 else "false"
    by_distance = f"coalesce(step_km >= {distance}, false)" if distance > 0 else "false"
    return f"""{filled},
s1 AS (SELECT *, lag(t) OVER o AS s_t, lag(latitude) OVER o AS s_lat, lag(longitude) OVER o AS s_lon, lag(file_name) OVER o AS prev_file
 FROM filled WINDOW o AS ({order})),
s2 AS (SELECT *, (t - s_t) / 3600000000.0 AS gap_hours,
  CASE WHEN latitude <> 0 AND longitude <> 0 AND s_lat <> 0 AND s_lon <> 0 THEN {km('s_lat', 's_lon', 'latitude', 'longitude')} END AS step_km FROM s1),
s3 AS (SELECT *, {by_time} AS time_break, {by_distance} AS distance_break FROM s2),
steps AS (SELECT *, 1 + sum(CASE WHEN time_break OR distance_break THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS album_id FROM s3)"""


def figures(library: str = "1") -> str:
    return f"""
figures AS (SELECT {library} AS lib, album_id, min(date_created) AS first_date, max(date_created) AS last_date, count(*) AS files,
 coalesce(bool_or(length(location_name) > 0), false) AS has_place FROM steps GROUP BY 1, 2),
date_named AS (SELECT *, strftime(first_date, '%d %b %Y') || CASE WHEN first_date::DATE <> last_date::DATE THEN ' - ' || strftime(last_date, '%d %b %Y') ELSE '' END AS date_name FROM figures)"""


TOP = """
place_counts AS (SELECT album_id, trim(location_name) AS place, count(*) AS n, min(date_created) AS seen FROM steps WHERE trim(location_name) <> '' GROUP BY 1, 2),
top_four AS (SELECT * FROM place_counts QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY n DESC, seen) <= 4),
top_lists AS (SELECT album_id, list(place ORDER BY seen) AS places FROM top_four GROUP BY 1),
place_named AS (SELECT d.*, l.places, list_transform(l.places, lambda x: regexp_replace(trim(replace(x, '/', '')), ' {2,}', ' ', 'g')) AS clean
 FROM date_named d LEFT JOIN top_lists l ON l.album_id = d.album_id)"""

LIST_NAME = """CASE len(clean) WHEN 1 THEN clean[1] WHEN 2 THEN clean[1] || ' and ' || clean[2]
 ELSE array_to_string(clean[1:len(clean)-1], ', ') || ', and ' || clean[len(clean)] END"""

PARTS = """
part_a AS (SELECT *, CASE WHEN lag(base) OVER (PARTITION BY lib ORDER BY album_id) = base THEN 0 ELSE 1 END AS fresh FROM based),
part_b AS (SELECT *, sum(fresh) OVER (PARTITION BY lib ORDER BY album_id ROWS UNBOUNDED PRECEDING) AS island FROM part_a),
part_c AS (SELECT *, CAST(row_number() OVER (PARTITION BY lib, island ORDER BY album_id) AS INTEGER) AS part FROM part_b),
albums AS (SELECT *, base || CASE WHEN part >= 2 THEN ' (part ' || part || ')' ELSE '' END AS album_name FROM part_c)"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in ctes) + "\n" + select


def single(hours: float, distance: float) -> list[str]:
    return [MEDIA, WANTED, UNNAMED_MEDIA, walked(hours, distance)]


def by_owner() -> list[str]:
    return [OWNER, WANTED, UNNAMED_MEDIA, walked(48, 10, "owner")]


def placed(hours: float, distance: float) -> list[str]:
    return [MEDIA, WANTED, PLACES, nearest(3), NAMED_MEDIA, walked(hours, distance)]


def date_albums(hours: float, distance: float) -> list[str]:
    return [*single(hours, distance), figures(), "based AS (SELECT *, date_name AS base FROM date_named)", PARTS]


def place_albums(hours: float, distance: float, base: str) -> list[str]:
    named = f"based AS (SELECT *, CASE WHEN has_place THEN {LIST_NAME}{base} ELSE date_name END AS base FROM place_named)"
    return [*placed(hours, distance), figures(), TOP, named, PARTS]


LATITUDE = """CASE event_id % 6
  WHEN 0 THEN CASE WHEN event_id % 91 = 0 AND event_id % 181 = 0 THEN 0 ELSE event_id % 91 END
  WHEN 1 THEN -(event_id % 80 + (event_id % 60 + 0.25) / 60.0)
  WHEN 2 THEN event_id % 80 + 0.5 WHEN 3 THEN event_id % 89 + 0.5
  WHEN 4 THEN event_id % 80 + (event_id % 60) / 60.0 + (event_id % 60 + 0.5) / 3600.0
  ELSE CASE WHEN event_id % 12 = 5 THEN -5 ELSE 0 END END"""
LONGITUDE = """CASE event_id % 6
  WHEN 0 THEN -(event_id % 181) WHEN 1 THEN event_id % 170 + (event_id % 60 + 0.5) / 60.0
  WHEN 2 THEN -(event_id % 170 + 0.75) WHEN 3 THEN -(event_id % 170 + 0.125)
  WHEN 4 THEN -(event_id % 170 + (event_id % 60) / 60.0 + 1.5 / 3600.0)
  ELSE CASE WHEN event_id % 12 = 5 THEN -10 ELSE 0 END END"""
TAG_FILE = "concat('/media/f', CAST(event_id AS VARCHAR), '.jpg') AS file_name"
TAG_DATE = "CASE WHEN event_id % 4 = 2 THEN ts ELSE date_trunc('second', ts) END"
TAG_PLACE = (
    f"round(CAST({LATITUDE} AS DOUBLE), 9) AS latitude, round(CAST({LONGITUDE} AS DOUBLE), 9) AS longitude"
)

PLACEMENT = rf"""
named_files AS (SELECT s.file_name, s.date_created, a.album_name, {BASE.replace('file_name', 's.file_name')} AS name, s.length, s.content_md5
 FROM steps s JOIN albums a ON a.album_id = s.album_id),
contents AS (SELECT album_name, name, length, content_md5, min(date_created) AS seen FROM named_files GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY album_name, name ORDER BY seen) - 1 AS number FROM contents),
manifest AS (SELECT f.file_name, f.album_name,
  CASE WHEN n.number = 0 THEN f.name ELSE regexp_replace(f.name, '^(.*)(\.[^.]*)$', '\1 (' || n.number || ')\2') END AS target_name,
  CASE WHEN n.seen = f.date_created THEN 'PLACE' ELSE 'SKIP_IDENTICAL' END AS action
 FROM named_files f JOIN numbered n ON n.album_name = f.album_name AND n.name = f.name AND n.length = f.length AND n.content_md5 = f.content_md5)"""

ONTO_EXISTING = rf"""
present AS (SELECT *, true AS there FROM numbered WHERE number = 0 AND CAST(regexp_extract(name, 'IMG_(\d+)', 1) AS INTEGER) % 3 = 0),
again AS (SELECT c.*, p.there, row_number() OVER (PARTITION BY c.album_name, c.name ORDER BY c.there_key, c.seen) AS k FROM (
   SELECT n.*, CASE WHEN n.number = 0 AND CAST(regexp_extract(n.name, 'IMG_(\d+)', 1) AS INTEGER) % 3 = 0 THEN 0 ELSE 1 END AS there_key FROM numbered n) c
  LEFT JOIN present p ON p.album_name = c.album_name AND p.name = c.name AND p.length = c.length AND p.content_md5 = c.content_md5),
result AS (SELECT f.file_name, f.album_name,
  CASE WHEN n.k = 1 THEN f.name ELSE regexp_replace(f.name, '^(.*)(\.[^.]*)$', '\1 (' || (n.k - 1) || ')\2') END AS target_name,
  CASE WHEN n.there THEN 'SKIP_IDENTICAL' WHEN n.seen = f.date_created THEN 'PLACE' ELSE 'SKIP_IDENTICAL' END AS action
 FROM named_files f JOIN again n ON n.album_name = f.album_name AND n.name = f.name AND n.length = f.length AND n.content_md5 = f.content_md5)"""

# the rule arrival by arrival: `taken` is a map of a family's names to what they hold
TANGLED_SQL = rf"""
WITH RECURSIVE files AS (SELECT *, regexp_replace(name, '(?: \(\d+\))*\.jpg$', '') AS root, concat(length, ':', digest) AS content FROM ({fx.TANGLED})),
present AS (SELECT *, regexp_replace(name, '(?: \(\d+\))*\.jpg$', '') AS root, concat(length, ':', digest) AS content FROM ({fx.TANGLED_EXISTING})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY folder, root ORDER BY item_no) AS k FROM files),
families AS (SELECT DISTINCT folder, root FROM files),
start AS (SELECT f.folder, f.root, coalesce(list(p.name) FILTER (p.name IS NOT NULL), []) AS names, coalesce(list(p.content) FILTER (p.name IS NOT NULL), []) AS contents
  FROM families f LEFT JOIN present p ON p.folder = f.folder AND p.root = f.root GROUP BY 1, 2),
run AS (SELECT folder, root, CAST(0 AS BIGINT) AS k, names, contents, '' AS file_name, '' AS target_name, '' AS action FROM start
  UNION ALL SELECT folder, root, k, CASE WHEN held = 0 THEN list_append(names, slot) ELSE names END, CASE WHEN held = 0 THEN list_append(contents, content) ELSE contents END,
   file_name, slot, CASE WHEN held = 0 THEN 'PLACE' ELSE 'SKIP_IDENTICAL' END
  FROM (SELECT *, coalesce(list_position(names, slot), 0) AS held FROM (
   SELECT n.folder, n.root, n.k, r.names, r.contents, n.file_name, n.content,
    list_filter(list_transform(range(0, len(r.names) + 1), lambda i: CASE WHEN i = 0 THEN n.name ELSE regexp_replace(n.name, '\.jpg$', ' (' || i || ').jpg') END),
     lambda x: coalesce(list_position(r.names, x), 0) = 0 OR r.contents[list_position(r.names, x)] = n.content)[1] AS slot
   FROM run r JOIN numbered n ON n.folder = r.folder AND n.root = r.root AND n.k = r.k + 1) a) b)
SELECT file_name, folder AS album_name, target_name, action FROM run WHERE k > 0
"""

CONTENT = f"content AS (SELECT path, encode(text) AS bytes, octet_length(encode(text)) AS length FROM ({fx.CONTENT}))"


TREE = """tree AS (SELECT concat(source, '/d', CAST(doc_id % 3 AS VARCHAR), '/', CAST(doc_id AS VARCHAR),
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.txt' WHEN 1 THEN '.MP4' ELSE '.jpg' END) AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length, text FROM documents)"""


def duplicates(key: str) -> str:
    return _sql(
        CONTENT,
        select=f"SELECT CAST(length AS BIGINT) AS length, count(*) AS files, min(path) AS first_path FROM content GROUP BY length, {key} HAVING count(*) > 1",
    )


def violations(chars: str) -> str:
    segments = "list_filter(string_split(path, '/'), lambda x: x <> '')"
    names = "'CON','PRN','AUX','NUL'," + ",".join(f"'COM{n}','LPT{n}'" for n in range(1, 10))
    return f"""concat_ws('; ', CASE WHEN trim(path) = '' THEN 'blank' END,
  CASE WHEN len(list_filter({segments}, lambda x: regexp_matches(x, '[{chars}]'))) > 0 THEN 'invalid characters' END,
  CASE WHEN len(list_filter({segments}, lambda x: upper(x) IN ({names}))) > 0 THEN 'reserved name' END)"""


_PORTABLE = r'/\x00-\x1f<>:"\\|?*'

MARKS = f"{OWNER}, marks AS ({fx.ALBUM_STATE})"


def oracle_sql() -> dict[str, str]:
    media = lambda condition, columns="event_id, file_name": _sql(MEDIA, select=f"SELECT {columns} FROM media WHERE {condition}")
    both = f"({EXT} IN {PHOTOS} OR {EXT} IN {VIDEOS})"
    place_columns = "geonameid, name, latitude, longitude, feature_class, feature_code, country, admin1, population"
    place_rows = lambda p: _sql(PLACES, select=f"SELECT {place_columns} FROM places WHERE {relevant(p)}")
    best = lambda p: _sql(
        MEDIA, PLACES, nearest(p),
        select="SELECT latitude, longitude, CAST(coalesce(tier, 0) AS INTEGER) AS tier, coalesce(geonameid, -1) AS geonameid, name, round(distance_km, 6) AS distance_km FROM best",
    )
    ids = lambda ctes, columns="event_id": _sql(*ctes, select=f"SELECT {columns}, CAST(album_id AS BIGINT) AS album_id FROM steps")
    album_rows = "SELECT CAST(album_id AS BIGINT) AS album_id, album_name, part FROM albums"
    names_ = lambda ctes: _sql(*ctes, select=album_rows)
    return {
        "media_type_filter": media(both),
        "photos_only": media(f"{EXT} IN {PHOTOS}"),
        "videos_only": media(f"{EXT} IN {VIDEOS}"),
        "scan_dedup_paths": _sql(MEDIA, select=f"SELECT DISTINCT file_name FROM media WHERE {both}"),
        "scan_report": _sql(
            MEDIA, f"per AS (SELECT file_name, count(*) AS seen, max(length) AS length FROM media WHERE {both} GROUP BY 1)",
            select="SELECT count(*) AS files, CAST(sum(seen - 1) AS BIGINT) AS duplicates, CAST(sum(length) AS BIGINT) AS total_bytes FROM per",
        ),
        "total_bytes": media(both, "CAST(sum(length) AS BIGINT) AS total_bytes"),
        "missing_gps_count": media(f"{both} AND latitude = 0 AND longitude = 0", "count(*) AS missing"),
        "tag_dates": f"SELECT {TAG_FILE}, {TAG_DATE} AS date_created FROM events",
        "tag_locations": f"SELECT {TAG_FILE}, {TAG_PLACE} FROM events",
        "media_from_tags": f"""SELECT {TAG_FILE}, {TAG_DATE} AS date_created, {TAG_PLACE} FROM events
WHERE {TAG_DATE} >= TIMESTAMP '2024-01-10 00:00:00' AND {TAG_DATE} < TIMESTAMP '2024-01-20 12:00:00'""",
        "date_range": media("date_created >= TIMESTAMP '2024-01-05 00:00:00' AND date_created < TIMESTAMP '2024-01-12 06:30:00'", "event_id, date_created"),
        "resume_from_mark": f"WITH {MARKS} SELECT event_id, m.owner, date_created FROM media m LEFT JOIN marks k ON k.owner = m.owner WHERE k.owner IS NULL OR date_created >= last_processed",
        "exclude_recent": media("date_created < TIMESTAMP '2024-01-23 09:30:00'", "event_id, date_created"),
        "late_dropped": f"WITH {MARKS} SELECT m.owner, count(*) AS late FROM media m JOIN marks k ON k.owner = m.owner WHERE date_created < last_processed GROUP BY 1",
        "save_mark": _sql(OWNER, select="SELECT owner, max(date_created) AS last_processed FROM media WHERE date_created < TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1"),
        "marks_compacted": _sql(OWNER, select="SELECT owner, max(date_created) AS last_processed FROM media WHERE date_created < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1"),
        "merged_marks": f"""WITH {MARKS} SELECT owner, max(last_processed) AS last_processed FROM (
 SELECT owner, date_created AS last_processed FROM media WHERE date_created < TIMESTAMP '2024-01-12 00:00:00' UNION ALL SELECT * FROM marks) GROUP BY 1""",
        "haversine_steps": _sql(*single(0, 0), select="SELECT event_id, round(step_km, 6) AS distance_km FROM steps WHERE step_km IS NOT NULL"),
        "sanitize_names": _sql(
            PLACES, r"dirty AS (SELECT geonameid, '  ' || name || ': ' || chr(9) || '*  x  ' AS name FROM places)",
            r"""kept AS (SELECT geonameid, replace(name, '/', '') AS a, regexp_replace(name, '[/<>:"\\|?*\x01-\x1f]', '', 'g') AS b FROM dirty)""",
            select=r"SELECT geonameid, regexp_replace(regexp_replace(a, '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g') AS posix, regexp_replace(regexp_replace(b, '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g') AS portable FROM kept",
        ),
        "format_place_list": f"WITH k AS (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS clean FROM events GROUP BY 1, 2) SELECT user_id, CAST(day AS VARCHAR) AS day, {LIST_NAME} AS words FROM k",
        "pluralise_counts": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT -1, event_type, count(*) FROM events GROUP BY 2)
SELECT user_id, event_type, CASE WHEN n = 1 THEN '1 file' ELSE format('{:,}', n) || ' files' END AS label FROM n""",
        "parse_iso_dates": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN event_id % 7 IN (1, 3) THEN date_trunc('minute', ts)
 WHEN event_id % 7 IN (2, 4) THEN date_trunc('second', ts) END AS parsed FROM events""",
        "date_names": """SELECT event_id, strftime(ts, '%d %b %Y') AS usual, strftime(ts, '%A %-d %B %y, %H:%M:%S') AS long_form,
 strftime(ts, '%m/%d/%Y at %-I %p') AS slashes, 'YYYY-' || strftime(ts, '%m') AS unknown_letters FROM events""",
        "template_paths": """SELECT event_id, 'Trip to ' || event_type AS plain, strftime(ts, '%Y') || '/' || event_type AS year,
 strftime(ts, '%Y/%m_') || event_type AS month, strftime(ts, 'Year %Y/%B/') || event_type AS words, 'abs' || event_type AS rooted, '<yyyy' || event_type AS open FROM events""",
        "name_violations": f"""WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'con' WHEN 1 THEN '2024/' || c_name WHEN 2 THEN '  '
 WHEN 3 THEN 'a/LPT1/b: c' WHEN 4 THEN 'COM1.txt' ELSE c_mktsegment || '?' END AS path FROM customer)
SELECT c_custkey, {violations('/')} AS posix, {violations(_PORTABLE)} AS portable FROM p""",
        "places_relevant_p1": place_rows(1),
        "places_relevant_p2": place_rows(2),
        "places_relevant_p3": place_rows(3),
        "geonames_text_reader": place_rows(3),
        "places_near_media": _sql(
            MEDIA, PLACES, "spots AS (SELECT DISTINCT latitude, longitude FROM media WHERE latitude <> 0 OR longitude <> 0)",
            select="""SELECT geonameid, name FROM places p WHERE EXISTS (SELECT 1 FROM spots m WHERE m.latitude BETWEEN p.latitude - 1 AND p.latitude + 1
 AND m.longitude BETWEEN p.longitude - 1 AND p.longitude + 1)""",
        ),
        "places_load_counts": _sql(
            MEDIA, PLACES, "spots AS (SELECT DISTINCT latitude, longitude FROM media WHERE latitude <> 0 OR longitude <> 0)",
            select=f"""SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM spots m WHERE m.latitude BETWEEN p.latitude - 1 AND p.latitude + 1
 AND m.longitude BETWEEN p.longitude - 1 AND p.longitude + 1)) AS kept FROM places p WHERE {relevant(3)}""",
        ),
        "box_join": _sql(
            MEDIA, PLACES, "points AS (SELECT DISTINCT latitude, longitude FROM media WHERE latitude <> 0 AND longitude <> 0)",
            select="""SELECT m.latitude, m.longitude, p.geonameid AS place_geonameid FROM points m JOIN places p
 ON p.latitude BETWEEN m.latitude - 0.01 AND m.latitude + 0.01 AND p.longitude BETWEEN m.longitude - 0.01 AND m.longitude + 0.01""",
        ),
        "nearest_place_p1": best(1),
        "nearest_place_p2": best(2),
        "nearest_place_p3": best(3),
        "enrich_media": _sql(MEDIA, WANTED, PLACES, nearest(3), NAMED_MEDIA, select="SELECT event_id, location_name FROM enriched"),
        "impute_locations": _sql(*single(0.25, 10), select="SELECT event_id, latitude, longitude FROM filled"),
        "impute_audit": _sql(
            *single(0.25, 10),
            select="""SELECT event_id, CASE WHEN via_prev THEN prev_file0 ELSE b_file END AS source_file, CASE WHEN via_prev THEN gap ELSE until END AS source_gap,
 CASE WHEN via_prev AND reach THEN b_file WHEN NOT via_prev AND behind THEN prev_file0 END AS rejected_file,
 CASE WHEN via_prev AND reach THEN until WHEN NOT via_prev AND behind THEN gap ELSE -1 END AS rejected_gap FROM f7 WHERE how IN ('back', 'next')""",
        ),
        "album_ids": ids(single(0.25, 10)),
        "album_ids_time_only": ids(single(0.25, 0)),
        "album_ids_distance_only": ids(single(0, 10)),
        "album_ids_by_owner": ids(by_owner(), "event_id, owner"),
        "album_breaks": _sql(
            *single(0.25, 10),
            select=f"""SELECT event_id, prev_file, round(gap_hours, 6) AS gap_hours, round(step_km, 6) AS distance_km, time_break, distance_break,
 {BASE.replace('file_name', 'prev_file')} AS prev_name, {BASE} AS curr_name FROM steps WHERE time_break OR distance_break""",
        ),
        "album_break_texts": _sql(
            *single(0.25, 10),
            select=f"""SELECT event_id, {BASE.replace('file_name', 'prev_file')} AS prev_name, {BASE} AS curr_name,
 concat_ws(' and ', CASE WHEN time_break THEN printf('time (%.2f hrs)', ((t - s_t) * 2 + 36000000) // 72000000 / 100.0) END,
  CASE WHEN distance_break THEN printf('distance (%.2f km)', step_km) END) AS reason FROM steps WHERE time_break OR distance_break""",
        ),
        "imputation_texts": _sql(
            *single(0.25, 10),
            """audit AS (SELECT event_id, CASE WHEN via_prev THEN prev_file0 ELSE b_file END AS source, CASE WHEN via_prev THEN gap ELSE until END AS g,
 CASE WHEN via_prev AND reach THEN until WHEN NOT via_prev AND behind THEN gap END AS r FROM f7 WHERE how IN ('back', 'next'))""",
            select=rf"""SELECT event_id, {BASE.replace('file_name', 'source')} AS source_name, strftime(make_timestamp(g), '%H:%M:%S') AS source_gap_text,
 coalesce(strftime(make_timestamp(r), '%H:%M:%S'), 'none') AS rejected_gap_text FROM audit""",
        ),
        "album_dates": _sql(*by_owner(), select="SELECT owner, CAST(album_id AS BIGINT) AS album_id, min(date_created) AS first_date, max(date_created) AS last_date, count(*) AS files FROM steps GROUP BY 1, 2"),
        "album_top_places": _sql(*placed(0.25, 10), figures(), TOP, select="SELECT CAST(album_id AS BIGINT) AS album_id, array_to_string(places, '|') AS places FROM top_lists"),
        "album_names_dates": names_(date_albums(0.25, 10)),
        "album_names_places": names_(place_albums(0.25, 10, "")),
        "album_names_append": names_(place_albums(0.25, 10, " || strftime(first_date, ' (%B %Y)')")),
        "album_names_prefix": _sql(
            *by_owner(), figures("owner"), "based AS (SELECT *, strftime(first_date, '%Y/%m_') || date_name AS base FROM date_named)", PARTS,
            select="SELECT lib AS owner, CAST(album_id AS BIGINT) AS album_id, album_name, part FROM albums",
        ),
        "album_unique_names": _sql(
            *single(0.25, 0), figures(), f"there AS ({fx.EXISTING_FOLDERS})",
            """free AS (SELECT date_name, min(n) AS n FROM (SELECT DISTINCT d.date_name, g.n FROM date_named d JOIN there e ON e.folder = d.date_name, range(1, 50) g(n)
  WHERE NOT EXISTS (SELECT 1 FROM there x WHERE x.folder = d.date_name || ' (' || g.n || ')')) GROUP BY 1)""",
            "based AS (SELECT d.*, d.date_name || CASE WHEN f.n IS NULL THEN '' ELSE ' (' || f.n || ')' END AS base FROM date_named d LEFT JOIN free f ON f.date_name = d.date_name)",
            PARTS, select="SELECT CAST(album_id AS BIGINT) AS album_id, album_name FROM albums",
        ),
        "album_parts": names_(date_albums(0.25, 0)),
        "album_no_parts": _sql(*single(0.25, 10), figures(), select="SELECT CAST(album_id AS BIGINT) AS album_id, date_name AS album_name, 0 AS part FROM date_named"),
        "album_catalog": _sql(
            *by_owner(), figures("owner"), "based AS (SELECT *, date_name AS base FROM date_named)", PARTS,
            select="SELECT lib AS owner, album_name, '/albums/' || lib || '/' || album_name AS album_path, min(first_date) AS album_date, CAST(sum(files) AS BIGINT) AS files FROM albums GROUP BY lib, album_name",
        ),
        "album_preview": _sql(
            *date_albums(0.25, 10),
            select="""SELECT album_name, CAST(sum(files) AS BIGINT) AS files, CASE WHEN sum(files) = 1 THEN '1 file' ELSE format('{:,}', CAST(sum(files) AS BIGINT)) || ' files' END AS files_text
 FROM albums GROUP BY album_name""",
        ),
        "file_preview": _sql(
            *date_albums(0.25, 10),
            select=f"SELECT a.album_name, s.file_name, {BASE.replace('file_name', 's.file_name')} AS name FROM steps s JOIN albums a ON a.album_id = s.album_id",
        ),
        "run_totals": _sql(*date_albums(0.25, 10), select="SELECT CAST(sum(files) AS BIGINT) AS files, count(DISTINCT album_name) AS albums FROM albums"),
        "content_duplicates_md5": duplicates("md5(bytes)"),
        "content_duplicates_sha": duplicates("sha256(bytes)"),
        "content_duplicates_prefix": duplicates("bytes"),
        "content_same_prefix": """SELECT CAST(70008 AS BIGINT) AS length, count(*) AS files, min(concat('/long/', CAST(doc_id AS VARCHAR), '.mp4')) AS first_path
FROM documents GROUP BY doc_id % 100 HAVING count(*) > 1""",
        "content_files_twins": _sql(
            TREE, select="SELECT name, length FROM tree QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1"
        ),
        "content_long_twins": _sql(
            "blocks AS (SELECT CAST(floor(doc_id / 200) AS BIGINT) AS block, sum(octet_length(encode(coalesce(text, '')))) + count(*) AS length FROM documents GROUP BY 1)",
            select="SELECT concat(block, '/', n, '.mp4') AS name, CAST(length AS BIGINT) AS length, concat(block, '/a.mp4') AS first_name FROM blocks, (VALUES ('a'), ('b')) t(n)",
        ),
        "content_crc_ranges": _sql(
            TREE, select="SELECT name, length FROM tree QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1"
        ),
        "failed_files": _sql(
            TREE, "ids AS (SELECT name, CAST(regexp_extract(name, '(\\d+)\\.[^/.]*$', 1) AS BIGINT) AS doc FROM tree)",
            select="SELECT name, 'not found' AS reason FROM ids WHERE doc % 7 = 3 UNION ALL SELECT 'nowhere', 'not found'",
        ),
        "placement_failures": _sql(
            "docs AS (SELECT source AS album_name, doc_id, doc_id % 10 AS name, octet_length(encode(text)) AS length, md5(text) AS digest FROM documents)",
            "good AS (SELECT *, row_number() OVER (PARTITION BY album_name, name, length, digest ORDER BY doc_id) AS k FROM docs WHERE doc_id % 7 <> 3)",
            select="""SELECT album_name, CASE WHEN k = 1 THEN 'PLACE' ELSE 'SKIP_IDENTICAL' END AS action, count(*) AS files FROM good GROUP BY 1, 2
 UNION ALL SELECT album_name, 'FAILED', count(*) FROM docs WHERE doc_id % 7 = 3 GROUP BY 1""",
        ),
        "scan_files": _sql(TREE, select="SELECT name, length FROM tree WHERE name NOT LIKE '%.txt'"),
        "existing_listing": _sql(
            TREE, select="SELECT regexp_extract(name, '(.*)/', 1) AS folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS total_bytes FROM tree GROUP BY 1"
        ),
        "content_twins": _sql(
            CONTENT, "hashed AS (SELECT path, length, md5(bytes) AS digest FROM content)",
            select="SELECT path, digest, min(path) OVER (PARTITION BY length, digest) AS first_path FROM hashed QUALIFY count(*) OVER (PARTITION BY length, digest) > 1",
        ),
        "placement_manifest": _sql(*date_albums(0, 10), PLACEMENT, select="SELECT file_name, album_name, target_name, album_name || '/' || target_name AS target_path, action FROM manifest"),
        "placement_onto_existing": _sql(*date_albums(0, 10), PLACEMENT, ONTO_EXISTING, select="SELECT file_name, album_name, target_name, action FROM result"),
        "placement_tangled": TANGLED_SQL,
        "written_run": _sql(
            *date_albums(0, 10), PLACEMENT,
            "acts AS (SELECT album_name, count(*) FILTER (action = 'PLACE') AS placed, count(*) FILTER (action <> 'PLACE') AS skipped FROM manifest GROUP BY 1)",
            "catalog AS (SELECT album_name, CAST(sum(files) AS BIGINT) AS files, min(first_date) AS album_date FROM albums GROUP BY 1)",
            select="""SELECT c.album_name, c.album_name AS album_path, album_date, files, placed, skipped, 2 AS run, (SELECT max(date_created) FROM steps) AS mark
 FROM catalog c JOIN acts a ON a.album_name = c.album_name""",
        ),
        "placement_counts": _sql(*date_albums(0, 10), PLACEMENT, select="SELECT action, count(*) AS files FROM manifest GROUP BY 1"),
        "stream_sessions": """WITH s1 AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 86400000000 THEN 0 ELSE 1 END AS fresh FROM events),
s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s1),
s3 AS (SELECT user_id, min(ts) AS first_date, max(ts) AS last_date, count(*) AS files FROM s2 GROUP BY user_id, n)
SELECT * FROM s3 WHERE epoch_us(last_date) + 86400000000 - 1 <= (SELECT epoch_us(max(ts)) FROM events)""",
        "stream_albums": _sql(
            *date_albums(0.25, 10), "newest AS (SELECT max(t) AS t FROM steps)",
            select="""SELECT s.file_name, s.date_created, s.latitude, s.longitude, CAST(s.album_id AS BIGINT) AS album_id, a.album_name, a.part
 FROM steps s JOIN albums a ON a.album_id = s.album_id, newest n WHERE n.t - epoch_us(a.last_date) > 900000000""",
        ),
        "stream_albums_by_owner": _sql(
            *by_owner(), figures("owner"), "based AS (SELECT *, date_name AS base FROM date_named)", PARTS,
            "newest AS (SELECT max(t) AS t FROM steps)",
            select="""SELECT s.owner, s.file_name, CAST(s.album_id AS BIGINT) AS album_id, a.part
 FROM steps s JOIN albums a ON a.album_id = s.album_id AND a.lib = s.owner, newest n WHERE n.t - epoch_us(a.last_date) > 48 * 3600000000""",
        ),
        "stream_flush": _sql(
            *by_owner(), figures("owner"), "based AS (SELECT *, date_name AS base FROM date_named)", PARTS,
            select="SELECT s.owner, s.file_name, CAST(s.album_id AS BIGINT) AS album_id, a.part FROM steps s JOIN albums a ON a.album_id = s.album_id AND a.lib = s.owner",
        ),
        "stream_late": _sql(MEDIA, WANTED, select="SELECT file_name, date_created FROM wanted WHERE date_created BETWEEN '2024-01-03' AND '2024-01-04'"),
        "grouping_run": _sql(
            *placed(0.25, 10), figures(), TOP,
            f"based AS (SELECT *, strftime(first_date, '%Y/') || CASE WHEN has_place THEN {LIST_NAME} || strftime(first_date, ' (%b %Y)') ELSE date_name END AS base FROM place_named)",
            PARTS,
            select="SELECT s.event_id, s.location_name, CAST(s.album_id AS BIGINT) AS album_id, a.album_name, a.part FROM steps s JOIN albums a ON a.album_id = s.album_id",
        ),
    }
