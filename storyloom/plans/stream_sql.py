"""DuckDB SQL of what the streams leave, written from the rules for whole tables."""

from __future__ import annotations

from storyloom.plans.project_sql import ASKED
from storyloom.plans.script_sql import LISTED

GONE = "(book_id % 4 = 0 AND id >= 20)"
ENDED = f"""{ASKED}, ended AS (SELECT book_id, id, place, path, CASE WHEN error IS NULL AND {GONE} THEN 'Index out of range after reload' ELSE error END AS error FROM asked)"""

CHUNK = "{{'speaker': {0}, 'text': {1}, 'instruct': {2}, 'status': {3}, 'audio_path': {4}}}"
REPLAYED = f"""WITH RECURSIVE {LISTED},
run AS (
  SELECT book_id, 0::BIGINT AS k, list({CHUNK.format("speaker", "text", "instruct", "status", "audio_path")} ORDER BY id) AS l,
    []::STRUCT(speaker VARCHAR, text VARCHAR, instruct VARCHAR, status VARCHAR, audio_path VARCHAR)[][] AS h FROM listed GROUP BY book_id
  UNION ALL
  SELECT book_id, k + 1, CASE WHEN op = 4 AND len(h) > 0 THEN h[len(h)] ELSE coalesce(new, l) END, CASE WHEN op = 4 AND len(h) > 0 THEN h[1:len(h) - 1] WHEN new IS NOT NULL THEN list_append(h, l) ELSE h END
  FROM (
    SELECT book_id, k, l, h, op, CASE
      WHEN op = 0 AND inside THEN l[1:at_ + 1] || [{CHUNK.format("l[at_ + 1].speaker", "''", "''", "'pending'", "NULL")}] || l[at_ + 2:len(l)]
      WHEN op = 1 AND inside AND len(l) > 1 THEN l[1:at_] || l[at_ + 2:len(l)]
      WHEN op = 2 THEN l[1:held] || [{CHUNK.format("'R'", "'restored ' || k", "NULL", "'done'", "'r/' || k")}] || l[held + 1:len(l)]
      WHEN op = 3 AND inside AND (k % 2 = 1 OR k % 4 = 2 OR k % 3 = 0) THEN list_transform(l, lambda x, i: CASE WHEN i = at_ + 1
        THEN {CHUNK.format("CASE WHEN k % 3 = 0 THEN 'S' || k ELSE x.speaker END", "CASE WHEN k % 2 = 1 THEN 'edit ' || k ELSE x.text END", "CASE WHEN k % 4 = 2 THEN NULL ELSE x.instruct END", "'pending'", "x.audio_path")} ELSE x END) END AS new
    FROM (SELECT *, at_ BETWEEN 0 AND len(l) - 1 AS inside, greatest(0, least(at_, len(l))) AS held
      FROM (SELECT *, (book_id + k * k) % 6 AS op, (book_id * 3 + k * 7) % 19 - 1 AS at_ FROM run WHERE k < 24))))
SELECT book_id, i - 1 AS id, e.speaker AS speaker, e.text AS text, e.instruct AS instruct, e.status AS status, e.audio_path AS audio_path
FROM (SELECT book_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS i FROM run WHERE k = 24)"""


def oracle_sql() -> dict[str, str]:
    return {
        "edits_replayed": REPLAYED,
        "render_stream": f"""WITH {ENDED}, r AS (SELECT book_id, id, max_by(error IS NULL, place) AS ok, max_by(path, place) FILTER (error IS NULL) AS path FROM ended GROUP BY 1, 2)
SELECT l.book_id, l.id, CASE WHEN r.ok THEN 'done' WHEN NOT r.ok THEN 'error' ELSE l.status END AS status, coalesce(r.path, l.audio_path) AS audio_path
FROM (SELECT * FROM listed WHERE NOT {GONE}) l LEFT JOIN r ON r.book_id = l.book_id AND r.id = l.id""",
        "render_failures": f"WITH {ENDED} SELECT book_id, id, error FROM ended WHERE error IS NOT NULL",
        "log_ring": """SELECT task, n_lines, seq, line FROM (SELECT event_type AS task, event_id AS seq, props AS line, count(*) OVER (PARTITION BY event_type) AS n_lines,
row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 1000""",
    }
