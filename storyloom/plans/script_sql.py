"""DuckDB SQL that gives the rows of the script queries, written from their definitions."""

from __future__ import annotations

ENTRIES = """lines AS (SELECT doc_id AS book_id, string_split(text, chr(10)) AS ls FROM documents),
entries AS (
  SELECT book_id, pos, CASE (pos // 3) % 5 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'Alice' WHEN 2 THEN 'Bob' WHEN 3 THEN 'Élan & co' ELSE 'Dora' END AS speaker,
    text, CASE WHEN (pos // 6) % 2 = 0 THEN 'calm' ELSE '' END AS instruct
  FROM (SELECT book_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS text FROM lines))"""

CONFIG = """config(speaker, type, voice, character_style, default_style, seed, adapter_id, description) AS (VALUES
  ('NARRATOR', 'custom', 'deep', 'measured', 'plain', '7', NULL, NULL), ('Alice', 'clone', NULL, NULL, 'bright', '-1', NULL, NULL),
  ('Bob', 'builtin_lora', NULL, 'gruff', NULL, NULL, 'a1', NULL), ('Dora', 'design', NULL, NULL, NULL, NULL, NULL, ' A warm voice '))"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def norm(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(lower({x}), '[^\pL\pM\pN_\s\x0b]', '', 'g'), '[\s\x0b]+', ' ', 'g')")


def meant(x: str) -> str:
    """What is to come of the words that the query breaks."""
    for word, to in (("e th", "''"), ("n th", "''"), ("e de", '"'), ("d th", '"'), ("t th", '"'), ("s de", "—"), ("r th", "–"), ("a de", "…")):
        x = f"replace({x}, '{word}', '{to}')"
    return x


def words(x: str) -> str:
    return f"CASE WHEN {norm(x)} = '' THEN 0 ELSE len(string_split({norm(x)}, ' ')) END"


def structural(x: str) -> str:
    s = strip(x)
    return f"({s} = '' OR (length({s}) < 80 AND right({s}, 1) NOT IN ('.', '!', '?')))"


def section(x: str) -> str:
    s = strip(x)
    return rf"(regexp_matches({s}, '(?i)^chapter\b') OR ({s} = upper({s}) AND length({s}) < 80 AND regexp_matches({s}, '^[\x00-\x7F]*$')))"


PLAIN = r"regexp_replace(name, '[^\pL\pM\pN_\- ]', '', 'g')"
STEM = r"lower(regexp_replace({0}, '[^\pL\pM\pN_\-]', '_', 'g'))"
KEY = "CASE WHEN c.type = 'clone' THEN 'clone:' || e.speaker WHEN c.type IN ('lora', 'builtin_lora') THEN 'lora:' || coalesce(c.adapter_id, '') WHEN c.type = 'design' THEN 'design' ELSE 'custom' END"
SIDES = f"""{ENTRIES},
o AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) // 25 AS batch_no, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) % 25 AS idx FROM entries),
c AS (
  SELECT book_id, batch_no, idx, CASE WHEN pos % 7 = 3 THEN substr(text, 1, 40) ELSE text END AS text,
    CASE WHEN pos % 11 = 5 THEN 'NARRATOR' ELSE speaker END AS speaker, instruct FROM o WHERE NOT (book_id % 5 = 0 AND idx = 24)),
stats AS (
  SELECT book_id, batch_no, count(o.text) AS n_original, count(c.text) AS n_corrected,
    count(*) FILTER (o.text IS NOT NULL AND c.text IS NOT NULL AND o.text <> c.text) AS text_changed,
    count(*) FILTER (o.text IS NOT NULL AND c.text IS NOT NULL AND o.speaker <> c.speaker) AS speaker_changed,
    count(*) FILTER (o.text IS NOT NULL AND c.text IS NOT NULL AND o.instruct <> c.instruct) AS instruct_changed,
    sum({words("coalesce(o.text, '')")})::BIGINT AS words_original, sum({words("coalesce(c.text, '')")})::BIGINT AS words_corrected
  FROM o FULL JOIN c USING (book_id, batch_no, idx) GROUP BY book_id, batch_no),
gate AS (SELECT *, CASE WHEN words_original = 0 THEN 1.0 ELSE words_corrected / words_original END AS ratio, CASE WHEN words_original = 0 THEN true ELSE words_corrected / words_original >= 0.95 END AS passed FROM stats)"""


def packed(source: str, hard: str, cap: int) -> str:
    return f"""flags AS (SELECT *, {hard} AS hard FROM {source} WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
runs AS (SELECT *, sum(CASE WHEN coalesce(hard, true) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos) AS run FROM flags),
arrays AS (
  SELECT book_id, run, list(pos ORDER BY pos) AS ps, list(text ORDER BY pos) AS ts, min(speaker) AS speaker, min(instruct) AS instruct FROM runs GROUP BY book_id, run),
cut AS (
  SELECT *, list_reduce(list_transform(ts, lambda t: length(t)::BIGINT), lambda a, x: CASE WHEN a.total + 1 + x > {cap}
    THEN {{'total': x, 'g': a.g + 1, 'gs': list_append(a.gs, a.g + 1)}} ELSE {{'total': a.total + 1 + x, 'g': a.g, 'gs': list_append(a.gs, a.g)}} END,
    {{'total': 1000000000::BIGINT, 'g': 0::BIGINT, 'gs': []::BIGINT[]}}).gs AS gs FROM arrays),
flat AS (SELECT book_id, run, speaker, instruct, unnest(ps) AS pos, unnest(ts) AS text, unnest(gs) AS g FROM cut),
packed AS (
  SELECT book_id, min(pos) AS pos, count(*) AS n_entries, any_value(speaker) AS speaker, any_value(instruct) AS instruct, string_agg(text, ' ' ORDER BY pos) AS text
  FROM flat GROUP BY book_id, run, g)"""


GROUPED = f"""{ENTRIES}, st AS (SELECT *, {structural("text")} AS st FROM entries),
{packed("st", "lag(pos) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR lag(instruct) OVER w <> instruct OR lag(st) OVER w OR st", 500)},
grouped AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS id FROM packed)"""


def line(source: str, key: str) -> str:
    return f"""there AS (SELECT book_id, {key} AS id, speaker, text, length(text) * 60 AS dur_ms FROM {source} WHERE length(text) > 0),
paused AS (
  SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 0 WHEN lag(speaker) OVER w = speaker THEN 250 ELSE 500 END AS pause_ms
  FROM there WINDOW w AS (PARTITION BY book_id ORDER BY id)),
line AS (
  SELECT *, (sum(pause_ms + dur_ms) OVER (PARTITION BY book_id ORDER BY id))::BIGINT AS end_ms,
    (sum(pause_ms + dur_ms) OVER (PARTITION BY book_id ORDER BY id))::BIGINT - dur_ms AS start_ms FROM paused)"""


LISTED = f"""{ENTRIES},
listed AS (
  SELECT book_id, pos AS id, speaker, text, instruct, CASE WHEN pos % 2 = 0 THEN 'done' ELSE 'pending' END AS status,
    CASE WHEN pos % 2 = 0 THEN 'a/' || pos END AS audio_path, count(*) OVER (PARTITION BY book_id) AS n, book_id % 5 - 1 AS at_ FROM entries)"""

SAMPLES = """samples AS (
  SELECT d.source AS name, d.doc_id AS idx, d.text, d.n_chars / 15.0 AS duration, CASE WHEN l.quality = 1 THEN 'done' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def sub_batch_plan(max_items: str) -> str:
    full = f"x.i - a.first >= {max_items} OR " if max_items else ""
    state = "{{'total': {0}, 'n': {1}, 'first': {2}, 'g': {3}, 'gs': list_append(a.gs, {3})}}"
    return f"""{ENTRIES},
asked AS (SELECT book_id // 10 AS req, book_id * 100000 + pos AS id, length(text)::BIGINT AS n FROM entries),
arrays AS (SELECT req, list(id ORDER BY n, id) AS ids, list(n ORDER BY n, id) AS ns FROM asked GROUP BY req),
cut AS (
  SELECT *, list_reduce(list_transform(ns, lambda n, i: {{'n': n, 'i': i::BIGINT}}), lambda a, x: CASE
    WHEN a.g < 0 OR {full}a.total + x.n > 3000 OR (x.i - a.first >= 4 AND x.n > 5.0 * greatest(a.n, 1))
    THEN {state.format("x.n", "x.n", "x.i", "a.g + 1")} ELSE {state.format("a.total + x.n", "a.n", "a.first", "a.g")} END,
    {{'total': 0::BIGINT, 'n': 0::BIGINT, 'first': 0::BIGINT, 'g': -1::BIGINT, 'gs': []::BIGINT[]}}).gs AS gs FROM arrays),
plan AS (SELECT req, unnest(gs) AS sub_no, unnest(ids) AS id, unnest(ns) AS n_chars FROM cut)"""


def tail(size: int, k: int, last_only: bool) -> str:
    near = "AND p.b = q.b - 1" if last_only else ""
    return f"""WITH {ENTRIES},
b AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) // {size} AS b FROM entries),
q AS (SELECT DISTINCT book_id, b FROM b),
r AS (SELECT q.book_id, q.b, p.text, p.pos, row_number() OVER (PARTITION BY q.book_id, q.b ORDER BY p.pos DESC) AS rn
  FROM q JOIN b p ON p.book_id = q.book_id AND p.b < q.b AND p.pos >= q.b * {size} - {k} {near})
SELECT q.book_id, q.b AS batch_no, coalesce(string_agg(r.text, '|' ORDER BY r.pos) FILTER (rn <= {k}), '') AS tail
FROM q LEFT JOIN r USING (book_id, b) GROUP BY q.book_id, q.b"""


SPLIT = rf"""WITH books AS (SELECT doc_id AS book_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
paras AS (
  SELECT book_id, list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(2), 'g'), chr(2)), lambda x: {strip("x")}), lambda x: x <> '') AS ps FROM books),
units AS (
  SELECT book_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > 1000
    THEN list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s, i: {{'t': s, 'n': length(s)::BIGINT, 'k': CASE WHEN i = 1 THEN 1 ELSE 2 END}})
    ELSE [{{'t': p, 'n': length(p)::BIGINT, 'k': 0}}] END)) AS us FROM paras),
cut AS (
  SELECT book_id, us, list_reduce(us, lambda a, x: CASE WHEN a.g < 0 OR x.k = 1 OR a.total + (CASE WHEN x.k = 2 THEN 1 ELSE 2 END) + x.n > 1000
    THEN {{'total': x.n, 'g': a.g + 1, 'gs': list_append(a.gs, a.g + 1)}}
    ELSE {{'total': a.total + (CASE WHEN x.k = 2 THEN 1 ELSE 2 END) + x.n, 'g': a.g, 'gs': list_append(a.gs, a.g)}} END,
    {{'total': 0::BIGINT, 'g': -1::BIGINT, 'gs': []::BIGINT[]}}).gs AS gs FROM units WHERE len(us) > 0),
flat AS (SELECT book_id, unnest(range(0, len(us))) AS i, unnest(us) AS u, unnest(gs) AS g FROM cut),
joined AS (
  SELECT book_id, g AS chunk_no, string_agg(CASE WHEN f.first THEN '' WHEN f.k = 2 THEN ' ' ELSE chr(10) || chr(10) END || f.t, '' ORDER BY f.i) AS text
  FROM (SELECT book_id, g, i, u.t AS t, u.k AS k, row_number() OVER (PARTITION BY book_id, g ORDER BY i) = 1 AS first FROM flat) f GROUP BY book_id, g)
SELECT book_id, chunk_no, text, CASE WHEN chunk_no = 0 THEN '(Beginning of text)' WHEN chunk_no + 1 = count(*) OVER (PARTITION BY book_id) THEN '(End of text)'
  ELSE '(Part ' || (chunk_no + 1) || ' of ' || count(*) OVER (PARTITION BY book_id) || ')' END AS label
FROM joined"""

RESPONSE_COUNT = "CASE WHEN (conv_id + turn) % 6 = 5 THEN 0 WHEN (conv_id + turn) % 6 = 4 THEN 1 ELSE 2 END"


def oracle_sql() -> dict[str, str]:
    edit_cols = "book_id, id, speaker, text, instruct, status, audio_path"
    return {
        "speakers_sorted": "SELECT speaker, row_number() OVER (ORDER BY speaker) AS rank FROM (SELECT DISTINCT trim(role) AS speaker FROM conversations WHERE trim(role) <> '')",
        "voices_with_config": f"WITH {ENTRIES}, {CONFIG} SELECT e.speaker, c.type, c.default_style, c.speaker IS NOT NULL AS configured FROM (SELECT DISTINCT speaker FROM entries) e LEFT JOIN config c USING (speaker)",
        "roster_prefix": f"""WITH {ENTRIES}, b AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) // 5 AS chunk_no, speaker FROM entries),
q AS (SELECT DISTINCT book_id, chunk_no FROM b), f AS (SELECT book_id, speaker, min(chunk_no) AS f FROM b WHERE speaker NOT IN ('', 'NARRATOR') GROUP BY 1, 2)
SELECT q.book_id, q.chunk_no, coalesce(string_agg(f.speaker, ', ' ORDER BY f.speaker), '') AS roster FROM q LEFT JOIN f ON f.book_id = q.book_id AND f.f < q.chunk_no GROUP BY 1, 2""",
        "norm_words": f"SELECT doc_id, {norm('text')} AS norm, ({words('text')})::BIGINT AS n_words FROM documents",
        "safe_names": rf"""WITH n AS (SELECT c_custkey, ' É-' || c_name || ' / ' || c_mktsegment || '! ' AS name FROM customer)
SELECT c_custkey, {STEM.format("name")} AS stem, lower(regexp_replace({strip(PLAIN)}, '\s+', '_', 'g')) AS project FROM n""",
        "text_predicates": f"""WITH {ENTRIES} SELECT book_id, pos, {structural("text")} AS structural, {section("text")} AS section_break,
CASE WHEN instruct <> '' THEN '[' || instruct || '] ' ELSE '' END || CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview FROM entries""",
        "mojibake_fixed": f"SELECT doc_id, {meant('text')} AS text FROM documents",
        "review_batches": tail(25, 2, True),
        "generation_context": tail(5, 3, False),
        "entry_diff": f"WITH {SIDES} SELECT book_id, batch_no, n_original, n_corrected, text_changed, speaker_changed, instruct_changed FROM stats",
        "text_loss_gate": f"WITH {SIDES} SELECT book_id, batch_no, words_original, words_corrected, ratio, passed FROM gate",
        "review_totals": f"""WITH {SIDES} SELECT book_id, coalesce(sum(text_changed + speaker_changed + instruct_changed) FILTER (passed), 0)::BIGINT AS changes,
coalesce(sum(greatest(n_corrected - n_original, 0)) FILTER (passed), 0)::BIGINT AS added, coalesce(sum(greatest(n_original - n_corrected, 0)) FILTER (passed), 0)::BIGINT AS removed,
count(*) FILTER (NOT passed) AS failed FROM gate GROUP BY book_id""",
        "reviewed_entries": f"""WITH {SIDES} SELECT book_id, batch_no, idx, speaker, text, instruct FROM c JOIN gate USING (book_id, batch_no) WHERE passed
UNION ALL SELECT book_id, batch_no, idx, speaker, text, instruct FROM o JOIN gate USING (book_id, batch_no) WHERE NOT passed""",
        "group_chunks": f"WITH {GROUPED} SELECT book_id, id, speaker, instruct, text, n_entries FROM grouped",
        "merge_narrators": f"""WITH {ENTRIES}, op AS (SELECT *, speaker = 'NARRATOR' AND NOT {section("text")} AS op FROM entries),
{packed("op", "lag(pos) OVER w IS NULL OR NOT op OR NOT lag(op) OVER w OR lag(instruct) OVER w <> instruct", 800)} SELECT book_id, pos, speaker, text, n_entries FROM packed""",
        "split_text": SPLIT,
        "timeline_rows": f"WITH {ENTRIES}, {line('entries', 'pos')} SELECT book_id, id, speaker, start_ms, end_ms FROM line",
        "labels_txt": f"""WITH {GROUPED}, {line("grouped", "id")}
SELECT book_id, id, printf('%d.%06d', start_ms // 1000, start_ms % 1000 * 1000) || chr(9) || printf('%d.%06d', end_ms // 1000, end_ms % 1000 * 1000) || chr(9) || '[' || speaker || '] ' || substr(text, 1, 80) AS label FROM line""",
        "speaker_tracks": f"WITH {ENTRIES}, {line('entries', 'pos')} SELECT book_id, id, speaker, start_ms - coalesce(lag(end_ms) OVER (PARTITION BY book_id, speaker ORDER BY id), 0) AS gap_ms FROM line",
        "track_summary": f"""WITH {ENTRIES}, {line("entries", "pos")}, t AS (SELECT book_id, max(end_ms) AS total_ms FROM line GROUP BY 1)
SELECT book_id, speaker, min(id) AS first_id, sum(dur_ms)::BIGINT AS spoken_ms, any_value(total_ms) - max(end_ms) AS pad_ms, any_value(total_ms) AS total_ms FROM line JOIN t USING (book_id) GROUP BY 1, 2""",
        "lof_text": f"""WITH {ENTRIES}, {line("entries", "pos")}, s AS (SELECT book_id, speaker, min(id) AS f FROM line GROUP BY 1, 2)
SELECT book_id, string_agg('file "' || {STEM.format("speaker")} || '.wav"', chr(10) ORDER BY f) || chr(10) AS content FROM s GROUP BY 1""",
        "audio_names": f"""WITH {ENTRIES} SELECT book_id, pos AS id, printf('voiceline_%04d_', pos + 1) || {STEM.format("speaker")} || CASE WHEN length(text) * 20 < 1024 THEN '.wav' ELSE '.mp3' END AS file_name FROM entries""",
        "sub_batches": f"WITH {sub_batch_plan('40')} SELECT req, sub_no, id, n_chars FROM plan",
        "sub_batch_figures": f"WITH {sub_batch_plan('')} SELECT req, sub_no, count(*) AS n_items, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM plan GROUP BY 1, 2",
        "batch_limit": """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN greatest(1, floor(p_partkey * 1000000 * 0.8 / (p_size::BIGINT * 2 * 8 * 128 * 2 * (64 + p_size * 7 // 3 + p_size * 11 // 3 + 10 + 2048) * 2.0)))
  ELSE 9999 END::BIGINT AS max_items FROM part""",
        "voice_routes": f"""WITH {ENTRIES}, {CONFIG} SELECT book_id, pos, CASE WHEN c.speaker IS NULL THEN 'skip' WHEN c.type = 'builtin_lora' THEN 'lora' ELSE c.type END AS single,
CASE WHEN c.type = 'builtin_lora' THEN 'lora' ELSE coalesce(c.type, 'custom') END AS batch, {KEY} AS key FROM entries e LEFT JOIN config c ON e.speaker = c.speaker""",
        "voice_groups": f"""WITH {ENTRIES}, {CONFIG}, k AS (SELECT book_id, pos AS req_pos, {KEY} AS key FROM entries e LEFT JOIN config c ON e.speaker = c.speaker),
f AS (SELECT *, min(req_pos) OVER (PARTITION BY book_id, key) AS f FROM k)
SELECT book_id, req_pos, key, row_number() OVER (PARTITION BY book_id ORDER BY f, req_pos) - 1 AS place FROM f""",
        "instruct_resolve": f"""WITH {ENTRIES}, {CONFIG}, r AS (SELECT e.*, nullif(c.default_style, '') AS d, coalesce(nullif(c.character_style, ''), nullif(c.default_style, '')) AS s, trim(c.description) AS b FROM entries e LEFT JOIN config c ON e.speaker = c.speaker)
SELECT book_id, pos, coalesce(nullif(instruct, ''), d, 'neutral') AS single, coalesce(nullif(instruct, ''), 'neutral') || coalesce(' ' || s, '') AS batch,
CASE WHEN concat_ws(' ', nullif(instruct, ''), s) <> '' THEN '<|im_start|>user' || chr(10) || concat_ws(' ', nullif(instruct, ''), s) || '<|im_end|>' || chr(10) END AS lora,
coalesce(nullif(concat_ws(', ', nullif(b, ''), nullif(instruct, '')), ''), 'A clear, natural speaking voice') AS design FROM r""",
        "seed_resolve": f"""WITH {ENTRIES} SELECT book_id, pos, CASE WHEN pos = 0 THEN 5 WHEN pos = 2 AND book_id % 3 - 1 >= 0 THEN book_id % 3 - 1
WHEN book_id % 4 - 1 >= 0 THEN book_id % 4 - 1 ELSE -1 END::BIGINT AS seed FROM entries""",
        "voice_upsert": f"""WITH {CONFIG}, ch AS (SELECT DISTINCT 'Voice ' || source AS speaker FROM documents UNION SELECT 'Bob')
SELECT speaker, type, adapter_id FROM config WHERE speaker NOT IN (SELECT speaker FROM ch) UNION ALL SELECT speaker, 'custom', NULL FROM ch""",
        "adapter_union": """WITH u AS (SELECT 'b' || n_nationkey AS id, n_name AS name, true AS builtin FROM nation WHERE n_regionkey > 0 UNION ALL SELECT 'u' || s_suppkey, s_name, false FROM supplier)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY builtin DESC, id) AS rank FROM u) WHERE id <> 'u3'""",
        "stem_collisions": f"""WITH s AS (SELECT DISTINCT c_mktsegment || ' ' || substr(c_name, -2, 1) AS speaker FROM customer UNION SELECT DISTINCT lower(c_mktsegment) || '!' || substr(c_name, -2, 1) FROM customer)
SELECT {STEM.format("speaker")} AS stem, count(*) AS n, string_agg(speaker, ', ' ORDER BY speaker) AS speakers FROM s GROUP BY 1 HAVING count(*) > 1""",
        "chunk_insert": f"""WITH {LISTED} SELECT book_id, id + CASE WHEN at_ BETWEEN 0 AND n - 1 AND id > at_ THEN 1 ELSE 0 END AS id, speaker, text, instruct, status, audio_path FROM listed
UNION ALL SELECT book_id, id + 1, speaker, '', '', 'pending', NULL FROM listed WHERE at_ BETWEEN 0 AND n - 1 AND id = at_""",
        "chunk_delete": f"""WITH {LISTED} SELECT book_id, id - CASE WHEN n > 1 AND at_ BETWEEN 0 AND n - 1 AND id > at_ THEN 1 ELSE 0 END AS id, speaker, text, instruct, status, audio_path
FROM listed WHERE NOT (n > 1 AND at_ BETWEEN 0 AND n - 1 AND id = at_)""",
        "chunk_restore": f"""WITH {LISTED}, r AS (SELECT *, greatest(0, least(at_ * 3, n)) AS p FROM listed)
SELECT book_id, id + CASE WHEN id >= p THEN 1 ELSE 0 END AS id, speaker, text, instruct, status, audio_path FROM r
UNION ALL SELECT DISTINCT book_id, p, 'Bob', 'back', '', 'done', 'x.mp3' FROM r""",
        "chunk_update": f"""WITH {LISTED} SELECT book_id, id, CASE WHEN id = at_ AND at_ <> 1 THEN 'Zed' ELSE speaker END AS speaker, CASE WHEN id = at_ AND at_ = 1 THEN NULL ELSE text END AS text, instruct,
CASE WHEN id = at_ THEN 'pending' ELSE status END AS status, audio_path FROM listed""",
        "chunk_status": f"""WITH {LISTED}, s AS (SELECT user_id % 200 AS book_id, event_id % 5 AS id, arg_max(event_type, event_id) AS st, 'e' || max(event_id) AS ap FROM events GROUP BY 1, 2)
SELECT l.book_id, l.id, speaker, text, instruct, coalesce(s.st, l.status) AS status, CASE WHEN s.st IS NOT NULL THEN s.ap ELSE l.audio_path END AS audio_path FROM listed l LEFT JOIN s ON s.book_id = l.book_id AND s.id = l.id""",
        "renderable_requests": f"""WITH {LISTED}, want(req_pos, id) AS (VALUES (0, 4), (1, 0), (2, 99999), (3, 2), (4, 0))
SELECT book_id, req_pos::BIGINT AS req_pos, l.id, text FROM listed l JOIN want w ON l.id = w.id WHERE {strip("text")} <> ''""",
        "builder_merge": f"""WITH {ENTRIES} SELECT book_id, pos, text, CASE WHEN (pos < 6 OR book_id % 3 = 1) AND ((pos <> 2) OR {strip("text")} = 'other') THEN 'done' ELSE 'pending' END AS status,
CASE WHEN (pos < 6 OR book_id % 3 = 1) AND ((pos <> 2) OR {strip("text")} = 'other') THEN 'u/' || pos END AS audio_url FROM entries""",
        "dataset_filter": f"WITH {SAMPLES} SELECT name, idx, duration FROM samples WHERE duration <= 30",
        "dataset_skips": f"WITH {SAMPLES} SELECT name, count(*) FILTER (duration <= 30) AS used, count(*) FILTER (NOT coalesce(duration <= 30, false)) AS skipped FROM samples GROUP BY 1",
        "dataset_summary": f"WITH {SAMPLES} SELECT name, count(*) AS sample_count, count(*) FILTER (status = 'done') AS done_count FROM samples GROUP BY 1",
        "reference_samples": f"WITH {SAMPLES} SELECT name, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (idx <> 20), idx) AS rn FROM samples WHERE status = 'done') WHERE rn = 1",
        "json_repair": f"SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 2 THEN 'commas' WHEN 3 THEN 'trailing' WHEN 5 THEN 'none' ELSE 'as_is' END AS how, ({RESPONSE_COUNT})::BIGINT AS n, CASE WHEN (conv_id + turn) % 6 = 5 THEN '' ELSE text END AS first_text FROM conversations",
        "annotated_turns": f"""WITH r AS (SELECT conv_id AS book_id, turn // 3 AS chunk_no, turn % 3 AS attempt, ({RESPONSE_COUNT})::BIGINT AS n FROM conversations)
SELECT book_id, chunk_no, min(attempt) FILTER (n > 0) AS attempt, arg_min(n, attempt) FILTER (n > 0) AS n FROM r GROUP BY 1, 2""",
        "log_tail": "SELECT task, seq, line FROM (SELECT event_type AS task, event_id AS seq, props AS line, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 100",
        "log_counts": "SELECT event_type AS task, count(*) AS n_lines, max(event_id) AS last_seq FROM events GROUP BY 1",
        "progress_running": """SELECT user_id % 50 AS job, event_id AS seq, count(*) FILTER (event_type <> 'error') OVER w AS completed, count(*) FILTER (event_type = 'error') OVER w AS failed,
count(*) OVER (PARTITION BY user_id % 50) AS total FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
        "best_loss": """WITH m AS (SELECT user_id % 10 AS run, event_id // 500 AS epoch, avg(CASE WHEN event_type <> 'error' THEN value END) AS a, count(CASE WHEN event_type <> 'error' THEN value END) AS n FROM events GROUP BY 1, 2)
SELECT run, epoch, round(a, 6) AS avg_loss, n AS n_steps, coalesce(a < min(a) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a IS NOT NULL) AS is_best,
round(min(a) OVER (PARTITION BY run ORDER BY epoch), 6) AS best_loss FROM m""",
        "accumulation_steps": "SELECT user_id % 10 AS run, event_id AS step, (event_id + 1) % 4 = 0 OR event_id = max(event_id) OVER (PARTITION BY user_id % 10) AS applies FROM events",
    }
