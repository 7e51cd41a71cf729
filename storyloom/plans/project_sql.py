"""DuckDB SQL that gives the rows of the project queries, written from their definitions."""

from __future__ import annotations

from storyloom.plans.script_sql import CONFIG, ENTRIES, KEY, LISTED, SAMPLES, SIDES, STEM, line, packed, section, strip

ENTRY = """'{"speaker": ' || to_json(speaker)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || ', "instruct": ' || to_json(instruct)::VARCHAR || '}'"""
PRETTY = """'  {' || chr(10) || '    "speaker": ' || to_json(speaker)::VARCHAR || ',' || chr(10) || '    "text": ' || to_json(text)::VARCHAR || ',' || chr(10) || '    "instruct": ' || to_json(instruct)::VARCHAR || chr(10) || '  }'"""

GENERATION = f"""WITH {ENTRIES},
b AS (SELECT *, (row_number() OVER w - 1) // 5 AS k, row_number() OVER w AS n, {ENTRY} AS e FROM entries WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
p AS (SELECT book_id, k, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) OVER (PARTITION BY book_id) AS parts FROM b GROUP BY book_id, k),
f AS (SELECT book_id, speaker, min(k) AS f FROM b WHERE speaker NOT IN ('', 'NARRATOR') GROUP BY 1, 2),
who AS (SELECT p.book_id, p.k, string_agg(f.speaker, ', ' ORDER BY f.speaker) AS names FROM p JOIN f ON f.book_id = p.book_id AND f.f < p.k GROUP BY 1, 2),
tail AS (SELECT p.book_id, p.k, string_agg(b.e, chr(10) ORDER BY b.n) AS tail FROM p JOIN b ON b.book_id = p.book_id AND b.n BETWEEN p.k * 5 - 2 AND p.k * 5 GROUP BY 1, 2)
SELECT book_id, k AS chunk_no, CASE WHEN k = 0 THEN '(Beginning of text)' WHEN k + 1 = parts THEN '(End of text)' ELSE '(Part ' || (k + 1) || ' of ' || parts || ')' END
  || coalesce(chr(10) || 'Characters in this book: ' || names, '') || coalesce(chr(10) || chr(10) || 'Previous section ended with:' || chr(10) || tail, '')
  || chr(10) || chr(10) || 'TEXT:' || chr(10) || text || chr(10) AS prompt
FROM p LEFT JOIN who USING (book_id, k) LEFT JOIN tail USING (book_id, k)"""

REVIEW = f"""WITH {ENTRIES},
b AS (SELECT *, (row_number() OVER w - 1) // 25 AS k, row_number() OVER w AS n, {ENTRY} AS e, {PRETTY} AS e2 FROM entries WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
p AS (SELECT book_id, k, '[' || chr(10) || string_agg(e2, ',' || chr(10) ORDER BY n) || chr(10) || ']' AS body, count(*) OVER (PARTITION BY book_id) AS parts FROM b GROUP BY book_id, k),
tail AS (SELECT p.book_id, p.k, string_agg(b.e, chr(10) ORDER BY b.n) AS tail FROM p JOIN b ON b.book_id = p.book_id AND b.n BETWEEN p.k * 25 - 1 AND p.k * 25 GROUP BY 1, 2)
SELECT book_id, k AS batch_no, 'Batch ' || (k + 1) || ' of ' || parts || '.' || coalesce(chr(10) || chr(10) || 'Previous batch ended with:' || chr(10) || tail, '')
  || chr(10) || '---' || chr(10) || body AS prompt FROM p LEFT JOIN tail USING (book_id, k)"""

#: Batches of 12 requests by voice, parted by route and key, then sorted by length and cut; what became of each item.
ASKED = f"""{LISTED}, {CONFIG}, want AS (SELECT unnest([4, 0, 99999, 2, 10, 0] || range(11, 61)) AS id, unnest(range(0, 56)) AS req_pos),
setup AS (SELECT speaker, type, character_style, default_style, description, adapter_id FROM config UNION ALL SELECT 'Élan & co', 'lora', NULL, NULL, NULL, NULL),
e AS (SELECT l.*, w.req_pos, length(l.text)::BIGINT AS len FROM listed l JOIN want w ON l.id = w.id WHERE {strip("l.text")} <> ''),
keyed AS (SELECT e.*, CASE WHEN c.type IN ('lora', 'builtin_lora') THEN 'lora' ELSE coalesce(c.type, 'custom') END AS route, {KEY} AS key, c.adapter_id IS NOT NULL AS has_adapter,
  coalesce(nullif(c.character_style, ''), nullif(c.default_style, '')) AS style, trim(c.description) AS base FROM e LEFT JOIN setup c ON e.speaker = c.speaker),
first AS (SELECT *, min(req_pos) OVER (PARTITION BY book_id, key) AS f FROM keyed),
placed AS (SELECT * REPLACE (CASE WHEN route = 'design' THEN 'design:' || place ELSE key END AS key), place // 12 AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f, req_pos) - 1 AS place FROM first)),
arrays AS (SELECT book_id, batch, route, key, list(place ORDER BY len, place) AS ps, list(len ORDER BY len, place) AS ns FROM placed GROUP BY ALL),
cut AS (
  SELECT *, list_reduce(list_transform(ns, lambda n, i: {{'n': n, 'i': i::BIGINT}}), lambda a, x: CASE
    WHEN a.g < 0 OR x.i - a.first >= 5 OR a.total + x.n > 3000 OR (x.i - a.first >= 4 AND x.n > 5.0 * greatest(a.n, 1))
    THEN {{'total': x.n, 'n': x.n, 'first': x.i, 'g': a.g + 1, 'gs': list_append(a.gs, a.g + 1)}}
    ELSE {{'total': a.total + x.n, 'n': a.n, 'first': a.first, 'g': a.g, 'gs': list_append(a.gs, a.g)}} END,
    {{'total': 0::BIGINT, 'n': 0::BIGINT, 'first': 0::BIGINT, 'g': -1::BIGINT, 'gs': []::BIGINT[]}}).gs AS gs FROM arrays),
subs AS (SELECT book_id, batch, route, key, unnest(gs) AS sub_no, unnest(ps) AS place FROM cut),
plan AS (SELECT p.*, s.sub_no, row_number() OVER (PARTITION BY p.book_id, p.batch, p.route, p.key, s.sub_no ORDER BY p.len, p.place) - 1 AS idx,
  bool_or(p.len % 37 = 5) OVER (PARTITION BY p.book_id, p.batch, p.route, p.key, s.sub_no) AS broken FROM placed p JOIN subs s USING (book_id, place)),
asked AS (SELECT *, CASE WHEN route = 'lora' AND NOT has_adapter THEN 'No adapter' WHEN broken THEN 'Batch error: bad line' WHEN len % 17 = 0 THEN 'Audio has 0 duration' END AS error,
  'voicelines/' || printf('voiceline_%04d_', id + 1) || {STEM.format("speaker")} || CASE WHEN len % 7 = 0 OR len * 960 < 1024 THEN '.wav' ELSE '.mp3' END AS path FROM plan)"""

STORE = f"""{ENTRIES},
store AS (SELECT 'book_' || book_id AS script_name, * FROM entries WHERE book_id % 3 = 0 AND (book_id % 6 <> 0 OR pos < 3)),
configs AS (SELECT 'book_' || doc_id AS script_name FROM documents WHERE doc_id % 2 = 0)"""

BUILDER = """asked AS (SELECT r_name || '!' AS asked, lower(replace(r_name, ' ', '_')) AS name FROM region UNION SELECT ' ' || n_name || '?', lower(replace(n_name, ' ', '_')) FROM nation UNION SELECT '!!!', ''),
old AS (SELECT lower(replace(r_name, ' ', '_')) AS name FROM region),
fate AS (SELECT asked, name, CASE WHEN name = '' THEN 'invalid' WHEN name IN (SELECT name FROM old) THEN 'exists' ELSE 'created' END AS fate FROM asked)"""

SAVING = f"""{SAMPLES},
asked AS (SELECT DISTINCT name FROM samples UNION SELECT 'nobody'),
done AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY idx <> 20, idx) AS rn, count(*) OVER (PARTITION BY name) AS n FROM samples WHERE status = 'done'),
outcome AS (
  SELECT a.name, CASE WHEN a.name = 'nobody' THEN 'missing' WHEN d.n IS NULL THEN 'empty' WHEN length(a.name) % 3 = 0 THEN 'exists' ELSE 'saved' END AS outcome, d.n, d.idx, d.text
  FROM asked a LEFT JOIN done d ON d.name = a.name AND d.rn = 1)"""



def oracle_sql() -> dict[str, str]:
    return {
        "generation_prompts": GENERATION,
        "review_prompts": REVIEW,
        "render_calls": f"""WITH {ASKED} SELECT book_id, batch, route, key, sub_no, idx, id, CASE route
  WHEN 'lora' THEN '<|im_start|>user' || chr(10) || nullif(concat_ws(' ', nullif(instruct, ''), style), '') || '<|im_end|>' || chr(10)
  WHEN 'design' THEN coalesce(nullif(concat_ws(', ', nullif(base, ''), nullif(instruct, '')), ''), 'A clear, natural speaking voice')
  WHEN 'custom' THEN concat_ws(' ', coalesce(nullif(instruct, ''), 'neutral'), style) END AS instruct FROM asked""",
        "render_status": f"""WITH {ASKED}, r AS (SELECT book_id, id, max_by(error IS NULL, place) AS ok, max_by(path, place) AS path FROM asked GROUP BY 1, 2)
SELECT l.book_id, l.id, CASE WHEN r.ok THEN 'done' WHEN NOT r.ok THEN 'error' ELSE l.status END AS status, CASE WHEN r.ok THEN r.path ELSE l.audio_path END AS audio_path
FROM listed l LEFT JOIN r ON r.book_id = l.book_id AND r.id = l.id""",
        "render_results": f"""WITH {ASKED} SELECT book_id, coalesce(string_agg(CASE WHEN error IS NULL THEN id::VARCHAR END, ',' ORDER BY id), '') AS completed,
coalesce(string_agg(id || ':' || error, ',' ORDER BY id, error), '') AS failed FROM asked GROUP BY 1""",
        "speech_durations": "SELECT conv_id AS book_id, turn AS id, length(text) * 60 AS dur_ms, true AS ok FROM conversations",
        "script_store": f"WITH {STORE} SELECT script_name, count(*) AS n_entries, script_name IN (SELECT script_name FROM configs) AS has_voice_config FROM store GROUP BY 1",
        "script_load": f"""WITH {STORE}, n AS (SELECT book_id, count(*) AS n FROM store GROUP BY 1)
SELECT doc_id AS book_id, CASE WHEN n.n IS NOT NULL AND doc_id % 2 = 0 THEN 'Bob' ELSE 'Ann' END AS speaker, CASE WHEN n.n IS NOT NULL AND doc_id % 2 = 0 THEN 'clone' ELSE 'custom' END AS type,
coalesce(n.n, 0) AS n_entries FROM documents LEFT JOIN n ON n.book_id = doc_id WHERE doc_id % 4 < 2""",
        "builder_create": f"WITH {BUILDER} SELECT asked, name, fate FROM fate",
        "builder_meta": f"""WITH {BUILDER}, p AS (SELECT name, 'old' AS d, '5' AS s FROM old UNION SELECT name, '', '' FROM fate WHERE fate = 'created'),
c AS (SELECT lower(replace(n_name, ' ', '_')) AS name, 'voice ' || n_nationkey AS d FROM nation WHERE n_nationkey % 2 = 0)
SELECT name, coalesce(c.d, p.d) AS description, CASE WHEN c.d IS NULL THEN p.s ELSE '9' END AS global_seed FROM p LEFT JOIN c USING (name)""",
        "dataset_save": f"""WITH {SAVING} SELECT name, outcome, CASE WHEN outcome = 'saved' THEN n END AS sample_count, CASE WHEN outcome = 'saved' THEN idx END AS ref_idx, CASE WHEN outcome = 'saved' THEN text END AS ref_text FROM outcome""",
        "dataset_metadata": f"WITH {SAVING} SELECT name, idx, printf('sample_%03d.wav', idx) AS audio_filepath, text, 'ref.wav' AS ref_audio FROM done WHERE name IN (SELECT name FROM outcome WHERE outcome = 'saved')",
        "export_files": f"""WITH {ENTRIES}, {line("entries", "pos")}, s AS (SELECT book_id, speaker, min(id) AS f FROM line GROUP BY 1, 2),
tracks AS (SELECT *, {STEM.format("speaker")} || '.wav' AS file, start_ms - coalesce(lag(end_ms) OVER (PARTITION BY book_id, speaker ORDER BY id), 0) AS gap_ms FROM line)
SELECT book_id, 'project.lof' AS file, string_agg('file "' || {STEM.format("speaker")} || '.wav"', chr(10) ORDER BY f) || chr(10) AS content FROM s GROUP BY 1
UNION ALL SELECT book_id, 'labels.txt', string_agg(printf('%d.%06d', start_ms // 1000, start_ms % 1000 * 1000) || chr(9) || printf('%d.%06d', end_ms // 1000, end_ms % 1000 * 1000) || chr(9) || '[' || speaker || '] ' || substr(text, 1, 80) || chr(10), '' ORDER BY id) FROM line GROUP BY 1
UNION ALL SELECT book_id, file, string_agg(gap_ms || chr(9) || id || chr(9) || dur_ms || chr(10), '' ORDER BY id) FROM tracks GROUP BY 1, 2""",
        "config_defaults": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'http://localhost:11434/v1' WHEN 2 THEN 'x' END AS base_url, CASE c_custkey % 5 WHEN 0 THEN 'external' WHEN 4 THEN 'local' END AS mode,
CASE c_custkey % 5 WHEN 1 THEN 'own' WHEN 3 THEN 'a' ELSE 'S' END AS system_prompt, CASE c_custkey % 5 WHEN 3 THEN 'b' ELSE 'U' END AS user_prompt FROM customer""",
        "optional_fields": """SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 5 <> 0 THEN 'banned_tokens=[7]' END, CASE WHEN p_size % 2 = 0 THEN 'min_p=0' END, CASE WHEN p_size % 3 > 0 THEN 'top_k=' || p_size END) AS fields FROM part""",
        "chunks_loaded": f"""WITH {LISTED} SELECT book_id, id, speaker, text, instruct, CASE WHEN book_id % 3 = 0 THEN 'done' ELSE status END AS status, audio_path FROM listed WHERE book_id % 3 <> 0 OR id < 2""",
        "chunks_with_audio": f"WITH {LISTED} SELECT book_id, id, audio_path FROM listed WHERE id % 4 = 0 AND id < 40",
        "chunks_reset": f"WITH {LISTED} SELECT book_id, id, status FROM listed WHERE book_id % 3 = 0",
        "adapter_delete": """SELECT 'a' || p_partkey AS id, CASE WHEN p_partkey IN (SELECT n_nationkey FROM nation) THEN 'forbidden' WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'deleted' ELSE 'missing' END AS fate FROM part WHERE p_partkey % 2 = 0""",
        "total_changes": f"""WITH {SIDES}, op AS (SELECT *, speaker = 'NARRATOR' AND NOT {section("text")} AS op FROM entries),
{packed("op", "lag(pos) OVER w IS NULL OR NOT op OR NOT lag(op) OVER w OR lag(instruct) OVER w <> instruct", 800)},
m AS (SELECT book_id, sum(n_entries - 1)::BIGINT AS merges FROM packed GROUP BY 1),
t AS (SELECT book_id, coalesce(sum(text_changed + speaker_changed + instruct_changed) FILTER (passed), 0)::BIGINT AS changes, coalesce(sum(greatest(n_corrected - n_original, 0)) FILTER (passed), 0)::BIGINT AS added,
  coalesce(sum(greatest(n_original - n_corrected, 0)) FILTER (passed), 0)::BIGINT AS removed, count(*) FILTER (NOT passed) AS failed FROM gate GROUP BY 1)
SELECT book_id, changes, added, removed, failed, coalesce(merges, 0) AS merges, changes + added + removed + coalesce(merges, 0) AS total FROM t LEFT JOIN m USING (book_id)""",
        "script_files": "SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS speaker, text, 'é' AS instruct FROM conversations",
        "book_files": "SELECT rtrim(string_agg(text, chr(10) ORDER BY turn), chr(10)) AS text FROM conversations GROUP BY conv_id",
        "jsonl_files": "SELECT conv_id || '_' || turn || '.wav' AS audio_filepath, text FROM conversations",
        "jsonl_count": "SELECT count(*)::BIGINT AS n FROM conversations",
        "log_appended": "SELECT event_type AS task, event_id AS seq, props AS line FROM events",
        "script_listing": "SELECT n_name || '.json' AS name, n_name AS script, n_regionkey = 1 AS has_voice_config FROM nation",
        "prompt_files": "SELECT p_partkey, trim(p_name) AS system, trim(p_type) AS user FROM part",
        "requested_samples": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
SELECT conv_id::VARCHAR AS name, idx, CASE WHEN conv_id % 2 = 0 THEN trim(role) ELSE '' END AS emotion, trim(text) AS text FROM c WHERE turn % 5 <> 4 AND trim(text) <> ''""",
        "reference_audio": """WITH f AS (SELECT lang AS name, min(doc_id) AS d, count(*) FILTER (doc_id % 50 = 7) AS r FROM documents GROUP BY 1)
SELECT name, CASE WHEN d % 2 = 1 AND name IN ('en', 'de') THEN 'own.wav' WHEN r > 0 THEN 'ref.wav' ELSE 's' || d || '.wav' END AS ref_audio FROM f""",
        "dataset_prepared": """WITH r AS (SELECT source AS name, CASE WHEN count(*) FILTER (doc_id % 50 = 7) > 0 THEN 'ref.wav' ELSE 's' || min(doc_id) || '.wav' END AS ref_audio FROM documents GROUP BY 1)
SELECT source AS name, doc_id AS pos, CASE WHEN doc_id % 50 = 7 THEN 'ref.wav' ELSE 's' || doc_id || '.wav' END AS audio, n_chars / 15.0 AS duration, ref_audio
FROM documents JOIN r ON r.name = source WHERE n_chars / 15.0 <= 30""",
        "dataset_ingest": "SELECT conv_id AS dataset, conv_id % 4 < 2 AND count(*) FILTER (turn % 3 <> 1 AND trim(text) <> '') > 0 AS accepted, CASE WHEN conv_id % 4 < 2 THEN count(*) FILTER (turn % 3 <> 1 AND trim(text) <> '') ELSE 0 END AS n_samples FROM conversations GROUP BY 1",
        "pretty_scripts": f"WITH e AS (SELECT conv_id, turn, role AS speaker, text, 'é' AS instruct FROM conversations) SELECT conv_id AS book_id, '[' || chr(10) || string_agg({PRETTY}, ',' || chr(10) ORDER BY turn) || chr(10) || ']' AS content FROM e GROUP BY 1",
        "stamped_ids": "SELECT event_id, 'my_' || event_type || '_' || (event_id + 1700000000) AS id FROM events",
        "script_delete": f"WITH {STORE} SELECT script_name, count(*) AS n_entries, script_name IN (SELECT script_name FROM configs) AS has_voice_config FROM store WHERE book_id % 9 <> 0 GROUP BY 1",
        "builder_delete": f"""WITH {BUILDER}, p AS (SELECT name, 'old' AS description, '5' AS global_seed FROM old UNION SELECT name, '', '' FROM fate WHERE fate = 'created')
SELECT * FROM p WHERE name NOT IN (SELECT lower(replace(n_name, ' ', '_')) FROM nation WHERE n_nationkey % 2 = 0)""",
        "point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1",
        "scalar_rules": r"""SELECT p_partkey, 'a ' || p_name || ' b {x} ' || p_name AS filled, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || p_name ELSE '/root/' || p_name END AS path, p_name AS stem, 'v1.2.' || p_brand AS last_stem,
least(nullif(p_size % 9, 0), nullif(p_size % 4, 0))::BIGINT AS most_items, round(p_size + p_size / 4.0 * 0.3, 6)::DOUBLE AS loss, CASE WHEN p_size % 7 > 0 THEN round(p_size / (p_size % 7), 6) ELSE 0.0 END::DOUBLE AS speed,
CASE p_size % 4 WHEN 0 THEN '1,-,-' WHEN 1 THEN '1,2,-' WHEN 2 THEN '1,2,3' ELSE '1,2,3,4' END AS padded, CASE WHEN p_partkey % 3 > 0 THEN 'calm, ' || p_type ELSE 'calm' END AS description,
'{"speaker": "\"é\\' || p_name || '", "text": "a\nb\tc", "instruct": null}' AS entry FROM part""",
        "json_salvage": """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'as_is' WHEN 1 THEN 'lenient' WHEN 2 THEN 'objects' ELSE 'truncated' END AS how,
CASE (conv_id + turn) % 4 WHEN 0 THEN 'line' || chr(10) || 'break' || chr(9) || 'and tab' WHEN 1 THEN 'odd \\q "here"' WHEN 2 THEN 'one|two' ELSE 'b' END AS texts FROM conversations""",
    }
