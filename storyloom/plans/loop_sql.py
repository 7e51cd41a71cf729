"""DuckDB SQL of the loops: recursion over the parts of a book, with the stand-in models written as SQL."""

from __future__ import annotations

from storyloom.plans.project_sql import ENTRY, PRETTY
from storyloom.plans.script_sql import ENTRIES, SPLIT, words

WORDS = words("coalesce(text, '')")
#: The first of three hashes of the prompt whose attempt succeeds, by its first digit.
ATTEMPT = """CASE WHEN md5('0' || prompt)[1] NOT IN ({bad}) THEN 0 WHEN md5('1' || prompt)[1] NOT IN ({bad}) THEN 1 WHEN md5('2' || prompt)[1] NOT IN ({bad}) THEN 2 END"""
LINE = ENTRY.replace("speaker)", "e.speaker)").replace("text)", "e.text)").replace("instruct)", "e.instruct)")

GENERATED = f"""WITH RECURSIVE parts AS MATERIALIZED (SELECT book_id, chunk_no, text, label FROM ({SPLIT})),
run AS (
  SELECT DISTINCT book_id, -1::BIGINT AS k, ''::VARCHAR AS prompt, NULL::INTEGER AS attempt, []::STRUCT(speaker VARCHAR, text VARCHAR)[] AS es, []::VARCHAR[] AS names, []::VARCHAR[] AS tail FROM parts
  UNION ALL
  SELECT book_id, k, prompt, attempt, es, list_sort(list_distinct(names || list_filter(list_transform(es, lambda e: e.speaker), lambda s: s <> 'NARRATOR'))),
    (tail || list_transform(es, lambda e: '{{"speaker": ' || to_json(e.speaker)::VARCHAR || ', "text": ' || to_json(e.text)::VARCHAR || ', "instruct": ""}}'))[-3:]
  FROM (
    SELECT *, CASE WHEN attempt IS NULL THEN [] ELSE list_transform(range(0, CASE WHEN h[2] IN ('0','1','2','3','4','5','6','7') THEN 2 ELSE 1 END),
      lambda i: {{'speaker': CASE WHEN h[3 + i] IN ('0','1','2','3') THEN 'NARRATOR' ELSE 'S' || h[3 + i] END, 'text': substr(h, 9 + 4 * i, 4)}}) END AS es
    FROM (
      SELECT *, md5(attempt || prompt) AS h FROM (
        SELECT *, {ATTEMPT.format(bad="'0','1','2','3'")} AS attempt FROM (
          SELECT r.book_id, p.chunk_no::BIGINT AS k, r.names, r.tail, p.label || CASE WHEN len(r.names) > 0 THEN chr(10) || 'Characters in this book: ' || array_to_string(r.names, ', ') ELSE '' END
            || CASE WHEN len(r.tail) > 0 THEN chr(10) || chr(10) || 'Previous section ended with:' || chr(10) || array_to_string(r.tail, chr(10)) ELSE '' END
            || chr(10) || chr(10) || 'TEXT:' || chr(10) || p.text || chr(10) AS prompt
          FROM run r JOIN parts p ON p.book_id = r.book_id AND p.chunk_no = r.k + 1)))))
"""

REVIEWED = f"""WITH RECURSIVE {ENTRIES},
b AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1) // 25 AS k FROM entries),
parts AS MATERIALIZED (SELECT book_id, k, list({{'speaker': speaker, 'text': text, 'instruct': instruct}} ORDER BY pos) AS es, '[' || chr(10) || string_agg({PRETTY}, ',' || chr(10) ORDER BY pos) || chr(10) || ']' AS body,
  count(*) OVER (PARTITION BY book_id) AS n, sum({WORDS}) AS words, min_by({WORDS}, pos) AS first_words FROM b GROUP BY book_id, k),
run AS (
  SELECT DISTINCT book_id, -1::BIGINT AS k, ''::VARCHAR AS prompt, NULL::INTEGER AS attempt, ''::VARCHAR AS outcome, []::STRUCT(speaker VARCHAR, text VARCHAR, instruct VARCHAR)[] AS es, ''::VARCHAR AS tail FROM parts
  UNION ALL
  SELECT book_id, k, prompt, attempt, outcome, out, array_to_string(list_transform(out[-2:], lambda e: {LINE}), chr(10))
  FROM (
    SELECT *, CASE WHEN outcome <> 'passed' THEN es ELSE list_transform(CASE WHEN cut THEN es[1:1] ELSE es END,
      lambda e, i: CASE WHEN i = 1 THEN {{'speaker': 'S' || h[2], 'text': e.text, 'instruct': e.instruct}} ELSE e END) END AS out
    FROM (
      SELECT *, CASE WHEN attempt IS NULL THEN 'failed' WHEN cut AND words > 0 AND first_words / words < 0.95 THEN 'lost' ELSE 'passed' END AS outcome FROM (
        SELECT *, md5(attempt || prompt) AS h, coalesce(md5(attempt || prompt)[1] IN ('7','8'), false) AS cut FROM (
          SELECT *, {ATTEMPT.format(bad="'0','1','2','3','4','5','6'")} AS attempt FROM (
            SELECT r.book_id, p.k, p.es, p.words, p.first_words, 'Batch ' || (p.k + 1) || ' of ' || p.n || '.' || CASE WHEN r.tail <> '' THEN chr(10) || chr(10) || 'Previous batch ended with:' || chr(10) || r.tail ELSE '' END
              || chr(10) || '---' || chr(10) || p.body AS prompt
            FROM run r JOIN parts p ON p.book_id = r.book_id AND p.k = r.k + 1))))))
"""
PLACED = "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY k, i) - 1 AS pos, e.speaker AS speaker, e.text AS text, {instruct} AS instruct FROM (SELECT book_id, k, unnest(es) AS e, unnest(range(0, len(es))) AS i FROM run WHERE k >= 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "generated_parts": GENERATED + "SELECT book_id, k AS chunk_no, md5(prompt) AS prompt_md5, attempt, CASE WHEN attempt IS NULL THEN 'nothing' ELSE 'made' END AS outcome, len(es) AS n_entries FROM run WHERE k >= 0",
        "generated_entries": GENERATED + PLACED.format(instruct="''"),
        "reviewed_parts": REVIEWED + "SELECT book_id, k AS batch_no, md5(prompt) AS prompt_md5, attempt, outcome, len(es) AS n_entries FROM run WHERE k >= 0",
        "reviewed_script": REVIEWED + PLACED.format(instruct="e.instruct"),
    }
