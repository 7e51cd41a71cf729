"""DuckDB SQL of the queries by ranges, over versions, headers and archives."""

from __future__ import annotations

from storyloom.plans.script_sql import ENTRIES, LISTED, line
from storyloom.plans.script_sql import oracle_sql as by_books

LIBRARY = f"""{ENTRIES}, library AS (SELECT 0 AS book_id, book_id * 100000 + pos AS pos, speaker, text FROM entries), {line("library", "pos")}"""


def oracle_sql() -> dict[str, str]:
    whole = by_books()
    return {
        "file_listing": """SELECT 'folder=' || source AS folder, length('[{"id": "' || source || '", "n": ' || n || '}') + 1 + (n % 2 = 0)::INTEGER AS length, CASE WHEN n % 2 = 0 THEN n END AS n
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""",
        "folder_listing": """SELECT 'lang=' || lang AS folder, row_number() OVER (ORDER BY 'lang=' || lang) AS rank, 1::BIGINT AS n_files, sum(length('line ' || doc_id) + 1)::BIGINT AS bytes FROM documents GROUP BY lang""",
        "group_chunks_ranges": whole["group_chunks"],
        "merge_narrators_ranges": whole["merge_narrators"],
        "library_timeline": f"WITH {LIBRARY} SELECT id, speaker, start_ms, end_ms FROM line",
        "library_tracks": f"WITH {LIBRARY} SELECT id, speaker, start_ms - coalesce(lag(end_ms) OVER (PARTITION BY speaker ORDER BY id), 0) AS gap_ms FROM line",
        "status_versions": f"""WITH {LISTED} SELECT book_id, id, CASE WHEN id % 6 = 0 THEN 'done' WHEN id % 3 = 0 THEN 'generating' WHEN id % 3 = 1 THEN 'error' ELSE status END AS status, audio_path FROM listed""",
        "wav_durations": """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 < 3 THEN length(text) * 2000 * 1000 // ([16000, 24000, 44100][turn % 3 + 1] * 2) END::BIGINT AS dur_ms FROM conversations""",
        "archive_members": "SELECT lang || '/' || doc_id || '.txt' AS name, strlen(text)::BIGINT AS length, sha256(text) AS sha256, NULL::VARCHAR AS error FROM documents",
    }
