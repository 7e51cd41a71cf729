"""DuckDB SQL for the queries of this subpackage, written from their definitions."""

from __future__ import annotations

from storyloom.llm.lines import BLOCK_TAGS
from storyloom.llm.quality import STOP_WORDS

OP1 = rf"""
WITH base AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*@)?([^/?#:@]+)', 2)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<!--.*?-->|<script[\s>].*?</script>|<style[\s>].*?</style>', '', 'g'), '[\r\n]+', ' ', 'g'),
      '(?i)</?({"|".join(BLOCK_TAGS)})(\s[^>]*)?/?>', chr(10), 'g'), '</?[A-Za-z!][^>]*>', '', 'g') AS body,
    row_number() OVER () AS r FROM pages),
lines AS (
  SELECT r, host, page_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS ls
  FROM base),
hosts AS (SELECT host, count(*) AS host_pages FROM base GROUP BY host),
freq AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM lines) GROUP BY host, line),
bad AS (SELECT f.host, f.line FROM freq f JOIN hosts h USING (host) WHERE h.host_pages >= 3 AND f.n > h.host_pages * 0.3 AND f.n > 1),
listed AS (SELECT host, list(line) AS drops FROM bad GROUP BY host),
kept AS (
  SELECT l.*, h.host_pages, list_filter(l.ls, lambda x: NOT list_contains(coalesce(d.drops, []), x)) AS ks
  FROM lines l JOIN hosts h USING (host) LEFT JOIN listed d USING (host))
SELECT page_id, host, host_pages, len(ls)::BIGINT AS n_lines, (len(ls) - len(ks))::BIGINT AS n_dropped,
  sha256(array_to_string(ks, chr(10))) AS kept_sha256
FROM kept
"""

OP9 = r"""
WITH said AS (
  SELECT *, (n - 1) // 1024 AS own FROM (
    SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), coalesce(role, 'unknown'), coalesce(text, '')) AS n FROM conversations)),
shown AS (
  SELECT *, own AS piece FROM said
  UNION ALL SELECT s.*, p.piece FROM said s JOIN (SELECT DISTINCT conv_id, own AS piece FROM said WHERE own > 0) p
    ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE s.role = 'system' AND s.own = 0),
speakers AS (SELECT DISTINCT conv_id, role FROM said WHERE role <> 'system'),
views AS (SELECT s.*, w.role AS me FROM shown s LEFT JOIN speakers w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
parts AS (
  SELECT *, CASE WHEN role = 'system' THEN '<|im_start|>system' WHEN role = me THEN '<|im_start|>assistant' ELSE '<|im_start|>user name='
    || replace(replace(regexp_replace(role, '[\x00-\x1f\x7f]', ' ', 'g'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') END || chr(10) AS opening,
    replace(replace(text, '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') || '<|im_end|>' AS body FROM views),
placed AS (
  SELECT *, coalesce(sum(length(opening) + length(body) + 1) OVER (PARTITION BY conv_id, piece, me ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(opening) AS spot FROM parts)
SELECT conv_id, piece, me AS participant, count(*) AS n_turns,
  string_agg(opening || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(CASE WHEN role = me THEN spot || '-' || (spot + length(body)) END, ',' ORDER BY n), '') AS mask_spans
FROM placed GROUP BY conv_id, piece, me
"""

#: Whitespace of words, as a character class.
OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls,
    row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
reps AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM reps, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs, len(list_filter(w, lambda x: x = '|'))::BIGINT AS n_pipes,
    len(list_filter(w, lambda x: list_contains(['{"', '".join(dict.fromkeys(STOP_WORDS))}'], lower(x))))::BIGINT AS n_stop_words,
    len(ls)::BIGINT AS n_lines
  FROM d LEFT JOIN cov USING (r)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_filter([
      CASE WHEN word_chars / nullif(n_words, 0) < 2.0 OR word_chars / nullif(n_words, 0) > 12.0 THEN 'mean_word_chars' END,
      CASE WHEN n_symbols / greatest(n_words, 1) > 0.3 THEN 'symbol_ratio' END,
      CASE WHEN n_bangs / greatest(n_words, 1) > 0.5 THEN 'bang_ratio' END,
      CASE WHEN n_pipes / greatest(n_words, 1) > 0.25 THEN 'pipe_ratio' END,
      CASE WHEN n_stop_words / greatest(n_words, 1) < 0.02 THEN 'stop_word_ratio' END,
      CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'dup_line_ratio' END], lambda x: x IS NOT NULL) AS broken
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_pipes, n_stop_words, n_lines, base_failed,
  NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules
FROM v
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, bw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= {percent} * (x.n + y.n - n_both)),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
comp AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
seen AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS f FROM g) WHERE f < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i FROM seen, (SELECT unnest(range(0, 13)) AS k) x),
cut AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
ws AS (SELECT d.r, u.i, d.w[u.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) u),
kept AS (SELECT ws.r, string_agg(word, ' ' ORDER BY ws.i) AS t FROM ws ANTI JOIN gone ON ws.r = gone.r AND ws.i = gone.i GROUP BY ws.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(cut.gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

#: The curve's steps for three dimensions of five bits: (highest bit in hand, dimension).
_HILBERT = "[" + ", ".join(f"{{'q': {1 << b}, 'i': {i}}}" for b in range(4, 0, -1) for i in range(1, 4)) + "]"

OP2 = f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(0, 256) r(n)),
base AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size,
    list_transform(range(0, strlen(coalesce(text, ''))), lambda k: ('0x' || substr(hex(coalesce(text, '')), 2 * k + 1, 2))::BIGINT) AS bytes,
    [(('0x' || substr(md5(coalesce(lang, '')), 1, 4))::BIGINT % 32), (('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % 32),
     least(length(bin(strlen(coalesce(text, '')) + 1)) - 1, 31)] AS x0
  FROM documents),
turned AS (
  SELECT doc_id, size, bytes, list_reduce({_HILBERT}, lambda x, s: CASE
    WHEN x[s.i] & s.q <> 0 THEN [xor(x[1], s.q - 1), x[2], x[3]]
    WHEN s.i = 1 THEN x
    WHEN s.i = 2 THEN [xor(x[1], xor(x[1], x[2]) & (s.q - 1)), xor(x[2], xor(x[1], x[2]) & (s.q - 1)), x[3]]
    ELSE [xor(x[1], xor(x[1], x[3]) & (s.q - 1)), x[2], xor(x[3], xor(x[1], x[3]) & (s.q - 1))] END, x0) AS x
  FROM base),
gray AS (SELECT doc_id, size, bytes, [x[1], xor(x[1], x[2]), xor(xor(x[1], x[2]), x[3])] AS g FROM turned),
flipped AS (
  SELECT doc_id, size, bytes, g, list_reduce([16, 8, 4, 2], lambda f, q: CASE WHEN g[3] & q <> 0 THEN xor(f, q - 1) ELSE f END, 0::BIGINT) AS f FROM gray),
curve AS (
  SELECT doc_id, size, bytes, list_reduce(range(0, 15), lambda h, k: h * 2 + ((xor(g[k % 3 + 1], f) >> (4 - k // 3)) & 1), 0::BIGINT) AS hilbert FROM flipped),
crc AS (
  SELECT doc_id, size, hilbert, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM curve, crc_table),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, size, doc_id) - 1 AS rk, count(*) OVER () AS total FROM crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (rk * 8 // total)::INT AS shard,
  (rk - ((rk * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, hilbert::BIGINT AS hilbert
FROM ranked
"""


def op6(entropy: float = 0.95, repetition: float = 4.0, keep_all: bool = False) -> str:
    """Copies of every document; see ``mixing.mixed``."""
    spread = "ln(sum(pow(p, {0}))) - sum(pow(p, {0}) * ln(pow(p, {0}))) / sum(pow(p, {0}))"
    most = "max(pow(p, {0}) / p) / sum(pow(p, {0}))"
    e, r = "(e + (1 << (19 - step))) / 1048576.0", "(r + (1 << (19 - step))) / 1048576.0"
    budget = "greatest(max(total) OVER (), ceil(max(available * z / w) OVER () * (1 + 1e-9)))::BIGINT" if keep_all else "total"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS said, coalesce(source, '') AS source, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sizes AS (SELECT source, sum(tokens)::BIGINT AS available FROM d GROUP BY source),
b AS (
  SELECT d.*, ('0x' || substr(key, 1, 8))::BIGINT % 4096 % least(4096, pow(2, ceil(log2(greatest(1, ceil(available / 1048576)))))::BIGINT) AS block
  FROM d JOIN sizes USING (source)),
src AS (SELECT * FROM sizes WHERE available > 0),
share AS (SELECT source, available, available / sum(available) OVER () AS p, (sum(available) OVER ())::BIGINT AS total, count(*) OVER () AS k FROM src),
grid AS (SELECT 0 AS step, 0 AS e, 0 AS r
  UNION ALL
  SELECT step + 1,
    CASE WHEN (SELECT {spread.format(e)} >= ln(max(k)) * {entropy} FROM share) THEN e + (1 << (19 - step)) ELSE e END,
    CASE WHEN (SELECT {most.format(r)} > {repetition} FROM share) THEN r + (1 << (19 - step)) ELSE r END
  FROM grid WHERE step < 20),
alpha AS (
  SELECT greatest(
    CASE WHEN (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) >= ln(max(k)) * {entropy} FROM share) THEN 1048576 ELSE e END,
    CASE WHEN (SELECT max(1 / p) / max(k) <= {repetition} FROM share) THEN 0 ELSE r + 1 END) / 1048576.0 AS a FROM grid WHERE step = 20),
weight AS (SELECT source, available, total, pow(p, a) AS w, sum(pow(p, a)) OVER () AS z FROM share, alpha),
goal AS (SELECT source, available, floor(w / z * ({budget}) + 0.5)::BIGINT AS target FROM weight),
blocks AS (SELECT source, block, sum(tokens)::BIGINT AS tokens FROM b GROUP BY source, block),
plan AS (
  SELECT x.*, coalesce(target // available, 0) AS epochs, coalesce(target % available, 0) AS rest FROM blocks x LEFT JOIN goal USING (source)),
run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY md5('7:' || source || ':' || epochs || ':' || block) ROWS UNBOUNDED PRECEDING) AS upto FROM plan),
docs AS (
  SELECT b.*, epochs, rest, upto, run.tokens AS block_tokens,
    sum(b.tokens) OVER (PARTITION BY b.source, b.block ORDER BY key RANGE UNBOUNDED PRECEDING) AS within
  FROM b JOIN run ON b.source = run.source AND b.block = run.block)
SELECT doc_id, said AS source, tokens,
  (epochs + CASE WHEN upto <= rest THEN 1 WHEN upto - block_tokens >= rest THEN 0 WHEN within <= rest - upto + block_tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM docs
"""


def op5(percent: int = 85) -> str:
    """Groups of documents linked at this similarity."""
    return OP5.replace("{percent}", str(percent))


def pipeline(entropy: float, percent: int) -> str:
    """The stages of the corpus pipeline, each over the rows that the one before keeps."""
    over = lambda sql, name: sql.replace("FROM documents", f"FROM {name}")
    return f"""
WITH good AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP3}) WHERE kept)),
single AS MATERIALIZED (SELECT * FROM good WHERE doc_id IN (SELECT doc_id FROM ({over(op5(percent), "good")}) WHERE kept)),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM ({over(OP4, "single")}) WHERE contaminated)),
blend AS MATERIALIZED (
  SELECT c.* FROM clean c JOIN ({over(op6(entropy, keep_all=True), "clean")}) m USING (doc_id), LATERAL (SELECT unnest(range(0, m.copies))) u)
SELECT s.doc_id, s.size, s.text_crc32, s.law, s.shard, s.slot, s.grown_shard, s.hilbert, c.text, c.lang, c.source, c.n_chars
FROM ({over(OP2, "blend")}) s JOIN clean c USING (doc_id)
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, row_number() OVER () AS r
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

OP12 = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE side = 'd' AND len(w) > 0),
counted AS (SELECT side, r, id, n, term, count(*) AS tf FROM (SELECT side, r, id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, corpus WHERE side = 'd' GROUP BY term, docs),
scores AS (
  SELECT i.r, i.id AS item_id, d.r AS dr, d.id AS doc_id,
    sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * d.n * docs) // terms))))::BIGINT AS score
  FROM counted i JOIN counted d ON d.side = 'd' AND i.side = 'i' AND i.term = d.term JOIN weights ON weights.term = i.term, corpus
  GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST, dr) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


def op13(rounds: int = 6) -> str:
    """Codebooks round after round; distances in integers."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT r, p, (gap).e AS e, (gap).d AS d FROM (
    SELECT x.r, x.p, min({{'d': list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS gap
    FROM parts x JOIN b{r} b USING (p) GROUP BY x.r, x.p))""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT a.p, a.e, generate_subscripts(x.v, 1) AS i, unnest(x.v) AS c FROM a{r} a JOIN parts x USING (r, p)) GROUP BY p, e, i)
  GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 16),{",".join(steps)},
codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), book
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1,
        "op2_hilbert_sharding": OP2,
        "op3_quality_rules": OP3,
        "op4_decontamination": OP4,
        "op5_near_duplicates": op5(),
        "op6_temperature_mixing": op6(),
        "op7_substring_dedup": OP7,
        "op8_warc_round_trip": OP8,
        "op9_perspective_rotation": OP9,
        "op11_exact_dedup": OP11,
        "op12_ranked_search": OP12,
        "op13_vector_codes": op13(),
    }
