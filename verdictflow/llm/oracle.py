"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from verdictflow.llm.mixing import BLOCK_WORDS, REGION_SHARDS, SHARD_WORDS

_EXACT = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, role || text AS both_,
    regexp_matches(role || ' ' || text, '<s>|</s>|\[INST\]|\[/INST\]') AS clash
  FROM rows
), sized AS (
  SELECT *, length('<s></s>') + length(role) + length(text) + CASE WHEN clash THEN length('[/INST]') +
      (length(both_) - length(replace(both_, '\', ''))) +
      (length(both_) - length(replace(both_, '<s>', ''))) // 3 + (length(both_) - length(replace(both_, '</s>', ''))) // 4 +
      (length(both_) - length(replace(both_, '[INST]', ''))) // 6 + (length(both_) - length(replace(both_, '[/INST]', ''))) // 7
    ELSE length('[INST]') END AS chars
  FROM shown
), chats AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM chats
"""

_SUBSTRINGS = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM t WHERE len(w) >= 13)
), first AS (
  SELECT win, min(doc_id) AS low FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT DISTINCT doc_id, p + o AS p FROM wins JOIN first USING (win), range(13) r(o) WHERE doc_id > low
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t) w ANTI JOIN hit USING (doc_id, p)
  GROUP BY w.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

# --- Mixing: the same apportionment, draws and blocks as in mixing.py -------------


def _apportion(name: str, children: str, parent: str, child: str, votes: str, seats: str, most: str) -> str:
    """``name``: the rows of ``children`` with ``quota``; all children's quotients near the cut are ranked."""
    share = f"least({most}, floor({votes} * {{}} / total + 0.5)::BIGINT)"
    return f"""
{name}_bounds AS (
  SELECT *, CASE WHEN total > 0 THEN {share.format(f"greatest({seats} - n, 0)")} ELSE 0 END AS low,
    CASE WHEN total > 0 THEN {share.format(f"({seats} + n)")} ELSE 0 END AS high
  FROM (SELECT *, count(*) OVER (PARTITION BY {parent}) AS n, sum({votes}) OVER (PARTITION BY {parent}) AS total FROM {children})
), {name}_won AS (
  SELECT {parent}, {child}, count(*) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY {votes} / (2 * seat - 1) DESC, {child}) AS place
    FROM (SELECT *, unnest(generate_series(low + 1, high)) AS seat,
      {seats} - (SELECT sum(low) FROM {name}_bounds b WHERE ({', '.join(f'b.{p}' for p in parent.split(', '))}) = ({', '.join(f'a.{p}' for p in parent.split(', '))})) AS open
      FROM {name}_bounds a)
  ) WHERE place <= open GROUP BY {parent}, {child}
), {name} AS (
  SELECT a.*, low + coalesce(more, 0) AS quota FROM {name}_bounds a LEFT JOIN {name}_won USING ({parent}, {child})
)"""


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _up_to(words: str) -> str:
    chosen = lambda j: f"floor(({j}) * (quota % blocks) / blocks + phase)"
    block = f"floor(({words}) / {BLOCK_WORDS})"
    return f"""CASE WHEN blocks = 0 THEN 0 ELSE ({words}) * (quota // blocks) + ({chosen(block)} - {chosen(0)}) * {BLOCK_WORDS}
      + ({chosen(block + ' + 1')} - {chosen(block)}) * (({words}) - {block} * {BLOCK_WORDS}) END"""


_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, 0 AS everything,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size
  FROM documents
), per_source AS (
  SELECT k, everything, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY k, everything
), room AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM per_source
  WINDOW before AS (ORDER BY 3 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
  SELECT *, least(3 * source_size, weight * max(words_left / weight_left) OVER ()) AS target,
    3 * ceil(source_size / {BLOCK_WORDS})::BIGINT AS most,
    round(sum(source_size) OVER () / {BLOCK_WORDS})::BIGINT AS seats,
    greatest(ceil(source_size / {SHARD_WORDS})::BIGINT, 1) AS shards
  FROM room
), {_apportion("sources", "wanted", "everything", "k", "target", "seats", "most")}
, placed AS (
  SELECT doc_id, size, s.k, source_size, target, quota AS source_quota,
    {_draw("'0:' || coalesce(doc_id::VARCHAR, 'null')")} % shards AS shard,
    {_draw("'order:0:' || coalesce(doc_id::VARCHAR, 'null')")} AS draw
  FROM sized JOIN sources s USING (k)
), dealt AS (
  SELECT k, source_quota, shard, shard // {REGION_SHARDS} AS region, sum(size)::BIGINT AS shard_size,
    ceil(sum(size) / {BLOCK_WORDS})::BIGINT AS blocks, 3 * ceil(sum(size) / {BLOCK_WORDS})::BIGINT AS most
  FROM placed GROUP BY ALL
), areas AS (
  SELECT k, source_quota, region, sum(shard_size)::BIGINT AS region_size, sum(most)::BIGINT AS most FROM dealt GROUP BY ALL
), {_apportion("regions", "areas", "k", "region", "region_size", "source_quota", "most")}
, parts AS (
  SELECT d.*, r.quota AS region_quota FROM dealt d JOIN regions r USING (k, region)
), {_apportion("cut", "parts", "k, region", "shard", "shard_size", "region_quota", "most")}
, line AS (
  SELECT p.*, blocks, quota, {_draw("'phase:0:' || k || ':' || shard")} % 997 / 997 AS phase,
    coalesce(sum(size) OVER (PARTITION BY k, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM placed p JOIN (SELECT k, shard, blocks, quota FROM cut) USING (k, shard)
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (({_up_to("first + size")}) - ({_up_to("first")}))::BIGINT AS taken FROM line
"""

# Base 32 of a digest: five hexadecimal digits are four letters.
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, {5 * group + 1}, 5) AS BIGINT) >> {shift}) & 31)::INT, 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)

_WARC = f"""
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS low FROM t
)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM f
"""

# --- Lines and turns ---------------------------------------------------------------

_SPACE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

_LINES = f"""
WITH l AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('=' || doc_id, r::VARCHAR)) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""

# A path is its cost, its edits and what it has written so far; the least of several is the
# one to go on with, as paths in one state with the same edits have written the same.


def _edit(path: str, cost: str, letter: str, written: str = "") -> str:
    joined = f"{path}.w || CASE WHEN {path}.w = '' THEN '' ELSE chr(10) END || {written}" if written else f"{path}.w"
    return f"{{c: {path}.c + {cost}, a: {path}.a || '{letter}', w: {joined}}}"


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _deleted(path: str) -> str:
    return _edit(path, "3", "D")


def _turn(path: str, initial: str, name: str) -> tuple[str, str]:
    kept = _edit(path, f"CASE WHEN must OR initial <> '{initial}' THEN 1000000 ELSE late END", "K", "role || ':' || text")
    return kept, _edit(path, "CASE WHEN must THEN 1000000 ELSE 2 + late END", "R", f"'{name}:' || text") if name else kept


def _added(path: str, name: str) -> str:
    return _edit(path, "2", "I", f"'{name}:'")


_USER = ", ".join(x for f in ("f0", "f1", "f3") for x in _turn(f, "u", "user"))
_REPAIR = f"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295] || list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)
    )) % 20 AS draw
  FROM conversations
), turns AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM placed, range(2) WHERE draw <> 0 AND (range = 0 OR draw = 3)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS time,
    right(rtrim(text, {_SPACE}), 1) AS last, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM turns)
), judged AS (
  SELECT *, last = '' AS blank, last <> '' AND time > 1 AS again, last <> '' AND time = 1 AND last NOT IN ('.', '!', '?') AS short,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM seen
), told AS (
  SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (wrong) AS illegal
  FROM judged GROUP BY conv_id
), run AS (
  SELECT coalesce('=' || conv_id, '') AS k, 0::BIGINT AS p, {{c: 0, a: '', w: ''}} AS f0, {{c: 1000000, a: '', w: ''}} AS f1,
    {{c: 2, a: 'I', w: 'user:'}} AS f2, {{c: 4, a: 'II', w: 'user:' || chr(10) || 'assistant:'}} AS f3
  FROM told
  UNION ALL
  SELECT k, p, f0, f1, f2, {_least("f3", _added("f2", "assistant"))} FROM (
    SELECT k, p, f0, f1, {_least("f2", _added("f0", "user"), _added("f1", "user"), _added("f3", "user"))} AS f2, f3 FROM (
      SELECT k, judged.p, {_deleted("f0")} AS f0, {_least(_deleted("f1"), _turn("f0", "s", "")[0])} AS f1,
        {_least(_deleted("f2"), _USER)} AS f2, {_least(_deleted("f3"), *_turn("f2", "a", "assistant"))} AS f3
      FROM run JOIN (SELECT *, blank OR again AS must, short::INT AS late, coalesce('=' || conv_id, '') AS j FROM judged) judged
        ON judged.j = run.k AND judged.p = run.p + 1
    )
  )
), ended AS (
  SELECT told.conv_id, {_least("f0", "f3")} AS best FROM run JOIN told ON run.k = coalesce('=' || told.conv_id, '') AND run.p = m
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(best.w, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told ON c.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN ended ON c.conv_id IS NOT DISTINCT FROM ended.conv_id
"""

ORACLE_SQL = {
    "op2_mixing": _MIXING,
    "op10_warc": _WARC,
    "op4_substring_dedup": _SUBSTRINGS,
    "op5_exact_dedup": _EXACT,
    "op9_chat_format": _CHAT,
    "op11_line_dedup": _LINES,
    "op13_structure_repair": _REPAIR,
}
