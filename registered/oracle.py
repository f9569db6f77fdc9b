"""Reference SQL (DuckDB) for the registered queries, over the same tables.

Written on its own terms: tokens are extracted and classified one by one where the library
rewrites whole lines, windows run per source over the whole log where the library splits it.
"""

from __future__ import annotations

from .tables import LIFECYCLE_COLUMNS, LIFECYCLE_WHERE, LOG_COLUMNS, SINCE_TEXT, select_list

SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"


def trimmed(c: str) -> str:
    return f"trim({c}, {SPACES})"


def named_level(s: str) -> str:
    return (
        f"CASE WHEN {s} IN ('trace','trc') THEN 'trace' WHEN {s} IN ('debug','dbg') THEN 'debug'"
        f" WHEN {s} IN ('info','inf') THEN 'info' WHEN {s} IN ('warn','warning','wrn') THEN 'warn'"
        f" WHEN {s} IN ('error','err','fatal') THEN 'error' WHEN {s} IN ('unknown','any','all') THEN 'unknown' END"
    )


def rank(level: str) -> str:
    return (
        f"CASE {level} WHEN 'unknown' THEN 0 WHEN 'trace' THEN 1 WHEN 'debug' THEN 2 WHEN 'info' THEN 3"
        f" WHEN 'warn' THEN 4 WHEN 'error' THEN 5 END"
    )


def json_doc(p: str) -> str:
    """The payload as JSON where it is an object, else null."""
    return (
        f"CASE WHEN starts_with({trimmed(p)}, '{{') AND json_valid({trimmed(p)}) THEN CAST({trimmed(p)} AS JSON) END"
    )


def json_level(j: str, path: str) -> str:
    kind, text = f"json_type({j}, {path})", f"json_extract_string({j}, {path})"
    name = f"lower({trimmed(text)})"
    number = f"TRY_CAST({text} AS BIGINT)"
    return (
        f"CASE WHEN {kind} = 'VARCHAR' THEN CASE WHEN {name} IN ('critical','crit','emergency','emerg','alert')"
        f" THEN 'error' ELSE {named_level(name)} END"
        f" WHEN {kind} IN ('UBIGINT','BIGINT') THEN CASE WHEN {number} BETWEEN 0 AND 3 THEN 'error'"
        f" WHEN {number} = 4 THEN 'warn' WHEN {number} BETWEEN 5 AND 6 THEN 'info' WHEN {number} = 7 THEN 'debug' END END"
    )


def structured(j: str) -> str:
    keys = ("level", "severity", "severity_text", "log_level", "loglevel", "log.level")
    tries = [
        json_level(j, f"('/' || list_min(list_filter(json_keys({j}), lambda k: lower(k) = '{key}')))") for key in keys
    ]
    return f"coalesce({', '.join(tries)}, {json_level(j, chr(39) + '/log/level' + chr(39))})"


def words(p: str, alternatives: str, end: str = "($|[^A-Za-z0-9_])") -> str:
    return f"regexp_matches({p}, '(?i)(^|[^A-Za-z0-9_])({alternatives}){end}')"


def text_level(p: str) -> str:
    failure = (
        "(" + words(p, "err|error|errors|fatal|panic|panicked|exception|failed|failure|traceback")
        + f" OR regexp_matches({p}, '(Error|Exception)($|[^A-Za-z0-9_])')"
        + f" OR regexp_matches({p}, '(?i)segmentation fault|unhandled rejection|uncaught exception'))"
    )
    clean = (
        f"regexp_matches({p}, '(?i)0 error|0 failure|no error|no failure|without error|error_count 0|error_count=0"
        "|errors: 0|errors=0|error-free|failure-free')"
    )
    return (
        f"CASE WHEN {failure} AND NOT {clean} THEN 'error' WHEN {words(p, 'warn', '')} THEN 'warn'"
        f" WHEN {words(p, 'debug')} THEN 'debug' WHEN {words(p, 'trace')} THEN 'trace'"
        f" WHEN {words(p, 'info')} THEN 'info' ELSE 'unknown' END"
    )


_HEX = "[0-9a-fA-F]"
_UUID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"


def fingerprint(p: str) -> str:
    return f"substring({template(p)}, 1, 300)"


def template(p: str) -> str:
    quoted = "|".join(f'{q}[^{q}]{{0,198}}{q}' for q in ('"', "''", "`"))
    pieces = f"regexp_extract_all({p}, '(?s){quoted}|[0-9A-Za-z:._+-]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+|.')"
    run = f"'^(.*?)([0-9].*|[a-fA-F]{_HEX}{{7,}}|{_UUID}[:._+]*)?$'"
    part = f"regexp_extract(t, {run}, 2)"
    colons, dots = f"(length({part}) - length(replace({part}, ':', '')))", f"(length({part}) - length(replace({part}, '.', '')))"
    classified = (
        f"CASE WHEN {part} = '' THEN ''"
        f" WHEN regexp_matches({part}, '^{_UUID}[:._+]*$') THEN '<UUID>'"
        f" WHEN regexp_matches({part}, '^(0x)*{_HEX}{{8,}}$') THEN '<HEX>'"
        f" WHEN {colons} >= 2 THEN '<TIME>' WHEN contains({part}, 'T') AND {colons} >= 1 THEN '<TS>'"
        f" WHEN {dots} >= 2 OR {colons} >= 1 THEN '<ADDR>' ELSE '<N>' END"
    )
    each = (
        f"CASE WHEN length(t) > 1 AND left(t, 1) IN ('\"', '''', '`') THEN '<S>'"
        f" WHEN regexp_matches(t, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+$') THEN ' '"
        f" WHEN regexp_matches(t, '^[0-9A-Za-z:._+-]+$') THEN regexp_extract(t, {run}, 1) || {classified} ELSE t END"
    )
    return f"trim(array_to_string(list_transform({pieces}, lambda t: {each}), ''))"


RAW = f"raw AS (SELECT {select_list(LOG_COLUMNS)} FROM events)"
LOGS = (
    f"{RAW}, parsed AS (SELECT *, {json_doc('payload')} AS j FROM raw),"
    f" logs AS (SELECT seq, timestamp, source, coalesce({structured('j')}, {text_level('payload')}) AS level, payload FROM parsed)"
)
LIFE = f"life AS (SELECT {select_list(LIFECYCLE_COLUMNS)} FROM events WHERE {LIFECYCLE_WHERE})"
RECORD = "seq, timestamp, source, level, payload"


def elided(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '… [+' || CAST(length({c}) - {n} AS VARCHAR) || ' chars]' ELSE {c} END"


def preview(c: str, n: int) -> str:
    flat = f"replace(replace({c}, chr(10), ' '), chr(13), ' ')"
    return f"CASE WHEN length({flat}) > {n} THEN substring({flat}, 1, {n}) || '…' ELSE {flat} END"


def answer(source: str, n: int = 2000) -> str:
    return (
        f"SELECT seq, timestamp, source, level, {elided('payload', n)} AS payload,"
        f" CASE WHEN length(payload) > {n} THEN CAST(length(payload) AS BIGINT) END AS payload_truncated_from FROM {source}"
    )


def on_logs(select: str) -> str:
    return f"WITH {LOGS} {select}"


def where(condition: str) -> str:
    return on_logs(f"SELECT {RECORD} FROM logs WHERE {condition}")


def lines_of(name: str, key: str, text: str) -> str:
    return (
        f"WITH parts AS (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {name}),"
        f" lines AS (SELECT {key}, i - 1 AS line, parts[i] AS payload FROM (SELECT {key}, parts,"
        f" unnest(range(1, len(parts) + 1)) AS i FROM parts))"
    )


def line_query(name: str, key: str, text: str, column: str, value: str) -> str:
    return f"{lines_of(name, key, text)} SELECT {key}, CAST(line AS INTEGER) AS line, {value} AS {column} FROM lines"


def context(n: int, anchors: str = "true") -> str:
    """CTEs `ctx(seq, source, context)`: the context of every anchor row."""
    return (
        f"brk AS (SELECT *, CASE WHEN level <> 'unknown' OR {trimmed('payload')} = '' THEN 1 ELSE 0 END AS b FROM logs),"
        " blocks AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY seq) AS blk FROM brk),"
        f" framed AS (SELECT *, list({elided('payload', 2000)}) OVER (PARTITION BY source, blk ORDER BY seq"
        f" ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS c FROM blocks),"
        f" ctx AS (SELECT seq, source, coalesce(array_to_string(c, '|'), '') AS context FROM framed WHERE {anchors})"
    )


def groups(matching: str, with_context: int | None = None) -> str:
    """CTEs `g`: groups of the rows of `matching`, with ranked sources."""
    return (
        f"fp AS (SELECT *, {template('payload')} AS tpl, {rank('level')} AS r FROM {matching}),"
        " per_source AS (SELECT tpl, source, count(*) AS n FROM fp GROUP BY ALL),"
        " ranked AS (SELECT tpl, string_agg(source, '|' ORDER BY n DESC, source) AS sources FROM per_source GROUP BY tpl),"
        " g0 AS (SELECT tpl, substring(tpl, 1, 300) AS fingerprint, count(*) AS count, arg_max(level, r) AS level, min(timestamp) AS first_seen,"
        " max(timestamp) AS last_seen, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(payload, seq) AS sample"
        " FROM fp GROUP BY tpl),"
        " g AS (SELECT g0.*, ranked.sources FROM g0 JOIN ranked USING (tpl))"
    )


def newest_groups(condition: str, limit: int, n: int) -> str:
    """CTEs `top`: the shown groups with number, sample and context."""
    return (
        f"WITH {LOGS}, hit AS (SELECT * FROM logs WHERE {condition}), {groups('hit')}, {context(n)},"
        " top AS (SELECT g.*, ctx.context, row_number() OVER (ORDER BY last_seen DESC, first_seq) AS i FROM g"
        f" JOIN ctx ON ctx.seq = g.last_seq ORDER BY last_seen DESC, first_seq LIMIT {limit})"
    )


SHOWN_GROUP = (
    f"SELECT fingerprint, count, sources, level, first_seen, last_seen, {elided('sample', 2000)} AS sample, context FROM top"
)
IS_ERROR = "level = 'error'"
AT_LEAST_WARN = "level IN ('warn', 'error')"
SINCE = "timestamp >= TIMESTAMP '2024-01-15 00:00:00'"
STATS = (
    "stats AS (SELECT source AS name, count(*) AS total, count(*) FILTER (level = 'error') AS errors,"
    f" count(*) FILTER (level = 'warn') AS warns, arg_max(timestamp, seq) AS last_seen, {elided('arg_max(payload, seq)', 200)} AS last_line"
    " FROM logs GROUP BY source)"
)
STATE = (
    f"{LIFE}, state AS (SELECT name, arg_max(status, changed_at) AS status,"
    " arg_max(CASE WHEN detail IS NULL THEN '' ELSE detail END, changed_at) AS d, max(changed_at) AS changed_at FROM life GROUP BY name)"
)
VIEWS = (
    "views AS (SELECT coalesce(state.name, stats.name) AS name, coalesce(status, 'observed') AS status,"
    " nullif(d, '') AS detail, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns,"
    " last_seen, last_line, coalesce(changed_at, last_seen) AS status_changed_at"
    " FROM state FULL OUTER JOIN stats ON state.name = stats.name)"
)
LEVEL_MATCH = "contains(lower(payload), 'handler.run (') OR contains(lower(source), 'handler.run (')"


def newest(condition: str, n: int) -> str:
    return f"(SELECT * FROM logs WHERE {condition} ORDER BY seq DESC LIMIT {n}) t"


def wait_from(condition: str, which: str, limit: int) -> str:
    return on_logs(answer(
        f"(SELECT * FROM logs WHERE seq >= (SELECT {which}(seq) FROM logs WHERE {condition}) ORDER BY seq LIMIT {limit}) t"
    ))


def pad(c: str, width: str) -> str:
    return f"({c} || repeat(' ', greatest(CAST({width} AS BIGINT) - length({c}), 0)))"


def pad_left(c: str, width: int) -> str:
    return f"(repeat(' ', greatest({width} - length({c}), 0)) || {c})"


def clock(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%H:%M:%S'), '?')"


_CURSORS = (0, 1, 50, 99_999, 100_000, 10_000_000)
_MICROS = "strftime(timestamp, '%f')"

ORACLE = {
    "detect_level": on_logs("SELECT seq, level FROM logs"),
    "detect_level_documents": (
        f"{lines_of('documents', 'doc_id', 'text')}, parsed AS (SELECT *, {json_doc('payload')} AS j FROM lines)"
        f" SELECT doc_id, CAST(line AS INTEGER) AS line, coalesce({structured('j')}, {text_level('payload')}) AS level FROM parsed"
    ),
    "structured_level": (
        f"WITH {RAW}, parsed AS (SELECT *, {json_doc('payload')} AS j FROM raw) SELECT seq, {structured('j')} AS level FROM parsed"
    ),
    "parse_level_words": (
        f"WITH {RAW}, w AS (SELECT seq, regexp_extract(payload, '[A-Za-z]+') AS word FROM raw),"
        f" l AS (SELECT *, {named_level('lower(word)')} AS level FROM w) SELECT seq, word, level, {rank('level')} AS severity FROM l"
    ),
    "severity_rank": on_logs(f"SELECT seq, {rank('level')} AS severity, upper(left(rpad(level, 5, ' '), 5)) AS label FROM logs"),
    "fingerprint": f"WITH {RAW} SELECT seq, {fingerprint('payload')} AS fingerprint FROM raw",
    "fingerprint_documents": line_query("documents", "doc_id", "text", "fingerprint", fingerprint("payload")),
    "fingerprint_pages": line_query("pages", "page_id", "html", "fingerprint", fingerprint("payload")),
    "strip_line_ending": (
        f"WITH {RAW} SELECT seq, payload AS from_file, CAST(length(payload) + 1 AS INTEGER) AS container_chars,"
        " CAST(length(payload) + 2 AS INTEGER) AS line_chars FROM raw"
    ),
    "filter_grep": where("regexp_matches(payload, 'refused: \\w+:543[3-5]|0x[0-9a-f]+ accepted')"),
    "filter_source": where("contains(source, 'api')"),
    "filter_min_level": where(AT_LEAST_WARN),
    "filter_since": where(SINCE),
    "filter_all": where(
        f"regexp_matches(payload, 'timeout|failed') AND contains(source, 'api') AND {IS_ERROR} AND {SINCE} AND seq > 500"
    ),
    "filter_lenient": where("contains(source, 'web')"),
    "filter_interactive": where(
        "regexp_matches(payload, '(?i)GATEWAY|order 0x') OR regexp_matches(source, '(?i)GATEWAY|order 0x')"
    ),
    "filter_interactive_text": where(LEVEL_MATCH),
    "filter_sets": where("source IN ('api', 'db') AND level IN ('warn', 'unknown')"),
    "filtered_row_count": on_logs(
        "SELECT count(*) FILTER (level IN ('warn', 'error') AND (regexp_matches(payload, 'slow|timeout')"
        " OR regexp_matches(source, 'slow|timeout'))) AS total FROM logs"
    ),
    "error_group_summary": (
        f"WITH {LOGS}, hit AS (SELECT * FROM logs WHERE {IS_ERROR}), {groups('hit')}"
        " SELECT fingerprint, count, level, first_seen, last_seen, first_seq, last_seq FROM g"
    ),
    "error_group_sources": (
        f"WITH {LOGS}, hit AS (SELECT * FROM logs WHERE {IS_ERROR}), {groups('hit')} SELECT fingerprint, sources FROM g"
    ),
    "document_line_groups": (
        f"{lines_of('documents', 'doc_id', 'text')}, rows AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS seq,"
        f" TIMESTAMP '2024-01-01 00:00:00' AS timestamp, documents.source, {text_level('payload')} AS level, payload"
        f" FROM lines JOIN documents USING (doc_id)), {groups('rows')}"
        " SELECT fingerprint, count, level, sources, first_seq, last_seq FROM g"
    ),
    "error_groups_with_context": newest_groups(IS_ERROR, 20, 8) + SHOWN_GROUP,
    "error_groups_any_level": newest_groups("true", 1000, 50) + SHOWN_GROUP,
    "recent_errors_envelope": (
        f"WITH {LOGS}, hit AS (SELECT * FROM logs WHERE {IS_ERROR} AND seq > 10), {groups('hit')},"
        " s AS (SELECT CAST(sum(count) AS BIGINT) AS total_matching, count(*) AS distinct_groups FROM g)"
        ' SELECT total_matching, distinct_groups AS "distinct", distinct_groups > 3 AS truncated,'
        " (SELECT arg_min(timestamp, seq) FROM logs) AS buffer_starts_at, (SELECT max(seq) FROM logs) AS next_cursor,"
        " (SELECT min(seq) FROM logs) AS buffer_start_cursor, false AS cursor_gap FROM s"
    ),
    "trailing_context_errors": f"WITH {LOGS}, {context(8, IS_ERROR)} SELECT seq, source, context FROM ctx",
    "trailing_context_all_rows": f"WITH {LOGS}, {context(5)} SELECT seq, context FROM ctx",
    "source_statistics": f"WITH {LOGS}, {STATS} SELECT name, total, errors, warns, last_seen, last_line FROM stats",
    "source_view_list": f"WITH {LOGS}, {STATS}, {STATE}, {VIEWS} SELECT * FROM views",
    "lifecycle_states": f"WITH {STATE} SELECT name, status, nullif(d, '') AS detail, changed_at FROM state",
    "source_total_list": on_logs(
        "SELECT min(seq) AS position, source, count(*) AS total FROM logs GROUP BY source"
        " UNION ALL SELECT 0 AS position, 'all' AS source, count(*) AS total FROM logs"
    ),
    "log_status": f"WITH {RAW} SELECT true AS ok, count(*) AS buffered, coalesce(max(seq), 0) AS cursor FROM raw",
    "log_horizon": (
        f"WITH {RAW} SELECT min(seq) AS buffer_start_cursor, coalesce(max(seq), 0) AS next_cursor,"
        " arg_min(timestamp, seq) AS buffer_starts_at FROM raw"
    ),
    "search_newest": on_logs(answer(newest("true", 100), 30)),
    "search_filtered": on_logs(answer(newest(
        f"regexp_matches(payload, 'spent|slow') AND contains(source, 'api') AND {AT_LEAST_WARN}", 250
    ))),
    "search_envelope": on_logs(
        f"SELECT count(*) FILTER ({AT_LEAST_WARN} AND seq > 100) AS total_matching,"
        f" count(*) FILTER ({AT_LEAST_WARN} AND seq > 100) > 50 AS truncated, max(seq) AS next_cursor,"
        " min(seq) AS buffer_start_cursor, false AS cursor_gap FROM logs"
    ),
    "search_after_cursor": on_logs(answer(newest("seq > 900 AND contains(source, 'worker')", 1000))),
    "cursor_gaps": (
        f"WITH {RAW}, kept AS (SELECT min(seq) AS lo, max(seq) AS hi FROM (SELECT seq FROM raw ORDER BY seq DESC LIMIT 5000)),"
        f" c AS (SELECT CAST(unnest([{', '.join(map(str, _CURSORS))}]) AS BIGINT) AS cursor)"
        " SELECT cursor, cursor + 1 < (SELECT lo FROM kept) OR cursor > (SELECT hi FROM kept) AS cursor_gap FROM c"
    ),
    "latest_matching": (
        f"WITH {RAW} SELECT max(seq) AS seq FROM raw WHERE contains(payload, 'bucket:7734') AND contains(source, 'api')"
    ),
    "first_matching_after": (
        f"WITH {RAW} SELECT min(seq) AS seq FROM raw WHERE contains(payload, 'bucket:7734') AND contains(source, 'api')"
        " AND seq > 400"
    ),
    "burst_from_anchor": wait_from(f"{IS_ERROR} AND contains(source, 'db') AND seq > 700", "min", 40),
    "wait_buffered": wait_from("regexp_matches(payload, 'slow query took 1\\d\\dms') AND seq > 20", "max", 100),
    "wait_settled": on_logs(
        "SELECT * FROM (" + answer("logs") + f") t WHERE seq >= (SELECT min(seq) FROM logs WHERE {IS_ERROR} AND seq > 300)"
        f" AND timestamp <= (SELECT arg_min(timestamp, seq) FROM logs WHERE {IS_ERROR} AND seq > 300) + INTERVAL 2 MINUTE"
    ),
    "retained": on_logs(f"SELECT {RECORD} FROM logs ORDER BY seq DESC LIMIT 5000"),
    "retained_filtered": on_logs(
        f"SELECT {RECORD} FROM logs WHERE level IN ('info', 'warn', 'error') ORDER BY seq DESC LIMIT 1234"
    ),
    "tail_of_each_source": on_logs(
        f"SELECT {RECORD} FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS r FROM logs) t WHERE r <= 50"
    ),
    "page": on_logs(
        f"SELECT {RECORD} FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS n FROM logs"
        " WHERE regexp_matches(payload, 'error') OR regexp_matches(source, 'error')) t"
        " WHERE r >= least(300, greatest(n - 40, 0)) AND r < least(300, greatest(n - 40, 0)) + 40"
    ),
    "page_clamped": on_logs(f"SELECT {RECORD} FROM logs WHERE {IS_ERROR} ORDER BY seq DESC LIMIT 25"),
    "page_follow": on_logs(f"SELECT {RECORD} FROM logs WHERE {IS_ERROR} ORDER BY seq DESC LIMIT 30"),
    "sequence_numbers": (
        "SELECT row_number() OVER (ORDER BY conv_id, turn, role) AS seq, conv_id, turn, role FROM conversations"
    ),
    "ingest_filtered": (
        f"WITH {RAW} SELECT row_number() OVER (ORDER BY seq) AS seq, seq AS arrival, source, payload FROM raw"
        " WHERE regexp_matches(payload, 'bucket|order') AND contains(source, 'api')"
    ),
    "merged_sources": (
        f"WITH {LOGS}, chat AS (SELECT 'chat-' || role AS source, text AS payload, {json_doc('text')} AS j FROM conversations)"
        " SELECT 'events' AS source, level, payload FROM logs UNION ALL"
        f" SELECT source, coalesce({structured('j')}, {text_level('payload')}) AS level, payload FROM chat"
    ),
    "deduplicated": on_logs(
        "SELECT seq, timestamp, source, level, CASE WHEN seq % 3 = 0 THEN upper(payload) ELSE payload END AS payload FROM logs"
    ),
    "flattened_json": (
        f"WITH {RAW}, parsed AS (SELECT *, {json_doc('payload')} AS j FROM raw), flat AS (SELECT seq, payload,"
        " CASE WHEN j IS NOT NULL THEN array_to_string(list_transform(list_sort(json_keys(j)),"
        " lambda k: k || '=' || coalesce(json_extract_string(j, '/' || k), 'null')), '  ') END AS flat FROM parsed)"
        " SELECT seq, flat, coalesce(flat, payload) AS shown FROM flat"
    ),
    "json_recognised": (
        f"WITH {RAW}, p AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN payload || '}} x' ELSE payload END AS payload FROM raw)"
        " SELECT seq, (starts_with(trim(payload), '{') OR starts_with(trim(payload), '[')) AND json_valid(payload) AS is_json FROM p"
    ).replace("}} x", "} x"),
    "elided_documents": (
        f"SELECT doc_id, {elided('text', 200)} AS text, CASE WHEN length(text) > 200 THEN CAST(length(text) AS BIGINT) END AS truncated_from,"
        f" {preview('text', 80)} AS preview FROM documents"
    ),
    "clock_times": (
        f"WITH {RAW} SELECT seq, strftime(timestamp, '%H:%M:%S') AS short_time, strftime(timestamp, '%H:%M:%S.%g') AS clock,"
        f" strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {_MICROS} = '000000' THEN '' WHEN {_MICROS} LIKE '%000'"
        f" THEN '.' || left({_MICROS}, 3) ELSE '.' || {_MICROS} END || 'Z' AS instant FROM raw"
    ),
    "json_record_sink": on_logs(
        "SELECT '{\"seq\":' || CAST(seq AS VARCHAR) || ',\"timestamp\":\"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S')"
        f" || CASE WHEN {_MICROS} = '000000' THEN '' WHEN {_MICROS} LIKE '%000' THEN '.' || left({_MICROS}, 3)"
        f" ELSE '.' || {_MICROS} END || 'Z\",\"source\":' || to_json(source) || ',\"level\":' || to_json(level)"
        " || ',\"payload\":' || to_json(payload) || '}' AS value FROM logs"
    ),
    "all_records": where("contains(source, 'b')"),
    "rendered_records": on_logs(
        f"SELECT row_number() OVER (ORDER BY seq) AS row, {clock('timestamp')} || ' ' || {pad('level', '5')} || ' ' ||"
        f" {pad('source', 'least(max(strlen(source)) OVER (), 20)')} || ' ' || payload AS line FROM {newest(AT_LEAST_WARN, 60)}"
    ),
    "rendered_groups": newest_groups(IS_ERROR, 20, 3) + (
        f"SELECT i AS row, '[' || i || '] x' || count || ' ' || level || ' ' || replace(sources, '|', ',') || ' first ' ||"
        f" {clock('first_seen')} || ' last ' || {clock('last_seen')} || chr(10) || '    ' || sample || CASE WHEN context = '' THEN ''"
        f" ELSE array_to_string(list_transform(string_split(context, '|'), lambda c: chr(10) || '      ' || {trimmed('c')}), '') END"
        " AS line FROM top"
    ),
    "rendered_sources": f"WITH {LOGS}, {STATS}, {STATE}, {VIEWS} " + (
        "SELECT row_number() OVER (ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'exited' THEN 1 WHEN 'starting' THEN 2"
        " WHEN 'running' THEN 3 ELSE 4 END, errors DESC, name) AS row, "
        + pad("name", "least(max(strlen(name)) OVER (), 24)") + " || '  ' || " + pad("status", "8") + " || ' ' || "
        + pad_left("CAST(total AS VARCHAR)", 5) + " || ' records  ' || " + pad_left("CAST(errors AS VARCHAR)", 4)
        + " || ' err  ' || " + pad_left("CAST(warns AS VARCHAR)", 4) + " || ' warn  last ' || " + clock("last_seen")
        + " || '  ' || " + preview("coalesce(last_line, '')", 80)
        + " || CASE WHEN detail IS NULL THEN '' ELSE ' · ' || " + preview("detail", 80) + " END AS line FROM views"
    ),
}

# a stream that has seen everything gives the batch answer
ORACLE["streamed_ingest"] = on_logs(f"SELECT {RECORD} FROM logs")
ORACLE["streamed_source_stats"] = ORACLE["source_statistics"]
ORACLE["streamed_error_groups"] = ORACLE["error_group_summary"]
ORACLE["streamed_traces"] = ORACLE["trailing_context_errors"]
ORACLE["streamed_follow"] = ORACLE["json_record_sink"] + " WHERE contains(source, 'worker') AND contains(payload, 'error')"

ORACLE["ingested_lines"] = (
    f"{lines_of('documents', 'doc_id', 'text')}"
    " SELECT row_number() OVER (ORDER BY doc_id, line) AS seq, payload FROM lines WHERE payload <> ''"
)
ORACLE["records_round_trip"] = on_logs(
    "SELECT CASE WHEN seq % 10 <> 0 THEN seq END AS seq, CASE WHEN seq % 10 <> 0 THEN payload END AS payload,"
    " CASE WHEN seq % 10 = 0 THEN substring('{\"seq\":' || seq || ',\"timestamp', 1, 10) END AS rejected FROM logs"
)
ORACLE["error_groups_null_source"] = (
    f"WITH {LOGS}, hit AS (SELECT * FROM logs WHERE {IS_ERROR}), {groups('hit')}"
    f" SELECT fingerprint, count, {elided('sample', 2000)} AS sample FROM g ORDER BY last_seen DESC, first_seq LIMIT 20"
)
ORACLE["fingerprint_long_lines"] = (
    f"WITH {LOGS}, hit AS (SELECT seq, timestamp, source, level, repeat('padding ', 50) || payload AS payload FROM logs), {groups('hit')}"
    " SELECT fingerprint, count, first_seq, last_seq FROM g"
)
ORACLE["streamed_follow_replayed"] = on_logs("SELECT seq, source, level, payload FROM logs")
ORACLE["filter_grep_classes"] = on_logs(
    "SELECT seq, timestamp, source, level, payload FROM logs WHERE regexp_matches(payload, '[^ -~]|^[b-df-hj-np-tv-z]+ [^0-9]|[(?=]{2}')"
)

_SOME = "CASE WHEN seq % 3 <> 0 THEN source END"
_NEWEST_POSITION = "row_number() OVER (ORDER BY seq) AS position"
ORACLE["settled_burst_hour"] = on_logs(
    "SELECT * FROM (" + answer("logs") + f") t WHERE seq >= (SELECT min(seq) FROM logs WHERE {IS_ERROR} AND contains(source, 'db') AND seq > 200)"
    f" AND timestamp <= (SELECT arg_min(timestamp, seq) FROM logs WHERE {IS_ERROR} AND contains(source, 'db') AND seq > 200) + INTERVAL 60 MINUTE"
)
ORACLE["tail_null_source"] = on_logs(
    f"SELECT seq, timestamp, {_SOME} AS source, level, payload FROM"
    f" (SELECT *, row_number() OVER (PARTITION BY {_SOME} ORDER BY seq DESC) AS r FROM logs) t WHERE r <= 40"
)
ORACLE["streamed_traces_null_source"] = (
    f"WITH {LOGS}, nulled AS (SELECT * REPLACE ({_SOME} AS source) FROM logs), {context(8, IS_ERROR).replace('FROM logs', 'FROM nulled')}"
    " SELECT seq, source, context FROM ctx"
)
_GAP = "timestamp - lag(timestamp) OVER (PARTITION BY source ORDER BY seq) > INTERVAL 3 MINUTE"
ORACLE["streamed_traces_timeout"] = ORACLE["streamed_traces_null_source"].replace("level <> 'unknown' OR", f"level <> 'unknown' OR {_GAP} OR")
ORACLE["streamed_unique"] = on_logs(f"SELECT {RECORD} FROM logs")
ORACLE["kept_source_statistics"] = ORACLE["source_statistics"]
_LAST_400 = f"WITH {LOGS.replace(' logs AS (', ' whole AS (')}, logs AS (SELECT * FROM whole WHERE seq > (SELECT max(seq) FROM whole) - 400)"
ORACLE["kept_source_views"] = f"{_LAST_400}, {STATS}, {STATE}, {VIEWS} SELECT * FROM views"
ORACLE["kept_totals"] = (
    f"{_LAST_400}, h AS (SELECT min(seq) AS buffer_start_cursor, max(seq) AS next_cursor, arg_min(timestamp, seq) AS buffer_starts_at FROM logs),"
    " t AS (SELECT min(seq) AS position, source, count(*) AS total FROM logs GROUP BY source"
    " UNION ALL SELECT 0 AS position, 'all' AS source, count(*) AS total FROM logs) SELECT * FROM t, h"
)
_KEPT = "seq > (SELECT max(seq) FROM logs) - 4 * (SELECT max(seq) // 5 FROM logs)"
ORACLE["searched_table"] = on_logs(answer(newest(
    f"regexp_matches(payload, '(?i)BUCKET:773[3-6]\\b|cache miss at 10\\.0\\.0\\.1') AND {_KEPT}", 1000
)))
_SLOW = f"regexp_matches(payload, 'slow query took 7|spent: bucket') AND {AT_LEAST_WARN} AND seq > 300 AND {_KEPT}"
ORACLE["searched_table_envelope"] = on_logs(
    f"SELECT count(*) FILTER ({_SLOW}) AS total_matching, count(*) FILTER ({_SLOW}) > 50 AS truncated, max(seq) AS next_cursor,"
    f" min(seq) FILTER ({_KEPT}) AS buffer_start_cursor, min(seq) FILTER ({_KEPT}) - 1 > 300 AS cursor_gap FROM logs"
)
ORACLE["compacted_log"] = on_logs(
    f"SELECT {RECORD}, (SELECT count(*) FROM logs) AS seen, (SELECT count(*) FROM logs) AS seen_once FROM logs ORDER BY seq DESC LIMIT 2500"
)
_WAITED = "contains(payload, 'bucket:7734') AND contains(source, 'api') AND seq > 20"
ORACLE["wait_answer"] = on_logs(
    "SELECT * FROM (" + answer(f"(SELECT * FROM logs WHERE seq >= (SELECT max(seq) FROM logs WHERE {_WAITED}) ORDER BY seq LIMIT 60) t")
    + "), (SELECT true AS matched, true AS matched_from_buffer, count(*) AS total_matching, count(*) > 60 AS truncated,"
    f" (SELECT max(seq) FROM logs) AS next_cursor FROM logs WHERE seq >= (SELECT max(seq) FROM logs WHERE {_WAITED}))"
)
ORACLE["hydrated_view"] = on_logs(f"SELECT {RECORD} FROM logs")
ORACLE["incremental_steps"] = on_logs(
    f"SELECT CASE WHEN seq <= 1500 THEN 1 ELSE 2 END AS step, seq, source, level, payload FROM logs WHERE {AT_LEAST_WARN} AND seq > 900 AND seq <= 2200"
)
ORACLE["newest_positions"] = on_logs(f"SELECT {RECORD}, {_NEWEST_POSITION} FROM (SELECT * FROM logs ORDER BY seq DESC LIMIT 120) t")
ORACLE["page_positions"] = on_logs(
    f"SELECT {RECORD}, {_NEWEST_POSITION} FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS n FROM logs"
    " WHERE regexp_matches(payload, 'error') OR regexp_matches(source, 'error')) t"
    " WHERE r >= least(100, greatest(n - 60, 0)) AND r < least(100, greatest(n - 60, 0)) + 60"
)
ORACLE["burst_positions"] = on_logs(
    f"SELECT {RECORD}, {_NEWEST_POSITION} FROM (SELECT * FROM logs WHERE seq >= (SELECT min(seq) FROM logs WHERE {IS_ERROR} AND seq > 500)"
    " ORDER BY seq LIMIT 80) t"
)
_AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"
ORACLE["since_column"] = (
    f"WITH {RAW} SELECT seq, {SINCE_TEXT} AS text, CASE CAST(seq % 8 AS INT)"
    " WHEN 0 THEN date_trunc('second', timestamp) + INTERVAL 1 MILLISECOND * (10 * (seq % 10) + 5) - INTERVAL 150 MINUTE"
    " WHEN 1 THEN date_trunc('second', timestamp) + INTERVAL 1 MICROSECOND"
    f" WHEN 2 THEN {_AS_OF} - INTERVAL 1 MINUTE * seq WHEN 3 THEN {_AS_OF} - INTERVAL 1 DAY * (seq % 50)"
    f" WHEN 4 THEN {_AS_OF} - INTERVAL 1 HOUR * seq WHEN 7 THEN TIMESTAMP '0001-01-01 00:00:00' END AS since FROM raw"
)
_LEVELED = (
    f"{lines_of('documents', 'doc_id', 'text')}, parsed AS (SELECT *, {json_doc('payload')} AS j FROM lines),"
    f" leveled AS (SELECT payload, coalesce({structured('j')}, {text_level('payload')}) AS level FROM parsed)"
)
ORACLE["ingested_files"] = (
    f"{_LEVELED} SELECT 'documents' AS source, level, payload, count(*) AS lines, CAST(1 AS BIGINT) AS first_seq,"
    " (SELECT count(*) FROM leveled WHERE payload <> '') AS last_seq FROM leveled WHERE payload <> '' GROUP BY level, payload"
)
ORACLE["ingested_from_config"] = (
    f"{_LEVELED}, every AS (SELECT 'files' AS source, level, payload FROM leveled WHERE payload <> ''"
    " UNION ALL SELECT 'process', level, payload FROM leveled UNION ALL SELECT 'pipe', 'unknown', role FROM conversations)"
    " SELECT source, level, payload, count(*) AS lines FROM every GROUP BY source, level, payload"
)
