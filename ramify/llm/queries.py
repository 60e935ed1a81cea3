"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ramify.llm import bpe, chat, linededup, media, neardup, packing, pii, quality, secrets, toxicity
from ramify.llm.common import table


_SAID = "</s>[INST] ok [/INST]"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_report(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity.learn_from(spark, sf_dir))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_SAID}'), (-1L, 1L, 'assistant', '{_SAID}') AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.format_windows(turns.unionByName(own)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_secrets, op3_personal, op4_bpe, op5_media, op6_toxicity, op7_neardup, op8_packing, op9_linededup, op10_chat, pipeline)
    return {f.__name__: f for f in own}


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, {_LOWER.format(f"trim(lines[i], {_SPACE})")} AS key FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
h AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep <> doc_id) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN h USING (key) GROUP BY doc_id"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {neardup.SHINGLE} THEN [array_to_string(w, ' ')]
ELSE list_distinct(list_transform(range(1, len(w) - {neardup.SHINGLE} + 2), lambda i: array_to_string(w[i:i + {neardup.SHINGLE - 1}], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= {neardup.THRESHOLD} * (a.n + b.n - shared)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT u.y, r.label FROM r JOIN u ON u.x = r.id)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, min(label) AS component_id, min(label) = id AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id, n"""


def _chat_sql() -> str:
    escaped = "{0}"
    for raw, code in chat._ESCAPES:
        escaped = f"replace({escaped}, '{raw}', '{code}')"
    room = f"greatest(1, {chat.BUDGET - chat.HISTORY_SHARE} - system_cost)"
    back = "".join(f" + CASE WHEN {' + '.join(f'coalesce(back{j}, {chat.BUDGET})' for j in range(1, k + 1))} <= {chat.HISTORY_SHARE} THEN chars{k} ELSE 0 END" for k in range(1, chat.HISTORY + 1))
    lags = "".join(f", lag(cost, {k}) OVER o AS back{k}, lag(chars, {k}) OVER o AS chars{k}" for k in range(1, chat.HISTORY + 1))
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
s AS (SELECT *, '{chat._OPEN}' || {escaped.format("role")} || ']' || chr(10) || {escaped.format("text")} || '{chat._CLOSE}' AS s,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM t),
c AS (SELECT *, length(s) AS chars, greatest(1, len(regexp_extract_all(s, '{chat.PIECES}')) + strlen(s) - length(s)) AS cost, i = 0 AND role = 'system' AS head FROM s),
h AS (SELECT *, coalesce(max(cost) FILTER (WHERE head) OVER (PARTITION BY conv_id), 0) AS system_cost, coalesce(max(chars) FILTER (WHERE head) OVER (PARTITION BY conv_id), 0) AS system_chars FROM c),
b AS (SELECT *, {room} AS room, sum(cost) OVER o - cost AS before{lags} FROM h WHERE NOT head WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
e AS (SELECT *, before // room AS cell FROM b),
g AS (SELECT *, max(before + cost) OVER w - min(before) OVER w > room AND count(*) OVER w > 1 AND i = max(i) OVER w AS apart FROM e WINDOW w AS (PARTITION BY conv_id, cell)),
k AS (SELECT conv_id, cell, apart, sum(chars) AS chars, min(i) AS i FROM g GROUP BY conv_id, cell, apart),
f AS (SELECT conv_id, sum(k.chars + system_chars{back}) AS chars FROM k JOIN (SELECT * EXCLUDE (chars, cell, apart) FROM g) USING (conv_id, i) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LOSS_ROLE}'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
coalesce(any_value(f.chars), sum(c.chars)) AS formatted_chars FROM c LEFT JOIN f USING (conv_id) GROUP BY conv_id"""


def _secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        rx = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i,
coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS start, length(ms[i]) AS n
FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, gs FROM (SELECT doc_id, string_split_regex(text, {rx}) AS gaps,
regexp_extract_all(text, {rx}, 0) AS ms, regexp_extract_all(text, {rx}, {rule.group}) AS gs FROM documents WHERE regexp_matches(text, {rx}))) WHERE length(gs[i]) >= {rule.least}""")
    base = [str(i) for i, r in enumerate(secrets.RULES) if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{secrets.RULES[int(i)].kind}" for i in base)
    one = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank)"
    return f"""WITH f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({one} FILTER (WHERE rank IN ({", ".join(base)})), '')) AS base_sha256, coalesce({one}, '') AS spans
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the operators whose results follow from SQL; doc_id is unique and there in the tables."""
    return {"op2_secrets": _secrets_sql(), "op7_neardup": _NEAR, "op9_linededup": _LINES, "op10_chat": _chat_sql()}
