"""The registered queries of the corpus operators, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import preference_digest
from .common import table
from .embedding_dedup import embedding_digest
from .imatch import imatch_digest
from .mixing import DOMAIN_SQL, WEIGHTS, mixture_digest
from .ngram_join import ngram_jaccard_classes
from .packing import pack_best_fit
from .prefix_trie import trie_digest
from .quality import quality_digest
from .secrets import secrets_digest
from .topk import topk_digest
from .toxicity import toxicity_digest
from .turn_repair import repair_conversations
from .warc import warc_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_digest(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_digest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least_revisit=1000)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_digest(table(spark, sf_dir, "embeddings"))


def op7_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_digest(table(spark, sf_dir, "conversations"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=1024, end_id=2)


def op11_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_digest(table(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_digest(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join, op2_toxicity_cnn, op3_weighted_mixing, op4_exact_topk, op5_warc, op6_embedding_near_dedup, op7_quality_gbt, op8_secret_scan, op9_preference_format, op10_best_fit_packing,
        op11_imatch_fingerprints, op12_conversation_prefix_trie, op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END s FROM w
), sh AS (SELECT doc_id, unnest(s) s FROM sets),
sizes AS (SELECT doc_id, len(s) n FROM sets),
same AS (SELECT x.doc_id a, y.doc_id b, count(*) k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM same JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON e.a = r.b)
SELECT z.doc_id, CAST(z.n AS BIGINT) n_shingles, least(z.doc_id, coalesce(min(r.b), z.doc_id)) component_id
FROM sizes z LEFT JOIN reach r ON r.a = z.doc_id GROUP BY z.doc_id, z.n
"""


def _weight_sql(level: int) -> str:
    names = ("domain", "lang", "source")
    cases = " ".join("WHEN " + " AND ".join(f"{n} = '{v}'" for n, v in zip(names, path)) + f" THEN {w}" for path, w in WEIGHTS.items() if len(path) == level + 1)
    return f"CAST(CASE {cases} ELSE 1 END AS BIGINT)"


def _fill_sql(rows: str, family: str, name: str) -> str:
    """Shares of a family: children in order of capacity per weight, see the operator."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""(
    SELECT * EXCLUDE (share, spare, turn, given), share + CASE WHEN share < capacity AND turn <= spare THEN 1 ELSE 0 END budget
    FROM (SELECT *, row_number() OVER ({part} ORDER BY CAST(share < capacity AS INT) DESC, {name}) turn,
             CAST(least(given, sum(capacity) OVER ({part})) - sum(share) OVER ({part}) AS BIGINT) spare
    FROM (SELECT * EXCLUDE (budget, lv), budget given, least(capacity, CAST(floor(greatest(0.0, coalesce(max(lv) OVER ({part}), 0.0)) * CAST(weight AS DOUBLE)) AS BIGINT)) share
    FROM (SELECT *, CASE WHEN w_after > 0 THEN CAST(budget - c_before AS DOUBLE) / CAST(w_after AS DOUBLE) END lv FROM (
      SELECT *, CAST(coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) c_before,
             CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) w_after
      FROM ({rows}) WINDOW o AS ({part} ORDER BY CAST(capacity AS DOUBLE) / nullif(weight, 0) ASC NULLS FIRST, {name}))))))"""


_TOP = _fill_sql("SELECT domain, CAST(sum(cap) AS BIGINT) capacity, max(w0) weight, (SELECT CAST(sum(n) * 6 // 10 AS BIGINT) FROM d) budget FROM leaf GROUP BY domain", "", "domain")
_MID = _fill_sql("SELECT l.domain, l.lang, CAST(sum(cap) AS BIGINT) capacity, max(w1) weight, max(t.budget) budget FROM leaf l JOIN top t ON t.domain = l.domain GROUP BY l.domain, l.lang", "domain", "lang")
_LOW = _fill_sql("SELECT l.domain, l.lang, l.source, l.tokens, cap capacity, w2 weight, m.budget FROM leaf l JOIN mid m ON m.domain = l.domain AND m.lang = l.lang", "domain, lang", "source")
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce({DOMAIN_SQL}, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) n FROM documents
), leaf AS (
  SELECT *, CASE WHEN w0 > 0 AND w1 > 0 AND w2 > 0 THEN tokens * 3 ELSE 0 END cap FROM (
    SELECT domain, lang, source, tokens, {_weight_sql(0)} w0, {_weight_sql(1)} w1, {_weight_sql(2)} w2
    FROM (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) tokens FROM d GROUP BY ALL))
), top AS (SELECT * FROM {_TOP}), mid AS (SELECT * FROM {_MID}), low AS (SELECT * FROM {_LOW}),
plan AS (SELECT domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) whole, coalesce(budget % nullif(tokens, 0), 0) rest FROM low),
run AS (
  SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('42:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n AS before
  FROM d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source
), taken AS (
  SELECT doc_id, domain, lang, source, unnest(range(whole)) epoch, n, n take FROM run
  UNION ALL SELECT doc_id, domain, lang, source, whole, n, least(n, CAST(rest - before AS BIGINT)) FROM run WHERE before < rest
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) epoch, n n_tokens, take take_tokens FROM taken
"""

OP9_SQL = """
WITH t AS (
  SELECT conv_id // 2 pair_id, conv_id % 2 = 0 chosen, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) i FROM conversations
), common AS (
  SELECT c.pair_id, c.i, c.role = r.role AND c.text = r.text same FROM t c JOIN t r ON r.pair_id = c.pair_id AND r.i = c.i AND c.chosen AND NOT r.chosen
), k AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) k FROM common GROUP BY pair_id),
pairs AS (SELECT p.pair_id, coalesce(k, 0) k FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN k ON k.pair_id = p.pair_id),
z AS (
  SELECT t.*, k, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN pairs p ON p.pair_id = t.pair_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, chosen ORDER BY i) - length(body) AS s FROM z WHERE i > k
), sides AS (
  SELECT pair_id, chosen, string_agg(head || body, '' ORDER BY i) txt,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN s || ':' || (s + length(body)) END, ',' ORDER BY i), '') loss FROM o GROUP BY ALL
), there AS (SELECT DISTINCT pair_id, chosen FROM t)
SELECT p.pair_id, CAST(p.k AS INT) n_prompt_turns,
       coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM z WHERE z.pair_id = p.pair_id AND z.chosen AND z.i <= p.k), '') prompt,
       CASE WHEN hc.pair_id IS NOT NULL THEN coalesce(c.txt, '') END AS chosen, CASE WHEN hr.pair_id IS NOT NULL THEN coalesce(r.txt, '') END AS rejected,
       CASE WHEN hc.pair_id IS NOT NULL THEN coalesce(c.loss, '') END AS chosen_loss, CASE WHEN hr.pair_id IS NOT NULL THEN coalesce(r.loss, '') END AS rejected_loss
FROM pairs p
LEFT JOIN sides c ON c.pair_id = p.pair_id AND c.chosen LEFT JOIN sides r ON r.pair_id = p.pair_id AND NOT r.chosen
LEFT JOIN there hc ON hc.pair_id = p.pair_id AND hc.chosen LEFT JOIN there hr ON hr.pair_id = p.pair_id AND NOT hr.chosen
"""


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, CAST(rank AS INT) rank, vec_id, score FROM r WHERE rank <= 10
"""


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, CAST(strlen(h) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, url, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < head THEN head END AS refers_to FROM q
"""


# CRC-32 of an ASCII text, from a table by rule: tab is a list of its 256 entries.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) v FROM (SELECT unnest(range(256)) i)))"""


def _crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a // 256, tab[1 + xor(a % 256, b)])), 4294967295)"


OP12_SQL = f"""
WITH {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT *, substr(sha256(length(role) || ':' || role || text), 1, 32) code FROM r),
turns AS (SELECT conv_id, code, length(text) chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, code) i FROM coded),
convs AS (SELECT conv_id, conv_id - conv_id % 100 base, {_crc_sql('CAST(conv_id AS VARCHAR)')} % 6 h FROM (SELECT DISTINCT conv_id FROM r), crc_table),
heads AS (SELECT c.conv_id, b.i, b.code, b.chars FROM convs c JOIN turns b ON b.conv_id = c.base AND b.i <= c.h),
taken AS (SELECT c.conv_id, any_value(h) h, count(x.i) k FROM convs c LEFT JOIN heads x ON x.conv_id = c.conv_id GROUP BY 1),
rebuilt AS (SELECT conv_id, i d, code, chars FROM heads UNION ALL SELECT t.conv_id, k + i - h, code, chars FROM turns t JOIN taken c ON c.conv_id = t.conv_id AND t.i > h),
members AS (SELECT conv_id, d, string_agg(code, ',') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) p, chars FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT p, d, min(conv_id) conv_id, count(*) n, max(chars) chars FROM members GROUP BY 1, 2),
ends AS (SELECT p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) ids FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) z FROM members) WHERE z = 1 GROUP BY 1),
up AS (SELECT x.p, m.p above, y.conv_id parent FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.d = x.d - 1 JOIN nodes y ON y.p = m.p AND y.d = m.d),
kids AS (SELECT above, count(*) k FROM up GROUP BY 1),
sums AS (SELECT a.p, sum((x.n - 1) * x.chars) saved, count(*) FILTER (kids.k IS NULL) leaves FROM nodes x LEFT JOIN kids ON kids.above = x.p JOIN members a ON a.conv_id = x.conv_id AND a.d <= x.d GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.parent AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(coalesce(kids.k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x JOIN sums ON sums.p = x.p LEFT JOIN up ON up.p = x.p LEFT JOIN kids ON kids.above = x.p LEFT JOIN ends ON ends.p = x.p
"""


def _least_sql(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _after_sql(state: str, cost: str, letters: str, when: str = "true") -> str:
    """An element (cost c, audit a) after more edits; NULL where there is none or the edits do not fit."""
    return f"CASE WHEN {state} IS NOT NULL AND ({when}) THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {letters}}} END"


_CLOSED = f"""s0, s1, {_least_sql('s2', *(_after_sql(x, '5', "'I'") for x in ('s0', 's1', 's3')))} s2, {_least_sql('s3', _after_sql('s2', '5', "'I'"), _after_sql('s0', '10', "'II'"), _after_sql('s1', '10', "'II'"))} s3"""
_STAYS = "f NOT IN ('blank', 'duplicate')"


def _step_sql(state: str, initial: str, sources: tuple[str, ...]) -> str:
    extra = "CASE WHEN f = 'truncated' THEN 5 ELSE 0 END"
    ways = [_after_sql(state, "2", "'D'")]
    for x in sources:
        if initial == "s":
            ways.append(_after_sql(x, extra, "'K'", f"{_STAYS} AND ini = 's'"))
        else:
            ways.append(_after_sql(x, f"{extra} + CASE WHEN ini = '{initial}' THEN 0 ELSE 1 END", f"CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END", _STAYS))
    return _least_sql(*ways)


_NO = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT r.*, {_crc_sql("conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 kind FROM r, crc_table),
damaged AS (SELECT conv_id, turn, role r0, text t0, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) copy FROM k WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) i, rtrim(text, {_BLANKS}) solid, substr(role, 1, 1) ini FROM damaged),
marked AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END f,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) before FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (f = 'blank') blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') truncated,
  count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) illegal, max(i) n FROM marked GROUP BY 1),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': ''}} AS STRUCT(c BIGINT, a VARCHAR)), {_NO}, {_NO}, {_NO} FROM told
  UNION ALL
  SELECT conv_id, i, {_step_sql('s0', 's', ())}, {_step_sql('s1', 's', ('s0',))}, {_step_sql('s2', 'u', ('s0', 's1', 's3'))}, {_step_sql('s3', 'a', ('s2',))}
  FROM (SELECT w.conv_id, m.i, m.f, m.ini, {_CLOSED} FROM walk w JOIN marked m ON m.conv_id = w.conv_id AND m.i = w.i + 1)),
best AS (SELECT conv_id, {_least_sql('s0', 's3')} e FROM (SELECT w.conv_id, {_CLOSED} FROM walk w JOIN told t ON t.conv_id = w.conv_id AND t.n = w.i)),
letters AS (SELECT conv_id, unnest(range(1, length(e.a) + 1)) j, e.a audit FROM best),
edits AS (SELECT conv_id, j, substr(audit, j, 1) x, count(*) FILTER (substr(audit, j, 1) <> 'I') OVER w i, count(*) FILTER (substr(audit, j, 1) <> 'D') OVER w - 1 AS place, length(replace(audit, 'D', '')) % 2 odd FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT e.conv_id, j, CASE WHEN x = 'K' THEN m.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE m.text END line FROM edits e LEFT JOIN marked m ON m.conv_id = e.conv_id AND m.i = e.i WHERE x <> 'D'),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) body FROM lines GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce("duplicate", 0) AS BIGINT) AS "duplicate", CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM r) c LEFT JOIN told ON told.conv_id = c.conv_id LEFT JOIN best ON best.conv_id = c.conv_id LEFT JOIN repaired ON repaired.conv_id = c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL, "op3_weighted_mixing": OP3_SQL, "op4_exact_topk": OP4_SQL, "op5_warc": OP5_SQL, "op9_preference_format": OP9_SQL,
        "op12_conversation_prefix_trie": OP12_SQL, "op13_conversation_repair": OP13_SQL,
    }
