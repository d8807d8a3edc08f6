"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import constants as C
from ..functions import predicates as P
from ..functions import text as T
from ..operators import adjudicate, detect, diff, grounding, locate, packing, stats
from ..sources import readers

#: So many bytes may be dealt out by a shuffle.
SMALL_TABLE = 256 << 20

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one in few files is dealt over the cores, so that a wide scan does not run in a single task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_TABLE and len(df.inputFiles()) < min(cores, 64) else df


# --- shared views -----------------------------------------------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "documents/")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.text_lines(table(spark, sf_dir, "pages"), "page_id", "html", "pages/")


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return diff.text_lines(c, "id", "text", "conversations/")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dedup(detect.rule_findings(document_lines(spark, sf_dir)))


def _lines_sql(name: str, key: str, text: str, prefix: str) -> str:
    return f"""
    {name} AS (
      SELECT {key}::VARCHAR AS request_id, '{prefix}' || {key}::VARCHAR AS path, unnest(range(1, len(ls) + 1))::INT AS line, regexp_replace(unnest(ls), '\\r$', '') AS text
      FROM (SELECT {key}, CASE WHEN {text} = '' OR {text} LIKE '%' || chr(10) THEN string_split({text}, chr(10))[1 : len(string_split({text}, chr(10))) - 1] ELSE string_split({text}, chr(10)) END AS ls
            FROM (SELECT {key}, coalesce({text}, '') AS {text} FROM {{source}})))"""


DOC_LINES = _lines_sql("lines", "doc_id", "text", "documents/").format(source="documents")
PAGE_LINES = _lines_sql("lines", "page_id", "html", "pages/").format(source="pages")
CONV_LINES = _lines_sql("lines", "id", "text", "conversations/").format(source="(SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, text FROM conversations)")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(p: str) -> str:
    return _quoted(p.replace("(?iu)", "(?i)"))


_RULE, _ALLOW = _re2(C.ASSIGNMENT_RULE), _re2(C.KEY_SHAPE_ALLOWLIST)
_KEYWORD = "(" + " OR ".join(f"contains(lower(text), {_quoted(k)})" for k in C.ASSIGNMENT_KEYWORDS) + ")"
MATCHES = f"""
    allm AS (SELECT request_id, path, line, unnest(regexp_extract_all(text, {_RULE}, 0)) AS whole, unnest(regexp_extract_all(text, {_RULE}, 2)) AS match FROM lines WHERE {_KEYWORD}),
    m AS (SELECT * FROM allm WHERE NOT regexp_matches(whole, {_ALLOW}))"""
_ID = "substr(sha256(path || ':' || line::VARCHAR || ':' || match), 1, 12)"
DEDUP = f"""
    f AS (SELECT request_id, path, line, match, count(*) AS n, {_ID} AS id FROM m GROUP BY ALL)"""
_SENTINEL = "CASE " + " ".join(f"WHEN match = {_quoted(k)} THEN {_quoted(v)}" for k, v in C.SENTINELS.items()) + " " + " ".join(f"WHEN starts_with(match, {_quoted(p)}) THEN {_quoted(C.SENTINEL_PREFIX_REASON + p)}" for p in C.SENTINEL_PREFIXES) + " END"
_URL_RE = _quoted(T.URL)
_DSN_RE = _quoted(C.MYSQL_DSN)


def _within(x: str, side: str) -> str:
    """The longest head or tail of whole characters in four bytes."""
    return "CASE " + " ".join(f"WHEN strlen({side}({x}, {k})) <= 4 THEN {side}({x}, {k})" for k in (4, 3, 2, 1)) + " END"


def _preview_sql(x: str) -> str:
    """A cut character shows as U+FFFD, and at the tail once for each of its bytes."""
    head, tail = f"({_within(x, 'left')} || CASE WHEN strlen({_within(x, 'left')}) < 4 THEN chr(65533) ELSE '' END)", f"(repeat(chr(65533), 4 - strlen({_within(x, 'right')})) || {_within(x, 'right')})"
    return f"""CASE WHEN {x} = '' THEN '' WHEN regexp_matches({x}, {_URL_RE}) THEN regexp_extract({x}, {_URL_RE}, 1) || '://****:****@' || regexp_extract({x}, {_URL_RE}, 3) || regexp_extract({x}, {_URL_RE}, 4) || regexp_extract({x}, {_URL_RE}, 5)
      WHEN regexp_matches({x}, {_DSN_RE}) THEN '****:****@' || regexp_extract({x}, {_DSN_RE}, 3) WHEN strlen({x}) <= 8 THEN '****' ELSE {head} || '****' || {tail} END"""


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, line, part, v: every line of the documents, and its last word."""
    lines = document_lines(spark, sf_dir).select("request_id", "line", "text")
    parts = F.array(F.struct(F.lit("line").alias("part"), F.col("text").alias("v")), F.struct(F.lit("word").alias("part"), F.regexp_extract("text", "[^ ]+$", 0).alias("v")))
    return lines.select("request_id", "line", F.explode(parts).alias("p")).select("request_id", "line", "p.*")


VALUES = f"{DOC_LINES}, p AS (SELECT request_id, line, 'line' AS part, text AS v FROM lines UNION ALL SELECT request_id, line, 'word', regexp_extract(text, '[^ ]+$') FROM lines)"
KEY = ["request_id", "line", "part"]
_SPACE = "(" + " || ".join(f"chr({c})" for c in [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]) + ")"
_TRIM = lambda x: f"trim({x}, {_SPACE})"
_NORM = lambda x: _TRIM(f"""regexp_replace(regexp_replace({_TRIM(x)}, '[,;]+$', ''), '^(?s:"(.*)"|''(.*)''|`(.*)`)$', '\\1\\2\\3')""")
_REST = lambda x: f"substr({x}, strpos({x}, '://') + 3)"
_HASCRED = lambda x: f"(strpos({x}, '://') > 0 AND strpos({_REST(x)}, '@') > 0 AND contains(string_split({_REST(x)}, '@')[1], ':'))"
_PW = lambda x: f"substr(string_split({_REST(x)}, '@')[1], strpos(string_split({_REST(x)}, '@')[1], ':') + 1)"
_ISREF = lambda x: "(" + " OR ".join([f"regexp_matches({_NORM(x)}, {_quoted(C.BASIC_AUTH_REFERENCE)})", f"starts_with({x}, '$')", f"contains({x}, '${{')", f"regexp_matches({x}, {_quoted(C.COMMAND_SUBSTITUTION)})", f"(regexp_matches({x}, {_quoted(C.CALL_SHAPE)}) AND suffix({_TRIM(x)}, ')'))", *[f"starts_with({x}, {_quoted(p)})" for p in C.REFERENCE_PREFIXES]]) + ")"
_SHAPE = _quoted(C.ASSIGNMENT_SHAPE)
_AVAL = lambda x: _NORM(f"regexp_extract({x}, {_SHAPE}, 2)")
_ISASSIGN = lambda x: f"(regexp_matches({x}, {_SHAPE}) AND {_AVAL(x)} <> '')"


def _placeholder_sql(x: str) -> str:
    return "(" + " OR ".join(
        [
            f"{x} = ''", f"lower({x}) IN ({', '.join(map(_quoted, C.PLACEHOLDER_WORDS))})", f"(starts_with({x}, '<') AND suffix({x}, '>'))", f"(starts_with({x}, '{{{{') AND suffix({x}, '}}}}'))",
            f"(starts_with({x}, '%') AND suffix({x}, '%') AND strlen({x}) > 2)", *[f"starts_with(lower({x}), {_quoted(p)})" for p in C.PLACEHOLDER_PREFIXES], *[f"contains(lower({x}), {_quoted(p)})" for p in C.PLACEHOLDER_PARTS],
            f"(length({x}) >= 4 AND replace({x}, left({x}, 1), '') = '')",
        ]
    ) + ")"


# --- lines, rules, findings -------------------------------------------------------------------------------------------


@query(f"WITH {DOC_LINES}, {MATCHES}, {DEDUP} SELECT source, count(DISTINCT doc_id) AS n_documents, count(id) AS n_findings, count(DISTINCT path) AS n_files, count(*) FILTER (id IS NOT NULL AND {_SENTINEL} IS NOT NULL) AS n_dismissed, min(CASE WHEN id IS NOT NULL THEN {_preview_sql('match')} END) AS first_preview FROM documents LEFT JOIN f ON request_id = doc_id::VARCHAR GROUP BY source")
def leaks_by_source(spark, sf_dir):
    """Which sources leak which redacted secrets, and how many of their documents there are: the flagship."""
    found = detect.short_circuit(findings(spark, sf_dir)).withColumn("shown", T.preview(F.col("match")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("request_id"), "source")
    by_file = found.groupBy("request_id").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "dismissed").alias("d"), F.min("shown").alias("shown"))
    return docs.join(by_file, "request_id", "left").groupBy("source").agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.count("n").alias("n_files"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_dismissed"), F.min("shown").alias("first_preview")
    )


@query(f"WITH {DOC_LINES} SELECT request_id, count(*) AS n_lines, sum(strlen(text))::BIGINT AS n_bytes, max(line) AS last_line FROM lines GROUP BY request_id")
def scan_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"), F.max("line").alias("last_line"))


def _match_rows(lines):
    return detect.raw_matches(lines, detect.GENERIC).select("request_id", "path", "line", "whole", "match")


@query(f"WITH {DOC_LINES}, {MATCHES} SELECT * FROM m")
def rule_match_documents(spark, sf_dir):
    return _match_rows(document_lines(spark, sf_dir))


@query(f"WITH {PAGE_LINES}, {MATCHES} SELECT * FROM m")
def rule_match_pages(spark, sf_dir):
    return _match_rows(page_lines(spark, sf_dir))


@query(f"WITH {CONV_LINES}, {MATCHES} SELECT count(*) AS n, count(DISTINCT match) AS n_values FROM m")
def rule_match_conversations(spark, sf_dir):
    return _match_rows(conversation_lines(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_distinct("match").alias("n_values"))


@query(f"WITH {DOC_LINES} SELECT count(*) AS lines, count(*) FILTER ({_KEYWORD}) AS with_keyword, count(*) FILTER (regexp_matches(text, {_RULE})) AS matching, count(*) FILTER (regexp_matches(text, {_RULE}) AND NOT {_KEYWORD}) AS missed FROM lines")
def keyword_prefilter_equiv(spark, sf_dir):
    """The keyword test before the pattern loses no match."""
    t, hit = F.col("text"), F.col("text").rlike(C.ASSIGNMENT_RULE)
    k = detect.has_keyword(t, detect.GENERIC)
    return document_lines(spark, sf_dir).agg(F.count("*").alias("lines"), F.count_if(k).alias("with_keyword"), F.count_if(hit).alias("matching"), F.count_if(hit & ~k).alias("missed"))


_ALL_LINES = "lines AS (SELECT * FROM d UNION ALL SELECT * FROM g UNION ALL SELECT * FROM c)"


@query(f"WITH {DOC_LINES.replace('lines AS', 'd AS', 1)}, {PAGE_LINES.replace('lines AS', 'g AS', 1)}, {CONV_LINES.replace('lines AS', 'c AS', 1)}, {_ALL_LINES}, {MATCHES} SELECT path, line, whole, match, regexp_matches(whole, {_ALLOW}) AS allowed FROM allm")
def key_shape_allowlist(spark, sf_dir):
    """The rule's matches in all texts, with those that name a file or a path."""
    lines = document_lines(spark, sf_dir).unionByName(page_lines(spark, sf_dir)).unionByName(conversation_lines(spark, sf_dir))
    return detect.raw_matches(lines, detect.GENERIC, allowlist=False).select("path", "line", "whole", "match", detect.allowed(F.col("whole"), detect.GENERIC).alias("allowed"))


@query("SELECT event_id, substr(sha256('events/' || event_type || ':' || user_id::VARCHAR || ':' || coalesce(props, '')), 1, 12) AS id FROM events")
def finding_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.finding_id(F.concat(F.lit("events/"), F.col("event_type")), F.col("user_id"), F.coalesce("props", F.lit(""))).alias("id"))


def two_detectors(spark, sf_dir):
    """The rule's findings and, for every second document, a verified one of another detector."""
    a = detect.rule_findings(document_lines(spark, sf_dir))
    b = a.where("cast(request_id AS bigint) % 2 = 0").select("request_id", F.lit("subprocess").alias("detector_type"), F.lit("external").alias("detector_name"), F.lit("Any").alias("rule"), "path", "line", "match", F.lit(True).alias("verified"))
    return detect.union_findings(a, b, b)


_TWO = f"two AS (SELECT request_id, 'in_process' AS t, 'rules' AS d, '{C.ASSIGNMENT_RULE_ID}' AS r, path, line, match, false AS v FROM m UNION ALL SELECT request_id, 'subprocess', 'external', 'Any', path, line, match, true FROM m, (SELECT unnest([1, 2])) WHERE request_id::BIGINT % 2 = 0)"


@query(f"WITH {DOC_LINES}, {MATCHES}, {_TWO} SELECT {_ID} AS id, path, line, string_agg(t || '/' || d || '/' || r || '/' || v::VARCHAR, ',' ORDER BY t, d, r, v) AS detections, bool_or(v) AS any_verified FROM two GROUP BY path, line, match")
def dedup_findings(spark, sf_dir):
    trail = F.transform("detections", lambda d: F.concat_ws("/", d["detector_type"], d["detector_name"], d["rule"], d["verified"].cast("string")))
    return detect.dedup(two_detectors(spark, sf_dir)).select("id", "path", "line", F.concat_ws(",", trail).alias("detections"), "any_verified")


@query(f"WITH {DOC_LINES}, {MATCHES}, {_TWO}, b AS (SELECT DISTINCT path, line, match FROM m WHERE request_id::BIGINT % 3 = 0) SELECT d, count(*) AS n FROM two ANTI JOIN b USING (path, line, match) GROUP BY d")
def baseline_subtract(spark, sf_dir):
    all_ = two_detectors(spark, sf_dir)
    known = all_.where("cast(request_id AS bigint) % 3 = 0").select("path", "line", "rule", "match")
    return detect.subtract_baseline(all_, known).groupBy(F.col("detector_name").alias("d")).agg(F.count("*").alias("n"))


@query(f"WITH {VALUES}, q AS (SELECT request_id, line, part, v AS match, line % 7 = 0 AS any_verified FROM p) SELECT request_id, line, part, CASE WHEN any_verified THEN 'confirmed' WHEN {_SENTINEL} IS NOT NULL THEN 'dismissed' END AS verdict, CASE WHEN any_verified THEN {_quoted(C.VERIFIED_REASON)} ELSE {_SENTINEL} END AS reason FROM q")
def sentinel_short_circuit(spark, sf_dir):
    x = line_values(spark, sf_dir).select(*KEY, F.col("v").alias("match"), (F.col("line") % 7 == 0).alias("any_verified"))
    return detect.short_circuit(x).select(*KEY, "verdict", "reason")


# --- redaction and predicates -----------------------------------------------------------------------------------------


@query(f"WITH {VALUES} SELECT request_id, line, part, {_preview_sql('v')} AS shown FROM p")
def redact_preview(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, T.preview(F.col("v")).alias("shown"))


_INFO = f"CASE WHEN regexp_matches(v, {_URL_RE}) THEN regexp_extract(v, {_URL_RE}, 2) WHEN regexp_matches(v, {_DSN_RE}) THEN regexp_extract(v, {_DSN_RE}, 1) || ':' || regexp_extract(v, {_DSN_RE}, 2) ELSE '' END"


@query(f"""WITH {VALUES}, q AS (SELECT request_id, line, part, v, {_INFO} AS i, 'value ' || v || ' was found; user ' || string_split(v, ':')[1] || ' said p4ssw0rd and s3cret' AS t FROM p),
r AS (SELECT *, string_split(i, ':')[1] AS u, CASE WHEN contains(i, ':') THEN substr(i, strpos(i, ':') + 1) ELSE '' END AS w FROM q),
s AS (SELECT *, CASE WHEN strlen(w) > strlen(u) THEN w ELSE u END AS a, CASE WHEN strlen(w) > strlen(u) THEN u ELSE w END AS b, CASE WHEN v = '' THEN t ELSE replace(t, v, {_preview_sql('v')}) END AS x FROM r),
y AS (SELECT *, CASE WHEN v = '' OR a = '' THEN x ELSE replace(x, a, '****') END AS z FROM s)
SELECT request_id, line, part, CASE WHEN v = '' OR b = '' THEN z ELSE replace(z, b, '****') END AS reason FROM y""")
def scrub_reason(spark, sf_dir):
    v = F.col("v")
    text = F.concat(F.lit("value "), v, F.lit(" was found; user "), F.get(F.split(v, ":"), F.lit(0)), F.lit(" said p4ssw0rd and s3cret"))
    return line_values(spark, sf_dir).select(*KEY, T.scrub(text, v).alias("reason"))


@query(f"WITH {VALUES}, q AS (SELECT request_id, line, part, {_TRIM('v')} AS v FROM p) SELECT request_id, line, part, CASE WHEN {_HASCRED('v')} THEN {_placeholder_sql(_PW('v'))} ELSE {_placeholder_sql('v')} END AS placeholder FROM q")
def placeholder_filter(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, P.is_placeholder(F.col("v")).alias("placeholder"))


@query(f"WITH {VALUES} SELECT request_id, line, part, {_ISREF('v')} AS reference FROM p")
def reference_filter(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, P.is_reference(F.col("v")).alias("reference"))


@query(f"WITH {VALUES} SELECT request_id, line, part, CASE WHEN {_ISASSIGN('v')} THEN regexp_extract(v, {_SHAPE}, 1) END AS key, CASE WHEN {_ISASSIGN('v')} THEN {_AVAL('v')} END AS value FROM p")
def assignment_split(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, P.assignment_key(F.col("v")).alias("key"), P.assignment_value(F.col("v")).alias("value"))


_SUFFIXES = "[" + ", ".join(map(_quoted, C.NON_SECRET_SUFFIXES)) + "]"


_WORD_KEY = "[A-Za-z_][A-Za-z0-9_.-]*"


@query(f"WITH {VALUES}, q AS (SELECT *, regexp_extract(v, '{_WORD_KEY}') AS k FROM p), r AS (SELECT *, upper(replace(replace(k, '-', '_'), '.', '_')) AS u FROM q) SELECT request_id, line, part, k AS key, {_HASCRED('v')} OR len(list_filter({_SUFFIXES}, lambda s: u = s OR suffix(u, '_' || s))) = 0 AS secret_key FROM r")
def secret_key_filter(spark, sf_dir):
    """The first word of each value as the key of an assignment to the value."""
    x = line_values(spark, sf_dir).withColumn("key", F.regexp_extract("v", _WORD_KEY, 0))
    return x.select(*KEY, "key", P.is_secret_key(F.col("key"), F.col("v")).alias("secret_key"))


@query(f"WITH {VALUES} SELECT request_id, line, part, NOT ({_HASCRED('v')} OR contains(v, '-----BEGIN')) AND (contains(v, '\\n') OR contains(v, '\\r') OR contains(v, '\\t') OR regexp_matches(v, {_quoted(C.HTML_ELEMENT)})) AS formatting FROM p")
def formatting_filter(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, P.is_formatting_text(F.col("v")).alias("formatting"))


@query(f"WITH {VALUES}, q AS (SELECT request_id, line, part, list_filter(list_transform(string_split('x' || chr(10) || '  ' || v || chr(10) || 'y', chr(10)), lambda s: {_TRIM('s')}), lambda s: list_contains([{', '.join(map(_quoted, C.PRIVATE_KEY_HEADERS))}], s)) AS h FROM p) SELECT request_id, line, part, coalesce(h[1], '') AS header FROM q")
def pem_header(spark, sf_dir):
    return line_values(spark, sf_dir).select(*KEY, P.pem_header(F.concat(F.lit("x\n  "), F.col("v"), F.lit("\ny"))).alias("header"))


@query("SELECT doc_id, (strlen(text) + 2) // 3 AS tokens, CASE WHEN strlen(lang) <= 1 THEN lang ELSE left(lang, 1) END AS head FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents)")
def token_estimate(spark, sf_dir):
    t, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(t).alias("tokens"), T.clamp(lang, 1).alias("head"))


@query("SELECT page_id, CASE WHEN strlen(url) <= 24 THEN url ELSE left(url, 10) || '…[truncated]' END AS head, CASE WHEN strlen(url) <= 20 THEN url ELSE left(url, 3) || '…[truncated]' || right(url, 3) END AS middle FROM pages")
def clamp_fields(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.clamp(F.col("url"), 24).alias("head"), T.clamp_middle(F.col("url"), 20).alias("middle"))


# --- diffs ------------------------------------------------------------------------------------------------------------


def synthetic_diffs(spark, sf_dir):
    """Each document as a diff that adds its lines after one line of context, removing one between."""
    lines = diff.split_lines(F.coalesce("text", F.lit("")))
    body = F.concat_ws("\n", F.transform(lines, lambda x: F.concat(F.lit("+"), x)))
    id_ = F.col("doc_id").cast("string")
    head = F.concat(F.lit("diff --git a/d/"), id_, F.lit(" b/d/"), id_, F.lit("\n--- a/d/"), id_, F.lit("\n+++ b/d/"), id_, F.lit("\n@@ -1,2 +1,"), (F.size(lines) + 1).cast("string"), F.lit(" @@\n context\n-gone\n"))
    return table(spark, sf_dir, "documents").select(id_.alias("request_id"), F.concat(head, body, F.lit("\n")).alias("diff"))


@query(f"WITH {DOC_LINES} SELECT request_id, 'd/' || request_id AS path, line + 1 AS line, text FROM lines WHERE NOT starts_with(text, '++ ')")
def diff_roundtrip(spark, sf_dir):
    """Lines that the diff scanner finds are the documents' own, one number on."""
    return diff.added_lines(diff.diff_lines(synthetic_diffs(spark, sf_dir))).select("request_id", "path", "line", "text")


_MARKED = f"{DOC_LINES}, k AS (SELECT *, starts_with(text, '++ ') AS head, count(*) FILTER (starts_with(text, '++ ')) OVER (PARTITION BY request_id ORDER BY line) AS seg FROM lines)"


@query(f"WITH {_MARKED}, n AS (SELECT request_id, count(*) AS n, count(*) FILTER (NOT head) AS plain FROM k GROUP BY 1) SELECT doc_id::VARCHAR AS request_id, 1::BIGINT AS hunk, 2::BIGINT AS old_lines, 1 + coalesce(plain, 0) AS new_lines, coalesce(n, 0) = coalesce(plain, 0) AS ok FROM documents LEFT JOIN n ON request_id = doc_id::VARCHAR")
def hunk_validate(spark, sf_dir):
    """A line ``++ `` is read as a file's header when it is added, so its hunk falls short."""
    return diff.hunk_check(diff.diff_lines(synthetic_diffs(spark, sf_dir)))


@query(f"""WITH {_MARKED}, x AS (SELECT *, 1 + count(*) FILTER (NOT head) OVER (PARTITION BY request_id ORDER BY line) AS place FROM k),
h AS (SELECT request_id, seg, CASE WHEN trim(substr(text, 4)) = '/dev/null' THEN '' ELSE regexp_replace(trim(substr(text, 4)), '^b/', '') END AS path FROM x WHERE head)
SELECT x.request_id, CASE WHEN x.seg = 0 THEN 'd/' || x.request_id ELSE h.path END AS path, min(place) AS first_line, count(*) AS n, sum(strlen(text))::BIGINT + count(*) - 1 AS n_bytes
FROM x LEFT JOIN h ON h.request_id = x.request_id AND h.seg = x.seg WHERE NOT head AND (x.seg = 0 OR h.path <> '') GROUP BY x.request_id, x.seg, h.path""")
def added_blocks(spark, sf_dir):
    b = diff.added_blocks(diff.diff_lines(synthetic_diffs(spark, sf_dir)))
    return b.select("request_id", "path", F.col("start_line").cast("long").alias("first_line"), F.size(F.split("content", "\n", -1)).cast("long").alias("n"), F.octet_length("content").cast("long").alias("n_bytes"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOC_LINES}, n AS (SELECT request_id, 1 AS needle_id, regexp_extract(text, '[^ ]+$') AS needle FROM lines QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY line DESC) = 1),
h AS (SELECT n.request_id, min(l.line) AS line FROM n JOIN lines l ON n.request_id = l.request_id AND needle <> '' AND contains(l.text, needle) GROUP BY ALL)
SELECT request_id, needle, CASE WHEN h.line IS NULL THEN '' ELSE 'documents/' || request_id END AS path, coalesce(h.line, 0) AS line FROM n LEFT JOIN h USING (request_id)""")
def locate_first(spark, sf_dir):
    """The first line that holds the last word of each document."""
    lines = document_lines(spark, sf_dir).withColumn("ord", F.col("line"))
    needles = lines.groupBy("request_id").agg(F.max_by("text", "line").alias("text")).select("request_id", F.lit(1).alias("needle_id"), F.regexp_extract("text", "[^ ]+$", 0).alias("needle"))
    return locate.locate(needles, lines).select("request_id", "needle", "path", "line")


@query(f"""WITH {DOC_LINES}, {MATCHES}, {DEDUP},
c AS (SELECT f.id, string_agg((CASE WHEN l.line = f.line THEN '>' ELSE ' ' END) || ' ' || lpad(l.line::VARCHAR, greatest(length((f.line + 3)::VARCHAR), length(l.line::VARCHAR))::INT, ' ') || ': ' || l.text, chr(10) ORDER BY l.line) AS context
  FROM f JOIN lines l ON l.request_id = f.request_id AND l.path = f.path AND l.line BETWEEN f.line - 3 AND f.line + 3 GROUP BY f.id)
SELECT id, sha256(context) AS digest FROM c""")
def context_window_join(spark, sf_dir):
    return locate.with_context(findings(spark, sf_dir), document_lines(spark, sf_dir)).select("id", F.sha2("context", 256).alias("digest"))


@query(f"WITH {DOC_LINES}, {MATCHES}, {DEDUP}, c AS (SELECT request_id, path, line, left(match, 10) AS match FROM f UNION ALL SELECT request_id, path, line + 1, match FROM f UNION ALL SELECT request_id, path, line, 'unrelated' FROM f) SELECT c.path, c.line, length(c.match) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.request_id = c.request_id AND f.path = c.path AND f.line = c.line AND (contains(c.match, f.match) OR contains(f.match, c.match)))")
def collision_anti_join(spark, sf_dir):
    f = findings(spark, sf_dir).select("request_id", "path", "line", "match")
    c = f.withColumn("match", F.substring("match", 1, 10)).unionByName(f.withColumn("line", F.col("line") + 1)).unionByName(f.withColumn("match", F.lit("unrelated")))
    return locate.without_collisions(c, f).select("path", "line", F.length("match").cast("long").alias("n"))


def answered(spark, sf_dir):
    """Orders as findings and their lines as a model's answers in order: some repeated, some with an unknown verdict, some missing.

    Of answers alike in number and part, which the SQL's order leaves open, the last in the file counts, in every run.
    """
    f = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("request_id"), F.col("o_orderkey").cast("string").alias("id"))
    kind = F.get(F.array(*[F.lit(x) for x in ("confirmed", "dismissed", "unsure")]), (F.col("l_partkey") % 3).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("request_id"))
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("*", F.col("_metadata.row_index").alias("row")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return f, v.select("request_id", F.col("l_orderkey").cast("string").alias("finding_id"), kind.alias("verdict"), (F.col("l_quantity") / 100).alias("confidence"), F.col("l_returnflag").alias("reason"), F.struct("l_linenumber", "l_partkey", "row", "l_quantity").alias("ord"))


_ANSWERED = """v AS (SELECT l_orderkey AS k, (['confirmed', 'dismissed', 'unsure'])[l_partkey % 3 + 1] AS verdict, l_quantity / 100 AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem),
    g AS (SELECT o_custkey::VARCHAR AS request_id, o_orderkey::VARCHAR AS id, CASE WHEN verdict IN ('confirmed', 'dismissed') THEN verdict ELSE 'unreviewed' END AS verdict, CASE WHEN verdict IN ('confirmed', 'dismissed') THEN confidence ELSE 0 END AS confidence FROM orders LEFT JOIN (SELECT * FROM v WHERE rn = 1) v ON o_orderkey = k)"""


@query(f"WITH {_ANSWERED} SELECT * FROM g")
def verdict_gap_fill(spark, sf_dir):
    return locate.fill_gaps(*answered(spark, sf_dir)).select("request_id", "id", "verdict", "confidence")


@query(f"WITH {_ANSWERED} SELECT request_id, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'dismissed') AS dismissed, count(*) FILTER (verdict = 'unreviewed') AS unreviewed FROM g GROUP BY request_id")
def verdict_counts(spark, sf_dir):
    return stats.verdict_counts(locate.fill_gaps(*answered(spark, sf_dir)), "request_id")


def order_findings(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(F.col("l_suppkey").cast("string").alias("request_id"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").cast("int").alias("line"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_returnflag")).alias("match"))


_ORDERF = "x AS (SELECT l_suppkey::VARCHAR AS request_id, 'p/' || l_partkey::VARCHAR AS path, l_linenumber::INT AS line, l_orderkey::VARCHAR || '/' || l_returnflag AS match FROM lineitem)"


@query(f"WITH {_ORDERF}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY path, line, match) AS rank FROM x) SELECT request_id, path, line, match FROM r WHERE rank <= 20")
def topn_truncate(spark, sf_dir):
    return detect.truncated(order_findings(spark, sf_dir), 20).where("NOT cut").select("request_id", "path", "line", "match")


@query("WITH d AS (SELECT doc_id % 20 AS g, doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, 1 + doc_id % 4 AS n FROM d), c AS (SELECT d.doc_id, (strlen(text) + 2) // 3 + (n * (200 + 5 + 2) + 2) // 3 AS estimate, n FROM d JOIN f USING (doc_id)) SELECT doc_id::VARCHAR AS request_id, estimate::BIGINT AS estimate, CASE WHEN estimate <= (2000 - 500) * 9 // 10 AND n <= 3 THEN 'single' ELSE 'batched' END AS mode FROM c")
def token_budget_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), F.coalesce("text", F.lit("")).alias("diff"), F.col("doc_id"))
    f = d.select("request_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("i")).select("request_id", F.lit("12345").alias("match"), F.lit("ab").alias("path"))
    return packing.call_mode(f, d, 2000, 500, 3)


_COST = lambda x: f"(strlen({x}) + 2) // 3"


@query(f"""WITH RECURSIVE {_ORDERF}, t AS (SELECT request_id, {_COST("'finding_id=' || repeat('i', 12) || ' file=' || path || ' line=' || line::VARCHAR || chr(10) || 'match: ' || match || chr(10) || repeat('c', line * 20) || chr(10)")} AS tokens,
    row_number() OVER (PARTITION BY request_id ORDER BY path, line, match) AS k FROM x),
b AS (SELECT request_id, k, tokens, tokens AS spent, 1 AS held, 0 AS batch_id FROM t WHERE k = 1
  UNION ALL SELECT t.request_id, t.k, t.tokens, CASE WHEN b.spent + t.tokens > 1800 THEN t.tokens ELSE b.spent + t.tokens END, CASE WHEN b.spent + t.tokens > 1800 OR b.held = 12 THEN 1 ELSE b.held + 1 END,
    b.batch_id + CASE WHEN b.spent + t.tokens > 1800 OR b.held = 12 THEN 1 ELSE 0 END FROM b JOIN t ON t.request_id = b.request_id AND t.k = b.k + 1)
SELECT request_id, batch_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM b GROUP BY ALL""")
def pack_batches(spark, sf_dir):
    """Greedy batches of findings within a budget: a sum that resets."""
    x = order_findings(spark, sf_dir).withColumn("id", T.finding_id(F.col("path"), F.col("line"), F.col("match"))).withColumn("context", F.repeat(F.lit("c"), F.col("line") * 20))
    return packing.pack_findings(x, 3000, 1000, 12).groupBy("request_id", "batch_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


_HEAD_COST = _COST("'=== ' || path || chr(10)")


@query(f"""WITH RECURSIVE {_MARKED}, h AS (SELECT request_id, seg, CASE WHEN trim(substr(text, 4)) = '/dev/null' THEN '' ELSE regexp_replace(trim(substr(text, 4)), '^b/', '') END AS path FROM k WHERE head),
x AS (SELECT k.request_id, k.seg, k.line, k.text, CASE WHEN k.seg = 0 THEN 'd/' || k.request_id ELSE h.path END AS path FROM k LEFT JOIN h ON h.request_id = k.request_id AND h.seg = k.seg WHERE NOT head),
s AS (SELECT *, {_HEAD_COST} AS hc, {_COST("text")} + 1 AS c, row_number() OVER w AS n, (sum(strlen(text) + 1) OVER (PARTITION BY request_id, seg) + strlen('=== ' || path || chr(10)) + 2) // 3 <= 512 AS fits FROM x WHERE path <> '' WINDOW w AS (PARTITION BY request_id, seg ORDER BY line)),
p AS (SELECT request_id, seg, n, c::BIGINT AS spent, 0 AS part FROM s WHERE n = 1
  UNION ALL SELECT s.request_id, s.seg, s.n, CASE WHEN NOT fits AND p.spent + c > 512 - hc THEN c ELSE p.spent + c END, p.part + CASE WHEN NOT fits AND p.spent + c > 512 - hc THEN 1 ELSE 0 END FROM p JOIN s ON s.request_id = p.request_id AND s.seg = p.seg AND s.n = p.n + 1),
q AS (SELECT request_id, seg, part, any_value(path) AS path, sum(strlen(text) + 1)::BIGINT + any_value(strlen('=== ' || path || chr(10))) AS n_bytes FROM p JOIN s USING (request_id, seg, n) GROUP BY ALL),
r AS (SELECT *, (n_bytes + 2) // 3 AS c, coalesce(path <> lag(path) OVER w, true) AS other, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY request_id ORDER BY seg, part)),
v AS (SELECT request_id, k, n_bytes, c::BIGINT AS spent, 0 AS window_ix FROM r WHERE k = 1
  UNION ALL SELECT r.request_id, r.k, r.n_bytes, CASE WHEN other OR v.spent + c > 512 THEN c ELSE v.spent + c END, v.window_ix + CASE WHEN other OR v.spent + c > 512 THEN 1 ELSE 0 END FROM v JOIN r ON r.request_id = v.request_id AND r.k = v.k + 1),
z AS (SELECT request_id, window_ix, sum(n_bytes)::BIGINT AS n_bytes, count(*) OVER (PARTITION BY request_id) > 48 AS truncated FROM v GROUP BY request_id, window_ix)
SELECT * FROM z WHERE window_ix < 48""")
def deep_windows(spark, sf_dir):
    blocks = diff.added_blocks(diff.diff_lines(synthetic_diffs(spark, sf_dir)))
    return packing.deep_windows(blocks, 512).select("request_id", "window_ix", F.octet_length("window").cast("long").alias("n_bytes"), "truncated")


@query(f"WITH {DOC_LINES}, {MATCHES}, {DEDUP}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY path, line, match) AS rank, {_SENTINEL} AS why FROM f) SELECT request_id, id, CASE WHEN rank <= 200 AND why IS NOT NULL THEN 'dismissed' ELSE 'confirmed' END AS verdict, CASE WHEN rank > 200 THEN 0 WHEN why IS NOT NULL THEN 1 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN rank > 200 THEN {_quoted(C.UNSEEN_REASON)} ELSE coalesce(why, 'stub') END AS reason FROM r")
def adjudicate_stub(spark, sf_dir):
    """The whole adjudication with an offline scorer, which confirms every id it is shown."""
    import re

    def scorer(prompt: str) -> str:
        ids = re.findall(r"finding_id=([0-9a-f]{12}) ", prompt)
        return '{"verdicts": [' + ", ".join(f'{{"finding_id": "{i}", "verdict": "confirmed", "confidence": 0.9, "reason": "stub"}}' for i in ids) + "]}"

    f = locate.with_context(findings(spark, sf_dir), document_lines(spark, sf_dir))
    return adjudicate.adjudicate(f, scorer).select("request_id", "id", "verdict", "confidence", "reason")


_PEM = lambda x: f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {_TRIM('s')}), lambda s: list_contains([{', '.join(map(_quoted, C.PRIVATE_KEY_HEADERS))}], s))[1], '')"
_FILLER = lambda x: f"(CASE WHEN {_HASCRED(_TRIM(x))} THEN {_placeholder_sql(_TRIM(_PW(_TRIM(x))))} ELSE {_placeholder_sql(_TRIM(x))} END)"
_FORMAT = lambda x: f"(NOT ({_HASCRED(x)} OR contains({x}, '-----BEGIN')) AND (contains({x}, '\\n') OR contains({x}, '\\r') OR contains({x}, '\\t') OR regexp_matches({x}, {_quoted(C.HTML_ELEMENT)})))"
#: Claims: the last words of each document's first and last lines, every match of the rule, and every line with one.
_CLAIMS = f"""{DOC_LINES}, {MATCHES}, {DEDUP},
    claims AS (SELECT request_id, 1 AS src, line, regexp_extract(text, '[^ ]+$') AS value FROM lines WHERE line = 1
      UNION ALL (SELECT request_id, 2, line, regexp_extract(text, '[^ ]+$') FROM lines QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY line DESC) = 1)
      UNION ALL SELECT DISTINCT request_id, 3, line, match FROM m UNION ALL SELECT DISTINCT l.request_id, 4, l.line, l.text FROM lines l SEMI JOIN m USING (request_id, line)),
    n AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY src, line, value) AS cand_ix, value, {_TRIM('value')} AS needle FROM claims),
    a AS (SELECT *, CASE WHEN {_ISASSIGN('needle')} THEN regexp_extract(needle, {_SHAPE}, 1) END AS k, CASE WHEN {_ISASSIGN('needle')} THEN {_AVAL('needle')} END AS v FROM n),
    tries AS (SELECT request_id, cand_ix, 1 AS form, needle AS x FROM a UNION ALL SELECT request_id, cand_ix, 2, {_NORM('needle')} FROM a WHERE strlen({_NORM('needle')}) >= 6
      UNION ALL SELECT request_id, cand_ix, 3, v FROM a WHERE v IS NOT NULL UNION ALL SELECT request_id, cand_ix, 4, {_NORM('v')} FROM a WHERE v IS NOT NULL AND strlen({_NORM('v')}) >= 6),
    hits AS (SELECT t.request_id, cand_ix, form, x, min(l.line) AS line FROM tries t JOIN lines l ON l.request_id = t.request_id AND x <> '' AND contains(l.text, x) GROUP BY ALL),
    spot AS (SELECT request_id, cand_ix, x, line, form FROM hits QUALIFY row_number() OVER (PARTITION BY request_id, cand_ix ORDER BY form) = 1),
    t AS (SELECT a.*, spot.form, coalesce(spot.line, 0) AS line, CASE WHEN spot.line IS NULL THEN '' ELSE 'documents/' || a.request_id END AS path, coalesce(v, spot.x, '') AS match, coalesce(l.text, '') AS text
      FROM a LEFT JOIN spot USING (request_id, cand_ix) LEFT JOIN lines l ON l.request_id = a.request_id AND l.line = spot.line),
    lit AS (SELECT *, string_split(text, needle)[1] AS before FROM t),
    opened AS (SELECT *, regexp_replace(before, '(?s)^(?:[^"'']|"(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*'')*', '') AS o FROM lit),
    quoted AS (SELECT *, left(o, 1) AS q, substr(o, 2) || needle || string_split(substr(text, length(before) + length(needle) + 1), left(o, 1))[1] AS literal FROM opened),
    rescue AS (SELECT *, form = 1 AND regexp_matches(needle, {_quoted(C.CALL_SHAPE)}) AND suffix(needle, ')') AND NOT ({' OR '.join(f"starts_with(needle, {_quoted(x)})" for x in C.REFERENCE_PREFIXES)}) AND NOT regexp_matches(literal, '[$\\\\{{}}]') AND o <> ''
      AND NOT contains(needle, q) AND contains(substr(text, length(before) + length(needle) + 1), q) AND (literal = needle OR strpos(literal, ':' || needle || '@') > 1) AS rescued FROM quoted),
    early AS (SELECT *, CASE WHEN ((contains(value, '-----BEGIN ') OR contains(value, '-----END ')) AND {_PEM('value')} = '') OR strlen(needle) < 6 OR ({_ISREF('needle')} AND NOT coalesce(rescued, false)) THEN 'invalid_or_reference'
        WHEN v IS NOT NULL AND (NOT ({_HASCRED('v')} OR len(list_filter({_SUFFIXES}, lambda s: upper(replace(replace(k, '-', '_'), '.', '_')) = s OR suffix(upper(replace(replace(k, '-', '_'), '.', '_')), '_' || s))) = 0) OR {_FILLER('v')} OR strlen(v) < 6) THEN 'non_secret_assignment'
        WHEN v IS NULL AND {_FILLER('needle')} THEN 'placeholder' WHEN v IS NULL AND {_FORMAT('needle')} THEN 'formatting_text' WHEN path = '' THEN 'not_found' WHEN {_SENTINEL} IS NOT NULL THEN 'sentinel'
        WHEN match <> '' AND contains(text, match) AND len(list_filter(range(1, length(text) - length(match) + 2), lambda i: substr(text, i, length(match)) = match AND NOT (i > 1 AND substr(text, i - 1, 1) = '$') AND NOT (i > 2 AND substr(text, i - 2, 2) = '${{'))) = 0 THEN 'reference' END AS early FROM rescue),
    cover AS (SELECT *, early IS NULL AND EXISTS (SELECT 1 FROM f WHERE f.request_id = early.request_id AND f.path = early.path AND f.line = early.line AND (contains(early.match, f.match) OR contains(f.match, early.match))) AS covered FROM early),
    nth AS (SELECT *, row_number() OVER (PARTITION BY request_id, path, line, match, early IS NULL ORDER BY covered, cand_ix) AS nth FROM cover)"""


@query(f"WITH {_CLAIMS} SELECT request_id, cand_ix, coalesce(early, CASE WHEN covered THEN 'detector_overlap' WHEN nth > 1 THEN 'duplicate' ELSE 'discovered' END) AS outcome, path, line, match FROM nth")
def ground_claims(spark, sf_dir):
    """Claims about the documents, traced: each has its place, or the reason why it has none."""
    lines = document_lines(spark, sf_dir).withColumn("ord", F.col("line"))
    word = F.regexp_extract("text", "[^ ]+$", 0).alias("value")
    ends = lines.groupBy("request_id").agg(F.max("line").alias("line"), F.max_by("text", "line").alias("text"))
    m = detect.raw_matches(lines, detect.GENERIC)
    claims = (
        lines.where("line = 1").select("request_id", F.lit(1).alias("src"), "line", word).unionByName(ends.select("request_id", F.lit(2).alias("src"), "line", word))
        .unionByName(m.select("request_id", F.lit(3).alias("src"), "line", F.col("match").alias("value")).distinct()).unionByName(m.select("request_id", F.lit(4).alias("src"), "line", F.col("text").alias("value")).distinct())
    )
    order = Window.partitionBy("request_id").orderBy("src", "line", "value")
    c = claims.select("request_id", F.row_number().over(order).alias("cand_ix"), "value", F.lit("credential").alias("kind"), F.lit(0.5).alias("confidence"), F.lit("").alias("reason"))
    return grounding.ground(c, lines, findings(spark, sf_dir)).select("request_id", F.col("cand_ix").cast("long").alias("cand_ix"), "outcome", "path", "line", "match")


@query("""WITH a AS (SELECT coalesce(strlen(text), 0) AS size, CASE doc_id % 5 WHEN 0 THEN 'bare' WHEN 1 THEN 'envelope' WHEN 2 THEN 'fenced' WHEN 3 THEN 'garbage' ELSE 'two' END AS shape FROM documents)
SELECT shape, count(*) AS answers, sum(CASE shape WHEN 'garbage' THEN 0 WHEN 'two' THEN 2 ELSE 1 END)::BIGINT AS verdicts, sum((shape = 'garbage')::INT)::BIGINT AS errors, sum(CASE shape WHEN 'garbage' THEN 0 WHEN 'two' THEN 2 * size ELSE size END)::BIGINT AS reason_bytes FROM a GROUP BY shape""")
def parse_answers(spark, sf_dir):
    """Answers in all shapes that give each document's whole text as their reason."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("finding_id"), F.lit("confirmed").alias("verdict"), F.lit(0.5).alias("confidence"), F.col("text").alias("reason")))
    bare, k = F.concat(F.lit("["), one, F.lit("]")), F.pmod("doc_id", F.lit(5))
    shapes = {
        "bare": bare, "envelope": F.concat(F.lit('{"verdicts": '), bare, F.lit("}")), "fenced": F.concat(F.lit("```json\n"), bare, F.lit("\n```")), "garbage": F.concat(F.lit("I think so: "), "text"),
        "two": F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")),
    }
    pick = F.get(F.array(*[F.struct(F.lit(name).alias("shape"), answer.alias("answer")) for name, answer in shapes.items()]), k.cast("int"))
    a = docs.select(F.col("doc_id").cast("string").alias("request_id"), F.lit(0).alias("batch_id"), pick.alias("p")).select("request_id", "batch_id", "p.*")
    parsed = adjudicate.parse_verdicts(a.drop("shape")).groupBy("request_id").agg(F.count_if(~F.col("error")).alias("n"), F.count_if("error").alias("e"), F.sum(F.coalesce(F.octet_length("reason"), F.lit(0))).alias("b"))
    return a.join(parsed, "request_id").groupBy("shape").agg(F.count("*").alias("answers"), F.sum("n").alias("verdicts"), F.sum("e").alias("errors"), F.sum("b").alias("reason_bytes"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query(f"WITH {DOC_LINES}, {MATCHES}, {DEDUP}, r AS (SELECT request_id, count(*) AS n FROM m GROUP BY 1), g AS (SELECT request_id, count(*) AS n FROM f GROUP BY 1) SELECT doc_id::VARCHAR AS request_id, coalesce(r.n, 0) AS raw_findings, coalesce(g.n, 0) AS after_dedup, coalesce(g.n, 0) > 200 AS truncated FROM documents LEFT JOIN r ON r.request_id = doc_id::VARCHAR LEFT JOIN g ON g.request_id = doc_id::VARCHAR")
def request_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"))
    raw = detect.rule_findings(document_lines(spark, sf_dir))
    f = detect.short_circuit(detect.dedup(raw))
    return stats.request_stats(docs, raw, f, f).select("request_id", "raw_findings", "after_dedup", "truncated")


@query("WITH e AS (SELECT user_id::VARCHAR AS request_id, 'd' || (event_id % 3)::VARCHAR AS detector, event_type AS error FROM events) SELECT request_id, count(*) AS n, string_agg(detector || ': ' || error, '; ' ORDER BY detector, error) AS summary FROM e GROUP BY request_id")
def detector_error_list(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("request_id"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("detector"), F.col("event_type").alias("error"))
    return stats.error_list(e).select("request_id", F.size("errors").cast("long").alias("n"), "summary")


_BOUNDS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 48.0]


@query("SELECT l_returnflag AS stage, le, count(*) FILTER (l_quantity <= bound) AS n, sum(l_quantity) AS sum FROM lineitem, (VALUES ('1', 1.0), ('2', 2.0), ('4', 4.0), ('8', 8.0), ('16', 16.0), ('32', 32.0), ('48', 48.0), ('+Inf', 1e308)) b(le, bound) GROUP BY ALL")
def histogram_buckets(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("stage"), "l_quantity")
    return stats.histogram(x, "l_quantity", _BOUNDS, "stage")


@query("SELECT event_type AS stage, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "stage")
    low, high = stats.middles()
    r = stats.ranked(x, "value", "stage", {"p50": stats.nearest(0.5), "p95": stats.nearest(0.95), "longest": F.col("n") - 1, "low": low, "high": high})
    return r.select("stage", "n", "p50", "p95", "longest", ((F.col("low") + F.col("high")) / 2).alias("median"))


@query("WITH a AS (SELECT event_type, list_sort(list(value)) AS xs FROM events GROUP BY 1) SELECT event_type, xs[len(xs) // 2 + 1] AS median, xs[least(len(xs) - 1, floor(len(xs) * 0.95)::BIGINT) + 1] AS p95 FROM a")
def bench_stats(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stats.ranked(x, "value", "event_type", {"median": stats.bench_median(), "p95": stats.bench_p95()}).drop("n")


_FIXTURES = "x AS (SELECT o_orderkey AS fixture, [o_orderpriority, o_orderstatus] AS tags, o_orderkey % 3 AS hits, 2 AS total FROM orders)"


@query(f"WITH {_FIXTURES}, t AS (SELECT unnest(tags) AS tag, hits, total FROM x UNION ALL SELECT '*', hits, total FROM x) SELECT tag, sum(hits)::BIGINT AS hits, sum(total)::BIGINT AS total, sum(hits)::DOUBLE / sum(total) AS agreement FROM t GROUP BY tag")
def tag_agreement(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fixture"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), (F.col("o_orderkey") % 3).alias("hits"), F.lit(2).cast("long").alias("total"))
    return stats.agreement(x)


@query("SELECT o_custkey AS pair, count(*) FILTER (o_orderkey % 2 = 0) AS positives, count(*) FILTER (o_orderkey % 2 <> 0) AS negatives, count(*) FILTER (o_orderkey % 2 = 0) = 1 AND count(*) FILTER (o_orderkey % 2 <> 0) = 1 AS complete FROM orders GROUP BY 1")
def pair_completeness(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, "positive").otherwise("negative").alias("polarity"))
    return stats.pair_completeness(x)


@query(f"WITH {DOC_LINES}, {MATCHES}, {DEDUP}, v AS (SELECT *, request_id::BIGINT % 2 = 0 AS sure FROM f), e AS (SELECT DISTINCT request_id, path, line FROM f) SELECT count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.request_id = e.request_id AND v.path = e.path AND v.line = e.line AND (sure OR v.request_id::BIGINT % 3 = 0))) AS met FROM e")
def secret_recall_semi_join(spark, sf_dir):
    f = findings(spark, sf_dir)
    expected = f.select("request_id", "path", "line", F.lit("credential").alias("kind")).distinct()
    verdicts = f.withColumn("verdict", F.when(F.col("request_id").cast("long") % 2 == 0, "confirmed").otherwise("dismissed"))
    found = f.where("cast(request_id AS bigint) % 3 = 0").withColumn("kind", F.lit("credential"))
    met = stats.secret_recall(expected, verdicts, found).agg(F.count("*").alias("met"))
    return expected.agg(F.count("*").alias("expected")).withColumn("k", F.lit(1)).join(met.withColumn("k", F.lit(1)), "k").select("expected", "met")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) AS rate FROM events GROUP BY 1")
def audit_rate_5m(spark, sf_dir):
    return stats.rates_by_window(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", F.col("event_type") == "purchase", 5)


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'only_left' WHEN o_orderkey % 11 = 0 THEN 'only_right' WHEN o_orderkey % 5 = 0 THEN 'differs' ELSE 'equal' END AS status FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)")
def run_comparison(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    a = o.where("NOT (k % 11 = 0)")
    b = o.where("NOT (k % 7 = 0)").withColumn("v", F.when(F.col("k") % 5 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return stats.run_comparison(a, b, ["k"], "v")


@query("(SELECT c_nationkey AS k, 'left' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL (SELECT s_nationkey, 'right' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer))")
def set_difference(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"))
    return stats.differences(a, spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("k")))


@query("SELECT event_id, CASE WHEN regexp_full_match(trim(given), '[A-Za-z0-9_.:-]{1,128}') THEN trim(given) END AS request_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_type || '-' || event_id::VARCHAR || ' ' WHEN 1 THEN event_type || ' x' WHEN 2 THEN repeat('a', 130) ELSE event_type END AS given FROM events)")
def request_ids(spark, sf_dir):
    k = F.col("event_id") % 4
    given = F.when(k == 0, F.concat(F.lit(" "), "event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(" "))).when(k == 1, F.concat("event_type", F.lit(" x"))).when(k == 2, F.repeat(F.lit("a"), F.lit(130))).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", readers.request_id(given).alias("request_id"))
