"""Unified diffs as relations: lines, added blocks, the post-image, hunk checks.

The line scanner's state (path, line number, block) is a set of running windows over (request_id ORDER BY ord), so one
exchange on request_id serves every operator here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_LINE_BYTES = 1 << 20


def split_lines(text: Column) -> Column:
    """Lines without their ends; no last empty line after a final newline."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))


def text_lines(docs: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """Each text as a file of added lines: request_id, path, line, text."""
    return docs.select(F.col(key).cast("string").alias("request_id"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("path"), F.posexplode(split_lines(F.coalesce(F.col(text), F.lit("")))).alias("ord", "text")).select(
        "request_id", "path", (F.col("ord") + 1).alias("line"), "text"
    )


def parsed_path(line: Column) -> Column:
    p = F.trim(F.substring(line, 5, 1 << 30))
    return F.when(p == "/dev/null", F.lit("")).otherwise(F.regexp_replace(p, "^b/", ""))


def hunk_start(line: Column) -> Column:
    """The number after the first plus sign, up to a comma or blank; 0 if malformed."""
    return F.coalesce(F.regexp_extract(line, r"^[^+]*[+]([+-]?[0-9]+)[, ]", 1).try_cast("int"), F.lit(0))


def diff_lines(diffs: DataFrame, max_line_bytes: int | None = MAX_LINE_BYTES) -> DataFrame:
    """request_id, ord, kind, path, line, text, blk for each line of each diff.

    kind: git, path, old, hunk, note, add, del, ctx or bare. line is the post-image number of add, ctx and counted bare
    lines. blk numbers added blocks. A line over ``max_line_bytes`` ends its diff, as a scanner with that buffer does.
    """
    x = diffs.select("request_id", F.posexplode(split_lines(F.col("diff"))).alias("ord", "raw"))
    w = Window.partitionBy("request_id").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if max_line_bytes:
        x = x.withColumn("cut", F.max((F.octet_length("raw") > max_line_bytes).cast("int")).over(upto)).where("cut = 0").drop("cut")
    r = F.col("raw")
    starts = lambda p: F.startswith(r, F.lit(p))  # noqa: E731  LIKE would read the backslash as an escape
    kind = (
        F.when(starts("diff --git "), "git").when(starts("+++ "), "path").when(starts("--- "), "old").when(starts("@@"), "hunk").when(starts("\\ "), "note")
        .when(starts("+"), "add").when(starts("-"), "del").when(starts(" "), "ctx").otherwise("bare")
    )
    x = x.withColumn("kind", kind)
    x = x.withColumn("path", F.coalesce(F.last(F.when(F.col("kind") == "git", F.lit("")).when(F.col("kind") == "path", parsed_path(r)), ignorenulls=True).over(upto), F.lit("")))
    x = x.withColumn("base", F.coalesce(F.last(F.when(F.col("kind") == "git", F.lit(0)).when(F.col("kind") == "hunk", hunk_start(r)), ignorenulls=True).over(upto), F.lit(0)))
    x = x.withColumn("seg", F.sum(F.col("kind").isin("git", "hunk").cast("long")).over(upto))
    ws = Window.partitionBy("request_id", "seg").orderBy("ord")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.sum(F.col("kind").isin("add", "ctx").cast("int")).over(before), F.lit(0))
    # an unmarked line advances only where the number is above 0: from the start of a good hunk, else after a marked line
    counts = F.when(F.col("kind").isin("add", "ctx"), 1).when((F.col("kind") == "bare") & ((F.col("base") > 0) | (sure > 0)), 1).otherwise(0)
    x = x.withColumn("adv", counts)
    x = x.withColumn("line", F.col("base") + F.coalesce(F.sum("adv").over(before), F.lit(0)))
    x = x.withColumn("blk", F.sum(F.col("kind").isin("git", "path", "hunk", "ctx", "bare").cast("long")).over(upto))
    text = F.when(F.col("kind").isin("add", "ctx"), F.substring(r, 2, 1 << 30)).otherwise(r)
    return x.select("request_id", "ord", "kind", "path", F.col("line").cast("int").alias("line"), text.alias("text"), "blk")


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'add' AND path <> ''")


def added_blocks(lines: DataFrame) -> DataFrame:
    """request_id, blk, path, start_line, content: runs of added lines, removed lines between them ignored."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "line", "path", "text")))
    b = added_lines(lines).groupBy("request_id", "blk").agg(rows.alias("r"))
    return b.select("request_id", "blk", F.col("r")[0]["path"].alias("path"), F.col("r")[0]["line"].alias("start_line"), F.concat_ws("\n", F.col("r.text")).alias("content"))


def post_image(lines: DataFrame) -> DataFrame:
    """request_id, path, line, text of the new files as far as the diff shows them; a later line of one number wins."""
    seen = lines.where("kind IN ('add', 'ctx', 'bare') AND path <> '' AND line > 0")
    return seen.groupBy("request_id", "path", "line").agg(F.max_by("text", "ord").alias("text"))


def added_line_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("request_id").agg(F.count_if((F.col("kind") == "add") & (F.col("path") != "")).alias("added_lines"))


def hunk_check(lines_with_raw: DataFrame) -> DataFrame:
    """request_id, hunk, old_lines, new_lines, ok: each hunk's lines against the counts of its header."""
    w = Window.partitionBy("request_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = lines_with_raw.withColumn("hunk", F.sum((F.col("kind") == "hunk").cast("long")).over(w)).withColumn("file", F.sum((F.col("kind") == "git").cast("long")).over(w))
    head = r"^@@ -[0-9]+(?:,([0-9]+))? \+[0-9]+(?:,([0-9]+))? @@"
    size = lambda g: F.when(F.regexp_extract("text", head, g) == "", F.lit(1)).otherwise(F.regexp_extract("text", head, g).cast("int"))
    g = x.where("hunk > 0").groupBy("request_id", "hunk").agg(
        F.max(F.when(F.col("kind") == "hunk", size(1))).alias("want_old"),
        F.max(F.when(F.col("kind") == "hunk", size(2))).alias("want_new"),
        F.count_if(F.col("kind").isin("del", "ctx")).alias("old_lines"),
        F.count_if(F.col("kind").isin("add", "ctx")).alias("new_lines"),
    )
    return g.select("request_id", "hunk", "old_lines", "new_lines", ((F.col("want_old") == F.col("old_lines")) & (F.col("want_new") == F.col("new_lines"))).alias("ok"))
