from leaklens.operators import diff


def lines(spark, text, **kw):
    df = spark.createDataFrame([("r", text)], "request_id string, diff string")
    return diff.diff_lines(df, **kw)


def added(spark, text):
    return [(r.path, r.line, r.text) for r in diff.added_lines(lines(spark, text)).orderBy("ord").collect()]


def test_numbers_run_on_over_removed_lines(spark):
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +10,4 @@\n keep\n+one\n-old\n+two\n+three\n"
    assert added(spark, d) == [("x", 11, "one"), ("x", 12, "two"), ("x", 13, "three")]
    blocks = diff.added_blocks(lines(spark, d)).collect()
    assert [(b.start_line, b.content) for b in blocks] == [(11, "one\ntwo\nthree")]


def test_deleted_files_and_lines_without_a_path_are_dropped(spark):
    d = "+stray\ndiff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n+odd\ndiff --git a/y b/y\n+++ b/y\n@@ -0,0 +1 @@\n+kept\n"
    assert added(spark, d) == [("y", 1, "kept")]


def test_an_added_line_that_looks_like_a_header_changes_the_path(spark):
    d = "diff --git a/x b/x\n+++ b/x\n@@ -0,0 +1,3 @@\n+a\n+++ b/z\n+b\n"
    assert added(spark, d) == [("x", 1, "a"), ("z", 2, "b")]


def test_carriage_returns_bad_headers_and_notes(spark):
    d = "diff --git a/x b/x\r\n+++ b/x\r\n@@ bad @@\r\n+a\r\n\\ No newline at end of file\r\n+b"
    assert added(spark, d) == [("x", 0, "a"), ("x", 1, "b")]


def test_an_over_long_line_ends_the_diff(spark):
    d = "diff --git a/x b/x\n+++ b/x\n@@ -0,0 +1,3 @@\n+a\n+" + "z" * 200 + "\n+b\n"
    got = diff.added_lines(lines(spark, d, max_line_bytes=100)).orderBy("ord").collect()
    assert [r.text for r in got] == ["a"]


def test_post_image_keeps_the_last_of_one_number(spark):
    d = "diff --git a/x b/x\n+++ b/x\n@@ -1 +1,2 @@\n a\n+b\n@@ -1 +2 @@\n+c\n"
    assert sorted((r.line, r.text) for r in diff.post_image(lines(spark, d)).collect()) == [(1, "a"), (2, "c")]


def test_hunk_counts(spark):
    d = "diff --git a/x b/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n@@ -9 +9,2 @@\n+only\n"
    assert [(r.hunk, r.ok) for r in diff.hunk_check(lines(spark, d)).orderBy("hunk").collect()] == [(1, True), (2, False)]
