import pytest
from pyspark.sql import functions as F

from heronry.functions import expr as x


def values(spark, f, *given, kind="string"):
    df = spark.createDataFrame([(v,) for v in given], f"c {kind}")
    return [r[0] for r in df.select(f(F.col("c")).alias("o")).collect()]


def test_utc_is_range_checked_not_calendar_checked(spark):
    given = ("2021-02-30 00:00:00 UTC", "2021-13-01 00:00:00 UTC", "2021-02-03 04:05:06 GMT", "", None, "2021-02-03 04:05:06 UTC\n")
    assert values(spark, lambda c: x.stamp_text(x.parse_utc(c)), *given) == [given[0], None, None, None, None, None]
    assert values(spark, lambda c: x.to_moment(x.parse_utc(c)).cast("string"), given[0], "2021-02-03 04:05:06 UTC") == [None, "2021-02-03 04:05:06"]


def test_epoch_floors_and_is_absent_at_zero(spark):
    got = values(spark, lambda c: x.stamp_text(x.epoch_stamp(c)), -1, 999, None, 2005949145600000, kind="long")
    assert got == ["1969-12-31 23:59:59 UTC", "1970-01-01 00:00:00 UTC", None, None]
    assert values(spark, x.opt_epoch, 0, -1, kind="long") == [None, -1]


def test_location(spark):
    got = values(spark, x.split_location, "Latitude, Longitude: 91.0, 0.0", "latitude, longitude: 1.5, -3", "Paris", "", "Latitude, Longitude: 1", None)
    assert [r.bad for r in got] == [True, False, False, False, True, False]
    assert got[1].point == (1.5, -3.0) and got[2].place == "Paris" and got[3].place is None


def test_numbers_of_a_location(spark):
    label = "Latitude, Longitude:"
    got = values(spark, x.split_location, label + "\u3000 .5\n,\t5.\u2028", label + "1 2, 3", label + "1, 2, 3", label + "1e999, 0", label + "+90.0,-180", label + " ,1", label + "9" * 3000)
    assert [r.bad for r in got] == [False, True, True, True, False, True, True]
    assert got[0].point == (0.5, 5.0) and got[4].point == (90.0, -180.0)


def test_error_texts_lose_their_values(spark):
    assert values(spark, x.strip_delimited, 'a "b\\"c" d `e` f "open', "x `y") == ['a "…" d `…` f "…', "x `…"]


def test_memory_and_chat_names(spark):
    name = "a/2020-01-02_abcdefgh-1234-abcd-ABCD-abcdefgh1234-main.jpg"
    got = values(spark, x.parse_memory_name, name, "2020-01-02_x-main.jpg", "2020-13-02_abcdefgh-1234-abcd-ABCD-abcdefgh1234-main.jpg", "memories.html")
    assert got[0].uuid == "abcdefgh-1234-abcd-ABCD-abcdefgh1234" and got[0].role == "main" and got[1:] == [None] * 3
    got = values(spark, x.parse_chat_name, "2020-01-02_B~abc.jpg", "2020-01-02_media~zip-123.zip.h4sh.mp4", "2020-01-02_other~a.jpg", "2020-01-02_b~a.b.jpg")
    assert (got[0].id, got[0].family) == ("b~abc", "plain") and (got[1].id, got[1].family) == ("2020-01-02_zip-123.zip.h4sh", "zip") and got[2:] == [None, None]


def test_parts(spark):
    got = values(spark, x.parse_part, "mydata~123", "mydata~123-2", "mydata~123-1", "mydata~-2", "mydata~", "mydata~1-02", "x")
    assert [r and tuple(r) for r in got] == [("123", 1), ("123", 2), ("123-1", 1), None, None, ("1-02", 1), None]


def test_directory_names(spark):
    assert values(spark, x.dir_name, "a/b", "..", "con.txt", "é" * 3, "", "." + "a" * 80, "Nul") == ["a_b", "_unnamed", "_con.txt", "___", "_unnamed", "a" * 63, "_Nul"]


def test_paths(spark):
    assert values(spark, x.is_unsafe_path, "a/b", "../a", "a/../../b", "/x", "c:\\x", "a/C:/x", "a/../b", "") == [False, True, True, True, True, True, False, True]
    assert values(spark, x.normalize_path, "/a//b/./c/../d", "../x/../y", "/../a") == ["/a/b/d", "../y", "/a"]


def test_csv_and_html(spark):
    assert values(spark, x.csv_field, "=1", "a,b", 'q"q', "-x\ny", "plain") == ["'=1", '"a,b"', '"q""q"', '"\'-x\ny"', "plain"]
    assert values(spark, x.html_escape, "<a href='x'>&\"") == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]


def test_bounds_and_sizes(spark):
    assert values(spark, lambda c: x.bound_bytes(c, 5), "ééé", "abcdefgh", "ab", None) == ["éé", "abcde", "ab", None]
    assert values(spark, x.binary_bytes, 1023, 1024, 1048576 - 1, 1 << 60, kind="long") == ["1023 B", "1.0 KiB", "1.0 MiB", "1024.0 PiB"]


def test_notes(spark):
    got = values(spark, lambda c: x.redact_note(c, F.lit("https://h/AbCdEfGhIjKl99?x")), "see  https://x ok\tAbCdEfGhIjKl99z b@c fine", None)
    assert got == ["see  <redacted> ok\t<redacted> <redacted> fine", None]


def test_offsets(spark):
    assert values(spark, x.parse_offset, "+05:30", "-00:45", "+24:00", "05:30") == [19800, -2700, None, None]
    assert values(spark, x.format_offset, 19800, -2700, kind="int") == ["+05:30", "-00:45"]


def test_tokens(spark):
    assert values(spark, x.media_tokens, " b~1 | |B~2|x ") == [["b~1", "B~2", "x"]]
    assert values(spark, x.history_token, "B~aB1", "b~", "c~1", None) == ["b~aB1", None, None, None]


def test_ages(spark):
    now = F.lit("2021-03-31 00:00:00").cast("timestamp")
    given = ("2021-03-30 23:59:30 UTC", "2021-03-30 23:30:00 UTC", "2021-03-30 03:00:00 UTC", "2021-03-27 00:00:00 UTC", "2021-03-10 00:00:00 UTC", "2022-01-01 00:00:00 UTC")
    assert values(spark, lambda c: x.age_text(x.parse_utc(c), now), *given) == ["now", "30m ago", "21h ago", "4d ago", "3w ago", "2022-01-01"]


@pytest.mark.parametrize("word, kind", [("image", "image"), ("Video", "video"), ("TEXT", "unknown"), ("other", "unknown")])
def test_kinds(spark, word, kind):
    assert values(spark, x.kind_of_word, word) == [kind]
