"""Tables of id patterns against LIKE, pattern by pattern."""

import random
import re

import pytest

from wellspark.operators.ids import match_pattern_table


def like(text, pattern, ignore_case=False):
    wild = {"%": ".*", "_": "."}
    flags = re.S | (re.I if ignore_case else 0)
    return re.fullmatch("".join(wild.get(c) or re.escape(c) for c in pattern), text, flags) is not None


IDS = ["", "a", "B", "\\", "a\\b", "a%b", "x_y", "05001", "0500100001", "05001000019999", "é🎉", "🎉", "a\nb", None, "12345678901234567890", "12345678901234567", "0500100001"]
# Each tried alone: a table with "%" would match all.
ALONE = [("%", False), ("__", False), ("___%", False), ("%\\%", False), ("A_b", True), ("%\\%", True), (None, False)]
TOGETHER = ["", "a%b", "%b", "\\", "a\\%", "%1000%", "%00%9_", "%901234567", "1%0", "_🎉", "a\nb", "12345678901234567%", None, "'%"]


@pytest.mark.parametrize("patterns, ignore_case", [([p], i) for p, i in ALONE] + [(TOGETHER, False)])
def test_patterns_equal_like(spark, patterns, ignore_case):
    ids = spark.createDataFrame([(i, t, "x") for i, t in enumerate(IDS)], "n int, id string, pattern string").coalesce(1)
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string").coalesce(1)
    got = sorted(r.n for r in match_pattern_table(ids, "id", table, ignore_case=ignore_case).collect())
    assert got == [i for i, t in enumerate(IDS) if t is not None and any(p is not None and like(t, p, ignore_case) for p in patterns)]


def test_many_patterns_together_equal_like(spark):
    draw = random.Random(4)
    ids = ["".join(draw.choices("0012", k=draw.randrange(12))) for _ in range(400)]
    patterns = ["".join(draw.choices("0012%_", k=draw.randrange(5, 12))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(ids)), "n int, id string")
    table = spark.createDataFrame([(p,) for p in patterns + patterns], "words string")
    got = sorted(r.n for r in match_pattern_table(frame, "id", table, "words").collect())
    want = [i for i, t in enumerate(ids) if any(like(t, p) for p in patterns)]
    assert got == want and 0 < len(want) < 400


def test_a_hundred_thousand_patterns_and_none(spark):
    ids = spark.range(20_000).selectExpr("lpad(id * 7, 14, '0') AS id")
    patterns = spark.range(100_000).selectExpr("CASE id % 3 WHEN 0 THEN concat(lpad(id, 13, '0'), '%') WHEN 1 THEN concat('%', lpad(id, 8, '0')) ELSE concat('_', lpad(id, 13, '0')) END AS pattern")
    want = 0
    for n in range(20_000):
        v = n * 7
        want += (v // 10 < 100_000 and v // 10 % 3 == 0) or (v < 100_000 and v % 3 != 0)
    assert match_pattern_table(ids, "id", patterns).count() == want
    assert match_pattern_table(ids, "id", patterns.limit(0)).count() == 0
