"""What line templates and near copies compute for each text: the same lines and windows as plain versions, each counted once."""

import re

from pyspark.sql import functions as F

from foliant.llm import folding, op10_templates

ODD = [None, "", " ", "\n", "\t", "\r\n", "a", " a  b\tc", "a b c d e", "a b c d e ", "a\x0bb\x0cc\rd\ne\n\nf", "é ü  ß x 漢字  y z", "x " * 30, "\x1ca \x1fb c d e f", "a\r\nb c d\te 9 f7 g"]
SPACE = r"[\x20\x09-\x0D]+"


def plain_windows(text):
    w = [x for x in re.split(SPACE, text or "") if x]
    return [" ".join(w[i : i + folding.SHINGLE]) for i in range(max(len(w) - folding.SHINGLE + 1, min(len(w), 1)))]


def plain_lines(text):
    lines = [[w for w in re.split(SPACE, x) if w] for x in (text or "").split("\n")]
    return [(len(w), " ".join("<*>" if re.search("[0-9]", x) else x for x in w[: op10_templates.LEADING])) for w in lines if w]


def test_windows_and_lines_of_odd_texts(spark):
    windows = [list(dict.fromkeys(plain_windows(t))) for t in ODD]
    df = spark.createDataFrame(list(zip(range(len(ODD)), ODD, windows, [plain_lines(t) for t in ODD], strict=True)), "i int, text string, windows array<string>, lines array<struct<n:int,path:string>>")
    text = F.coalesce("text", F.lit(""))
    leaves = F.transform(F.filter(op10_templates.line_leaves(text), lambda x: x.isNotNull()), lambda x: F.struct(x["n"], x["leaf"]))
    same = (
        (folding.window_set(F.col("text")) == F.transform("windows", lambda w: F.xxhash64(w)))
        & (leaves == F.transform("lines", lambda x: F.struct(x["n"], F.xxhash64(x["n"], x["path"]))))
        & (F.size(op10_templates.lines_with_tokens(text)) == F.size("lines"))
    )
    assert [ODD[r.i] for r in df.where(~same | same.isNull()).collect()] == []


def test_no_search_at_each_character(spark, capsys):
    """Windows are cut by no regular expression, and a line's tokens are counted once, not once for the count and once for the leaf."""
    df = spark.createDataFrame([("a",)], "text string")
    df.select(folding.window_set(F.col("text")).alias("out")).explain()
    assert "regexp" not in capsys.readouterr().out
    df.select(op10_templates.line_leaves(F.col("text")).alias("out")).explain()
    plan = capsys.readouterr().out
    assert plan.count("array_remove(") == 1 and not re.search(r"(?<!regexp_)replace\(", plan)
