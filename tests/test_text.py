"""Text functions on hand rows, Chinese ones included."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as T


def value(spark, make, *args):
    frame = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return frame.select(make(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).first().v


@pytest.mark.parametrize(("make", "arg", "want"), [
    (T.clean_text, "a\x08b�c\n12\nd  \t e\n\n\n\nf\n7 ", "a b c\nd e\n\nf"),
    (T.clean_text, None, ""),
    (T.tokenize, "Cell细胞 x膜9", ["cell", "细", "胞", "x", "膜", "9", "细胞", "胞膜", "细胞膜"]),
    (T.tokenize, "", []),
    (T.tokenize, "肝", ["肝"]),
    (T.normalize_evidence, " A b　C\n", "abc"),
    (T.has_broken_text, "a�", True),
    (T.has_broken_text, "a\nb", False),
    (T.normalize_name, " 细胞（Cell） Wall-2 ", "细胞wall2"),
    (T.clean_concept_name, "第三章  细胞损伤......12", "细胞损伤"),
    (T.clean_concept_name, "二、炎症：", "炎症"),
    (T.ngrams, "ab", ["ab"]), (T.ngrams, "abc", ["ab", "bc"]), (T.ngrams, "", []), (T.ngrams, "aaaa", ["aa"]),
    (T.title_of_file, "/data/03_病理学.pdf", "病理学"),
    (T.numeral, "二十三", 23), (T.numeral, "十", 10), (T.numeral, "十五", 15), (T.numeral, "7", 7), (T.numeral, "九", 9), (T.numeral, "x", None), (T.numeral, "四十", 40),
    (T.title_aliases, "医学免疫 与微生物", ["医学免疫与微生物", "免疫与微生物", "医学免疫", "微生物"]),
    (T.escape_markdown, "a*b_[c]", r"a\*b\_\[c\]"),
    (T.reflow, "wrapped\nline 断\n行\n\nnext", "wrapped line 断行\n\nnext"),
    (T.figure_labels, "见图 3－2 和图3-2、图 4-1", ["3-2", "4-1"]),
    (T.is_front_matter, "第一章 绪论", True), (T.is_front_matter, "细胞", False),
])
def test_values(spark, make, arg, want):
    assert value(spark, make, arg) == want


def test_quotes_similarity_and_json(spark):
    assert value(spark, T.quote_exists, "the Quick b", "see THE quick\nbrown") is True
    assert value(spark, T.quote_exists, "short", "short") is False
    assert value(spark, lambda a, b: T.jaccard(T.ngrams(a), T.ngrams(b)), "abcd", "bcde") == 0.5
    assert value(spark, lambda a, b: T.jaccard(T.ngrams(a), T.ngrams(b)), "", None) == 0.0
    parse = lambda c: T.json_object(c, "name string, n int")
    assert tuple(value(spark, parse, '```json\n{"name": "x", "n": 2}\n```')) == ("x", 2)
    assert tuple(value(spark, parse, 'Sure: {"name": "y"} done')) == ("y", None)


def test_color_index(spark):
    h = 0
    for c in "病理 A":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert value(spark, T.color_index, "病理 A") == h % 6
