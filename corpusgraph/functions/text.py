"""Column functions for text: cleaning, tokens, names, evidence, grams.

Null in, empty out, unless said otherwise.  Patterns name their characters, so
that the same pattern means the same in every engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and word lists of the text rules.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
BROKEN = r"\x{FFFD}|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
CJK = r"\x{4E00}-\x{9FFF}"
_TOKEN = re.compile("[a-z0-9]+|[\u4e00-\u9fff]").findall
NUMERALS = "一二三四五六七八九十百千"
EDGE_MARKS = " ：:，,。；;、-—"
NOISE = (
    r"^(?:目录|前言|序言|绪论(?:/前言)?|出版说明|编者的话|内容提要|参考文献|练习题|思考题|本章小结|关键词|[cC][oO][nN][tT][eE][nN][tT][sS]?|[pP][rR][eE][fF][aA][cC][eE])$",
    r"^第?[0-9]+页$",
    r"^[^\p{L}\p{N}]+$",
    r"(?:\.{4,}|…{2,}|·{4,})",
)
FRONT_MATTER = "前言|序言|绪论|目录|出版说明|编者的话|内容提要"
GENERIC_GRAMS = (
    "性疾", "疾病", "功能", "障碍", "细胞", "组织", "机制", "反应", "概述", "分类", "分型", "临床", "表现", "病因", "治疗",
    "诊断", "预防", "预后", "检查", "基本", "一般", "作用", "过程", "变化", "类型", "特征", "特点", "发生", "发展",
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def blank_runs(x: Column | str) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"[\s\x{A0}\x{3000}]+", " "))


def clean_text(x: Column | str) -> Column:
    """Page text without control characters, lines that hold a page number, runs of blanks and of empty lines."""
    c = F.regexp_replace(text(x), CONTROL, " ")
    c = F.replace(c, F.lit("�"), F.lit(" "))
    c = F.regexp_replace(c, r"\n[0-9]+\n", "\n")
    c = F.regexp_replace(c, r"(?m)^[0-9]+[ \t]*$", "")
    for pattern, to in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def word_tokens(x: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, and single CJK characters, in order."""
    return F.regexp_extract_all(F.lower(text(x)), F.lit(rf"[a-z0-9]+|[{CJK}]"), F.lit(0))


def slices(x: Column, size: int) -> Column:
    """All substrings of ``size`` characters; none of a shorter text."""
    n = F.length(x)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tokenize(x: Column | str) -> Column:
    """Word tokens, then pairs, triples and fours over all CJK characters of the text, gaps closed."""
    joined = F.regexp_replace(text(x), rf"[^{CJK}]+", "")
    return F.concat(word_tokens(x), *(slices(joined, k) for k in (2, 3, 4)))


def tokens_in(low: str) -> list[str]:
    """What ``tokenize`` gives, of a text in lower case, in Python."""
    words = _TOKEN(low)
    run = "" if low.isascii() else "".join(w for w in words if w[0] > "z")
    return words + [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]


def normalize_evidence(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(x), r"[\s\x{A0}\x{3000}]+", ""))


def has_broken_text(x: Column | str) -> Column:
    return text(x).rlike(BROKEN)


def normalize_name(x: Column | str) -> Column:
    """Lower case, without what stands in brackets, CJK and ASCII letters and digits only."""
    c = F.regexp_replace(F.lower(F.trim(text(x))), r"[（(][^)）]*[)）]", "")
    return F.regexp_replace(c, rf"[^{CJK}a-z0-9]+", "")


def clean_concept_name(x: Column | str) -> Column:
    """A heading without its number, and without what follows leader dots."""
    c = blank_runs(x)
    c = F.regexp_replace(c, rf"^第[{NUMERALS}0-9]+章 *", "")
    c = F.regexp_replace(c, r"^(?:第[一二三四五六七八九十0-9]+节|[一二三四五六七八九十]+[、.)．]|[0-9]+[、.)．]) *", "")
    c = F.regexp_replace(c, r"(?s)(?:\.{4,}|…{2,}|·{4,}).*$", "")
    return F.btrim(c, F.lit(EDGE_MARKS))


def ngrams(x: Column | str, size: int = 2) -> Column:
    """The distinct grams of the normalised name; a short one is its own gram, an empty one has none."""
    c = normalize_name(x)
    none = F.array().cast("array<string>")
    return F.when(c == "", none).when(F.length(c) <= size, F.array(c)).otherwise(F.array_distinct(slices(c, size)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def quote_exists(quote: Column | str, source: Column | str) -> Column:
    """Whether at least eight characters of evidence, white space and case aside, stand in the source."""
    q = normalize_evidence(quote)
    return (F.length(q) >= 8) & normalize_evidence(source).contains(q)


def is_front_matter(x: Column | str) -> Column:
    c = F.regexp_replace(F.btrim(blank_runs(x), F.lit(EDGE_MARKS)), rf"^第[{NUMERALS}0-9１２３４５６７８９０]+章 *", "")
    return c.rlike(FRONT_MATTER)


def title_of_file(x: Column | str) -> Column:
    """A file's stem without leading numbers and marks."""
    stem = F.regexp_replace(F.regexp_replace(text(x), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^[0-9]+[ _.\-]*", "")


def numeral(x: Column | str) -> Column:
    """Digits, or Chinese numerals up to ninety-nine, as an integer; null for anything else."""
    digits = "一二三四五六七八九"
    c = text(x)
    value = lambda s: F.when(s == "", 0).otherwise(F.instr(F.lit(digits), s))
    tens, ones = F.regexp_extract(c, "^([一二三四五六七八九]?)十", 1), F.regexp_extract(c, "([一二三四五六七八九]?)$", 1)
    return (
        F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
        .when(c.rlike("^[一二三四五六七八九]$"), value(c))
        .when(c.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), F.when(tens == "", 1).otherwise(value(tens)) * 10 + value(ones))
    ).cast("int")


def excerpt(x: Column | str, size: int = 320) -> Column:
    """The first sentence that has at least twenty characters, at most ``size`` of it; else the beginning."""
    c = blank_runs(x)
    first = F.regexp_extract(c, r"([^。！？!?.;；]{20,}[。！？!?.;；]?)", 1)
    return F.substring(F.trim(F.when(first != "", first).otherwise(c)), 1, size)


def title_aliases(x: Column | str, prefixes: tuple[str, ...] = ("医学", "局部")) -> Column:
    """A title in lower case without white space; without a known prefix; and its parts of three characters and more at 与."""
    c = F.lower(F.regexp_replace(text(x), r"[\s\x{A0}\x{3000}]+", ""))
    bare = [F.when(c.startswith(p) & (F.length(c) > len(p)), F.substring(c, len(p) + 1, 1 << 20)) for p in prefixes]
    parts = F.when(c.contains("与"), F.filter(F.split(c, "与"), lambda a: F.length(a) >= 3)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.array_compact(F.concat(F.array(c, *bare), parts))), lambda a: a != "")


def escape_markdown(x: Column | str) -> Column:
    return F.regexp_replace(text(x), r"([\\`*_{}\[\]<>#|])", r"\\$1")


def reflow(x: Column | str) -> Column:
    """Wrapped lines joined: a blank only between ASCII word characters; empty lines stay as paragraph ends."""
    c = F.regexp_replace(text(x), r"([A-Za-z0-9,.;:]) *\n *(?=[A-Za-z0-9])", "$1 ")
    return F.regexp_replace(c, r"(?<!\n) *\n *(?!\n)", "")


def figure_labels(x: Column | str) -> Column:
    """Figure labels such as 图 3-2, as 3-2, each once."""
    found = F.regexp_extract_all(text(x), F.lit(r"图[ \t]*([0-9]+[-－–][0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda f: F.regexp_replace(f, "[－–]", "-")))


def color_index(x: Column | str, colors: int = 6) -> Column:
    """A stable colour of a name: the rolling hash with factor 31 over 32 bits, modulo ``colors``."""
    codes = F.transform(F.filter(F.split(text(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))), F.lit(colors)).cast("int")


def json_object(x: Column | str, schema: str) -> Column:
    """A struct parsed from model output: the text without a code fence, else its largest {...}; null if neither parses."""
    bare = F.regexp_replace(F.trim(text(x)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    lenient = {"mode": "PERMISSIVE"}
    whole = F.from_json(F.when(bare.startswith("{"), bare), schema, lenient)
    part = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema, lenient)
    return F.coalesce(whole, part)
