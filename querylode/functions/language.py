"""Notes and reasons in English or Chinese. What the engine says is English; a table of phrases has the rest."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASES = (
    ("needs a catalog to know existing indexes", "需要表结构才能知道已有索引"),
    ("no Rows_examined in this input (slow log only)", "此输入没有扫描行数（仅慢日志有）"),
    ("the OFFSET is a bound parameter, so its size is not visible statically", "OFFSET 是绑定参数，静态分析看不到大小"),
    ("statement failed to parse", "语句无法解析"),
    ("several statements arrived merged (no ';' between them); not analysed", "多条语句粘连（缺少分号），未分析"),
    ("no table could be identified", "找不到表"),
    ("several statements without ; between them", "多条语句粘连，缺少分号"),
    ("the statement could not be parsed", "语句无法解析"),
    ("empty statement", "空语句"),
    ("inserts get no index advice", "插入语句不给索引建议"),
    ("only the first branch of a set operation is analysed", "集合运算只分析第一个分支"),
    ("statements are not analysed", "语句不分析"),
    ("a condition has OR between different columns", "条件在不同列之间使用 OR"),
    ("a derived table is analysed as a statement of its own", "派生表作为单独语句分析"),
    ("a part of the statement is built at run time (${})", "语句有一部分在运行时拼接（${}）"),
    ("is left out, its content kept", "被忽略，内容保留"),
    ("variants: the first are analysed", "个变体：只分析前面的"),
    ("is not in this file", "不在此文件中"),
    ("is left out", "被忽略"),
    ("an expression in", "表达式位于"),
    ("more than", "超过"),
    ("fragment", "片段"),
)


def resolve_lang(flag: str | None = None, environment: Mapping[str, str] | None = None) -> str:
    """zh or en: the flag's, else that of the environment."""
    environment = os.environ if environment is None else environment
    told = flag or environment.get("LC_ALL") or environment.get("LANG") or ""
    return "zh" if told.lower().startswith("zh") else "en"


def translated(text: Column | str, lang: str) -> Column:
    """The text in a language; phrases that the table doesn't have stay as they are."""
    text = F.col(text) if isinstance(text, str) else text
    for english, chinese in PHRASES if lang == "zh" else ():
        text = F.replace(text, F.lit(english), F.lit(chinese))
    return text
